"""Length matching of passages and order-dependent de-duplication."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import partial_ratio, token_jaccard, token_set_ratio, token_sort_ratio
from ..functions.tokens import n_words
from .slices import map_slices
from .windows import keep_first

#: Words that a task turns into Python's at a time; a longer text stands alone.
WORDS = 50_000


def sentence_table(df: DataFrame, sentences: Column, key: str) -> DataFrame:
    """(key, i, sentence, len, upto): word counts and their running sum per text."""
    s = df.select(key, F.posexplode(sentences).alias("i", "sentence")).withColumn("len", n_words(F.col("sentence")))
    return s.withColumn("upto", F.sum("len").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))


def best_snippets(df: DataFrame, sentences: Column, key: str, target: str, low: float = 0.7, high: float = 1.3, guard: float = 1.5) -> DataFrame:
    """(key, first, last, n): the run of sentences whose word count is nearest to the target.

    Runs within the tolerance come first, the smallest difference wins, then the
    earliest; else the single sentence nearest to the target. A result over the guard or under
    half the target is none. Buckets of the running sums bound the self join to runs within the tolerance.
    """
    from ..sources.files import materialize

    # Lengths only, written once: texts are cut to sentences a single time.
    held = df.select(key, F.col(target).alias("__t"), sentences.alias("__s"))
    each = held.select(key, "__t", F.posexplode(F.transform("__s", n_words)).alias("i", "len"))
    upto = F.sum("len").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    s = materialize(each.withColumn("upto", upto))
    t = s.withColumn("__w", F.floor(F.col("__t") * high) + 1)
    before = F.col("upto") - F.col("len")
    a = t.select(key, F.col("i").alias("first"), before.alias("before"), F.floor(before / F.col("__w")).alias("__b"), "__t")
    # A run is no longer than the width, so its end lies in the bucket of its start or the next one.
    ends = F.explode(F.array(F.floor(F.col("upto") / F.col("__w")), F.floor(F.col("upto") / F.col("__w")) - 1))
    b = t.select(key, F.col("i").alias("last"), F.col("upto").alias("end"), ends.alias("__b"))
    runs = a.join(b, [key, "__b"]).withColumn("n", F.col("end") - F.col("before"))
    runs = runs.filter((F.col("last") >= F.col("first")) & (F.col("n") >= F.floor(F.col("__t") * low)) & (F.col("n") <= F.floor(F.col("__t") * high)))
    one = s.select(key, F.col("i").alias("first"), F.col("i").alias("last"), F.col("len").alias("n"), "__t")
    ranked = runs.select(key, "first", "last", "n", "__t").withColumn("stage", F.lit(1)).unionByName(one.withColumn("stage", F.lit(2)))
    best = keep_first(ranked, [key], ["stage", F.abs(F.col("n") - F.col("__t")), "first", "last"])
    fits = (F.col("n") <= F.floor(F.col("__t") * guard) + 1) & (F.col("n") >= F.col("__t") * 0.5)
    return best.filter(fits).select(key, "first", "last", "n")


def near_sentences(df: DataFrame, sentences: str, key: str, quotes: DataFrame, quote: str, tokens: Callable[[Column], Column], least: float) -> DataFrame:
    """(key, dropped): sentences whose words and those of some quote have a Jaccard index of ``least`` or more.

    Sets that near share ceil(least x size) words, so the quote's words beyond its
    ceil(least x size) - 1 most frequent ones are enough as blocks: no match is lost.
    """
    q = quotes.select(F.array_distinct(tokens(F.col(quote))).alias("v")).distinct().filter("size(v) > 0").withColumn("q", F.monotonically_increasing_id())
    often = q.select("q", "v", F.explode("v").alias("w"))
    often = often.join(often.groupBy("w").agg(F.count("*").alias("c")), "w")
    order = often.groupBy("q", "v").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("o"))
    kept = F.size("v") - F.ceil(F.size("v") * least).cast("int") + 1
    blocks = order.select("v", F.explode(F.slice("o", F.lit(1), kept)).alias("b")).select("v", F.col("b.w").alias("w"))
    s = df.select(key, F.posexplode(F.transform(sentences, lambda x: F.array_distinct(tokens(x)))).alias("i", "u"))
    hits = s.select(key, "i", "u", F.explode("u").alias("w")).join(blocks, "w")
    fits = (F.size("u") >= F.size("v") * least) & (F.size("v") >= F.size("u") * least)
    return hits.filter(fits).filter(token_jaccard(F.col("u"), F.col("v")) >= least).select(key, "i").distinct().groupBy(key).agg(F.count("*").alias("dropped"))


def without_quote(sentences: Column, text: Column, quote: Column, least: float = 65, least_set: float = 70) -> Column:
    """The sentences that stay: where the text has the quote, by its partial ratio, those whose token-set ratio to the quote is ``least_set`` or more go. Without a quote all stay."""

    # Scores are rounded: the least ones that round to what is asked.
    low, low_set = max(math.ceil(least) - 0.5, 1e-9), math.ceil(least_set) - 0.5

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keep(sentences: pd.Series, text: pd.Series, quote: pd.Series) -> pd.Series:
        def one(own, t, q):
            if own is None or not t or not q or partial_ratio(t, q, low) < low:
                return own
            return [x for x in own if token_set_ratio(x, q, low_set) < low_set]

        return pd.Series([one(s, t, q) for s, t, q in zip(sentences, text, quote)])

    return keep(sentences, text, quote)


def greedy_matches(words: list[str], targets: list[int], tolerance: float = 0.1, reach: int = 500) -> list[tuple[int, int, int]]:
    """(target number, start, end) runs of words: a capital first, a stop last, lengths near the target, no word used twice."""
    out, at = [], 0
    stops = [w.endswith((".", "?", "!")) for w in words]
    capitals = [w[:1].isupper() for w in words]
    for k, target in enumerate(targets):
        if not target:
            continue
        low, high = int(target * (1 - tolerance)), int(target * (1 + tolerance))
        hit = next(
            ((s, e) for s in range(at, min(at + reach, len(words))) if capitals[s] for e in range(s + low, min(s + high, len(words) - 1) + 1) if e > s and stops[e - 1]),
            None,
        )
        if hit:
            out.append((k, *hit))
            at = hit[1]
    return out


def match_lengths(df: DataFrame, words: str, targets: str, key: str) -> DataFrame:
    """Greedy matches of each source row: (key, target_no, start, end). Order-dependent within a row, so one row is one fold."""

    def matched(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, *m) for k, w, t in zip(b[key], b[words], b[targets]) for m in greedy_matches(list(w), list(t))]
        return pd.DataFrame(rows, columns=[key, "target_no", "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(key, words, targets), words, lambda: matched, f"{key} {kind}, target_no int, start int, end int", WORDS)


def sorted_neighbour_dedupe(df: DataFrame, text: str, order: Sequence[str], key: str, block: Sequence[str], least: float = 95) -> DataFrame:
    """Rows that stay when, in order within a block, each row is dropped that is nearly the last kept one.

    The fold runs per block of neighbours, never over the whole table.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*order, key])
        kept, last = [], None
        for i, t in enumerate(p[text]):
            if last is None or t is None or token_sort_ratio(t.lower(), last.lower()) <= least:
                kept.append(i)
                last = t
        return p.iloc[kept]

    return df.groupBy(*block).applyInPandas(fold, df.schema)
