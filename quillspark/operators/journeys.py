"""Word-by-word series: surprisal, association, sentiment, shift and flow, with pluggable providers.

A provider is a table or a column expression: word vectors (word, vec), a word
polarity table, a counted background. The defaults need no model files; numbers
made with them say nothing about numbers of neural models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import cosine, squared_distance
from ..sources.files import materialize
from .pairs import chunks, own_surprisal, pair_counts
from .windows import exact_quantiles, shared_hash


#: Most words of a block, counts of words before blocks that are held, distances that are made at once, words of a run of texts.
FLOW_BLOCK, FLOW_HELD, FLOW_STEP, FLOW_WORDS = 512, 1 << 21, 1 << 17, 1_000_000


def positions(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, pos, token), positions from 0."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


# --- providers ---


def hash_vector(word: Column, dim: int = 4) -> Column:
    """A vector in (-0.5, 0.5)^dim made from hashes of the word: a stand-in that any engine can make."""
    return F.array(*[shared_hash(word, k) / F.lit(4294967296.0) - F.lit(0.5) for k in range(dim)])


def mean_vector(tokens: Column, dim: int = 4) -> Column:
    """Mean of the words' vectors, in the row."""
    vectors = F.transform(tokens, lambda w: hash_vector(w, dim))
    zero = F.array(*[F.lit(0.0)] * dim)
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens))).otherwise(zero)


def text_vectors(df: DataFrame, tokens: Column, key: str, lexicon: DataFrame, dim: int) -> DataFrame:
    """Mean vector of the words that a lexicon (word, vec) knows; the zero vector if it knows none."""
    known = positions(df, tokens, key).join(lexicon, F.col("token") == F.col("word"))
    parts = known.select(key, F.posexplode("vec").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
    return df.select(key).join(vec, key, "left").withColumn("vec", F.coalesce("vec", F.array(*[F.lit(0.0)] * dim)))


def definition_vectors(df: DataFrame, tokens: Column, key: str, glosses: DataFrame, embed) -> DataFrame:
    """(key, gloss, vec): the distinct glosses of each text's words, from a table (word, gloss), and their vectors."""
    words = df.select(key, F.explode(F.array_distinct(tokens)).alias("word"))
    return words.join(glosses, "word").select(key, "gloss").distinct().withColumn("vec", embed(F.col("gloss")))


def definition_shift(df: DataFrame, vector: Column, key: str, definitions: DataFrame, dim: int = 4) -> DataFrame:
    """(key, shift): 1 - cosine of each text's vector and the centroid of its definition vectors; null without a definition."""
    centroids = definitions.groupBy(key).agg(F.array(*[F.avg(F.col("vec")[k]) for k in range(dim)]).alias("centroid"))
    return df.select(key, vector.alias("vec")).join(centroids, key, "left").select(key, (1 - cosine(F.col("vec"), F.col("centroid"))).alias("shift"))


# --- background counts and association ---


def word_pairs(tokens: Column, width: int = 5) -> Column:
    """Ordered pairs of words at most ``width`` places apart, without a place with itself."""
    n = F.size(tokens)
    at = F.sequence(F.lit(0), n - 1)

    def around(i):
        near = F.filter(F.sequence(F.greatest(F.lit(0), i - width), F.least(n - 1, i + width)), lambda j: j != i)
        return F.transform(near, lambda j: F.struct(F.get(tokens, i).alias("w1"), F.get(tokens, j).alias("w2")))

    return F.when(n > 1, F.flatten(F.transform(at, around))).otherwise(F.array().cast("array<struct<w1:string,w2:string>>"))


def background(df: DataFrame, tokens: Column, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Word counts (word, n) and windowed pair counts (w1, w2, n)."""
    held = df.select(tokens.alias("t"))
    uni = held.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return uni, pair_counts(held, F.col("t"), width)


def delta_pmi(df: DataFrame, tokens: Column, key: str, uni: DataFrame, bi: DataFrame, width: int = 5, alpha: float = 0.5) -> DataFrame:
    """Mean over a text's distinct pairs of known words of its own PMI less the background's; null without any."""
    held = df.select(key, tokens.alias("t"))
    pairs = held.select(key, F.size("t").alias("size"), F.explode(word_pairs(F.col("t"), width)).alias("p"))
    c12 = pairs.groupBy(key, "p.w1", "p.w2").agg(F.count("*").alias("c12"), F.first("size").cast("double").alias("size"))
    own = held.select(key, F.explode("t").alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    total = uni.agg(F.sum("n").cast("double").alias("nb"))
    known = uni.select("word", "n")
    j = c12.join(own.toDF(key, "w1", "u1"), [key, "w1"]).join(own.toDF(key, "w2", "u2"), [key, "w2"])
    j = j.join(known.toDF("w1", "b1"), "w1").join(known.toDF("w2", "b2"), "w2").join(bi.withColumnRenamed("n", "b12"), ["w1", "w2"], "left").join(F.broadcast(total))
    size, nb = F.col("size"), F.col("nb")
    here = F.log2((F.col("c12") / size) / (F.col("u1") / size * F.col("u2") / size))
    there = F.log2(((F.coalesce("b12", F.lit(0)) + alpha) / (nb + alpha)) / (F.col("b1") / nb * F.col("b2") / nb))
    scores = j.groupBy(key).agg(F.avg(here - there).alias("delta_pmi"))
    return df.select(key).join(scores, key, "left")


# --- surprisal ---


def bigram_surprisal(df: DataFrame, tokens: Column, key: str, alpha: float = 0.1) -> DataFrame:
    """(key, pos, token, surprisal) in nats under an add-alpha bigram model of the table itself; from the second word on."""
    told = own_surprisal(df, tokens, key, alpha)
    after = F.slice("tokens", F.lit(2), F.size("surprisal"))
    steps = told.select(key, F.posexplode(F.arrays_zip(after.alias("token"), F.col("surprisal"))).alias("p", "s"))
    return steps.select(key, (F.col("p") + 1).alias("pos"), "s.token", "s.surprisal")


def surprisal_series(df: DataFrame, tokens: Column, key: str, alpha: float = 0.1) -> DataFrame:
    """(key, s): the surprisals of ``bigram_surprisal`` of each text with any, in order, in the row."""
    return own_surprisal(df, tokens, key, alpha, named=False).filter(F.size("surprisal") > 0).select(key, F.col("surprisal").alias("s"))


def summarize_series(series: DataFrame, key: str) -> DataFrame:
    """Mean, maximum and length of each series (key, s)."""
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return series.select(key, mean.alias("avg_value"), F.array_max("s").alias("max_value"), F.size("s").cast("long").alias("n"))


def summarize(steps: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, maximum, place and relative place of the maximum (first wins) of each series."""
    by = steps.groupBy(key).agg(
        F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.max_by("token", F.struct(value, -F.col("pos"))).alias("max_token"),
        F.max_by("pos", F.struct(value, -F.col("pos"))).alias("max_pos"), F.max("pos").alias("last"), F.count("*").alias("n"),
    )
    return by.withColumn("relative", F.when(F.col("last") > 0, F.col("max_pos") / F.col("last") * 100).otherwise(0.0)).drop("last")


# --- sentiment ---


def polarity(tokens: Column, positive: Sequence[str], negative: Sequence[str]) -> dict[str, Column]:
    """Shares of positive and negative words, the rest neutral; polarity is their difference; label is the largest."""
    n = F.greatest(F.size(tokens), F.lit(1))
    pos = F.size(F.filter(tokens, lambda w: w.isin(*positive))) / n
    neg = F.size(F.filter(tokens, lambda w: w.isin(*negative))) / n
    label = F.when((pos > neg), "positive").when(neg > pos, "negative").otherwise("neutral")
    return {"pos": pos, "neg": neg, "neu": 1 - pos - neg, "polarity": pos - neg, "label": label}


def sentiment_journey(df: DataFrame, tokens: Column, key: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Polarity of each prefix, and its change: (key, pos, token, polarity, shift). Prefix k ends with word k."""
    value = F.when(F.col("token").isin(*positive), 1.0).when(F.col("token").isin(*negative), -1.0).otherwise(0.0)
    w = Window.partitionBy(key).orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = positions(df, tokens, key).withColumn("polarity", F.sum(value).over(run) / (F.col("pos") + 1))
    return steps.withColumn("shift", F.col("polarity") - F.lag("polarity").over(w))


def sentiment_summary(journey: DataFrame, key: str) -> DataFrame:
    """Largest change, population deviation and last polarity; zeros for texts of fewer than two words."""
    s = journey.groupBy(key).agg(F.max(F.abs("shift")).alias("m"), F.stddev_pop("polarity").alias("d"), F.max_by("polarity", "pos").alias("f"), F.count("*").alias("word_count"))
    short = F.col("word_count") < 2
    pick = lambda c: F.when(short, 0.0).otherwise(F.col(c))
    return s.select(key, pick("m").alias("max_affective_shift"), pick("d").alias("sentiment_volatility"), pick("f").alias("final_sentiment"), "word_count")


# --- shifts and flow over word vectors ---


def prefix_shift(df: DataFrame, tokens: Column, key: str, dim: int = 4) -> DataFrame:
    """1 - cosine of the mean vectors of successive prefixes: (key, pos, token, shift), from the second word on."""
    steps = positions(df, tokens, key).withColumn("vec", hash_vector(F.col("token"), dim))
    w = Window.partitionBy(key).orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.withColumn("total", F.array(*[F.sum(F.col("vec")[k]).over(run) for k in range(dim)]))
    # A mean and its sum point the same way.
    both = sums.withColumn("before", F.lag("total").over(w)).filter("before IS NOT NULL")
    return both.select(key, "pos", "token", (1 - cosine(F.col("total"), F.col("before"))).alias("shift"))


def stepwise_distance(df: DataFrame, sentences: Column, key: str, embed) -> DataFrame:
    """Mean squared distance of successive sentence vectors; null for one sentence, no row for a text without any."""
    v = F.transform(sentences, embed)
    held = df.select(key, v.alias("v"))
    n = F.size("v")
    steps = F.zip_with(F.slice("v", 1, n - 1), F.slice("v", 2, n - 1), squared_distance)
    mean = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    # A filter would be pushed below the vectors and make them twice.
    return held.select(key, F.explode(F.when(n >= 2, F.array(mean)).when(n == 1, F.array(F.lit(None).cast("double")))).alias("swd"))


class _Distances:
    """Distances of vectors. Squares are one product; those so small that a difference of products costs them digits are told by the vectors' differences."""

    def __init__(self, known: np.ndarray):
        square, one = (known * known).sum(axis=1, keepdims=True), np.ones((len(known), 1))
        self.known, self.least = known, 1e-4 * square.max()
        self.left, self.right = np.concatenate((known, square, one), 1), np.concatenate((-2 * known, one, square), 1)

    def __call__(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Of the vectors numbered by ``rows``, (..., n), to those numbered by ``columns``, (..., m)."""
        out = self.left[rows] @ np.swapaxes(self.right[columns], -1, -2)
        close = np.flatnonzero(out < self.least)
        a, b = np.divmod(close, out.shape[-1])
        b += a // out.shape[-2] * out.shape[-1]
        a, b = rows.reshape(-1)[a], columns.reshape(-1)[b]
        apart, other = np.zeros(len(close)), a != b
        apart[other] = ((self.known[a[other]] - self.known[b[other]]) ** 2).sum(-1)
        out.reshape(-1)[close] = apart
        return np.sqrt(out, out=out)


def _products(apart: _Distances, counts: np.ndarray) -> np.ndarray:
    """The distances of all vectors times counts, (vectors, n); some rows at a time, each for both orders."""
    out, every = np.zeros_like(counts), np.arange(len(counts))
    rows = max(16, FLOW_STEP // len(counts))
    for r in range(0, len(counts), rows):
        d = apart(every[r : r + rows], every[: r + rows])
        out[r : r + rows] += d @ counts[: r + rows]
        out[:r] += d[:, :r].T @ counts[r : r + rows]
    return out


def _flow(known: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each word from the second on the mean distance to all before it; ``word`` numbers the words in the vectors ``known``.

    Distances of different words are computed once for the text and multiplied with the words' counts before each block of places; the distances within a block are added place by place. The wider the blocks, the fewer products and the more places: a sixth of the different words is the least work.
    """
    n, m, apart = len(word), len(known), _Distances(known)
    wide = int(min(FLOW_BLOCK, max(32, m // 6)))
    out, block = np.zeros(n), np.arange(n) // wide
    # Counts of each word before the second block, the third and so on: all blocks at once if they can be held, else some blocks and words at a time.
    held, every, last = max(1, FLOW_HELD // m), np.arange(m), int(block[-1])
    columns = m if last <= held else held
    for left in range(0, m if last else 0, columns):
        size = min(columns, m - left)
        distance, seen = None if columns == m else apart(every, every[left : left + size]), np.zeros(size)
        for low in range(0, last, held):
            high = min(last, low + held)
            here = word[low * wide : high * wide] - left
            inside = (here >= 0) & (here < size)
            before = np.bincount(((block[low * wide : high * wide] - low) * size + here)[inside], minlength=(high - low) * size).reshape(-1, size).astype(float)
            before[0] += seen
            before = np.ascontiguousarray(np.cumsum(before, axis=0, out=before).T)
            seen = before[:, -1].copy()
            far = _products(apart, before) if distance is None else distance @ before
            there = slice((low + 1) * wide, min(n, (high + 1) * wide))
            out[there] += far[word[there], block[there] - low - 1]
    lower, each = np.tril(np.ones((wide, wide)), -1), max(1, FLOW_STEP // (wide * wide))
    places = np.concatenate((word, np.zeros(-n % wide, word.dtype))).reshape(-1, wide)
    for k in range(0, len(places), each):
        near = np.einsum("kij,ij->ki", apart(places[k : k + each], places[k : k + each]), lower).reshape(-1)
        at = k * wide
        out[at : at + len(near)] += near[: n - at]
    return out[1:] / np.arange(1, n)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _mean_distances(flat: pd.Series, size: pd.Series) -> pd.Series:
    """``_flow`` of the vectors of each text's words."""

    def journey(v, n):
        if v is None or n < 2:
            return None
        known, word = np.unique(np.asarray(v, float).reshape(int(n), -1), axis=0, return_inverse=True)
        return _flow(known, word.reshape(-1))

    return pd.Series([journey(v, n) for v, n in zip(flat, size)], dtype=object)


def _hash_vectors(names: list[str], dim: int = 4) -> np.ndarray:
    """``hash_vector`` of each word."""
    first = b"".join(md5(w.encode() + b"|%d" % k).digest()[:4] for w in names for k in range(dim))
    return np.frombuffer(first, ">u4").reshape(-1, dim) / 4294967296.0 - 0.5


def _word_journeys(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """(key, journey) of (t, key) by hash vectors, which are made once for the different words of a run of texts."""
    for run in chunks(batches, FLOW_WORDS):
        words = pa.concat_arrays([b.column(0).flatten() for b in run]).dictionary_encode()
        codes, vectors, at = words.indices.to_numpy(), _hash_vectors(words.dictionary.to_pylist()), 0
        for b in run:
            told = []
            for n in pc.fill_null(pc.list_value_length(b.column(0)), 0).to_pylist():
                known, word = np.unique(codes[at : at + n], return_inverse=True)
                told.append(_flow(vectors[known], word) if n > 1 else None)
                at += n
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(told, pa.list_(pa.float64()))], ["key", "journey"])


def forward_flow(df: DataFrame, tokens: Column, key: str, vector=hash_vector) -> DataFrame:
    """Mean over words from the second on of the mean distance to all words before; null under two words.

    Stays in the row: quadratic in the words of one text, no shuffle.
    """
    if vector is hash_vector:
        slim = df.select(tokens.alias("t"), F.col(key).alias("key"))
        held = slim.mapInArrow(_word_journeys, f"key {slim.schema['key'].dataType.simpleString()}, journey array<double>").select(F.col("key").alias(key), "journey")
    else:
        held = df.select(key, _mean_distances(F.flatten(F.transform(tokens, lambda w: vector(w))), F.size(tokens)).alias("journey"))
    return held.select(key, "journey", (F.aggregate("journey", F.lit(0.0), lambda a, x: a + x) / F.size("journey")).alias("flow"))


def adjacent_flow(df: DataFrame, tokens: Column, key: str, vector=hash_vector) -> DataFrame:
    """Mean cosine distance of neighbouring words; 0 for one word, no row for a text without any."""
    held = df.select(key, F.transform(tokens, lambda w: vector(w)).alias("v"))
    n = F.size("v")
    steps = F.zip_with(F.slice("v", 1, F.greatest(n - 1, F.lit(0))), F.slice("v", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: 1 - cosine(a, b))
    mean = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    # A filter would be pushed below the vectors and make them twice.
    return held.select(key, F.explode(F.when(n >= 2, F.array(mean)).when(n == 1, F.array(F.lit(0.0)))).alias("volatility"))


# --- shapes ---


def quarter_means(steps: DataFrame, key: str, value: str) -> DataFrame:
    """Means of the first and the last max(1, n // 4) values of series with at least four."""
    s = steps.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("__v")))), lambda x: x["__v"]).alias("s"))
    return series_quarters(s, key)


def series_quarters(series: DataFrame, key: str) -> DataFrame:
    """The same of series (key, s) that are in the row."""
    s = series.filter(F.size("s") >= 4)
    q = F.greatest(F.lit(1), F.floor(F.size("s") / 4).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / q
    return s.select(key, mean(F.slice("s", F.lit(1), q)).alias("start"), mean(F.slice("s", F.size("s") - q + 1, q)).alias("finish"))


def archetypes(quarters: DataFrame) -> DataFrame:
    """Quadrant of each series about the medians of start and finish; ties belong to none."""
    j = quarters = materialize(quarters)
    for column, name in (("start", "ms"), ("finish", "mf")):
        j = j.join(F.broadcast(exact_quantiles(quarters, column, [], (0.5,), "__q").select(F.col("__q")[0].alias(name))), how="left")  # one row
    s, f = F.col("start"), F.col("finish")
    kind = (
        F.when((s < F.col("ms")) & (f > F.col("mf")), "crescendo").when((s > F.col("ms")) & (f < F.col("mf")), "diminuendo")
        .when((s > F.col("ms")) & (f > F.col("mf")), "sustained high").when((s < F.col("ms")) & (f < F.col("mf")), "sustained low")
    )
    return j.withColumn("archetype", kind).drop("ms", "mf")


def normalized_positions(steps: DataFrame, key: str) -> DataFrame:
    """Places from 0 to 100; 0 for a series of one."""
    n = F.count("*").over(Window.partitionBy(key))
    return steps.withColumn("percent", F.when(n > 1, F.col("pos") / (n - 1) * 100).otherwise(0.0))


def text_positions(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, pos, percent): the places of ``normalized_positions`` of the words of each text, from their number alone, in the row."""
    sized = df.select(key, F.size(tokens).alias("n")).filter("n > 0")
    each = sized.select(key, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return each.select(key, "pos", F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1) * 100).otherwise(0.0).alias("percent"))


def prefixes(tokens: Column) -> Column:
    """The text up to each word."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, F.lit(1), i), " "))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _word_of_part(words: pd.Series, parts: pd.Series) -> pd.Series:
    ends = lambda a: np.cumsum([len(x.replace(" ", "")) for x in a])
    return pd.Series([None if w is None or p is None else np.searchsorted(ends(w), ends(p), side="left").astype(np.int32) for w, p in zip(words, parts)])


def align_subwords(words: Column, parts: Column) -> Column:
    """Number of the word that each sub-word belongs to, by running lengths without spaces; both must spell the same."""
    return _word_of_part(words, parts)
