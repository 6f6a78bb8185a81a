"""Token-set similarity joins within blocks that do not score all pairs.

A pair can reach the score in two ways. Either the common tokens make up most of one text: then the other has one of the rarest of its tokens,
as the rest alone is too short. Or the two sorted token texts are a few edits apart: an edit changes at most three of the padded pairs of
neighbouring letters, so the texts share many of them, one among the rarest of each, and differ little in length. Texts that meet by
such a token or pair of letters are candidates; only they are scored. No pair that reaches the score is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..sources.files import materialize


def _tokens(text: Column) -> Column:
    """The different tokens, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda x: x != "")))


def _grams(tokens: Column) -> Column:
    """Pairs of neighbouring letters of the padded tokens, each with its number among equal ones."""
    padded = F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("\x02"), t, F.lit("\x03"))), "")
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - 1, F.lit(1)))
    pairs = F.array_sort(F.filter(F.transform(at, lambda i: padded.substr(i, F.lit(2))), lambda g: (F.length(g) == 2) & (g != "\x03\x02")))
    return F.transform(pairs, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(pairs, g).cast("int") + 1).alias("nth")))


def _ranked(texts: DataFrame, block: Sequence[str], items: Column, name: str) -> DataFrame:
    """(id, items): a text's items as (rows of the block with the item, item), rarest first."""
    each = texts.select("id", *block, F.explode(items).alias(name))
    size = each.groupBy(*block, name).agg(F.count("*").alias("n"))
    joined = each.join(size, [*block, name])
    return joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", name))).alias("items"))


def _texts(df: DataFrame, block: Sequence[str], text: str) -> DataFrame:
    """(id, block, text, tokens, long): the different texts of each block; ``long`` is the length of the joined tokens."""
    rows = df.filter(F.col(text).isNotNull()).select(*block, F.col(text).alias("text")).distinct()
    tokens = _tokens(F.col("text"))
    made = rows.withColumn("tokens", tokens).filter(F.size("tokens") > 0)
    return made.select(F.monotonically_increasing_id().alias("id"), *block, "text", "tokens", F.length(F.array_join("tokens", " ")).alias("long"))


def candidates(texts: DataFrame, block: Sequence[str], least: float) -> DataFrame:
    """(x, y), x < y: ids of the pairs of one block whose token-set ratio may reach ``least``."""
    t = least / 100
    words = _ranked(texts, block, F.col("tokens"), "token").join(texts.select("id", *block, "long"), "id")
    # The rarest tokens, until those left are too short to be most of the text.
    share = t / (2 - t)
    kept = F.filter("items", lambda _, i: _tail_length(F.col("items"), i) >= share * F.col("long") - 1e-9)
    rare = words.select("id", *block, F.explode(F.transform(kept, lambda x: x["token"])).alias("token"))
    all_ = words.select(F.col("id").alias("other"), *block, F.explode(F.transform("items", lambda x: x["token"])).alias("token"))
    by_token = rare.join(all_, [*block, "token"]).filter("id <> other").select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y"))

    grams = _ranked(texts, block, _grams(F.col("tokens")), "gram").join(texts.select("id", *block, "long"), "id")
    shared = (F.col("long") * (1 + share) * (1 - 3 * (1 - t)) + 2) / 2
    front = F.greatest(F.lit(0), F.least(F.size("items"), F.floor(F.size("items") - shared + 1 + 1e-9).cast("int")))
    first = grams.select("id", "long", *block, F.explode(F.transform(F.slice("items", 1, front), lambda x: x["gram"])).alias("gram"))
    if 1 - 3 * (1 - t) <= 0:  # a pair may have no letters in a row in common
        first = texts.select("id", "long", *block, F.lit(0).alias("gram"))
    second = first.select(F.col("id").alias("other"), F.col("long").alias("far"), *block, "gram")
    near = F.abs(F.col("long") - F.col("far")) <= (1 - t) * (F.col("long") + F.col("far")) + 1e-9
    by_gram = first.join(second, [*block, "gram"]).filter((F.col("id") < F.col("other")) & near).select(F.col("id").alias("x"), F.col("other").alias("y"))
    return by_token.union(by_gram).distinct()


def _tail_length(items: Column, i: Column) -> Column:
    """Length of the tokens from the i-th on, joined by spaces."""
    tail = F.slice(items, i + 1, F.size(items))
    return F.aggregate(tail, F.lit(-1), lambda n, x: n + F.length(x["token"]) + 1)


def similar_rows(df: DataFrame, key: str, block: Sequence[str], text: str, least: float) -> DataFrame:
    """(key, other, score): the pairs of rows of one block, key < other, whose token-set ratio, rounded, is ``least`` or more.

    Rows of equal texts with tokens are pairs; texts without tokens match nothing, rows whose block is null neither.
    """
    texts = materialize(_texts(df, block, text))
    pairs = candidates(texts, block, least - 0.5)
    a, b = texts.select(F.col("id").alias("x"), F.col("text").alias("a")), texts.select(F.col("id").alias("y"), F.col("text").alias("b"))
    scored = pairs.join(a, "x").join(b, "y").withColumn("score", sim.score("token_set_ratio", F.col("a"), F.col("b"))).filter(F.col("score") >= least)
    named = df.select(F.col(key).alias("key"), *block, F.col(text).alias("text")).join(texts.select("id", *block, "text"), [*block, "text"]).select("key", "id")
    between = scored.select("x", "y", "score").join(named.toDF("k", "x"), "x").join(named.toDF("l", "y"), "y").select("k", "l", "score")
    within = named.toDF("k", "x").join(named.toDF("l", "y"), F.col("x") == F.col("y")).filter("k < l").select("k", "l", F.lit(100).alias("score"))
    both = between.union(within)
    return both.select(F.least("k", "l").alias(key), F.greatest("k", "l").alias("other"), "score")
