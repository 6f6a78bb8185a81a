"""Lexicons learned from the texts themselves: polarity words from labelled texts, word vectors and glosses from contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import cosine
from ..sources.files import materialize
from .joins import join_hot
from .journeys import hash_vector, positions, text_vectors
from .windows import top_per_group


def polarity_lexicon(df: DataFrame, tokens: Column, label: str, least: int = 5, margin: float = 1.0) -> DataFrame:
    """(word, polarity, size), written: words whose smoothed log odds between texts of label 1 and 0 pass ``margin`` either way, 1 or -1.

    ``size`` is how often the texts have the word; rarer ones than ``least`` say nothing. Texts of no label are not learned from.
    """
    words = df.filter(F.col(label).isin(0, 1)).select(label, F.explode(tokens).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")))
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"), F.count("*").alias("v"))
    joined = counts.join(F.broadcast(total))  # one row
    odds = F.log((F.col("p") + 1) / (F.col("all_p") + F.col("v"))) - F.log((F.col("q") + 1) / (F.col("all_q") + F.col("v")))
    kept = joined.filter(F.col("p") + F.col("q") >= least).withColumn("odds", odds).filter(F.abs("odds") >= margin)
    return materialize(kept.select("word", F.signum("odds").cast("int").alias("polarity"), (F.col("p") + F.col("q")).alias("size")))


def polarity_by_lexicon(df: DataFrame, tokens: Column, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, pos, neg, neu, polarity, label): shares of positive and negative words; null shares without words."""
    # Only words leave the generator: a size beside it would be taken from the whole text again for every word.
    words = df.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    hits = join_hot(words, lexicon, ["word"])
    counted = hits.groupBy(key).agg(F.sum(F.when(F.col("polarity") > 0, F.col("times")).otherwise(0)).alias("p"), F.sum(F.when(F.col("polarity") < 0, F.col("times")).otherwise(0)).alias("q"))
    out = df.select(key, F.size(tokens).alias("n")).join(counted, key, "left")
    share = lambda c: F.when(F.col("n") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("n"))
    pos, neg = share("p"), share("q")
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").when(F.col("n") > 0, "neutral")
    return out.select(key, pos.alias("pos"), neg.alias("neg"), (1 - pos - neg).alias("neu"), (pos - neg).alias("polarity"), label.alias("label"))


def polarity_journey(df: DataFrame, tokens: Column, key: str, lexicon: DataFrame) -> DataFrame:
    """Polarity of each prefix of a text and its change: (key, pos, token, polarity, shift). Prefix k ends with word k."""
    steps = positions(df, tokens, key)
    known = join_hot(steps, lexicon.withColumnRenamed("word", "token"), ["token"]).select(key, "pos", F.col("polarity").alias("value"))
    w = Window.partitionBy(key).orderBy("pos")
    run = F.sum(F.coalesce("value", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) / (F.col("pos") + 1)
    journey = steps.join(known, [key, "pos"], "left").withColumn("polarity", run).drop("value")
    return journey.withColumn("shift", F.col("polarity") - F.lag("polarity").over(w))


def context_vectors(pairs: DataFrame, dim: int) -> DataFrame:
    """(word, n, vec) of counted pairs (w1, w2, n): the mean of the index vectors of the words that a word stands near, an index vector being drawn from the word's hash."""
    index = F.transform(hash_vector(F.col("w2"), dim), lambda x: x.cast("double"))
    drawn = pairs.select("w1", "n", index.alias("x"))
    sums = [F.sum(F.col("n") * F.col("x")[k]).alias(f"s{k}") for k in range(dim)]
    total = drawn.groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("n"), *sums)
    return total.select("word", "n", F.array(*[F.col(f"s{k}") / F.col("n") for k in range(dim)]).alias("vec"))


def glosses(pairs: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """(word, gloss): the words that stand near a word most of all their own times, ``top`` of those that do so ``least`` times; ties by the word."""
    all_ = pairs.groupBy("w2").agg(F.sum("n").alias("all"), F.count("*").alias("size"))
    near = join_hot(pairs.filter(F.col("n") >= least), materialize(all_), ["w2"]).withColumn("share", F.col("n") / F.col("all"))
    return top_per_group(near, ["w1"], [F.col("share").desc(), "w2"], top).select(F.col("w1").alias("word"), F.col("w2").alias("gloss"))


def definition_table(glossed: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(word, vec): the mean vector of the words of each gloss."""
    known = glossed.join(vectors.select(F.col("word").alias("gloss"), "vec"), "gloss")
    return known.groupBy("word").agg(F.array(*[F.avg(F.col("vec")[k]) for k in range(dim)]).alias("vec"))


def definition_shifts(df: DataFrame, tokens: Column, key: str, vectors: DataFrame, definitions: DataFrame, dim: int) -> DataFrame:
    """(key, n, shift): how many different words of a text are defined, and 1 - cosine of the text's vector and the mean of their definitions; null without one."""
    words = df.select(key, F.explode(F.array_distinct(tokens)).alias("word")).join(definitions, "word")
    middle = words.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("vec")[k]) for k in range(dim)]).alias("centroid"))
    texts = text_vectors(df, tokens, key, vectors.select("word", "vec"), dim).join(middle, key, "left")
    return texts.select(key, F.coalesce("n", F.lit(0)).alias("n"), (1 - cosine(F.col("vec"), F.col("centroid"))).alias("shift"))
