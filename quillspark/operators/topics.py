"""Topics of clustered texts: terms of one and two words, diverse term lists, merged topics, typical texts, coherence over sliding windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize
from .windows import top_per_group

#: Words of a sliding window, and what keeps logarithms finite.
WINDOW, TINY = 110, 1e-12


def text_clusters(df: DataFrame, tokens: Column, key: str, k: int, features: int = 512, seed: int = 42) -> DataFrame:
    """(key, words, topic): texts in k clusters of their hashed, document-frequency weighted words."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = df.select(F.col(key), F.coalesce(tokens, F.array().cast("array<string>")).alias("words"))
    hashed = HashingTF(numFeatures=features, inputCol="words", outputCol="tf").transform(words)
    # Numbers of words are written, which take a few bytes each; the weights, which do not, are made from them in every pass.
    held = materialize(hashed.select("tf"))
    idf, normal = IDF(inputCol="tf", outputCol="idf").fit(held), Normalizer(inputCol="idf", outputCol="features")
    model = KMeans(k=k, seed=seed).fit(normal.transform(idf.transform(held)).select("features"))
    return model.transform(normal.transform(idf.transform(hashed))).select(key, "words", F.col("prediction").alias("topic"))


def terms(tokens: Column, stop: Sequence[str] = ()) -> Column:
    """Words and pairs of neighbouring words, stop words left out first."""
    kept = F.filter(tokens, lambda x: ~x.isin(*stop)) if stop else tokens
    pairs = F.transform(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.element_at(kept, i + 2)))
    return F.concat(kept, pairs)


def topic_terms(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """(topic, term, c, weight) of counts (topic, term, c): the term's share of the topic times ln(1 + mean topic size / count of the term).

    Terms found in fewer than ``min_df`` topics are left out before.
    """
    of_term = counts.groupBy("term").agg(F.sum("c").alias("f"), F.count("*").alias("df")).filter(F.col("df") >= min_df)
    kept = counts.join(of_term.select("term", "f"), "term")
    of_topic = kept.groupBy("topic").agg(F.sum("c").alias("size"))
    mean = of_topic.agg(F.avg("size").alias("mean"))
    joined = kept.join(of_topic, "topic").crossJoin(F.broadcast(mean))  # the mean is one row
    return joined.select("topic", "term", "c", (F.col("c") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def similar_topics(weights: DataFrame) -> DataFrame:
    """(x, y, similarity): cosines of the topics' weights, x < y, by the terms that two topics share."""
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a, b = weights.select(F.col("topic").alias("x"), "term", F.col("weight").alias("wx")), weights.select(F.col("topic").alias("y"), "term", F.col("weight").alias("wy"))
    dots = a.join(b, "term").filter("x < y").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
    scaled = dots.join(norm.toDF("x", "nx"), "x").join(norm.toDF("y", "ny"), "y")
    return scaled.select("x", "y", (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("similarity"))


def shared_mass(counts: DataFrame) -> DataFrame:
    """(x, y, f, mass), written: of each pair of topics, x <= y, and each total count f of a term the sum of the products of the two topics' counts of such terms."""
    of_term = counts.groupBy("term").agg(F.sum("c").alias("f"), F.collect_list(F.struct("topic", "c")).alias("own"))
    first = of_term.select("f", "own", F.explode("own").alias("a"))
    both = first.select("f", F.col("a.topic").alias("x"), F.col("a.c").cast("double").alias("cx"), F.explode(F.filter("own", lambda b: b["topic"] >= F.col("a.topic"))).alias("b"))
    return materialize(both.groupBy("x", F.col("b.topic").alias("y"), "f").agg(F.sum(F.col("cx") * F.col("b.c")).alias("mass")))


def merged_topics(counts: DataFrame, least: float, min_df: int = 1) -> DataFrame:
    """(topic, into): topics of nearly the same terms are united, the most alike pair first, until none is alike by ``least``; the smaller number stays.

    Only pairs of topics come to the driver, as many as topics squared. Where no term is left out (``min_df`` 1), a term's weight in a cosine hangs on its
    total count and the number of topics alone, so that the terms are joined once, and united topics' products are sums of their parts'.
    """
    names = {r[0]: r[0] for r in counts.select("topic").distinct().collect()}
    held = (shared_mass(counts), counts.agg(F.sum("c")).first()[0]) if min_df <= 1 and names else None
    return counts.sparkSession.createDataFrame(sorted(united(names, least, held, counts, min_df).items()), "topic int, into int")


def united(names: dict, least: float, held: tuple[DataFrame, int] | None, counts: DataFrame | None = None, min_df: int = 1) -> dict:
    """Into which topic each of ``names`` goes: by ``held``, the products of ``shared_mass`` and the sum of all counts, or else by ``counts``."""
    while True:
        if held:
            weight = F.log(1 + F.lit(held[1] / len(set(names.values()))) / F.col("f"))
            alike = _alike(held[0].groupBy("x", "y").agg(F.sum(F.col("mass") * weight * weight)).collect(), names, least)
        else:
            step = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None)
            now = counts.withColumn("topic", step[F.col("topic")]).groupBy("topic", "term").agg(F.sum("c").alias("c")) if names else counts
            alike = [tuple(r) for r in similar_topics(topic_terms(now, min_df)).filter(F.col("similarity") >= least).collect()]
        taken: set = set()
        for x, y, _ in sorted(alike, key=lambda r: (-r[2], r[0], r[1])):
            if x not in taken and y not in taken:
                taken |= {x, y}
                names = {k: x if v == y else v for k, v in names.items()}
        if not taken:
            return names


def _alike(products: list, names: dict, least: float) -> list[tuple]:
    """(x, y, cosine) of the pairs of united topics, x < y, that reach ``least``, from the products of their parts."""
    dots: dict = defaultdict(float)
    for x, y, dot in products:
        for a, b in {(x, y), (y, x)}:
            dots[names[a], names[b]] += dot
    cosine = {(x, y): dot / (dots[x, x] * dots[y, y]) ** 0.5 for (x, y), dot in dots.items() if x < y and dots[x, x] * dots[y, y] > 0}
    return [(x, y, c) for (x, y), c in cosine.items() if c >= least]


def diverse_terms(weights: DataFrame, top: int = 10, candidates: int = 30, diversity: float = 0.3) -> DataFrame:
    """(topic, term, weight, place): of each topic's leading terms those that say it best and repeat each other least.

    A term is compared with the topic, and with the terms chosen before, by the cosine of their weights over all topics.
    """
    first = top_per_group(weights, ["topic"], [F.col("weight").desc(), "term"], candidates, "rank")
    across = weights.join(first.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "weight")))).alias("across"))
    rows = first.select("topic", "term", "weight", "rank").join(across, "term")

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank").reset_index(drop=True)
        names = sorted({t for m in own["across"] for t, _ in _items(m)})
        x = np.zeros((len(own), len(names)))
        for i, m in enumerate(own["across"]):
            for t, w in _items(m):
                x[i, names.index(t)] = w
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near, alike = x[:, names.index(own["topic"][0])], x @ x.T
        chosen = [int(np.lexsort((own["rank"], -near))[0])]
        while len(chosen) < min(top, len(own)):
            score = (1 - diversity) * near - diversity * alike[:, chosen].max(1)
            score[chosen] = -np.inf
            chosen.append(int(np.lexsort((own["rank"], -score))[0]))
        out = own.loc[chosen, ["topic", "term", "weight"]]
        return out.assign(place=np.arange(1, len(out) + 1))

    kind = weights.schema["topic"].dataType.simpleString()
    return rows.groupBy("topic").applyInPandas(choose, f"topic {kind}, term string, weight double, place int")


def _items(m) -> list:
    return list(m.items()) if isinstance(m, dict) else list(m)


def typical_texts(held: DataFrame, weights: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(topic, key, similarity, place): of each topic the texts whose terms, weighted as the topic's, are nearest to it. ``held`` has (key, topic, term, c)."""
    w = held.join(weights.select("topic", "term", "weight"), ["topic", "term"])
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    value = F.col("c") * F.col("weight")
    each = w.groupBy("topic", key).agg(F.sum(value * F.col("weight")).alias("dot"), F.sqrt(F.sum(value * value)).alias("own"))
    scored = each.join(norm, "topic").withColumn("similarity", F.col("dot") / (F.col("own") * F.col("norm")))
    return top_per_group(scored, ["topic"], [F.col("similarity").desc(), key], k, "place").select("topic", key, "similarity", "place")


def window_coherence(df: DataFrame, tokens: Column, topics: DataFrame, topic: str, word: str, window: int = WINDOW) -> DataFrame:
    """(topic, coherence, words): how alike a topic's words are in what they occur with.

    A text is the windows of ``window`` words that slide over it, one if it is shorter. A word's vector holds its normalised pointwise
    mutual information with every word of its topic over all windows; the coherence is the mean cosine of these vectors with their sum. Of each text only
    the places of topic words matter: windows with a word are a union of ranges, which are counted, never listed. The topics' words are
    sent to the tasks.
    """
    wanted = sorted({(r[0], r[1]) for r in topics.select(topic, word).collect()})
    sets = {}
    for t, w in wanted:
        sets.setdefault(t, []).append(w)
    held = df.sparkSession.sparkContext.broadcast((sets, {w for _, w in wanted}))

    def count(batches):
        lists, words = held.value
        for b in batches:
            totals: dict[tuple[str, str], int] = {("", ""): 0}
            for text in b["words"]:
                text = [] if text is None else list(text)
                n = max(1, len(text) - window + 1)
                totals["", ""] += n
                places: dict[str, list[int]] = {}
                for k, w in enumerate(text):
                    if w in words:
                        places.setdefault(w, []).append(k)
                inside = {}
                for w, at in places.items():
                    edge = np.zeros(n + 1, np.int64)
                    at = np.array(at)
                    np.add.at(edge, np.clip(at - window + 1, 0, n), 1)
                    np.add.at(edge, np.clip(at + 1, 0, n), -1)
                    inside[w] = np.cumsum(edge[:n]) > 0
                done = set()
                for own in lists.values():
                    own = [w for w in own if w in inside]
                    for i, x in enumerate(own):
                        for y in own[i:]:
                            if (x, y) not in done:
                                done.add((x, y))
                                totals[x, y] = totals.get((x, y), 0) + int((inside[x] & inside[y]).sum())
            yield pd.DataFrame([(x, y, n) for (x, y), n in totals.items()], columns=["x", "y", "n"])

    counted = df.select(tokens.alias("words")).mapInPandas(count, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    seen = {(r[0], r[1]): r[2] for r in counted.collect()}  # pairs of words of one topic
    total, out = seen.get(("", ""), 0), []
    for t, own in sets.items():
        p = np.array([[seen.get((min(x, y), max(x, y)), 0) for y in own] for x in own]) / max(1, total)
        single = np.diag(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.log((p + TINY) / np.outer(single, single)) / -np.log(p + TINY)
        npmi = np.nan_to_num(npmi, nan=0.0, posinf=0.0, neginf=0.0)
        whole = npmi.sum(0)
        size = np.linalg.norm(npmi, axis=1) * np.linalg.norm(whole)
        cosines = np.divide(npmi @ whole, size, out=np.zeros(len(own)), where=size > 0)
        out.append((t, float(cosines.mean()), len(own)))
    return df.sparkSession.createDataFrame(out, f"`{topic}` {topics.schema[topic].dataType.simpleString()}, coherence double, words int")
