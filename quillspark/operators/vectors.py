"""Embedding space: neighbours, centroids, dispersion, silhouettes, cluster quality, topic words.

Sums of unit vectors give mean cosine distances exactly, so no pairs are made for
them. Nearest neighbours do need all pairs: they are taken block by block as matrix
products inside tasks, and only each vector's best leave a block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.metrics import dot, norm, squared_distance
from .windows import top_per_group


def unit(v: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    # The norm is a variable of the outer lambda, or it would be computed for every element.
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))[0]


def vector_sums(df: DataFrame, vector: str, by: Sequence[str], out: str = "total") -> DataFrame:
    """Element-wise sums and counts per group, summed as rows (group, place)."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return parts.groupBy(*by).agg(ordered.alias(out), F.max("n").alias("n"))


def centroids(df: DataFrame, vector: str, by: Sequence[str]) -> DataFrame:
    s = vector_sums(df, vector, by)
    return s.select(*by, F.transform("total", lambda x: x / F.col("n")).alias("centroid"), "n")


def mean_pairwise_distance(df: DataFrame, vector: str, by: Sequence[str]) -> DataFrame:
    """Mean cosine distance over unordered pairs of each group: 1 - (|sum|^2 - n) / (n (n - 1))."""
    s = vector_sums(df.withColumn("__u", unit(F.col(vector))).filter("__u IS NOT NULL"), "__u", by)
    n = F.col("n").cast("double")
    return s.select(*by, "n", F.when(n > 1, 1 - (dot(F.col("total"), F.col("total")) - n) / (n * (n - 1))).alias("distance"))


def mean_distance_to(df: DataFrame, vector: str, reference: DataFrame) -> DataFrame:
    """Mean cosine distance of each vector to all reference vectors, by their mean unit vector (one row)."""
    ref = reference.select(F.lit(1).alias("__k"), unit(F.col(vector)).alias("__u")).filter("__u IS NOT NULL")
    mean = centroids(ref, "__u", ["__k"]).select("centroid")
    return df.join(F.broadcast(mean)).withColumn("distance", 1 - dot(unit(F.col(vector)), F.col("centroid"))).drop("centroid")


def silhouettes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Exact cosine silhouette of each row from the sums of its own and the other classes."""
    u = df.select(key, label, unit(F.col(vector)).alias("__u")).filter("__u IS NOT NULL")
    sums = vector_sums(u, "__u", [label]).select(F.col(label).alias("__c"), "total", "n")
    each = u.join(F.broadcast(sums))  # one row per class
    d = dot(F.col("__u"), F.col("total"))
    own = F.when((F.col("__c") == F.col(label)) & (F.col("n") > 1), ((F.col("n") - 1) - (d - 1)) / (F.col("n") - 1))
    other = F.when(F.col("__c") != F.col(label), 1 - d / F.col("n"))
    ab = each.groupBy(key, label).agg(F.max(own).alias("a"), F.min(other).alias("b"))
    return ab.select(key, label, F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def cluster_quality(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin indices (Euclidean)."""
    c = centroids(df, vector, [label])
    all_ = centroids(df.withColumn("__k", F.lit(1)), vector, ["__k"]).select(F.col("centroid").alias("mean"), F.col("n").alias("total"))
    near = df.select(label, vector).join(F.broadcast(c), label).withColumn("sq", squared_distance(F.col(vector), F.col("centroid")))
    spread = near.groupBy(label).agg(F.sum("sq").alias("within"), F.avg(F.sqrt("sq")).alias("scatter"))
    stats = c.join(spread, label).join(F.broadcast(all_))
    between = F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("mean")))
    k = F.count("*").cast("double")
    ch = stats.agg((between / (k - 1) / (F.sum("within") / (F.max("total") - k))).alias("calinski_harabasz"))
    a, b = stats.select(F.col(label).alias("i"), F.col("centroid").alias("ci"), F.col("scatter").alias("si")), stats.select(F.col(label).alias("j"), F.col("centroid").alias("cj"), F.col("scatter").alias("sj"))
    worst = a.join(F.broadcast(b), F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(squared_distance(F.col("ci"), F.col("cj")))).alias("r"))
    return ch.join(worst.agg(F.avg("r").alias("davies_bouldin")))


#: Rows of a block, and the cosines that a task holds at a time.
BLOCK_ROWS, HELD = 16_000, 1 << 21
#: A table of few blocks is cut finer, so that several tasks share it.
LEAST_BLOCKS, LEAST_ROWS = 6, 1000


def _blocks(df: DataFrame, block_rows: int) -> int:
    n = df.count()
    return max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // LEAST_ROWS))


def _dealt(df: DataFrame, key: str, vector: str, n: int, own: str) -> DataFrame:
    narrow = df.schema[vector].dataType.elementType.typeName() in ("float", "double")
    v = F.col(vector) if narrow else F.transform(vector, lambda x: x.cast("double"))
    return df.select(F.col(key).alias("id"), v.alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias(own))


def _spread(df: DataFrame, to: str, first: Column | int, last: Column | int) -> DataFrame:
    """Each row once for every block of the other side from ``first`` to ``last``."""
    ends = [F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (first, last)]
    return df.withColumn(to, F.explode(F.sequence(*ends)))


def _units(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block; rows without a direction are left out."""
    v = np.array(rows["v"].tolist()).astype(np.float64, copy=False)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
    held = np.isfinite(v).all(1)
    return rows["id"].to_numpy()[held], v[held]


def _rough(m: np.ndarray, w: np.ndarray):
    """(first row, cosines in single precision) of a few rows of ``m`` at a time, and how far two of them may be off together."""
    few, wide, step = m.astype(np.float32), w.astype(np.float32).T, max(1, HELD // max(1, len(w)))
    slack = np.float32((m.shape[1] + 8) * 2.0**-22)
    for at in range(0, len(m), step):
        yield at, few[at : at + step] @ wide, slack


def _cosines(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosine of each pair of unit vectors, the same for equal pairs wherever they stand."""
    return np.einsum("ij,ij->i", m, w)


_PAIRS = "id long, other long, similarity double"


def _pairs(parts: list[tuple]) -> pd.DataFrame:
    ids, others, sims = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
    return pd.DataFrame({"id": np.asarray(ids, np.int64), "other": np.asarray(others, np.int64), "similarity": np.asarray(sims, np.float64)})


def nearest(left: DataFrame, right: DataFrame, key: str, vector: str, k: int = 1, same: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, similarity): of each left vector its k best right ones by cosine, exactly; of equal ones the smallest keys.

    With ``same`` a row is not its own neighbour. Both sides are dealt to blocks, each pair of blocks is multiplied, some
    rows at a time, in single precision; what may be among the k best by that is computed in double, and k of each row leave.
    """
    n_left, n_right = _blocks(left, block_rows), _blocks(right, block_rows)
    a = _spread(_dealt(left, key, vector, n_left, "a"), "b", 0, n_right - 1)
    b = _spread(_dealt(right, key, vector, n_right, "b"), "a", 0, n_left - 1)

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return _pairs([])
        (ids, m), (others, w), out = _units(x), _units(y), []
        if not len(ids) or not len(others):
            return _pairs([])
        order, place = np.argsort(others, kind="stable"), max(0, len(others) - k)
        low, high = (np.searchsorted(others[order], ids, side) for side in ("left", "right"))
        for at, rough, slack in _rough(m, w):
            if same:
                for i in np.flatnonzero(low[at : at + len(rough)] < high[at : at + len(rough)]):
                    rough[i, order[low[at + i] : high[at + i]]] = -2
            least = rough.max(1) if k == 1 else np.partition(rough, place, axis=1)[:, place]
            i, j = np.nonzero(rough >= np.maximum(least - slack, np.float32(-1.5))[:, None])
            i += at
            sims = _cosines(m[i], w[j])
            order_ = np.lexsort((others[j], -sims, i))
            i, j, sims = i[order_], j[order_], sims[order_]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((ids[i[keep]], others[j[keep]], sims[keep]))
        return _pairs(out)

    out = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(product, _PAIRS)
    return top_per_group(out, ["id"], [F.col("similarity").desc(), "other"], k).drop("rn")


def near_pairs(df: DataFrame, key: str, vector: str, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, similarity): every pair of rows, id < other, from cosine ``least`` on, exactly; each pair of blocks is multiplied once."""
    n = _blocks(df, block_rows)
    a = _spread(_dealt(df, key, vector, n, "a"), "b", F.col("a"), n - 1)
    b = _spread(_dealt(df, key, vector, n, "b"), "a", 0, F.col("b"))

    def product(block: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return _pairs([])
        (ids, m), (others, w), out = _units(x), _units(y), []
        for at, rough, slack in _rough(m, w):
            i, j = np.nonzero(rough >= np.float32(least) - slack)
            u, v, sims = ids[i + at], others[j], _cosines(m[i + at], w[j])
            keep = (u < v if block[0] == block[1] else u != v) & (sims >= least)
            out.append((np.minimum(u, v)[keep], np.maximum(u, v)[keep], sims[keep]))
        return _pairs(out)

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(product, _PAIRS)


def duplicate_rows(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """The larger id of every near pair: the rows that leave."""
    return near_pairs(df, key, vector, least).select(F.col("other").alias(key)).distinct()


def class_tf_idf(df: DataFrame, tokens: Column, label: str, key: str, stop: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Leading words of each class: share in the class times ln(documents / total count of the word)."""
    words = df.select(label, key, F.explode(tokens).alias("token")).filter(~F.col("token").isin(*stop) if stop else F.lit(True))
    counts = words.groupBy(label, "token").agg(F.count("*").alias("c"))
    of_class = counts.groupBy(label).agg(F.sum("c").alias("class_total"))
    of_word = counts.groupBy("token").agg(F.sum("c").alias("word_total"))
    docs = df.agg(F.count("*").alias("docs"))
    scored = counts.join(F.broadcast(of_class), label).join(of_word, "token").join(F.broadcast(docs))
    scored = scored.withColumn("score", F.col("c") / F.col("class_total") * F.log(F.col("docs") / F.col("word_total")))
    return top_per_group(scored, [label], [F.col("score").desc(), "token"], top).select(label, "token", "score", "rn")


def topic_coherence(df: DataFrame, tokens: Column, key: str, topics: DataFrame, topic: str = "topic", word: str = "token") -> DataFrame:
    """Mean NPMI of the word pairs of each topic over documents."""
    wanted = topics.select(F.col(word).alias("token")).distinct()
    held = df.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(F.broadcast(wanted), "token")
    single = held.groupBy("token").agg(F.count("*").alias("n"))
    pairs = topics.select(topic, F.col(word).alias("x")).join(topics.select(topic, F.col(word).alias("y")), topic).filter("x < y")
    lists = held.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("w"))  # at most the topics' words
    both = lists.select(F.explode(F.flatten(F.transform("w", lambda x: F.transform(F.filter("w", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    both = both.groupBy("p.x", "p.y").agg(F.count("*").alias("nxy"))
    total = df.agg(F.count("*").cast("double").alias("docs"))
    j = pairs.join(both, ["x", "y"], "left").join(single.toDF("x", "nx"), "x", "left").join(single.toDF("y", "ny"), "y", "left").join(F.broadcast(total))
    pxy = F.col("nxy") / F.col("docs")
    npmi = F.when(F.col("nxy").isNull(), -1.0).when(F.col("nxy") == F.col("docs"), 1.0).otherwise(F.log(pxy / (F.col("nx") / F.col("docs") * F.col("ny") / F.col("docs"))) / -F.log(pxy))
    return j.groupBy(topic).agg(F.avg(npmi).alias("coherence"), F.count("*").alias("pairs"))


def principal_components(df: DataFrame, key: str, vector: str, k: int = 3) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("__v", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(x)
    return model.transform(x).select(key, vector_to_array("__p").alias("components"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, bisecting: bool = False) -> DataFrame:
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("features", array_to_vector(F.transform(unit(F.col(vector)), lambda v: v)))
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(x)
    return model.transform(x).select(key, F.col("prediction").alias("cluster"))


def density_clusters(df: DataFrame, key: str, vector: str, least: float, min_size: int) -> DataFrame:
    """Components of the graph of pairs from similarity ``least`` on; small ones are noise, -1.

    Each row takes the smallest label of its neighbours, then the label of the row that label names,
    until none changes; every round is written, so that plans stay short.
    """
    pairs = _kept(near_pairs(df, key, vector, least).select("id", "other"))
    edges = pairs.union(pairs.select("other", "id"))
    labels = df.select(F.col(key).alias("id"), F.col(key).alias("cluster"))
    while True:
        seen = edges.join(labels.select(F.col("id").alias("other"), "cluster").distinct(), "other").groupBy("id").agg(F.min("cluster").alias("low"))
        near = labels.join(seen, "id", "left").select("id", F.least("cluster", F.coalesce("low", "cluster")).alias("near"), (F.col("low") < F.col("cluster")).alias("moved"))
        further = near.groupBy(F.col("id").alias("near")).agg(F.min("near").alias("cluster"))
        new = _kept(near.join(further, "near").select("id", "cluster", "moved"))
        labels = new.select("id", "cluster")
        if not new.filter("moved").head(1):
            break
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return labels.join(sizes, "cluster").select(F.col("id").alias(key), F.when(F.col("n") >= min_size, F.col("cluster")).otherwise(F.lit(-1)).alias("cluster"))


def _kept(df: DataFrame) -> DataFrame:
    from ..sources.files import materialize

    return materialize(df)


