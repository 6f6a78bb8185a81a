"""Low-dimensional layouts that keep neighbourhoods: a fuzzy neighbour graph, pulled together along its edges, pushed apart elsewhere.

Each point's nearest neighbours become memberships that fall off from the nearest one, scaled so that their sum is the logarithm of
their number; the two directions of an edge are united. From the principal components on, every round moves each point
along the summed pull of its edges and the push of points drawn anew; positions are a written table, a round is two joins and a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .density import nearest_points
from .vectors import _kept, principal_components, unit

#: Points drawn in a round to push all others, and how many pushes each pull brings.
DRAWN, PUSHES = 48, 5.0
#: Neighbour lists that are weighed at a time.
LISTS = 1000


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), fitted to a curve that is flat up to ``min_dist`` and then falls with ``spread``."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.5, 0.9
    for _ in range(200):
        power = x ** (2 * b)
        f = 1 / (1 + a * power)
        j = np.stack((-power * f * f, -2 * a * np.log(x) * power * f * f), 1)
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f))
        a, b = max(1e-3, a + step[0]), max(1e-2, b + step[1])
    return float(a), float(b)


def memberships(lists: DataFrame, k: int) -> DataFrame:
    """(u, v, w) of each list (u, v, w: distance): 1 for the nearest, then falling, so that a list's sum is log2(k)."""

    def weigh(batches):
        for batch in batches:
            for at in range(0, len(batch), LISTS):
                b = batch.iloc[at : at + LISTS]
                sizes = b["v"].map(len).to_numpy()
                d = np.full((len(b), k), np.inf)
                d[np.arange(k)[None, :] < sizes[:, None]] = np.concatenate(b["w"].to_list())
                rest = np.maximum(d - np.where(d > 0, d, np.inf).min(1, initial=np.inf)[:, None], 0)
                rest = np.where(np.isnan(rest), 0, rest)
                low, high = np.full(len(b), 1e-9), np.full(len(b), 1e9)
                for _ in range(80):
                    middle = np.sqrt(low * high)
                    total = np.exp(-rest / middle[:, None]).sum(1)
                    over = total > math.log2(k)
                    high, low = np.where(over, middle, high), np.where(over, low, middle)
                w = np.exp(-rest / np.sqrt(low * high)[:, None])
                yield pd.DataFrame({"u": np.repeat(b["u"].to_numpy(), sizes), "v": np.concatenate(b["v"].to_list()), "w": w[np.arange(k)[None, :] < sizes[:, None]]})

    near = F.array_sort(F.collect_list(F.struct("w", "v")))  # k of each point
    own = lists.groupBy("u").agg(near.alias("near")).select("u", F.col("near.v").alias("v"), F.col("near.w").alias("w"))
    return own.mapInPandas(weigh, "u long, v long, w double")


def fuzzy_graph(lists: DataFrame, k: int) -> DataFrame:
    """(u, v, w) in both directions: a + b - ab of the two memberships of a pair."""
    each = memberships(lists, k).select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "w")
    pairs = each.groupBy("x", "y").agg(F.sum("w").alias("s"), F.max("w").alias("most"), F.count("*").alias("n"))
    w = F.col("s") - F.when(F.col("n") > 1, F.col("most") * (F.col("s") - F.col("most"))).otherwise(0.0)
    edges = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"), w.alias("w"))
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def _capped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(4.0)), F.lit(-4.0))


def _push(names: list[str], c: str, a: float, b: float):
    """Adds the push of a drawn point along the coordinate ``c``."""

    def add(total: Column, x: Column) -> Column:
        deltas = [F.col(e) - x[e] for e in names]
        squares = sum((d * d for d in deltas[1:]), deltas[0] * deltas[0])
        return total + _capped(2 * b * (F.col(c) - x[c]) / ((0.001 + squares) * (1 + a * F.pow(squares, F.lit(b)))))

    return add


def spread_out(graph: DataFrame, start: DataFrame, dims: int, min_dist: float = 0.1, rounds: int = 40, rate: float = 1.0) -> DataFrame:
    """(id, y0, y1, ...): positions after so many rounds from those of ``start``."""
    a, b = curve(min_dist)
    names = [f"y{d}" for d in range(dims)]
    edges = _kept(graph)
    top = edges.agg(F.max("w")).first()[0] or 1.0
    now = _kept(start.select("id", *names))
    n = now.count()
    for r in range(rounds):
        step = rate * (1 - r / rounds)
        share = min(1.0, DRAWN / max(1, n))
        drawn = now.filter(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1_000_003)) < share * 1_000_003).select(*names).limit(4 * DRAWN).collect()
        others = now.select(F.col("id").alias("v"), *[F.col(c).alias(f"o{c}") for c in names])
        pulled = edges.join(others, "v").join(now.withColumnRenamed("id", "u"), "u")
        delta = [F.col(c) - F.col(f"o{c}") for c in names]
        squares = sum((d * d for d in delta[1:]), delta[0] * delta[0])
        pull = F.when(squares > 0, -2 * a * b * F.pow(squares, F.lit(b - 1)) / (1 + a * F.pow(squares, F.lit(b)))).otherwise(0.0)
        sums = pulled.groupBy("u").agg(F.sum("w").alias("weight"), *[F.sum(F.col("w") / top * _capped(pull * d)).alias(f"p{c}") for c, d in zip(names, delta)])
        points = now.sparkSession.createDataFrame([([tuple(map(float, x)) for x in drawn],)], "drawn array<struct<" + ",".join(f"{c}:double" for c in names) + ">>")
        joined = now.join(sums.withColumnRenamed("u", "id"), "id", "left").crossJoin(F.broadcast(points))  # one row
        moved = []
        for c in names:
            force = F.aggregate("drawn", F.lit(0.0), _push(names, c, a, b)) / F.greatest(F.size("drawn"), F.lit(1)) * PUSHES * F.coalesce(F.col("weight"), F.lit(0.0)) / top
            moved.append((F.col(c) + step * _capped(F.coalesce(F.col(f"p{c}"), F.lit(0.0)) + force)).alias(c))
        now = _kept(joined.select("id", *moved))
    return now


def umap(df: DataFrame, key: str, vector: str, dims: int = 2, k: int = 15, min_dist: float = 0.1, rounds: int = 40) -> DataFrame:
    """key, y0, y1, ... of every row with a vector that is not zero: a layout by cosine neighbours; equal vectors share a place with slight jitter."""
    rows = _kept(df.select(F.col(key).alias("id"), unit(F.col(vector)).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL"))
    if not rows.head(1):
        return rows.select(F.col("id").alias(key), *[F.lit(0.0).alias(f"y{d}") for d in range(dims)])
    near = nearest_points(rows, rows, k).select("u", "v", (F.col("w") * F.col("w") / 2).alias("w"))
    graph = fuzzy_graph(near, k)
    parts = principal_components(rows.withColumnRenamed("v", "vector"), "id", "vector", dims)
    wide = _kept(parts.select("id", *[F.col("components")[d].alias(f"c{d}") for d in range(dims)]))
    reach = wide.agg(F.max(F.greatest(*[F.abs(f"c{d}") for d in range(dims)], F.lit(1e-12)))).first()[0]
    jitter = lambda d: (F.pmod(F.xxhash64("id", F.lit(d)), F.lit(10_007)) / F.lit(10_007.0) - 0.5) * 0.01
    start = wide.select("id", *[(F.col(f"c{d}") * (10 / reach) + jitter(d)).alias(f"y{d}") for d in range(dims)])
    return spread_out(graph, start, dims, min_dist, rounds).withColumnRenamed("id", key)
