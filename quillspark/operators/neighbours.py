"""Cosine neighbours through an inverted file: cells around centroids, their vectors in blocks, queries sent only where they may find.

``fit`` places centroids on a bounded sample; every row is indexed. ``search`` looks into each query's nearest cells; how many
that takes for the recall asked for is measured by ``calibrate`` on queries whose neighbours are searched in all rows. ``near_rows`` is exact: a pair
within an angle is missed by no cell that the angle and the cell's own radius can reach, so only those are compared.

Cells lie in blocks of bounded size, large cells in several; so do the queries, by their own nearest cell. A block of
vectors goes only to the blocks of queries that look into one of its cells. Rows without vector or of length zero are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import _kept, unit

#: Rows drawn to place the centroids, and the most centroids, which are broadcast.
SAMPLE, MOST_CELLS = 20_000, 4096
BLOCK_ROWS = 8000
#: Queries that are compared at a time.
ROWS = 1000
#: Queries on which the number of probed cells is measured.
TRIALS = 200
_PAIR = "id long, other long, similarity double"


@dataclass
class Cells:
    """Unit centroids in an order in which neighbours are often alike."""

    centroids: np.ndarray

    def ranked(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        sims = v @ self.centroids.T
        n = min(n, sims.shape[1])
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, copies) with unit vectors, one copy each."""
    return df.select(F.col(key).alias("id"), unit(F.col(vector)).alias("v"), F.lit(1).cast("long").alias("copies")).filter("id IS NOT NULL AND v IS NOT NULL")


def _drawn(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """About n rows by a hash of their id, all if there are no more."""
    share = min(1.0, n / max(1, rows.count()))
    return rows if share == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_003)) < share * 1_000_003)


def _matrix(values) -> np.ndarray:
    return np.array(list(values), np.float64)


def fit(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> Cells:
    """Spherical k-means on about ``sample`` rows; four times the root of the rows are cells, ``MOST_CELLS`` at most."""
    def packed(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [np.asarray(v, np.float32).tobytes() for v in b["v"]]})

    got = sorted(_drawn(rows, sample, "cells").select("id", "v").mapInPandas(packed, "id long, v binary").collect())
    if not got:
        return Cells(np.zeros((0, 0)))
    drawn = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(len(got), -1).astype(np.float64)
    n = min(len(drawn), cells or min(MOST_CELLS, max(1, int(4 * rows.count() ** 0.5))))
    rng = np.random.default_rng(seed)
    c = drawn[rng.choice(len(drawn), n, replace=False)]
    for _ in range(rounds):
        own = (drawn @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, drawn)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return Cells(c[np.argsort(c @ axis, kind="stable")])


class _Blocks:
    """Cells in blocks of about ``block_rows`` rows; a cell with more has blocks of its own, ``parts`` of them."""

    def __init__(self, sizes: np.ndarray, block_rows: int):
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        block, room = 0, block_rows
        for c, size in enumerate(sizes.tolist()):
            parts = -(-size // block_rows)
            if parts > 1 or size > room:
                block, room = block + 1, block_rows
            self.first[c], self.parts[c] = block, max(1, parts)
            if parts > 1:
                block, room = block + parts, block_rows
            else:
                room -= size

    def of(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % self.parts[cell]

    def reached(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block): the blocks of the cells that each row asks (rows x cells)."""
        begins = np.flatnonzero(np.concatenate(([True], self.first[1:] != self.first[:-1])))
        row, group = np.nonzero(np.logical_or.reduceat(asked, begins, axis=1)) if asked.size else (np.zeros(0, np.int64),) * 2
        parts = self.parts[begins][group]  # a cell of several parts is alone in its group
        row, block = np.repeat(row, parts), np.repeat(self.first[begins][group], parts)
        return row, block + np.arange(len(block)) - np.repeat(np.cumsum(parts) - parts, parts)


def _sizes(cells: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for cell, size in cells.groupBy("cell").count().collect():
        out[cell] = size
    return out


def _assigned(rows: DataFrame, index) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.assign(cell=index.value.ranked(_matrix(b["v"]), 1)[:, 0] if len(b) else np.zeros(0, np.int64))

    return _kept(rows.select("id", "v", "copies").mapInPandas(run, "id long, v array<double>, copies long, cell long"))


def _met(left: DataFrame, right: DataFrame, index, probed: Callable, compare: Callable, fold: Callable, schema: str, block_rows: int) -> DataFrame:
    """``compare`` on every cell of a block and the queries of a block that look into it, and ``fold`` on what it gives, the columns of ``schema``.

    ``probed(vectors)`` says of each query and cell whether the query looks into it.
    """
    n = len(index.value.centroids)
    right = _assigned(right, index)
    left = right if left is None else _assigned(left, index)
    blocks, own = _Blocks(_sizes(right, n), block_rows), _Blocks(_sizes(left, n), block_rows)

    def deal(batches):
        for b in batches:
            yield pd.DataFrame({"b": blocks.of(b["cell"].to_numpy(), b["id"].to_numpy()), "id": b["id"], "v": b["v"], "copies": b["copies"], "cell": b["cell"]})

    def send(batches):
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                some = batch.iloc[k : k + ROWS]
                row, block = blocks.reached(probed(_matrix(some["v"])))
                home = own.of(some["cell"].to_numpy(), some["id"].to_numpy())
                yield pd.DataFrame({"a": home[row], "b": block, "id": some["id"].to_numpy()[row], "v": some["v"].to_numpy()[row]})

    sent = _kept(left.mapInPandas(send, "a long, b long, id long, v array<double>"))
    dealt = right.mapInPandas(deal, "b long, id long, v array<double>, copies long, cell long")
    copies = dealt.join(sent.select("a", "b").distinct().toDF("x", "b"), "b").select("x", "b", "id", "v", "copies", "cell")
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            v, place, others, counted = _matrix(y["v"]), y["cell"].to_numpy(), y["id"].to_numpy(), y["copies"].to_numpy()
            for k in range(0, len(x), ROWS):
                ids, q = x["id"].to_numpy()[k : k + ROWS], _matrix(x["v"].iloc[k : k + ROWS])
                asked, found = probed(q), []
                for c in np.unique(place):
                    rows, columns = np.flatnonzero(asked[:, c]), np.flatnonzero(place == c)
                    if len(rows):
                        found.append(compare(ids[rows], q[rows], others[columns], v[columns], counted[columns]))
                if found:
                    out.append(fold(*(np.concatenate(z) for z in zip(*found))))
        return pd.DataFrame({n: np.concatenate([o[k] for o in out]) if out else [] for k, n in enumerate(names)})

    return sent.groupBy("a", "b").cogroup(copies.groupBy("x", "b")).applyInPandas(meet, schema)


def _best(k: int, same: bool) -> Callable:
    def compare(ids, q, others, v, copies):
        sims = q @ v.T
        if same:
            sims[ids[:, None] == others[None, :]] = -2
        at = max(0, sims.shape[1] - k)
        i, j = np.nonzero((sims >= np.partition(sims, at, axis=1)[:, at][:, None]) & (sims > -2))
        return ids[i], others[j], sims[i, j]

    return compare


def search(left: DataFrame | None, right: DataFrame, cells: Cells, probes: int, k: int = 1, same: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, similarity): of each query (id, v) the k best in its ``probes`` nearest cells; of equal ones the smallest ids. Without ``left`` all rows are queries."""
    index = right.sparkSession.sparkContext.broadcast(cells)

    def probed(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), len(index.value.centroids)), bool)
        np.put_along_axis(out, index.value.ranked(v, probes), True, 1)
        return out

    def fold(ids, others, sims):
        """The k best of each query so far."""
        order = np.lexsort((others, -sims, ids))
        ids, others, sims = ids[order], others[order], sims[order]
        first = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
        return ids[first], others[first], sims[first]

    found = _met(left, right, index, probed, _best(k, same), fold, _PAIR, block_rows)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def exact_best(queries: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, other, similarity): the k best of a bounded set of queries among all rows, which are read once."""
    asked = sorted(tuple(r) for r in queries.select("id", "v").collect())
    held = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked], np.int64), _matrix(v for _, v in asked)))

    def run(batches):
        ids, q = held.value
        for b in batches:
            if len(b) and len(ids):
                i, j, s = _best(k, same)(ids, q, b["id"].to_numpy(), _matrix(b["v"]), None)
                yield pd.DataFrame({"id": i, "other": j, "similarity": s})

    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    return rows.select("id", "v").mapInPandas(run, _PAIR).withColumn("place", place).filter(F.col("place") <= k).drop("place")


def calibrate(rows: DataFrame, cells: Cells, recall: float = 0.95, k: int = 1, trials: int = TRIALS) -> int:
    """How many cells a query must look into to find the share ``recall`` of its k best, measured on about ``trials`` queries."""
    queries = _drawn(rows, trials, "trials")
    best = exact_best(queries, rows, k, True).join(rows.select(F.col("id").alias("other"), F.col("v").alias("w")), "other").join(queries, "id").select("v", "w").collect()
    if not best:
        return 1
    order = cells.ranked(_matrix(r[0] for r in best), len(cells.centroids))
    own = cells.ranked(_matrix(r[1] for r in best), 1)
    places = np.sort((order == own).argmax(1))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


def nearest_rows(df: DataFrame, key: str, vector: str, k: int = 1, queries: Column | None = None, recall: float = 0.95) -> DataFrame:
    """(id, other, similarity): of every row, or of those that ``queries`` names, the k best other rows, found with about the recall asked for."""
    rows = _kept(prepared(df, key, vector))
    cells = fit(rows)
    asked = None if queries is None else prepared(df.filter(queries), key, vector)
    return search(asked, rows, cells, calibrate(rows, cells, recall, k), k, True)


def near_rows(df: DataFrame, key: str, vector: str, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_links, kept) of every row with a vector, exactly: how many others have a cosine of ``least`` or more, and whether none of them has a smaller key.

    Equal vectors are compared once; a row's own copies count as others.
    """
    rows = prepared(df, key, vector).drop("copies")
    own = _kept(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    cells = fit(own)
    spark = df.sparkSession
    index, angle = spark.sparkContext.broadcast(cells), float(np.arccos(np.clip(least, -1, 1)))
    reach = _radii(own, index, len(cells.centroids)) + angle + 1e-6

    def probed(v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v @ index.value.centroids.T, -1, 1)) <= reach

    def compare(ids, q, others, v, copies):
        near = (q @ v.T >= least) & (ids[:, None] != others[None, :])
        i = np.flatnonzero(near.any(1))
        return ids[i], np.where(near[i], others[None, :], np.iinfo(np.int64).max).min(1), near[i] @ copies

    def fold(ids, low, linked):
        """One row for each row and block, however many of the block's rows are near it."""
        names, at = np.unique(ids, return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, at, low)
        return names, least, np.bincount(at, linked, len(names)).astype(np.int64)

    found = _met(None, own, index, probed, compare, fold, "id long, low long, linked long", block_rows)
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"), F.min("low").alias("low"))
    told = own.select("v", "id", "copies").join(linked, "id", "left")
    each = rows.withColumnRenamed("id", "row").join(told, "v")
    first = F.col("row") == F.least("id", F.coalesce("low", "id"))
    return each.select(F.col("row").alias(key), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), first.alias("kept"))


def _radii(rows: DataFrame, index, n: int) -> np.ndarray:
    """The largest angle between a centroid and a row of its cell, of each cell."""

    def run(batches):
        for b in batches:
            if len(b):
                v = _matrix(b["v"])
                cell = index.value.ranked(v, 1)[:, 0]
                angle = np.arccos(np.clip((v * index.value.centroids[cell]).sum(1), -1, 1))
                yield pd.DataFrame({"cell": cell, "angle": angle}).groupby("cell", as_index=False).max()

    out = np.zeros(n)
    for cell, angle in rows.select("v").mapInPandas(run, "cell long, angle double").groupBy("cell").agg(F.max("angle")).collect():
        out[cell] = angle
    return out
