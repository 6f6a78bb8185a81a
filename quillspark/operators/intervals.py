"""Bias-corrected and accelerated bootstrap intervals of accuracy and ROC area, and kernel densities from bin counts.

A replicate weighs rows by Poisson(1) draws; rows of one score and class are drawn together, so that a replicate costs one draw for
each distinct score, and accuracy two draws in all. Scores lie in ranges; a task folds its range of scores for a block of replicates to
three sums each, and the blocks join them in the order of the ranges. The acceleration comes from the rank sums
themselves: leaving a row out changes the area by what that row adds to U.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize as _written
from .windows import upto

#: Replicates that one row of sums holds, and cells drawn at a time.
BLOCK, CELLS = 500, 2000


def bca(values: np.ndarray, estimate: float, acceleration: float, level: float = 0.95) -> tuple[float, float]:
    """The interval from replicates, the estimate and the acceleration; ties with the estimate count half below it."""
    values = np.sort(values[np.isfinite(values)])
    if not len(values) or values[0] == values[-1]:
        return estimate, estimate
    share = ((values < estimate).mean() + (values <= estimate).mean()) / 2
    normal = NormalDist()
    shift = normal.inv_cdf(min(max(share, 0.5 / len(values)), 1 - 0.5 / len(values)))
    out = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        z = shift + normal.inv_cdf(tail)
        out.append(float(np.quantile(values, normal.cdf(shift + z / (1 - acceleration * z)))))
    return out[0], out[1]


def accuracy_interval(df: DataFrame, label: str, predicted: str, replicates: int = 9999, level: float = 0.95, seed: int = 42) -> DataFrame:
    """n, estimate, low, high of the share of rows told right."""
    right = F.count_if(F.col(label) == F.col(predicted))
    one = df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(right.cast("long").alias("right"), F.count("*").alias("n"))

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        c, n = int(rows["right"][0]), int(rows["n"][0])
        if n < 2:
            return pd.DataFrame({"n": [n], "estimate": [c / n if n else None], "low": [None], "high": [None]})
        rng = np.random.default_rng(seed)
        a, b = rng.poisson(c, replicates), rng.poisson(n - c, replicates)
        with np.errstate(invalid="ignore"):
            values = a / (a + b)
        # Leaving out a right row gives (c - 1) / (n - 1), a wrong one c / (n - 1).
        apart = np.array([c - 1, c]) / (n - 1)
        held = np.array([c, n - c])
        middle = (held * apart).sum() / n
        low, high = bca(values, c / n, _acceleration((held * (middle - apart) ** 2).sum(), (held * (middle - apart) ** 3).sum()), level)
        return pd.DataFrame({"n": [n], "estimate": [c / n], "low": [low], "high": [high]})

    return one.groupBy().applyInPandas(interval, "n long, estimate double, low double, high double")


def _acceleration(squares: float, cubes: float) -> float:
    return float(cubes / (6 * squares**1.5)) if squares > 0 else 0.0


def area_interval(df: DataFrame, label: str, score: str, replicates: int = 9999, level: float = 0.95, seed: int = 42) -> DataFrame:
    """n, estimate, low, high of the ROC area of a score for label 1 against 0; null without both classes."""
    cells = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    cells = cells.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    ranked = upto(upto(cells, [], ["s"], "upto_a", value="a", total="all_a"), [], ["s"], "upto_b", value="b", total="all_b")
    below, above = F.col("upto_b") - F.col("b") / 2, F.col("all_a") - F.col("upto_a") + F.col("a") / 2
    parts = ranked.withColumns({"below": below, "above": above})
    total = parts.agg(F.sum(F.col("a") * F.col("below")).alias("u"), F.max("all_a").alias("n1"), F.max("all_b").alias("n0")).first()
    schema = "n long, estimate double, low double, high double"
    spark = df.sparkSession
    if not (total["n1"] and total["n0"]):
        return spark.createDataFrame([((total["n1"] or 0) + (total["n0"] or 0), None, None, None)], schema)
    u, n1, n0 = float(total["u"]), float(total["n1"]), float(total["n0"])
    estimate = u / (n1 * n0)
    # The area without one positive row and without one negative row of a cell, as a difference from the whole.
    one = (u - F.col("below")) / ((n1 - 1) * n0) - estimate if n1 > 1 else F.lit(0.0)
    zero = (u - F.col("above")) / (n1 * (n0 - 1)) - estimate if n0 > 1 else F.lit(0.0)
    left = parts.select("a", "b", one.alias("x"), zero.alias("y"))
    middle = left.agg(F.sum(F.col("a") * F.col("x") + F.col("b") * F.col("y"))).first()[0] / (n1 + n0)
    power = lambda k: F.sum(F.col("a") * F.pow(middle - F.col("x"), F.lit(k)) + F.col("b") * F.pow(middle - F.col("y"), F.lit(k)))
    acceleration = _acceleration(*map(float, left.agg(power(2), power(3)).first()))

    values = np.array([r[0] for r in replicated_areas(cells.withColumn("g", F.lit(0)), ["g"], replicates, seed).select("area").collect()])
    low, high = bca(values, estimate, acceleration, level)
    return spark.createDataFrame([(int(n1 + n0), estimate, low, high)], schema)


def replicated_areas(cells: DataFrame, by: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """(by, area): the ROC area of each replicate of each group, from cells (by, s: score, a and b: rows of either class)."""
    kinds = [(c, cells.schema[c].dataType.simpleString()) for c in by]
    blocks = range(0, replicates, BLOCK)

    def draw(batches):
        part, group, sums = TaskContext.get().partitionId(), None, None
        rng = np.random.default_rng((seed, part))

        def out():
            columns = dict(zip(by, ([x] * len(blocks) for x in group)))
            lists = {n: [x[r : r + BLOCK] for r in blocks] for n, x in zip(("p", "n", "u"), sums)}
            return pd.DataFrame(columns | {"block": [r // BLOCK for r in blocks], "part": part} | lists)

        for frame in batches:
            names = list(zip(*[frame[c] for c in by]))
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for start, stop in zip(starts, [*starts[1:], len(names)]):
                if sums is None or names[start] != group:
                    if sums is not None:
                        yield out()
                    group, sums = names[start], np.zeros((3, replicates))
                for k in range(start, stop, CELLS):
                    a, b = frame["a"].to_numpy()[k : min(k + CELLS, stop)], frame["b"].to_numpy()[k : min(k + CELLS, stop)]
                    for r in blocks:
                        own = slice(r, min(r + BLOCK, replicates))
                        wa = rng.poisson(np.repeat(a[:, None], own.stop - own.start, 1)).astype(float)
                        wb = rng.poisson(np.repeat(b[:, None], own.stop - own.start, 1)).astype(float)
                        sums[2, own] += (wa * (sums[1, own] + np.cumsum(wb, 0) - wb / 2)).sum(0)
                        sums[0, own] += wa.sum(0)
                        sums[1, own] += wb.sum(0)
        if sums is not None:
            yield out()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        p = n = u = 0.0
        for r in rows.sort_values("part").itertuples():
            u = u + r.u + r.p * n
            p, n = p + r.p, n + r.n
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.DataFrame({"area": u / (p * n)}).assign(**{c: rows[c].iloc[0] for c in by})[[*by, "area"]]

    named = ", ".join(f"`{c}` {kind}" for c, kind in kinds)
    drawn = cells.repartitionByRange(*by, "s").sortWithinPartitions(*by, "s").select(*by, "a", "b").mapInPandas(draw, f"{named}, block int, part int, p array<double>, n array<double>, u array<double>")
    return drawn.groupBy(*by, "block").applyInPandas(join, f"{named}, area double")


def delta_interval(df: DataFrame, value: str, side: str, by: list[str], replicates: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by, low, high: the percentile interval of Cliff's delta of side 1 against side 2; null without both sides."""
    cells = df.filter(F.col(value).isNotNull() & F.col(side).isin(1, 2)).groupBy(*by, F.col(value).cast("double").alias("s"))
    cells = cells.agg(F.count_if(F.col(side) == 1).alias("a"), F.count_if(F.col(side) == 2).alias("b"))
    areas = replicated_areas(cells, list(by), replicates, seed)
    tail = (1 - level) / 2
    q = areas.groupBy(*by).agg(F.percentile(F.when(~F.isnan("area"), 2 * F.col("area") - 1), [tail, 1 - tail]).alias("q"))  # one value a replicate
    return q.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def kernel_density(df: DataFrame, value: str, by: str, points: int = 50, bins: int = 400, reach: float = 3.0) -> DataFrame:
    """(by, point, x, density): Gaussian kernel densities of each group on a grid of its range and ``reach`` bandwidths beyond.

    The bandwidth is the deviation times n to the power -1/5. Values are counted in bins of the range; each grid point then sums
    the kernel over the group's bins. Groups with fewer than two different values are left out.
    """
    x = F.col(value).cast("double")
    known = df.filter(x.isNotNull() & ~F.isnan(x)).select(F.col(by).alias("g"), x.alias("x"))
    told = known.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd")).filter("high > low")
    told = told.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    width = (F.col("high") - F.col("low")) / bins
    told = _written(told)
    joined = known.join(told.select(F.col("g").alias("k"), "low", "high"), F.col("g").eqNullSafe(F.col("k")))
    place = F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))
    counts = joined.groupBy("k", place.alias("bin")).agg(F.count("*").alias("c"))
    held = counts.groupBy("k").agg(F.collect_list(F.struct("bin", "c")).alias("held"))  # at most ``bins`` a group
    each = told.join(held, F.col("g").eqNullSafe(F.col("k")))
    grid = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.col("low") - reach * F.col("h") + F.col("point") * ((F.col("high") - F.col("low") + 2 * reach * F.col("h")) / (points - 1))

    def kernel(total: Column, s: Column) -> Column:
        z = (F.col("at") - (F.col("low") + (s["bin"] + 0.5) * width)) / F.col("h")
        return total + s["c"] * F.exp(-0.5 * z * z)

    density = F.aggregate(F.array_sort("held"), F.lit(0.0), kernel) / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi)))
    return grid.withColumn("at", at).select(F.col("g").alias(by), "point", F.col("at").alias("x"), density.alias("density"))
