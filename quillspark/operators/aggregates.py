"""Grouped summaries, frequencies, shares, bins and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import for_java

from ..sources.files import materialize
from .windows import exact_quantiles


def describe(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (linear) and max of each group; no task holds a group's values."""
    held = materialize(df.select(*by, value))  # read twice
    sums = held.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    quartiles = exact_quantiles(held, value, by, (0.25, 0.5, 0.75), "__q").withColumnsRenamed({c: f"__{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = sums.join(quartiles, same, "left") if by else sums.join(quartiles, how="left")
    return out.withColumns({"q25": F.col("__q")[0], "q50": F.col("__q")[1], "q75": F.col("__q")[2]}).select(*by, "n", "mean", "std", "low", "high", "q25", "q50", "q75")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the values of a column, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__all")).alias("share"))


def token_counts(df: DataFrame, tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def joined_in_order(value: str, order: str, separator: str) -> Column:
    """Texts of a group joined in an explicit order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("__v"))))
    return F.array_join(F.transform(pairs, lambda x: x["__v"]), separator)


def health(df: DataFrame) -> DataFrame:
    """Per column: nulls and distinct values; with the rows and fully repeated rows of the table."""
    names = df.columns
    stats = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(names)], *[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(names)])
    distinct = df.distinct().agg(F.count("*").alias("__distinct"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls"), F.col(f"d_{i}").alias("distinct_values")) for i, c in enumerate(names)]))
    return stats.join(distinct).select(cells.alias("c"), "rows", (F.col("rows") - F.col("__distinct")).alias("repeated_rows")).select("c.*", "rows", "repeated_rows")


def retention(before: DataFrame, after: DataFrame, text: str) -> DataFrame:
    """Characters kept, in percent; none of none is 0, some of none is infinite."""
    a = before.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("original"))
    b = after.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("cleaned"))
    share = F.when(F.col("original") > 0, F.col("cleaned") / F.col("original") * 100).when(F.col("cleaned") > 0, F.lit(float("inf"))).otherwise(0.0)
    return a.join(b).withColumn("percent", share)


def equal_width_bins(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal-width bins over the observed or the given range; the last bin is closed."""
    if low is None:
        bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        df = df.join(F.broadcast(bounds))
    else:
        df = df.withColumns({"__lo": F.lit(float(low)), "__hi": F.lit(float(high))})
    at = F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    at = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    return df.groupBy(label).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def concentration(df: DataFrame, value: str, key: str, heads: Sequence[float]) -> DataFrame:
    """Share of the total held by the leading floor(n x head) rows."""
    from .joins import ranked

    by = ranked(df.select((-F.col(value)).alias("__neg"), key, value).withColumn("__o", F.struct("__neg", key)), "__o", "rn")
    total = df.agg(F.count("*").alias("n"), F.sum(value).alias("all"))
    head = F.explode(F.array(*[F.lit(float(h)) for h in heads])).alias("head")
    cuts = total.select("n", "all", head)
    hit = by.join(F.broadcast(cuts), F.col("rn") <= F.floor(F.col("n") * F.col("head")))
    sums = hit.groupBy("head").agg(F.sum(value).alias("held"), F.count("*").alias("rows"))
    return cuts.join(sums, "head", "left").select("head", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("held", F.lit(0.0)) / F.col("all")).alias("share"))


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*index).pivot(column, list(values)).agg(F.avg(value))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def regex_totals(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(for_java(p)))), F.lit(0)).cast("bigint").alias(n) for n, p in patterns.items()])


def running_share(df: DataFrame, value: str, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_share", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(*by)))
