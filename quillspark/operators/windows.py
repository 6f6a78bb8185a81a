"""Ordered computations within groups, top-k and sampling by a shared hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, value: str, order: Sequence[str | Column], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the last ``size`` rows; null until there are so many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumn("rolling", F.when(F.count(F.lit(1)).over(w) == size, F.avg(value).over(w)))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1, ties share their mean: running sums of the counts of distinct values, over ranges of them."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    summed = upto(counts, by, [value], "__upto", value="__n")
    ranks = summed.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def differences(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def adjacent_islands(df: DataFrame, order: Sequence[str], same: Column, by: Sequence[str] = ()) -> DataFrame:
    """Numbers runs of rows in which each is ``same`` as the row before it (``same`` may use __prev_* from ``with_previous``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("__start", start).withColumn("island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def with_previous(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"__prev_{c}": F.lag(c).over(w) for c in columns})


def benjamini_hochberg(df: DataFrame, p: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p-values of each family, at most 1."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    raw = F.col(p) * F.count("*").over(Window.partitionBy(*by)) / F.row_number().over(up)
    down = Window.partitionBy(*by).orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    staged = df.withColumns({"__raw": raw, "__rn": F.row_number().over(up)})
    return staged.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__raw", "__rn")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, out: str = "rn") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, rn).filter(F.col(out) <= k)


def both_ends(df: DataFrame, value: str, tie: str, by: Sequence[str], k: int = 20) -> DataFrame:
    """The k lowest and k highest of each group, of groups with at least 2k rows; the highest best first."""
    held = df.filter(F.col(value).isNotNull())
    large = held.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= 2 * k).toDF(*[f"__{c}" for c in by], "__n")
    # Each side is cut to k rows a group before its shuffle.
    lows = top_per_group(held, by, [value, tie], k, "place").withColumn("side", F.lit("low"))
    highs = top_per_group(held, by, [F.col(value).desc(), tie], k, "place").withColumn("side", F.lit("high"))
    return lows.unionByName(highs).join(large, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop("__n", *[f"__{c}" for c in by])


def upto(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, value: str | None = None, total: str | None = None) -> DataFrame:
    """Each row's place in its group, from 1, or the running sum of ``value``, and on demand the group's ``total``.

    Rows are dealt by ranges of group and order and written, so that a group of any size is spread;
    the sums of each range's groups, one row each, give the offsets. Places need an order without ties.
    """
    from ..sources.files import materialize

    # Written once: a second evaluation could draw other range bounds.
    placed = materialize(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    each = F.sum(value) if value else F.count("*")
    sums = placed.groupBy("__part", *by).agg(each.alias("__s"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__s").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumns({"__before": before, "__total": F.sum("__s").over(group)})
    offsets = offsets.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], "__before", "__total")
    inner = Window.partitionBy("__part", *by).orderBy(*order)
    here = F.sum(value).over(inner) if value else F.row_number().over(inner)
    same = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
    joined = placed.withColumn("__here", here).join(offsets, same).withColumn(out, F.col("__before") + F.col("__here"))
    if total:
        joined = joined.withColumn(total, F.col("__total"))
    return joined.select(*df.columns, out, *([total] if total else []))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """by and an array of the linear quantiles of each group, exactly, nulls left out; distinct values lie in ranges, so no task holds a group's."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = upto(cells, by, ["__v"], "__upto", value="__n", total="__all")
    before, found = F.col("__upto") - F.col("__n"), []
    for k, share in enumerate(shares):
        place = (F.col("__all") - 1) * float(share)
        for name, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when((before <= at) & (at < F.col("__upto")), F.col("__v"))).cast("double").alias(f"__{name}{k}"))
    ends = placed.groupBy(*by).agg(F.max("__all").alias("__all"), *found)

    def between(k: int, share: float) -> Column:
        place, low, high = (F.col("__all") - 1) * float(share), F.col(f"__low{k}"), F.col(f"__high{k}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return ends.select(*by, F.array(*[between(k, s) for k, s in enumerate(shares)]).alias(out))


def shared_hash(column: str | Column, seed: int = 42) -> Column:
    """A 32-bit hash that other engines give too: the first 8 hex digits of md5(id|seed)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("bigint")


def uniform(column: str, seed: int = 42) -> Column:
    """Uniform in (0, 1) from the shared hash."""
    return (shared_hash(column, seed) + 1) / F.lit(4294967297.0)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(shared_hash(key, seed), key).limit(n)


def sample_priority(df: DataFrame, key: str, first: Column, n: int, seed: int = 42) -> DataFrame:
    """All rows of priority come first, the rest fills up."""
    return df.orderBy(F.coalesce(first, F.lit(False)).desc(), shared_hash(key, seed), key).limit(n)


def sample_weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Without replacement, by exponential keys -ln(u)/w."""
    return df.filter(F.col(weight) > 0).orderBy(-F.log(uniform(key, seed)) / F.col(weight), key).limit(n)


def one_per_group(df: DataFrame, by: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    return keep_first(df, by, [shared_hash(key, seed), key])


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    placed = upto(df.withColumn("__hash", shared_hash(key, seed)), [label], ["__hash", key], "__place")
    return placed.withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__hash", "__place")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column is_test: the first share of each label in hash order."""
    placed = upto(df.withColumn("__hash", shared_hash(key, seed)), [label], ["__hash", key], "__place", total="__all")
    return placed.withColumn("is_test", F.col("__place") <= F.floor(F.col("__all") * test_share + 0.5)).drop("__hash", "__place", "__all")
