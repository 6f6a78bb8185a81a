"""Group comparison by ranks, correlations, classifier quality; every family is one grouped plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import average_ranks, upto


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z) of the standard normal."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


def exact_tail(u: float, m: int, n: int) -> float:
    """P(U >= u) without ties, by counting rank sums."""
    ways = [1] + [0] * (m * n)
    for k in range(1, m + 1):
        # Gaussian binomial: multiply by (1 - q^(n+k)), divide by (1 - q^k).
        for i in range(m * n, n + k - 1, -1):
            ways[i] -= ways[i - n - k]
        for i in range(k, m * n + 1):
            ways[i] += ways[i - k]
    return sum(ways[math.ceil(u) :]) / sum(ways)


def mann_whitney(df: DataFrame, value: str, side: str, by: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """Per family: n1, n2, means, U of side 1, Cliff's delta, z and p; ``side`` holds 1 or 2.

    Ranks come from counts of distinct values, so a family of any size moves one row per value and side.
    z carries the tie correction and the continuity correction. p is exact for small
    samples without ties (either side at most 8), normal otherwise.
    """
    clean = df.filter(F.col(value).isNotNull() & F.col(side).isin(1, 2))
    cells = clean.groupBy(*by, value).agg(F.count_if(F.col(side) == 1).alias("a"), F.count_if(F.col(side) == 2).alias("b"))
    t = F.col("a") + F.col("b")
    ranked = upto(cells.withColumn("both", t), by, [value], "upto", value="both").withColumn("rank", F.col("upto") - (t - 1) / 2)
    s = ranked.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), (F.sum(F.col("a") * F.col(value)) / F.sum("a")).alias("mean1"),
        (F.sum(F.col("b") * F.col(value)) / F.sum("b")).alias("mean2"), F.sum(F.col("a") * F.col("rank")).alias("r1"),
        F.sum((t * t * t - t).cast("double")).alias("ties"),
    ).filter("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    s = s.withColumn("delta", 2 * F.col("u") / (n1 * n2) - 1)
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u = F.greatest(F.col("u"), n1 * n2 - F.col("u")) if alternative == "two-sided" else F.col("u") if alternative == "greater" else n1 * n2 - F.col("u")
    s = s.withColumn("z", F.when(sigma > 0, (u - n1 * n2 / 2 - 0.5) / sigma))
    factor = 2 if alternative == "two-sided" else 1

    @F.pandas_udf(T.DoubleType())
    def exact(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, factor * exact_tail(x, int(a), int(b))) for x, a, b in zip(u, m, n)])

    small = ((F.col("n1") <= 8) | (F.col("n2") <= 8)) & (F.col("ties") == 0) & (F.col("n1") * F.col("n2") <= 4000)
    whole = s.filter(small).withColumn("p", exact(u, F.col("n1"), F.col("n2")))
    normal = s.filter(~small).withColumn("p", F.least(F.lit(1.0), factor * normal_tail("z")))
    return whole.unionByName(normal).drop("r1", "ties")


#: The named comparisons (name, first group, second group) and the pooled one.
COMPARISONS = (
    ("GSQ vs GBLM", "GSQ", "GBLM"), ("T50Q vs T50LM", "T50Q", "T50LM"), ("GSQ vs NLB", "GSQ", "NLB"), ("GPQ vs NLB", "GPQ", "NLB"),
    ("T50Q vs NLB", "T50Q", "NLB"), ("GPQ vs GSQ", "GPQ", "GSQ"), ("GSQ vs T50Q", "GSQ", "T50Q"),
)
POOLED = ("Extraordinary vs Ordinary", ("GSQ", "GPQ", "T50Q"), ("GBLM", "T50LM", "NLB"))


def comparison_rows(metrics: DataFrame, plan: Sequence[tuple[str, Sequence[str], Sequence[str]]], source: str = "source") -> DataFrame:
    """Long metrics times the plan: each row once for every comparison that its group takes part in."""
    pairs = [(name, g, k) for name, a, b in plan for k, groups in ((1, a), (2, b)) for g in ([groups] if isinstance(groups, str) else groups)]
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.lit(g).alias("__g"), F.lit(k).alias("side")) for n, g, k in pairs]))
    return metrics.withColumn("__c", table).filter(F.col("__c.__g") == F.col(source)).select(*metrics.columns, "__c.comparison", "__c.side")


def spearman(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over the rows where both are known."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key, x, y)
    ranked = average_ranks(average_ranks(both, x, by, "__rx"), y, by, "__ry")
    return ranked.groupBy(*by).agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def correlations(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def binary_quality(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision and recall of class 1, macro F1."""
    is_ = lambda l, p: F.count_if((F.col(label) == l) & (F.col(predicted) == p)).cast("double")
    c = df.groupBy(*by).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(0, 0).alias("tn"), is_(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(
        *by, ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        ((safe(2 * tp, 2 * tp + fp + fn) + safe(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"),
    )


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positive rates at each distinct score, from the highest."""
    cells = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    summed = upto(upto(cells, by, [score], "__upto_p", value="p", total="__all_p"), by, [score], "__upto_n", value="n", total="__all_n")
    rate = lambda c: F.try_divide(F.col(f"__all_{c}") - F.col(f"__upto_{c}") + F.col(c), F.col(f"__all_{c}"))  # noqa: E731  from the score up
    return summed.select(*by, score, rate("p").alias("tpr"), rate("n").alias("fpr"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """ROC area: U of the positives over the number of pairs."""
    sided = df.withColumn("__side", F.when(F.col(label) == 1, 1).otherwise(2))
    return mann_whitney(sided, score, "__side", by).select(*by, (F.col("u") / (F.col("n1") * F.col("n2"))).alias("auc"))
