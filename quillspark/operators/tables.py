"""Projections, filters and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import exact_quantiles


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Upper-case names, missing columns as null, columns in the order of ``schema``."""
    upper = df.toDF(*[c.upper() for c in df.columns])
    return upper.select(*[(F.col(f.name) if f.name in upper.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def rename_drop(df: DataFrame, renames: Mapping[str, str], drops: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(dict(renames)).drop(*drops)


def map_values(df: DataFrame, column: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mapped value, or the value itself where the lookup has none."""
    found = lookup.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(found, F.col(column) == F.col("__k"), "left").withColumn(out, F.coalesce("__v", column)).drop("__k", "__v")


def replace_values(column: str | Column, mapping: Mapping[str, str]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(pairs[c], c)


def to_number(column: str | Column, default: float | None = None) -> Column:
    """Double, or ``default`` where the text is none."""
    c = F.col(column) if isinstance(column, str) else column
    number = c.cast("string").try_cast("double")
    return number if default is None else F.coalesce(F.nanvl(number, F.lit(float(default))), F.lit(float(default)))


def to_count(column: str | Column) -> Column:
    return F.floor(to_number(column, 0)).cast("bigint")


def classify_columns(df: DataFrame, text_words: Sequence[str], metadata_words: Sequence[str]) -> dict[str, list[str]]:
    """Column names by part: text (word and string type), metadata (word), metric (numeric rest)."""
    out: dict[str, list[str]] = {"text": [], "metadata": [], "metric": []}
    for f in df.schema:
        low = f.name.lower()
        if any(w in low for w in metadata_words):
            out["metadata"].append(f.name)
        elif isinstance(f.dataType, T.StringType) and any(w in low for w in text_words):
            out["text"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out["metric"].append(f.name)
    return out


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each name with the longest prefix p for which the name starts with p and an underscore."""
    met = names.join(prefixes, F.col(name).startswith(F.concat(F.col(prefix), F.lit("_"))), "left")
    return met.groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the exact median of their column over the whole table."""
    filled = df
    for c in columns:
        filled = filled.join(F.broadcast(exact_quantiles(df, c, [], (0.5,), "__q").select(F.col("__q")[0].alias(f"__m_{c}"))), how="left")  # one row, or none
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def has_text(column: str) -> Column:
    return F.coalesce(F.length(F.trim(column)) > 0, F.lit(False))


def drop_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [has_text(c) for c in columns]))


def not_in(column: str, values: Sequence) -> Column:
    """Rows whose value is not listed; a null is not listed and stays."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def starts_with_any(column: str, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes])


#: Cells that count as empty, and as unknown, after trimming and in lower case.
EMPTY_CELLS = ("", "nan", "none")
UNKNOWN_CELLS = ("", "unknown", "not found")


def is_empty_cell(column: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin(*EMPTY_CELLS), F.lit(True))


def is_unknown(column: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin(*UNKNOWN_CELLS), F.lit(True))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [~is_empty_cell(c) for c in columns]))


def tukey_fence(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Rows with columns low, high and inside: the fences from exact quartiles of each group."""
    q = exact_quantiles(df, value, by, (0.25, 0.75), "__q")
    low, high = F.col("__q")[0], F.col("__q")[1]
    joined = df.join(q, list(by)) if by else df.join(F.broadcast(q))
    out = joined.withColumns({"low": low - k * (high - low), "high": high + k * (high - low)}).drop("__q")
    return out.withColumn("inside", F.col(value).between(F.col("low"), F.col("high")))


def changed(before: str, after: str) -> Column:
    return ~F.col(before).eqNullSafe(F.col(after))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shared_columns(parts: Sequence[DataFrame]) -> list[str]:
    """Columns that all frames have, sorted."""
    return sorted(set.intersection(*[set(p.columns) for p in parts]))
