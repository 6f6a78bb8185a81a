"""Declared schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

QUOTES = T.StructType.fromDDL("QUOTE string, LIKES double, AUTHOR string, TITLE string, TAGS string")
CORPUS_LONG = T.StructType.fromDDL("row_id bigint, source string, text string")
METRICS_LONG = T.StructType.fromDDL("row_id bigint, source string, metric string, value double")
VECTORS = T.StructType.fromDDL("row_id bigint, source string, embedding array<float>")
JOURNEY = T.StructType.fromDDL("row_id bigint, source string, steps array<struct<pos:int,token:string,value:double>>")


def require_columns(df: DataFrame, columns: list[str], skip: bool = False) -> list[str]:
    """The columns that are there; a missing one raises unless ``skip``."""
    missing = [c for c in columns if c not in df.columns]
    if missing and not skip:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in columns if c not in missing]


#: Metric columns of wide tables: prefix per text group, and the longer prefixes that lexical diversity uses.
PREFIXES = {"GSQ": "sample", "GPQ": "popular", "GBLM": "snippet", "T50Q": "t50", "T50LM": "t50freelength", "NLB": "nonlit"}
LEX_DIV_PREFIXES = {
    "GSQ": "sample", "GPQ": "popular", "GBLM": "matched_snippet", "T50Q": "t50_quote",
    "T50LM": "t50_quote_free_context_length_matched", "NLB": "nonlit_baseline",
}


def metric_column(source: str, stem: str) -> str:
    prefixes = LEX_DIV_PREFIXES if stem == "lex_div" else PREFIXES
    return f"{prefixes[source]}_{stem}"
