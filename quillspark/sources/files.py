"""Files in and out: declared schemas, whole-text folders, vectors, journeys, reports, resumable appends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that tabular readers take for missing.
MISSING = ("", "#N/A", "N/A", "NA", "NaN", "nan", "None", "null", "NULL", "n/a")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary one where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/quillspark-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Header, quoted fields with line breaks and doubled quotes; missing marks become null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).csv(path)
    return raw.select(*[F.when(~F.col(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    if decimals is not None:
        floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = df.withColumns({c: F.format_string(f"%.{decimals}f", F.col(c)) for c in floats})
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_articles(spark: SparkSession, folder: str, mark: str = "@highlight") -> DataFrame:
    """Whole text files that the mark parts in exactly two: path, context, quote, in order of path."""
    parts = F.split("value", mark)
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parts.alias("p"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return raw.filter(F.size("p") == 2).select("path", strip(F.col("p")[0]).alias("context"), strip(F.col("p")[1]).alias("quote")).orderBy("path")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec of a text file with a word and its numbers on each line; a header line of two numbers is left out."""
    cells = F.split("value", " ")
    raw = spark.read.text(path).select(cells.alias("c")).filter(F.size("c") > 2)
    return raw.select(F.col("c")[0].alias("word"), F.transform(F.slice("c", 2, F.size("c") - 1), lambda x: x.cast("float")).alias("vec"))


def read_npz(spark: SparkSession, folder: str) -> DataFrame:
    """ids and vectors of NumPy archives, read by the executors from their bytes."""
    return npz_rows(spark.read.format("binaryFile").load(folder))


def npz_rows(files: DataFrame) -> DataFrame:
    """row_id and embedding of archives in the column ``content``."""
    import io

    import numpy as np

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content))
                if not {"ids", "vectors"} <= set(z.files):
                    raise ValueError("an archive needs ids and vectors")
                yield pd.DataFrame({"row_id": z["ids"].astype("int64"), "embedding": list(z["vectors"].astype("float32"))})

    return files.select("content").mapInPandas(load, "row_id long, embedding array<float>")


def pack_npz(vectors: DataFrame) -> DataFrame:
    """``content``: an archive of ids and vectors for each batch of (row_id, embedding)."""
    import io

    import numpy as np

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = io.BytesIO()
                np.savez(out, ids=b["row_id"].to_numpy(), vectors=np.stack(b["embedding"].to_list()))
                yield pd.DataFrame({"content": [out.getvalue()]})

    return vectors.select("row_id", "embedding").mapInPandas(pack, "content binary")


def read_sqlite(spark: SparkSession, folder: str, query: str, schema: str) -> DataFrame:
    """Rows of a query over database files, each read by one task from its bytes; order and limit belong in the query."""
    return sqlite_rows(spark.read.format("binaryFile").load(folder), query, schema)


def sqlite_rows(files: DataFrame, query: str, schema: str) -> DataFrame:
    """Rows of a query over each database in the column ``content``."""
    import sqlite3

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                yield pd.read_sql_query(query, con)
                con.close()

    return files.select("content").mapInPandas(load, schema)


def pack_sqlite(rows: DataFrame, name: str) -> DataFrame:
    """``content``: a database with one table for each batch of rows."""
    import sqlite3

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                con = sqlite3.connect(":memory:")
                b.to_sql(name, con, index=False)
                yield pd.DataFrame({"content": [con.serialize()]})
                con.close()

    return rows.mapInPandas(pack, "content binary")


def write_journeys(journeys: DataFrame, path: str) -> None:
    """One JSON object per row; empty journeys are left out."""
    journeys.filter(F.size("steps") > 0).write.json(path)


def read_journeys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the sink lacks; returns how many keys it then has."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(done, keys, "left_anti")
    except Exception as e:  # the sink does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).select(*keys).distinct().count()


def map_distinct(df: DataFrame, keys: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` runs on the distinct keys only, its columns are joined back: for look-ups that cost."""
    return df.join(f(df.select(*keys).distinct()), keys, "left")


def fetch(keys: DataFrame, schema: str, get: Callable[[tuple], list[tuple]], retries: int = 3) -> DataFrame:
    """Rows that a slow outer source gives for each key row, asked by the executors; a failing call is tried again.

    Give distinct keys (see ``map_distinct``): every row is one call.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b.itertuples(index=False, name=None):
                for left in reversed(range(retries)):
                    try:
                        rows += get(key)
                        break
                    except OSError:
                        if not left:
                            raise
            yield pd.DataFrame(rows, columns=names)

    return keys.mapInPandas(run, schema)


def read_pages(spark: SparkSession, folder: str, recognise: Callable[[bytes], str]) -> DataFrame:
    """file name and recognised text of image files; the recogniser is the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"filename": b["path"].str.rsplit("/", n=1).str[-1], "text": [recognise(bytes(c)) for c in b["content"]]})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "filename string, text string")


# Figures that text reports state.
REPORT_FIGURES = {
    "accuracy": r"Accuracy[^:]*:\s*([0-9.]+)", "auc": r"AUC[^:]*:\s*([0-9.]+)", "silhouette": r"Silhouette[^:]*:\s*(-?[0-9.]+)",
}


def report_figures(text: Column) -> dict[str, Column]:
    """Figures of a report text, and the mean of all effect sizes that it states."""
    out = {k: F.regexp_extract(text, p, 1).try_cast("double") for k, p in REPORT_FIGURES.items()}
    deltas = F.transform(F.regexp_extract_all(text, F.lit(r"Cliff's Delta[^:]*:\s*(-?[0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    out["mean_delta"] = F.when(F.size(deltas) > 0, F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.size(deltas))
    return out
