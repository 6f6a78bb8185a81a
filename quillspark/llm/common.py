"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one of so many rows is joined by broadcast; there are at most so many of them.
HOT_SHARE = 2000

#: Folders written inside each open ``scratch`` block.
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, what ``materialize`` wrote inside it; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def hot_join(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a table of one row for each key, whose column ``size`` counts the key's rows.

    Keys that many rows share meet them by broadcast, so that no task gets all of a large group.
    """
    hot = F.broadcast(named.filter(F.col("size") * HOT_SHARE > total).drop("size"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(named.drop("size"), key))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each made longer until ``df`` has no column of that name in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_places(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two columns that tell them apart, file and row number, and the names of those.

    What is not read straight from Parquet files is written first.
    """
    f, r = free_names(docs, "file", "row")

    def placed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(at["file_path"]).alias(f), at["row_index"].alias(r))

    try:
        return placed(docs), [f, r]
    except AnalysisException:
        return placed(materialize(docs)), [f, r]


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def bounded_sample(df: DataFrame, id_col: str, by: str, per_class: int) -> DataFrame:
    """Rows of each class chosen by a hash of the id, about ``per_class`` of each at most.

    The share is set from the class counts, so that the sample stays bounded at any size.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect() if r[0] is not None}
    if not counts:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.filter(F.col(by).isNotNull() & (draw < share[F.col(by)]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
