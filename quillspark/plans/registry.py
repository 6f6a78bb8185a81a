"""Queries by name, with the survey ids they cover and, where SQL can say it, their SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    ids: tuple[str, ...]
    build: Build
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(ids: str, sql: str | None = None):
    """Registers a query under its function's name."""

    def wrap(build: Build) -> Build:
        if build.__name__ in PLANS:
            raise ValueError(f"two queries named {build.__name__}")
        PLANS[build.__name__] = Plan(build.__name__, tuple(ids.split()), build, sql)
        return build

    return wrap


class Tables:
    """Access to the input tables by name: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
