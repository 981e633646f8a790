"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round floating columns at the output edge, never inside."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints, for queries about sources and sinks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        from tablemirror.session import cut
        cut(spark.range(1))     # settles the folder
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:8]}"
