"""Queries on the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one data folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are costly to process.  A scan with fewer partitions than
        the session has cores (a file of one row group) is dealt out to all of them;
        any larger input is left as it is read."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``, with its SQL if it has one."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def sql_keywords(text: str) -> str:
    """SQL for the keyword list of an expression."""
    stop = ", ".join(f"'{w}'" for w in K.STOPWORDS)
    return (f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), "
            f"lambda w: length(w) > 2 AND w NOT IN ({stop})))")


def sql_overlap(ext: str, ref: str) -> str:
    return f"len(list_intersect({ref}, {ext}))"


def sql_need(n: str) -> str:
    return f"greatest(1, {n} // 3)"
