"""The driver's tables as the engine's inputs: `events` is a set of series, one per user, with gaps at every seventh event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The series in SQL; queries below start with it.
SERIES = """WITH s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
  CASE WHEN event_id % 7 <> 0 THEN value END AS x, value, event_type, event_id FROM events)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i, x (with gaps), value, event_type, event_id."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("bigint").alias("i"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"), "value", "event_type", "event_id")


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as arrays: record, fhr (brought into its range), uc."""
    s = series(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return s.select(F.col("user_id").cast("string").alias("record"), F.transform("v", lambda p: p["x"] / 4 + 90).alias("fhr"), F.transform("v", lambda p: p["x"] / 10).alias("uc"))
