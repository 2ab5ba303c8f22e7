"""Longitudinal features of ordered windows, and alerts along them: one window per sequence, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def lag_delta(x: str, w: WindowSpec, k: int = 2) -> Column:
    """The value less that of k rows before."""
    return F.col(x) - F.lag(x, k).over(w)


def falling_streak(df: DataFrame, x: str, keys: list[str], order: str, out: str) -> DataFrame:
    """Consecutive strict decreases up to each row; a rise, a tie or a missing value starts again at 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__d", F.coalesce((F.col(x) < F.lag(x).over(w)).cast("int"), F.lit(0)))
    df = df.withColumn("__g", F.sum(1 - F.col("__d")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum("__d").over(inner)).drop("__d", "__g")


def rolling_slope(df: DataFrame, y: str, t: str, keys: list[str], out: str, rows: int = 6, step: float = 5.0) -> DataFrame:
    """Least-squares slope over the last `rows` rows, if they are evenly `step` apart and two values at least are there; else NULL.

    Sums go from the first row to the last, times count from the last: every engine that adds so has the same bits.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    frame = w.rowsBetween(1 - rows, 0)
    tol = 1e-6 + 1e-5 * abs(step)
    back = range(rows - 1, 0, -1)
    df = df.withColumn("__gap", (F.abs(F.col(t) - F.lag(t).over(w) - step) <= tol).cast("int"))
    even = F.coalesce(F.sum("__gap").over(w.rowsBetween(2 - rows, 0)), F.lit(0)) == rows - 1
    enough = (F.count("*").over(frame) == rows) & (F.count(y).over(frame) >= 2)
    held = df.select("*", (even & enough).alias("__use"), *[F.lag(y, k).over(w).cast("double").alias(f"__y{k}") for k in back], *[(F.lag(t, k).over(w) - F.col(t)).cast("double").alias(f"__t{k}") for k in back])
    held = held.withColumns({"__y0": F.col(y).cast("double"), "__t0": F.lit(0.0)})
    add = lambda term: reduce(lambda total, k: total + F.when(F.col(f"__y{k}").isNotNull(), term(F.col(f"__y{k}"), F.col(f"__t{k}"))).otherwise(0.0), [*back, 0], F.lit(0.0))
    held = held.withColumns({"__n": add(lambda v, d: F.lit(1.0)), "__s": add(lambda v, d: d), "__q": add(lambda v, d: d * d)})
    slope = F.try_divide(add(lambda v, d: (F.col("__n") * d - F.col("__s")) * v), F.col("__n") * F.col("__q") - F.col("__s") * F.col("__s"))
    return held.select(*[c for c in df.columns if c not in ("__gap", out)], F.when(F.col("__use"), slope).alias(out))


def add_trends(df: DataFrame, keys: list[str], order: str, deltas: dict[str, str] | None = None, streaks: dict[str, str] | None = None, slopes: dict[str, str] | None = None) -> DataFrame:
    """Trend columns by name, each of one column: differences over two windows, falling streaks and slopes, with 0 where they can't be told. The windows share one exchange and sort."""
    w = Window.partitionBy(*keys).orderBy(order)
    for name, x in (deltas or {}).items():
        df = df.withColumn(name, F.coalesce(lag_delta(x, w), F.lit(0.0)))
    for name, x in (streaks or {}).items():
        df = falling_streak(df, x, keys, order, name)
    for name, x in (slopes or {}).items():
        df = rolling_slope(df, x, order, keys, name).na.fill(0.0, [name])
    return df


def persistent_start(df: DataFrame, alert: str, key: str, order: str) -> DataFrame:
    """Per key the first position of the last run of alerts, if it reaches the last row; NULL otherwise."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    quiet = F.sum((~F.coalesce(F.col(alert), F.lit(False))).cast("int")).over(w)
    return df.withColumn("__quiet", quiet).groupBy(key).agg(F.min(F.when(F.col("__quiet") == 0, F.col(order))).alias("persistent_start"))


def patient_rollup(df: DataFrame, key: str, order: str, alert: str, target: str, to_birth: str) -> DataFrame:
    """Per patient: target, whether any window alerts, where the persistent alert starts, and the early-warning time of true positives."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    flag = F.coalesce(F.col(alert), F.lit(False))
    d = df.withColumn("__quiet", F.sum((~flag).cast("int")).over(w))
    start = F.min(F.when(F.col("__quiet") == 0, F.struct(order, to_birth)))
    return d.groupBy(key).agg(F.max(target).alias("target"), F.max(flag.cast("int")).alias("any_alert"), start[order].alias("persistent_start"), start[to_birth].alias("__t")).withColumn("ewt", F.when(F.col("target") == 1, F.col("__t"))).drop("__t")


def live_metrics(patients: DataFrame) -> DataFrame:
    """Patients alerted per patient truly at risk (infinite if none), recall, and median early-warning time, of a patient_rollup."""
    tp = F.count_if((F.col("target") == 1) & (F.col("any_alert") == 1))
    alerts, positive = F.sum("any_alert"), F.sum("target")
    return patients.agg(
        F.when(tp > 0, alerts / tp).otherwise(float("inf")).alias("nna"),
        F.try_divide(tp.cast("double"), positive).alias("recall"),
        F.try_divide(F.count_if((F.col("target") == 1) & F.col("persistent_start").isNotNull()).cast("double"), positive).alias("persistent_recall"),
        F.median("ewt").alias("ewt_median"),
        F.avg("ewt").alias("ewt_mean"),
    )
