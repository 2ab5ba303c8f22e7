"""How true synthetic series are: distances of distributions, correlation of autocorrelations and spectra, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .features import _floats
from .prefix import running_sums
from .tables import safe_corr

# Fixed values: (name, good, fair) limits of the verdicts; distances are good below, correlations above.
LIMITS = (("ks", 0.05, 0.10), ("wasserstein", 1.0, 3.0), ("acf_r", 0.98, 0.90), ("psd_r", 0.95, 0.85), ("xcorr_r", 0.90, 0.90))


def _sides(df: DataFrame, x: str, side: Column) -> DataFrame:
    return df.where(F.col(x).isNotNull()).select(F.col(x).alias("v"), side.cast("long").alias("a"), (1 - side.cast("long")).alias("b"))


def _steps(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row per distinct value v (of each group `by`), with both samples' distribution functions and the next value, from counts a and b of the two samples. Counts are partial sums: a value that is frequent is one row."""
    by = by or []
    g = rows.groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = running_sums(rows, g, "v", ["a", "b"], by)
    share = lambda c: F.try_divide(F.col(f"{c}_run").cast("double"), F.col(f"{c}_all"))
    return s.select(*by, "v", F.col("v_next").alias("next"), F.col("a_all").alias("n1"), F.col("b_all").alias("n2"), share("a").alias("f"), share("b").alias("g"))


def ks(df: DataFrame, x: str, side: Column) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value."""
    d = _steps(_sides(df, x, side)).agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("ks"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    z = F.col("ks") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")).cast("double"))
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * z * z) for k in range(1, 40)), F.lit(0.0))
    p = F.when(z < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))
    return d.select("ks", p.alias("p_value"))


def wasserstein(df: DataFrame, x: str, side: Column) -> DataFrame:
    """Wasserstein-1: the area between the two distribution functions."""
    s = _steps(_sides(df, x, side)).where("next IS NOT NULL")
    return s.agg(F.sum(F.abs(F.col("f") - F.col("g")) * (F.col("next") - F.col("v"))).alias("wasserstein"))


def _distances(steps: DataFrame, by: list[str]) -> DataFrame:
    gap = F.abs(F.col("f") - F.col("g"))
    return steps.groupBy(*by).agg(F.max(gap).alias("ks"), F.sum(F.when(F.col("next").isNotNull(), gap * (F.col("next") - F.col("v")))).alias("wasserstein"))


def distances(df: DataFrame, x: str, side: Column) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 as one row, from one pass over the distribution functions."""
    return _distances(_steps(_sides(df, x, side)), [])


def distances_from(sets: DataFrame, x: str, names: list[str]) -> DataFrame:
    """Both distances of each named set of samples (column strategy) from the samples without a name: only counts of values are sorted, and the common side is repeated as counts only. NULL and NaN don't count."""
    return distances_of(value_counts(sets, x), names)


def value_counts(sets: DataFrame, x: str) -> DataFrame:
    """How often each value occurs in each set of samples: strategy, v, n. NULL and NaN don't count."""
    return sets.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy("strategy", F.col(x).alias("v")).agg(F.count("*").alias("n"))


def distances_of(n: DataFrame, names: list[str]) -> DataFrame:
    """distances_from, of value_counts, which are read three times: keep them where samples are dear to make."""
    common, none = F.col("strategy").isNull(), F.lit(0).cast("long")
    of = F.when(common, F.array(*map(F.lit, names))).otherwise(F.array("strategy"))
    rows = n.select(F.explode(of).alias("strategy"), "v", F.when(common, F.col("n")).otherwise(none).alias("a"), F.when(common, none).otherwise(F.col("n")).alias("b"))
    return _distances(_steps(rows, ["strategy"]), ["strategy"])


def mean_curves(sets: DataFrame, max_lag: int) -> DataFrame:
    """Mean curves of each set of series (strategy, fhr, and perhaps uc), from one pass: strategy, curve, at, value.

    Curves are the autocorrelation at lags up to max_lag (of series with more valid samples than that), the logarithm
    of one plus the mean density by bin, and, where there is uc, the cross-correlation at lags -max_lag..max_lag. A task
    adds up its batch's curves, so what is shuffled is a row per batch, set and point, whatever the number of records.
    """
    pair = "uc" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, np.ndarray] = {}
            for r, strategy in enumerate(batch.column("strategy").to_pylist()):
                x = _floats(batch.column("fhr")[r])
                found = {"psd": kernels.welch(x)[1]}
                if np.isfinite(x).sum() > max_lag:
                    found["acf"] = kernels.autocorrelation(x, max_lag)
                if pair:
                    y = _floats(batch.column("uc")[r])
                    if len(y) == len(x):
                        found["xcorr"] = kernels.cross_correlation(x, y, max_lag)
                for name, curve in found.items():
                    point = np.stack([np.nan_to_num(curve), ~np.isnan(curve)])
                    have = sums.get((strategy, name), np.zeros((2, 0)))
                    more = np.zeros((2, max(have.shape[1], point.shape[1])))
                    more[:, : have.shape[1]] += have
                    more[:, : point.shape[1]] += point
                    sums[strategy, name] = more
            for (strategy, name), (total, n) in sums.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([strategy] * k, pa.string()), pa.array([name] * k, pa.string()), pa.array(np.arange(k, dtype=np.int32)), pa.array(total), pa.array(n)], ["strategy", "curve", "at", "total", "n"])

    columns = ["fhr", *["uc"] * pair]
    rows = sets.select("strategy", *[F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")).alias(c) for c in columns])
    sums = rows.mapInArrow(run, "strategy string, curve string, at int, total double, n double")
    mean = sums.groupBy("strategy", "curve", "at").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m")).where("m IS NOT NULL")
    return mean.select("strategy", "curve", "at", F.when(F.col("curve") == "psd", F.log1p("m")).otherwise(F.col("m")).alias("value"))


def curve_correlations(curves: DataFrame, names: list[str]) -> DataFrame:
    """A row per named set that has curves: the correlation of each of its mean curves with that of the set without a name, as <curve>_r; NULL if one is flat."""
    own = curves.where("strategy IS NULL").select("curve", "at", F.col("value").alias("__own"))
    r = curves.where("strategy IS NOT NULL").join(own, ["curve", "at"]).groupBy("strategy", "curve").agg(safe_corr(F.col("__own"), F.col("value")).alias("r"))
    return r.groupBy("strategy").agg(*[F.max(F.when(F.col("curve") == c, F.col("r"))).alias(f"{c}_r") for c in names])


def mean_curve(curves: DataFrame, axis: str, value: str) -> DataFrame:
    return curves.groupBy(axis).agg(F.avg(value).alias(value))


def curve_correlation(a: DataFrame, b: DataFrame, axis: str, value: str) -> DataFrame:
    """Pearson correlation of two curves on their common axis; NULL if one is flat."""
    return a.select(axis, F.col(value).alias("__a")).join(b.select(axis, F.col(value).alias("__b")), axis).agg(safe_corr(F.col("__a"), F.col("__b")).alias("r"))


def curve_bias(a: DataFrame, b: DataFrame, axis: str, value: str, points: list[int]) -> DataFrame:
    """Both curves and their difference at some points of the axis."""
    j = a.where(F.col(axis).isin(points)).select(axis, F.col(value).alias("original")).join(b.select(axis, F.col(value).alias("synthetic")), axis)
    return j.withColumn("bias", F.col("synthetic") - F.col("original"))


def verdict(name: str, value: Column) -> Column:
    """good, fair or poor."""
    good, fair = next((g, f) for n, g, f in LIMITS if n == name)
    low = good < fair
    return F.when(value < good if low else value > good, "good").when(value < fair if low else value > fair, "fair").otherwise("poor")


def summary(measures: DataFrame) -> DataFrame:
    """measures (strategy, and some of ks, wasserstein, acf_r, psd_r, xcorr_r) with a verdict each; that of cross-correlation knows no fair."""
    return measures.withColumns({f"{n}_verdict": verdict(n, F.col(n)) for n, _, _ in LIMITS if n in measures.columns})
