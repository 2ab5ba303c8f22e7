"""Signal features of whole records or windows: array columns go to Python once, everything else stays relational."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.clinical import birth_minute


def _floats(v: pa.Scalar) -> np.ndarray:
    return np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0)


def extract(df: DataFrame, keys: list[str], fhr: str = "fhr", uc: str = "uc", fs: int = kernels.FS) -> DataFrame:
    """The 28 features beside the keys. Missing results are NULL."""
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], *[f"{n} double" for n in kernels.FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernels.features(_floats(a), _floats(b), fs) for a, b in zip(batch.column(len(keys)), batch.column(len(keys) + 1), strict=True)]
            cols = [pa.array([r[n] for r in rows], pa.float64(), from_pandas=True) for n in kernels.FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *cols], [*keys, *kernels.FEATURES])

    return df.select(*keys, F.col(fhr).cast("array<double>"), F.col(uc).cast("array<double>")).mapInArrow(run, schema)


def invalid_pct(x: Column, low: float, high: float, zero_missing: bool) -> Column:
    """Percent of an array's samples that are missing or outside the range."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & v.between(low, high) & ((v != 0) if zero_missing else F.lit(True))
    return F.lit(100.0) - F.size(F.filter(x, lambda v: F.coalesce(good(v), F.lit(False)))) * 100.0 / F.size(x)


def readable(signals: DataFrame, x: str = "fhr", over: float = 50.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Signals more than `over` percent of whose samples are there, and within [low, high] where these are given."""
    inf = float("inf")
    bad = invalid_pct(F.col(x), -inf if low is None else low, inf if high is None else high, False)
    return signals.where((F.size(x) > 0) & (100.0 - bad > over))


def window_features(signals: DataFrame, clinical: DataFrame | None = None, fs: int = kernels.FS, length_min: float = 20, stride_min: float = 5, most_pct: float = 30.0) -> DataFrame:
    """Features of each complete window of each record whose channels are valid enough, numbered from 0 over kept windows.

    signals has record, fhr, uc; clinical, if given, record and Sig2Birth, for time_to_birth_min. Windows are cut
    and filtered before Python sees them, so bad windows never cross; each is cleaned by itself.
    """
    n, step = int(length_min * 60 * fs), int(stride_min * 60 * fs)
    s = signals.withColumn("n", F.least(F.size("fhr"), F.size("uc")))
    if clinical is not None:
        s = s.join(clinical.select("record", "Sig2Birth"), "record", "left")
    else:
        s = s.withColumn("Sig2Birth", F.lit(None).cast("double"))
    s = s.withColumn("birth_min", birth_minute(F.col("n"), F.col("Sig2Birth"), fs)).where(F.col("n") >= n)
    w = s.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - n, F.lit(step))))
    w = w.withColumns({c: F.slice(c, F.col("start") + 1, n) for c in ("fhr", "uc")})
    w = w.where((invalid_pct(F.col("fhr"), *kernels.FHR_RANGE, True) <= most_pct) & (invalid_pct(F.col("uc"), *kernels.UC_RANGE, True) <= most_pct))
    f = extract(w, ["record", "start", "birth_min"], fs=fs)
    end = (F.col("start") + n) / (60.0 * fs)
    return f.select(
        "record",
        (F.row_number().over(Window.partitionBy("record").orderBy("start")) - 1).alias("window_id"),
        (F.col("start") / (60.0 * fs)).alias("window_start_min"),
        end.alias("window_end_min"),
        (F.col("birth_min") - end).alias("time_to_birth_min"),
        *kernels.FEATURES,
    )


def pair_kernel(df: DataFrame, keys: list[str], a: str, b: str, f, name: str) -> DataFrame:
    """One kernel on two array columns: keys and its result, an array of doubles."""
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], f"`{name}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [list(map(float, f(_floats(x), _floats(y)))) for x, y in zip(*batch.columns[len(keys) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(got, pa.list_(pa.float64()))], [*keys, name])

    return df.select(*keys, F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).mapInArrow(run, schema)


def array_kernel(df: DataFrame, keys: list[str], column: str, f, name: str, kind: str = "double") -> DataFrame:
    """One kernel on an array column: keys and its result (double or array<double>)."""
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], f"`{name}` {kind}"])
    to = pa.float64() if kind == "double" else pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [f(_floats(v)) for v in batch.column(len(keys))]
            got = [None if g is None or (np.isscalar(g) and np.isnan(g)) else (g if np.isscalar(g) else list(map(float, g))) for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(got, to)], [*keys, name])

    return df.select(*keys, F.col(column).cast("array<double>")).mapInArrow(run, schema)
