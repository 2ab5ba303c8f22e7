"""From a stream of samples to window features: keyed lists of samples, and a timer for the end of each window.

A window is due when the watermark has passed its end. Until then its samples may come in any order and late; what
comes after is too late for it, but still goes into later windows that it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "record string, window_id int, window_start_min double, window_end_min double, " + ", ".join(f"{n} double" for n in kernels.FEATURES)


def use_state_store(spark: SparkSession) -> None:
    """Lists and timers need the RocksDB state store: it is set for the session, unless another that isn't the default was."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _invalid(x: np.ndarray, low: float, high: float) -> float:
    good = np.isfinite(x) & (x >= low) & (x <= high) & (x != 0)
    return 100.0 - 100.0 * good.sum() / max(1, len(x))


class WindowFeatures(StatefulProcessor):
    """State of a record: its samples that a window still needs, in one list entry per batch of rows, and a row (origin_ms, next, kept, last, seen_ms): when sample 0 was, the next window, windows told so far, the last sample's number, the latest time seen."""

    def __init__(self, fs: int, length: int, stride: int, most_pct: float, idle_ms: int):
        self.fs, self.length, self.stride, self.most, self.idle = fs, length, stride, most_pct, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "i array<bigint>, fhr array<double>, uc array<double>")
        self.place = handle.getValueState("place", "origin_ms bigint, next int, kept int, last bigint, seen_ms bigint")

    def _due(self, origin: int, k: int) -> int:
        """When window k is over, in ms."""
        return origin + (k * self.stride + self.length) * 1000 // self.fs

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        at, ms = new["i"].to_numpy(np.int64), new["ms"].to_numpy(np.int64)
        known = self.place.get() if self.place.exists() else None
        origin, following, kept, last, seen = known or (int((ms - at * 1000 // self.fs).min()), 0, 0, -1, 0)
        # samples of windows that are over are of no use any more
        open_ = at >= following * self.stride
        self.samples.appendValue((at[open_].tolist(), *[_nullable(new[c].to_numpy(np.float64)[open_]) for c in ("fhr", "uc")]))
        before, last, seen = last, max(last, int(at.max())), max(seen, int(ms.max()))
        whole = lambda n: max(0, (n + 1 - self.length) // self.stride + 1) if n + 1 >= self.length else 0
        for k in range(max(following, whole(before)), whole(last)):
            self.handle.registerTimer(self._due(origin, k))
        self.place.update((origin, following, kept, last, seen))
        # the end of a record that doesn't say so
        self.handle.registerTimer(seen + self.idle)
        if new["ended"].fillna(False).astype(bool).any():
            self.handle.registerTimer(origin + (last + 1) * 1000 // self.fs + 1)
            self.place.update((origin, following, kept, last, -1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        origin, following, kept, last, seen = self.place.get()
        chunks = list(self.samples.get())
        at = np.concatenate([np.asarray(c[0], np.int64) for c in chunks]) if chunks else np.zeros(0, np.int64)
        fhr, uc = (np.concatenate([np.asarray(c[k], np.float64) for c in chunks]) if chunks else np.zeros(0) for k in (1, 2))
        out = []
        while self._due(origin, following) <= now and following * self.stride + self.length <= last + 1:
            start = following * self.stride
            own = (at >= start) & (at < start + self.length)
            window = np.full((2, self.length), np.nan)
            window[:, at[own] - start] = fhr[own], uc[own]
            following += 1
            if _invalid(window[0], *kernels.FHR_RANGE) <= self.most and _invalid(window[1], *kernels.UC_RANGE) <= self.most:
                found = kernels.features(*window, self.fs)
                minutes = 60.0 * self.fs
                out.append((key[0], kept, start / minutes, (start + self.length) / minutes, *[found[n] for n in kernels.FEATURES]))
                kept += 1
        ended = seen < 0 and now > origin + (last + 1) * 1000 // self.fs
        if ended or (seen >= 0 and now >= seen + self.idle):
            self.samples.clear()
            self.place.clear()
        else:
            keep = at >= following * self.stride
            self.samples.clear()
            if keep.any():
                self.samples.appendValue((at[keep].tolist(), _nullable(fhr[keep]), _nullable(uc[keep])))
            self.place.update((origin, following, kept, last, seen))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def _nullable(x: np.ndarray) -> list:
    return [None if v != v else v for v in x.tolist()]


def stream_features(samples: DataFrame, fs: int = kernels.FS, length_min: float = 20, stride_min: float = 5, most_pct: float = 30.0, late: str = "10 minutes", idle_min: float = 120) -> DataFrame:
    """Features of each complete window of each record, as features.window_features has them, as soon as it is over.

    samples is a stream of rows (record, i, ts, fhr, uc, ended): the sample's number from the record's start, its
    time, both channels (NULL or NaN: missing; a sample that never comes is missing too), and true on a record's last
    one. Of a sample that comes twice the later one counts. A window is told once, when the stream's time is `late`
    after its end; windows with too much missing are left out and not numbered. With the end of a record, or
    idle_min after its last sample by the stream's time, all its state goes.
    """
    use_state_store(samples.sparkSession)
    length, stride = int(length_min * 60 * fs), int(stride_min * 60 * fs)
    # the time that counts as a sample's is when its last window closes: until then it isn't late
    ahead = (F.floor(F.col("i") / stride) * stride + length - F.col("i")) * 1000 / fs
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = samples.select("record", F.col("i").cast("bigint"), ms.alias("ms"), F.col("fhr").cast("double"), F.col("uc").cast("double"), F.col("ended").cast("boolean"), F.timestamp_millis((ms + ahead).cast("bigint")).alias("closes"))
    amount, unit = late.split()
    delay = F.expr(f"INTERVAL {amount} {unit}")  # noqa: F841  a wrong text fails here
    minutes = {"second": 1 / 60, "minute": 1, "hour": 60}[unit.rstrip("s")] * float(amount)
    rows = rows.withWatermark("closes", f"{int((minutes + length_min) * 60_000)} milliseconds")
    processor = WindowFeatures(fs, length, stride, most_pct, int(idle_min * 60_000))
    return rows.groupBy("record").transformWithStateInPandas(processor, OUT, "Append", "EventTime")
