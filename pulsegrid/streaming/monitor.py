"""Live monitoring as Structured Streaming: event-time windows, and trends and alerts as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows kept per record: what the rolling slope looks back on.
KEPT = 6

OUT = "record string, window_start_min double, value double, delta2 double, falling_streak int, slope double, alert boolean, alert_run_start double"
STATE = "starts array<double>, vals array<double>, streak int, run double"


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The stream with a watermark. A timestamp without zone is read as UTC, since watermarks need one with."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sliding_means(df: DataFrame, key: str, value: str, ts: str = "ts", length: str = "20 minutes", stride: str = "5 minutes", complete: int = 1) -> DataFrame:
    """Means per key and sliding window, of windows with enough samples."""
    g = df.groupBy(key, F.window(ts, length, stride)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return g.where(F.col("n") >= complete).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _slope(t: list, y: list, step: float = 5.0) -> float | None:
    if len(t) < KEPT or any(abs(b - a - step) > 1e-6 + 1e-5 * step for a, b in zip(t[:-1], t[1:], strict=True)):
        return None
    pairs = [(a, b) for a, b in zip(t, y, strict=True) if b is not None and b == b]
    if len(pairs) < 2:
        return None
    mt, my = (sum(p[i] for p in pairs) / len(pairs) for i in (0, 1))
    return sum((a - mt) * (b - my) for a, b in pairs) / sum((a - mt) ** 2 for a, _ in pairs)


def track(threshold: float, idle_min: float = 24 * 60, ts: str | None = None):
    """The state function for applyInPandasWithState: new windows of a record, in order of start; a window not after the last one seen is late and dropped. A record's state goes idle_min after its last window by column ts, if one is given."""
    idle = int(idle_min * 60_000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, values, streak, began = ([], [], 0, None) if not state.exists else state.get
        starts, values = list(starts), list(values)
        rows = []
        new = pd.concat(list(frames)).sort_values("window_start_min")
        for t, v in zip(new["window_start_min"].tolist(), new["value"].astype("float64").tolist(), strict=True):
            v = None if v != v else v
            if starts and t <= starts[-1]:
                continue
            last = values[-1] if values else None
            streak = streak + 1 if v is not None and last is not None and v < last else 0
            two = values[-2] if len(values) >= 2 else None
            starts, values = [*starts, t][-KEPT:], [*values, v][-KEPT:]
            alert = v is not None and v >= threshold
            began = (t if began is None else began) if alert else None
            rows.append((key[0], t, v, v - two if v is not None and two is not None else 0.0, streak, _slope(starts, values) or 0.0, alert, began))
        state.update((starts, values, streak, began))
        if ts is not None:
            state.setTimeoutTimestamp(max(int(new[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def monitor(windows: DataFrame, threshold: float, idle_min: float = 24 * 60, ts: str = "ts") -> DataFrame:
    """A stream of (record, window_start_min, value) with its trends, alert and the start of the running alert.

    State per record is six rows, a streak and a start; it goes idle_min after the record's last window, by the
    stream's time: that needs a column ts with a watermark (see event_time). Without one, state stays.
    """
    timed = ts in windows.columns
    kind = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return windows.groupBy("record").applyInPandasWithState(track(threshold, idle_min, ts if timed else None), OUT, STATE, "append", kind)
