"""Block bootstraps of paired series. Randomness is a hash of (seed, record, replicate, position): partitions don't matter.

A replicate is an index vector made by array expressions and one gather per channel, so both channels of a
record stay synchronous and nothing leaves the JVM. Only jitter_warp, which has no relational form, uses Python.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import hash_unit, replicate_id
from ..functions.kernels import autocorrelation as _acf
from ..functions.kernels import jitter_warp as _jitter_warp
from .features import _floats, array_kernel


def _draw(seed: Column, record: Column, rep: Column, i: Column, what: str) -> Column:
    return hash_unit(F.lit(what), seed, record, rep, i)


def stationary_index(n: Column, mean_block: Column, seed: Column, record: Column, rep: Column) -> Column:
    """Positions 0..n-1 drawn in blocks of random length: each step starts anew with chance 1 / mean_block, else goes on, round the end."""
    jumps = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_draw(seed, record, rep, i, "jump") < 1.0 / mean_block))

    def block(js: Column, p: Column, k: Column) -> Column:
        start = F.floor(_draw(seed, record, rep, p, "start") * n).cast("int")
        size = F.coalesce(F.get(js, k + 1), n) - p
        # the start is drawn once a block: it is bound as the one element of an array
        return F.flatten(F.transform(F.array(start), lambda s: F.transform(F.sequence(F.lit(0), size - 1), lambda j: (s + j) % n)))

    # the jumps are found once: bound likewise
    return F.when(n > 0, F.flatten(F.transform(F.array(jumps), lambda js: F.flatten(F.transform(js, lambda p, k: block(js, p, k)))))).otherwise(F.array().cast("array<int>"))


def block_index(n: Column, length: Column, block: Column, seed: Column, record: Column, rep: Column, overlapping: bool) -> Column:
    """`length` positions in blocks that start at random: at any position (moving) or at multiples of the block (non-overlapping). A series no longer than a block repeats from its start; an empty one has no positions."""
    choices = F.greatest(n - block if overlapping else F.ceil((n - block) / block).cast("int"), F.lit(1))
    pick = lambda i: F.floor(_draw(seed, record, rep, i, "block") * choices).cast("int") * (F.lit(1) if overlapping else block)
    index = F.transform(F.sequence(F.lit(0), length - 1), lambda p: (F.when(n <= block, F.lit(0)).otherwise(pick(F.floor(p / block).cast("int"))) + F.when(n <= block, p).otherwise(p % block)) % n)
    return F.when((n > 0) & (length > 0), index).otherwise(F.array().cast("array<int>"))


def gather(x: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.element_at(x, (i + 1).cast("int")))


def _stationary(df: DataFrame, block: str, seed: int) -> Column:
    return stationary_index(F.size("fhr"), F.col(block).cast("double"), F.lit(seed), F.col("record"), F.col("bootstrap_idx"))


def _blocks(overlapping: bool) -> Callable:
    return lambda df, block, seed: block_index(F.size("fhr"), F.size("fhr"), F.col(block).cast("int"), F.lit(seed), F.col("record"), F.col("bootstrap_idx"), overlapping)


#: Index strategies by name; jitter_warp has its own way.
STRATEGIES: dict[str, Callable] = {"block_bootstrap": _blocks(False), "moving_block": _blocks(True), "stationary_bootstrap": _stationary}


def replicates(signals: DataFrame, m: int, strategy: str = "stationary_bootstrap", block: str = "block", seed: int = 42, first: int = 0) -> DataFrame:
    """m synthetic records per record (record, fhr, uc, and a block length), with lineage and the other columns inherited. They are numbered from `first` on; a replicate is the same whatever else is made with it."""
    if strategy != "jitter_warp" and strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}")
    each = signals.withColumn("bootstrap_idx", F.explode(F.sequence(F.lit(first), F.lit(first + m - 1))))
    if strategy == "jitter_warp":
        made = _warped(each, seed)
    else:
        made = each.withColumn("__ix", STRATEGIES[strategy](each, block, seed)).withColumns({c: gather(F.col(c), F.col("__ix")) for c in ("fhr", "uc")}).drop("__ix")
    return made.withColumns({"source_record": F.col("record"), "record": replicate_id(F.col("record"), F.col("bootstrap_idx")), "is_synthetic": F.lit(True)})


def _warped(each: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int.from_bytes(hashlib.md5(f"{seed}|{r}|{k}".encode()).digest(), "little") for r, k in zip(batch.column("record").to_pylist(), batch.column("bootstrap_idx").to_pylist(), strict=True)]
            out = {}
            for c in ("fhr", "uc"):
                made = [_jitter_warp(x, len(x), key) for x, key in zip(map(_floats, batch.column(c)), keys, strict=True)]
                flat = pa.array(np.concatenate(made), pa.float64(), from_pandas=True)
                out[c] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), flat)
            cols = [out.get(f.name, batch.column(f.name)) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return each.withColumns({c: F.col(c).cast("array<double>") for c in ("fhr", "uc")}).mapInArrow(run, each.withColumns({c: F.col(c).cast("array<double>") for c in ("fhr", "uc")}).schema)


def optimal_block(signals: DataFrame, x: str = "fhr", key: str = "record", threshold: float = 0.05, low: int = 240, high: int = 1200) -> DataFrame:
    """Block length per record of an array column: twice the first lag after 0 whose autocorrelation is small in size, within [low, high]; high where none is; low for a record with fewer than 2 * low valid samples, and for a constant one."""

    def block(v: np.ndarray) -> float:
        v = v[np.isfinite(v)]
        if len(v) < 2 * low:
            return float(low)
        small = np.flatnonzero(np.abs(_acf(v, high)[1:]) < threshold) + 1
        return float(min(max(2 * small[0], low), high)) if len(small) else float(high)

    return array_kernel(signals, [key], x, block, "block").withColumn("block", F.col("block").cast("int"))


def converged_multiplier(means: DataFrame, tolerance: float = 0.01, cap: int = 10) -> DataFrame:
    """How many of the replicates at hand are enough (`rounds` makes them only as long as need be): the first m >= 2 at which the deviation of all means up to replicate m changes by less than the tolerance; the cap if none. means: bootstrap_idx, mean."""
    per = means.groupBy("bootstrap_idx").agg(F.count("*").alias("n"), F.sum("mean").alias("s"), F.sum(F.col("mean") * F.col("mean")).alias("q"))
    w = Window.orderBy("bootstrap_idx")  # a row per replicate, of which there are `cap` at most
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    n, s, q = (F.sum(c).over(up) for c in ("n", "s", "q"))
    d = per.where(F.col("bootstrap_idx") < cap).withColumn("std", F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))
    d = d.withColumn("change", F.abs(F.col("std") - F.lag("std").over(w)))
    return d.agg(F.coalesce(F.min(F.when(F.col("change") < tolerance, F.col("bootstrap_idx") + 1)), F.lit(cap)).alias("multiplier"))


class Round(NamedTuple):
    """What is known after a round: how many replicates each record has, all replicates' means (their number, mean and deviation), the deviation's change, and whether that was small enough."""

    m: int
    n: int
    mean: float
    std: float
    change: float | None
    stop: bool


def mean_of(x: str) -> Column:
    """Mean of an array's valid samples; NULL without one."""
    good = F.filter(F.col(x).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(F.aggregate(good, F.lit(0.0), lambda a, v: a + v), F.size(good))


def rounds(signals: DataFrame, strategy: str = "stationary_bootstrap", block: str = "block", seed: int = 42, tolerance: float = 0.01, cap: int = 10, out: str | None = None) -> Iterator[Round]:
    """Replicates made one round at a time, one of each record in a round, until the deviation of all their means changes by less than the tolerance or `cap` rounds are done.

    A round is one job: only its moments come to the driver, and are merged with those of the rounds before, which
    aren't read again. No round after the stopping one is computed. With `out` a round's replicates are stored there on
    the way, under bootstrap_idx=<round>; a round that is done again replaces its own folder. Replicates without a valid
    sample have no mean. A table without any goes on to the cap.
    """
    spark, n, mean, m2, before = signals.sparkSession, 0, 0.0, 0.0, None
    for k in range(cap):
        made = replicates(signals, 1, strategy, block, seed, first=k).withColumn("__mean", mean_of("fhr"))
        if out is not None:
            at = f"{out}/bootstrap_idx={k}"
            made.drop("bootstrap_idx").write.mode("overwrite").parquet(at)
            made = spark.read.parquet(at)
        more = made.agg(F.count("__mean").alias("n"), F.avg("__mean").alias("mean"), F.var_pop("__mean").alias("var")).first()
        if more.n:
            step = more.mean - mean
            m2 += more.var * more.n + step * step * n * more.n / (n + more.n)
            n, mean = n + more.n, mean + step * more.n / (n + more.n)
        std = math.sqrt(max(m2, 0.0) / n) if n else None
        change = abs(std - before) if std is not None and before is not None else None
        stop = change is not None and change < tolerance
        yield Round(k + 1, n, mean if n else None, std, change, stop)
        if stop:
            return
        before = std


def replicates_until_stable(signals: DataFrame, out: str | None = None, strategy: str = "stationary_bootstrap", block: str = "block", seed: int = 42, tolerance: float = 0.01, cap: int = 10) -> tuple[DataFrame, list[Round]]:
    """As many replicates as `rounds` needs, and the rounds. They are those that `replicates` makes; with `out` they are read from there, whatever an earlier run has left beside them."""
    done = list(rounds(signals, strategy, block, seed, tolerance, cap, out))
    made = replicates(signals, len(done), strategy, block, seed)
    if out is None:
        return made, done
    stored = signals.sparkSession.read.option("basePath", out).parquet(*[f"{out}/bootstrap_idx={r.m - 1}" for r in done])
    return stored.select(*made.columns), done


def replay_differences(saved: DataFrame, again: DataFrame, key: str = "record", x: str = "fhr") -> DataFrame:
    """Records whose saved series isn't what the indices give again: empty if the replay is true."""
    return saved.select(key, F.col(x).alias("__a")).join(again.select(key, F.col(x).alias("__b")), key, "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key)
