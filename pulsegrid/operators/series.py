"""Operators on a series in long form: one row per (record, i) with i from 0 without gaps.

Everything is one window per record, so a plan has one exchange on the record and one sort, which the
operators share when chained. A record's rows stay together: a record is one signal of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.kernels import lag_sums

#: Samples of a chunk of a long series, four times the lags at least: what a chunk borrows from its successor is then a quarter.
CHUNK = 4096


def ordered(key: str, at: str = "i") -> WindowSpec:
    return Window.partitionBy(key).orderBy(at)


def backwards(key: str, at: str = "i") -> WindowSpec:
    """From the last row on. A frame up to a record's end is one that grows from there: read forwards, Spark would go through it anew at each row."""
    return Window.partitionBy(key).orderBy(F.col(at).desc())


def clean_range(x: Column, low: float, high: float, zero_missing: bool = True) -> Column:
    """NULL outside [low, high], and for zero if that means missing."""
    good = x.between(low, high)
    return F.when(good & (x != 0) if zero_missing else good, x)


def islands(df: DataFrame, flag: Column, key: str, at: str = "i", name: str = "island") -> DataFrame:
    """Numbers the runs of equal flags: rows of one run of one flag share `name`."""
    both = Window.partitionBy(key, "__flag").orderBy(at)
    out = df.withColumn("__flag", flag)
    return out.withColumn(name, F.row_number().over(ordered(key, at)) - F.row_number().over(both))


def gap_runs(df: DataFrame, x: str, key: str, at: str = "i") -> DataFrame:
    """Runs of missing samples: key, start, length."""
    runs = islands(df.select(key, at, x), F.col(x).isNull(), key, at)
    return runs.where("__flag").groupBy(key, "island").agg(F.min(at).alias("start"), F.count("*").alias("length")).drop("island")


def gap_summary(df: DataFrame, x: str, key: str, long: int, at: str = "i") -> DataFrame:
    """Per key: gaps, gaps longer than `long`, the longest."""
    runs = gap_runs(df, x, key, at)
    every = df.select(key).distinct()
    s = runs.groupBy(key).agg(F.count("*").alias("n_gaps"), F.count_if(F.col("length") > long).alias("n_long"), F.max("length").alias("max_gap"))
    return every.join(s, key, "left").na.fill(0, ["n_gaps", "n_long", "max_gap"])


def interpolate(df: DataFrame, x: str, key: str, out: str, at: str = "i", max_gap: int | None = None, on_all_missing: float | None = None) -> DataFrame:
    """Linear filling of missing samples.

    max_gap None: every gap, with the nearest valid sample at the ends. Otherwise only gaps between two valid
    samples of at most max_gap samples. A record without valid samples gets on_all_missing.
    """
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (ordered(key, at), backwards(key, at)))
    pos = F.when(F.col(x).isNotNull(), F.col(at))
    df = df.withColumns({"__p": F.last(x, True).over(back), "__pi": F.last(pos, True).over(back), "__n": F.last(x, True).over(ahead), "__ni": F.last(pos, True).over(ahead)})
    line = F.col("__p") + (F.col("__n") - F.col("__p")) * (F.col(at) - F.col("__pi")) / (F.col("__ni") - F.col("__pi"))
    between = F.col("__p").isNotNull() & F.col("__n").isNotNull()
    filled = F.when(F.col(x).isNotNull(), F.col(x))
    if max_gap is None:
        filled = filled.when(between, line).otherwise(F.coalesce("__p", "__n", F.lit(on_all_missing).cast("double")))
    else:
        filled = filled.when(between & (F.col("__ni") - F.col("__pi") - 1 <= max_gap), line)
    return df.withColumn(out, filled).drop("__p", "__pi", "__n", "__ni")


def moving(df: DataFrame, x: str, key: str, out: str, lo: int, hi: int, kind: str = "avg", at: str = "i", hold: bool = False) -> DataFrame:
    """A moving average or exact median over the rows from lo to hi around each.

    Missing samples don't count, and at a record's ends the frame is cut. With `hold`, for a series without gaps, it
    is filled up with the end's own sample instead, as filters do that hold the nearest sample.
    """
    w = ordered(key, at)
    near, whole = w.rowsBetween(lo, hi), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if not hold:
        return df.withColumn(out, {"avg": F.avg(x), "median": F.percentile(x, F.lit(0.5))}[kind].over(near))
    place, size = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(key))
    before, after = F.greatest(F.lit(-lo) - place, F.lit(0)), F.greatest(place + hi - (size - 1), F.lit(0))
    ends = {"__first": F.first(x).over(whole), "__last": F.last(x).over(whole), "__before": before.cast("int"), "__after": after.cast("int")}
    df = df.withColumns(ends)
    if kind == "avg":
        value = (F.sum(x).over(near) + F.col("__before") * F.col("__first") + F.col("__after") * F.col("__last")) / F.lit(float(hi - lo + 1))
    else:
        all_of = F.array_sort(F.concat(F.array_repeat("__first", F.col("__before")), F.collect_list(x).over(near), F.array_repeat("__last", F.col("__after"))))
        value = (F.get(all_of, F.lit((hi - lo) // 2)) + F.get(all_of, F.lit((hi - lo + 1) // 2))) / 2
    return df.withColumn(out, value).drop(*ends)


def sustained_events(df: DataFrame, delta: str, key: str, threshold: float, min_len: int, above: bool, at: str = "i") -> DataFrame:
    """Runs of at least min_len samples at or beyond the threshold: key, start, end (exclusive), peak (its first extreme), amplitude."""
    hit = F.coalesce(F.col(delta) >= threshold if above else F.col(delta) <= -threshold, F.lit(False))
    size = F.col(delta) if above else -F.col(delta)
    runs = islands(df.select(key, at, delta), hit, key, at).where("__flag").withColumn("__size", size)
    agg = runs.groupBy(key, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"), F.max(F.struct("__size", (-F.col(at)).alias("neg"))).alias("__top"), F.count("*").alias("length"))
    return agg.where(F.col("length") >= min_len).select(key, "start", "end", (-F.col("__top.neg")).alias("peak"), F.col("__top.__size").alias("amplitude"))


def first_below(df: DataFrame, value: str, at: str, key: str, threshold: float) -> DataFrame:
    """Per key the first position whose value is under the threshold."""
    return df.groupBy(key).agg(F.min(F.when(F.col(value) < threshold, F.col(at))).alias("first_below"))


def window_bounds(records: DataFrame, key: str, n: str, length: int, stride: int) -> DataFrame:
    """Start and end (exclusive) of each complete window from a record's start on; a shorter record has none."""
    some = records.where(F.col(n) >= length).select(key, F.explode(F.sequence(F.lit(0), (F.col(n) - length).cast("int"), F.lit(stride))).alias("start"))
    return some.withColumn("end", F.col("start") + length)


def windows(series: DataFrame, key: str, length: int, stride: int, at: str = "i") -> DataFrame:
    """Every sample once per complete window that has it, without a join: the windows of a sample follow from its place."""
    n = F.count("*").over(Window.partitionBy(key))
    s = series.withColumn("__n", n)
    low = F.greatest(F.lit(0), F.floor((F.col(at) - length) / stride) + 1)
    high = F.least(F.floor(F.col(at) / stride), F.floor((F.col("__n") - length) / stride))
    picks = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return s.withColumn("window", F.explode(picks)).withColumn("start", F.col("window") * stride).drop("__n")


def quality_windows(series: DataFrame, key: str, length: int, stride: int, channels: list[str], most_pct: float, at: str = "i") -> DataFrame:
    """Windows whose share of missing samples is at most most_pct in every channel, numbered anew from 0."""
    w = windows(series, key, length, stride, at)
    g = w.groupBy(key, "start").agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*")).alias(f"{c}_invalid_pct") for c in channels])
    for c in channels:
        g = g.where(F.col(f"{c}_invalid_pct") <= most_pct)
    return g.withColumn("window_id", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, other: str, out: str = "nearest") -> DataFrame:
    """Each left row with the right position nearest to its own in the same record; of two equally near the earlier one.

    Both sides are sorted along one window per record, so nothing is multiplied: the nearest position is the last
    one before or the first one after.
    """
    cols = left.columns
    both = left.withColumns({"__k": F.col(key), "__at": F.col(at), "__o": F.lit(None).cast(right.schema[other].dataType)}).unionByName(right.select(F.col(key).alias("__k"), F.col(other).alias("__at"), F.col(other).alias("__o")), allowMissingColumns=True)
    up, down = (w.rangeBetween(Window.unboundedPreceding, 0) for w in (ordered("__k", "__at"), backwards("__k", "__at")))
    near = both.withColumns({"__b": F.last("__o", True).over(up), "__a": F.last("__o", True).over(down)})
    pick = F.when(F.col("__a").isNull() | (F.col("__at") - F.col("__b") <= F.col("__a") - F.col("__at")), F.col("__b")).otherwise(F.col("__a"))
    return near.where(F.col("__o").isNull()).select(*cols, pick.alias(out))


def decelerations(events: DataFrame, key: str, lag_s: str) -> DataFrame:
    """Counts of early, late and variable decelerations by their lag to the nearest contraction, mean and median lag; without a contraction an event is variable."""
    lag = F.col(lag_s)
    early, late = F.abs(lag) <= 15, (lag > 15) & (lag <= 90)
    return events.groupBy(key).agg(
        F.count_if(early).alias("early"),
        F.count_if(late).alias("late"),
        (F.count("*") - F.count_if(early) - F.count_if(late)).alias("variable"),
        F.avg(lag).alias("lag_mean_s"),
        F.median(lag).alias("lag_median_s"),
    )


def block_stat(df: DataFrame, x: str, key: str, block: int, at: str = "i") -> DataFrame:
    """Means of consecutive whole blocks; a last part block is dropped."""
    g = df.groupBy(key, F.floor(F.col(at) / block).alias("block")).agg(F.avg(x).alias("mean"), F.count("*").alias("__n"))
    return g.where(F.col("__n") == block).drop("__n")


def autocorrelation(df: DataFrame, x: str, key: str, max_lag: int, at: str = "i", drop_missing: bool = False, long_enough: bool = False) -> DataFrame:
    """Autocorrelation per record and lag 0..max_lag: the mean product of the series less its mean at each lag, over that at lag 0.

    With drop_missing the valid samples close ranks first; without, a missing sample drops its products. Lags that
    the record doesn't reach are 0, and so are all of a constant one. With long_enough, records of fewer than
    max_lag + 1 samples are left out. The lags are windows over one sort, not joins.
    """
    s = df.select(key, at, F.col(x).alias("__x"))
    if drop_missing:
        s = s.where("__x IS NOT NULL").withColumn(at, F.row_number().over(ordered(key, at)))
    s = s.withColumn("__c", F.col("__x") - F.avg("__x").over(Window.partitionBy(key)))
    w = ordered(key, at)
    s = s.withColumn("__l", F.array(*[(F.col("__c") * (F.lag("__c", k).over(w) if k else F.col("__c"))) for k in range(max_lag + 1)]))
    g = s.groupBy(key).agg(F.count("*").alias("__rows"), F.array(*[F.avg(F.col("__l")[k]) for k in range(max_lag + 1)]).alias("__s"))
    if long_enough:
        g = g.where(F.col("__rows") > max_lag)
    first = F.col("__s")[0]
    share = F.transform("__s", lambda v, k: F.when(k >= F.col("__rows"), 0.0).when(first == 0, 0.0).otherwise(v / first))
    return g.select(key, F.posexplode(share).alias("lag", "acf"))


def positions(df: DataFrame, key: str, at: str, name: str, cell: int) -> DataFrame:
    """`name`: each row's place from 0 among its key's rows in the order of `at` (a whole number; ties in any order). Rows are counted in cells of `at`, so a task sorts one cell's rows, never a whole key's."""
    rows = df.withColumn("__cell", F.floor(F.col(at) / cell))
    before = F.sum("__n").over(ordered(key, "__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy(key, "__cell").agg(F.count("*").alias("__n")).select(F.col(key).alias("__cell_key"), F.col("__cell").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = rows.join(cells, F.col(key).eqNullSafe(F.col("__cell_key")) & F.col("__cell").eqNullSafe(F.col("__c")))
    place = F.row_number().over(Window.partitionBy(key, "__cell").orderBy(at)) - 1
    return joined.withColumn(name, F.col("__before") + place).drop("__cell", "__c", "__cell_key", "__before")


def long_autocorrelation(df: DataFrame, x: str, key: str, max_lag: int, at: str = "i", drop_missing: bool = False, long_enough: bool = False, chunk: int = CHUNK) -> DataFrame:
    """As `autocorrelation`, for series of any length and many lags: the plan doesn't grow with the lags, nor a task with the series.

    A series is cut into chunks of `chunk` samples (four times max_lag if that is more). Each takes the next max_lag
    samples along, gives the sum and number of its products at each lag in one correlation, and these add up. `at` is a
    whole number; NaN is missing; a null key is a key of its own. A constant series has only zeros, one without a valid
    sample nulls up to its length.
    """
    size = max(chunk, 4 * max_lag, 1)
    s = df.select(F.col(key).alias("__key"), F.col(at).cast("bigint").alias("__at"), F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("__x"))
    if drop_missing:
        s = s.where("__x IS NOT NULL")
    of_key = s.groupBy("__key").agg(F.count("*").alias("__rows"), F.avg("__x").alias("__mean"), (F.min("__x") == F.max("__x")).alias("__flat"))
    if long_enough:
        of_key = of_key.where(F.col("__rows") > max_lag)
    named = of_key.withColumnRenamed("__key", "__k")
    placed = positions(s, "__key", "__at", "__p", size).join(named, F.col("__key").eqNullSafe(F.col("__k"))).withColumn("__c", F.when(F.col("__flat"), 0.0).otherwise(F.col("__x") - F.col("__mean")))
    own = F.floor(F.col("__p") / size)
    # the first max_lag samples of a chunk go to the one before as well
    borrowed = (own > 0) & (F.col("__p") % size < max_lag)
    chunks = placed.withColumn("__chunk", F.explode(F.when(borrowed, F.array(own, own - 1)).otherwise(F.array(own))))
    packed = chunks.groupBy("__key", "__chunk").agg(F.array_sort(F.collect_list(F.struct("__p", "__c"))).alias("__v")).select("__key", F.col("__v")["__c"].alias("__v"))
    kind = s.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lags = pa.array(np.arange(max_lag + 1, dtype=np.int32))
        for batch in batches:
            for k in range(batch.num_rows):
                v = batch.column(1)[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                sums, counts = lag_sums(v, size, max_lag)
                same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(max_lag + 1, np.int32)), batch.column(0).slice(k, 1)).cast(batch.column(0).type)
                yield pa.RecordBatch.from_arrays([same, lags, pa.array(sums), pa.array(counts)], ["__key", "lag", "__s", "__n"])

    parts = packed.mapInArrow(run, f"__key {kind}, lag int, __s double, __n bigint")
    total = parts.groupBy("__key", "lag").agg((F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0))).alias("__v"))
    first = F.max(F.when(F.col("lag") == 0, F.col("__v"))).over(Window.partitionBy("__key"))  # max_lag + 1 rows a key
    share = F.when(F.col("lag") >= F.col("__rows"), 0.0).when(F.col("__first") == 0, 0.0).otherwise(F.col("__v") / F.nullif(F.col("__first"), F.lit(0.0)))
    return total.withColumn("__first", first).join(named, F.col("__key").eqNullSafe(F.col("__k"))).select(F.col("__key").alias(key), "lag", share.alias("acf"))


def first_small_lag(df: DataFrame, x: str, key: str, threshold: float, low: int, high: int, at: str = "i") -> DataFrame:
    """Block length per record from its samples in long form, of any length: see bootstrap.optimal_block, which takes arrays."""
    valid = df.where(F.col(x).isNotNull())
    n = df.groupBy(key).agg(F.count(x).alias("__n"))
    # a column per lag is quicker for a few
    curve = autocorrelation if high <= 32 else long_autocorrelation
    small = curve(valid, x, key, high, at, drop_missing=True).where((F.col("lag") > 0) & (F.abs("acf") < threshold)).groupBy(key).agg(F.min("lag").alias("__lag"))
    held = F.greatest(F.least(2 * F.col("__lag"), F.lit(high)), F.lit(low))
    return n.join(small, key, "left").select(key, F.when(F.col("__n") < 2 * low, F.lit(low)).otherwise(F.coalesce(held, F.lit(high))).cast("int").alias("block"))
