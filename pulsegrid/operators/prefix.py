"""Running sums and ranks over a whole table or large groups, without bringing a group into one task.

A value's bucket follows from bounds (approximate quantiles, a list of bounded length) or from its hash. Sums per
bucket are a small table; what stands before a bucket is added to the running sum within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str, rows: int = 32_768) -> DataFrame:
    """df dealt by hash into tasks of about `rows` rows, for what goes over it many times: tasks grow with the table, not with a setting, and a small table isn't hundreds of them. Counts df, which should be kept."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def quantile_bounds(df: DataFrame, x: str, parts: int) -> list[float]:
    """At most parts - 1 values that cut the column into about equal shares."""
    row = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10_000)).first() if parts > 1 else None
    return sorted(set(row[0])) if row and row[0] else []


def bucket(x: Column, bounds: list) -> Column:
    """The number of bounds that are at most x: by halving over a constant array, whose size the plan doesn't grow with."""
    if not bounds:
        return F.lit(0)
    kind = "double" if any(isinstance(b, float) for b in bounds) else "bigint"
    table = F.split(F.lit(",".join(map(repr, bounds))), ",").cast(f"array<{kind}>")
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when((s["lo"] < s["hi"]) & (x >= F.get(table, mid)), state(mid + 1, s["hi"])).otherwise(state(s["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, state(F.lit(0), F.lit(len(bounds))), halve)["lo"]


def running_sums(rows: DataFrame, values: DataFrame, x: str, sums: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """values (distinct x per `by`, with the columns of `sums`) with s_run, the sum up to x and with it, s_all, the whole, and x_next, the next x.

    rows is what values were summed from, with the same columns before summing: bounds and bucket sums come from it
    by partial aggregates, so only distinct values are ever sorted.
    """
    b = bucket(F.col(x), quantile_bounds(rows, x, _parts(rows)))
    way = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    cells = rows.withColumn("__bucket", b).groupBy(*by, "__bucket").agg(*[F.sum(s).alias(f"__{s}") for s in sums], F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    order = Window.partitionBy(*by).orderBy(way)
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    cells = cells.select(
        *by,
        "__bucket",
        *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__{s}").over(every).alias(f"{s}_all") for s in sums],
        F.lead("__hi" if descending else "__lo").over(order).alias("__next"),
    )
    d = values.withColumn("__bucket", b).join(cells, [*by, "__bucket"])
    inner = Window.partitionBy(*by, "__bucket").orderBy(F.col(x).desc() if descending else F.col(x).asc())
    up = inner.rowsBetween(Window.unboundedPreceding, 0)
    added = {f"{s}_run": F.col(f"__before_{s}") + F.sum(s).over(up) for s in sums}
    d = d.withColumns(added | {f"{x}_next": F.coalesce(F.lead(x).over(inner), "__next")})
    return d.drop("__bucket", "__next", *[f"__before_{s}" for s in sums])


def exact_percentiles(df: DataFrame, x: str, shares: list[float], by: list[str]) -> DataFrame:
    """Per group the exact percentiles of x, interpolated, as an array q: what stands at a place follows from running counts of distinct values, so no group is one task. Groups without values have no row."""
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v"), F.lit(1).cast("long").alias("__one"))
    s = running_sums(rows, rows.groupBy(*by, "__v").agg(F.sum("__one").alias("__one")), "__v", ["__one"], by)
    at = lambda i: F.min(F.when(F.col("__one_run") > i, F.col("__v")))
    place = lambda p: (F.col("__one_all") - 1) * F.lit(float(p))
    ends = [e.alias(f"__{side}{k}") for k, p in enumerate(shares) for side, e in (("lo", at(F.floor(place(p)))), ("hi", at(F.ceil(place(p)))))]
    g = s.groupBy(*by).agg(F.max("__one_all").alias("__one_all"), *ends)
    value = lambda k, p: F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (place(p) - F.floor(place(p)))
    return g.select(*by, F.array(*[value(k, p) for k, p in enumerate(shares)]).alias("q"))


def hash_ranks(df: DataFrame, unit: Column, by: list[str], order: list) -> DataFrame:
    """df with __rank, the place by `unit` (even in [0, 1)) and then `order` within `by`, and __size, the group's rows."""
    d = df.withColumn("__u", unit).withColumn("__bucket", F.floor(F.col("__u") * _parts(df)).cast("int"))
    cells = d.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__size"))
    place = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__u", *order))
    return d.withColumn("__place", place).join(cells, [*by, "__bucket"]).withColumn("__rank", F.col("__place") + F.col("__before")).drop("__u", "__bucket", "__place", "__before")
