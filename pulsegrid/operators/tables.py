"""Table operators: projections, validated joins, upserts, counts, crosstabs, ranking and set operations.

Joins leave the strategy to Spark. Cardinality is checked inside the plan with assert_true or by an aggregate of
the keys, never by collecting them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import exact_percentiles


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are, in the order given."""
    return df.select(*[c for c in columns if c in df.columns])


def add_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL doubles for columns that aren't there."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def fallback_columns(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Fill each target column from its fallback where it is missing or NULL."""
    return df.withColumns({to: (F.coalesce(to, source) if to in df.columns else F.col(source)) for to, source in pairs.items() if source in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all columns."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return df


def predictors(df: DataFrame, allowed: list[str] | None = None, prohibited: tuple = ()) -> list[str]:
    """Numeric columns, of an allowed list or all, that aren't prohibited and have two values at least: one pass over all of them."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in prohibited and (allowed is None or f.name in allowed)]
    if allowed is not None:
        names = [c for c in allowed if c in names]
    if not names:
        return []
    spread = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in names]).first()
    return [c for c in names if spread[c]]


def one_to_many(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails if the left side has a key twice. The check is a count beside the left rows, by the join's own key."""
    n = F.count("*").over(Window.partitionBy(on))
    checked = left.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, "duplicate key on the one side").isNull()).drop("__n")
    return checked.join(right, on)


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(on))
    checked = right.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, "duplicate key on the right").isNull()).drop("__n")
    return one_to_many(left, checked, on)


def lookup(df: DataFrame, table: DataFrame, on: str, defaults: dict | None = None) -> DataFrame:
    """Left join with defaults for rows that find nothing."""
    out = df.join(table, on, "left")
    return out.na.fill(defaults) if defaults else out


def strict_lookup(df: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """Left join that fails where a row finds nothing."""
    found = df.join(table.withColumn("__found", F.lit(True)), on, "left")
    return found.where(F.assert_true(F.col("__found").isNotNull(), "a key was not found").isNull()).drop("__found")


def in_split(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Rows whose key is a member."""
    return df.join(members.select(on).distinct(), on, "left_semi")


def synthetic_of_training(synthetic: DataFrame, train: DataFrame, source: str, key: str) -> DataFrame:
    """Synthetic rows whose source is a training record: none leaks from the others."""
    return synthetic.join(train.select(F.col(key).alias("__k")).distinct(), F.col(source) == F.col("__k"), "left_semi")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Old rows without those whose key is new, then the new rows."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new, allowMissingColumns=True)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def frequencies(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Rows per value, NULL among them or not."""
    return (df if keep_null else df.where(F.col(column).isNotNull())).groupBy(column).agg(F.count("*").alias("n"))


def criteria_counts(df: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """A row per criterion: rows that fulfil it, percent of all, and the others per one of them. One pass."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in criteria.items()])
    long = one.unpivot("total", list(criteria), "criterion", "n")
    return long.select("criterion", "n", F.try_divide(F.col("n") * 100.0, F.col("total")).alias("pct"), F.try_divide((F.col("total") - F.col("n")).cast("double"), F.col("n")).alias("others_per_case"))


def crosstab(df: DataFrame, a: str, b: str, total: str = "TOTAL") -> DataFrame:
    """Counts of a by b in long form with both margins and the grand total; rows with a NULL are left out."""
    cube = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(F.grouping(a).alias("__a"), F.grouping(b).alias("__b"), F.count("*").alias("n"))
    named = lambda c, g: F.when(F.col(g) == 1, total).otherwise(F.col(c)).alias(c)
    return cube.select(named(a, "__a"), named(b, "__b"), "n")


def score_histogram(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """How many rows have each score 0..top in each column; scores that don't occur count 0."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("score")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("score").agg(*[F.count_if(F.col("c") == c).alias(f"n_{c}") for c in columns])
    axis = df.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("score"))
    return axis.join(counts, "score", "left").na.fill(0)


def describe(df: DataFrame, x: str, keys: list[str] | None = None, percentiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, least, exact percentiles, most. Groups may be as large as the table."""
    keys = keys or []
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_percentiles(df, x, list(percentiles), keys)
    # a row each without keys
    q = q.select(*[F.col(k).alias(f"__{k}") for k in keys], "q")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = g.join(q, reduce(lambda a, b: a & b, same), "left") if keys else g.join(F.broadcast(q), F.lit(True), "left")
    return both.select(*keys, "n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(percentiles)], "max")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column with its number of NULLs."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "n_missing")


def record_stats(df: DataFrame, x: str, key: str, digits: int = 3) -> DataFrame:
    """Per record: n, mean, population deviation, least, most, percent missing; rounded half to even."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.bround(F.avg(x), digits).alias("mean"),
        F.bround(F.stddev_pop(x), digits).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.bround(F.count_if(F.col(x).isNull()) * 100.0 / F.count("*"), digits).alias("nan_pct"),
    )


def moments(df: DataFrame, x: str, key: str) -> DataFrame:
    """Mean, population deviation, biased skewness and excess kurtosis, exact percentiles."""
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), *[F.percentile(x, F.lit(p / 100)).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)])


def pair_correlation(df: DataFrame, x: str, y: str, key: str, more_than: int = 10) -> DataFrame:
    """Pearson correlation over rows where both are there; NULL unless there are more than so many and both vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return df.groupBy(key).agg(F.when(F.count(a) > more_than, safe_corr(a, b)).alias("corr"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL where one side is constant, which is an error to the built-in one."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def concordance(pairs: DataFrame, a: str, b: str, limits: tuple = (5, 10)) -> DataFrame:
    """Mean and greatest absolute difference, and percent of pairs within each limit."""
    d = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), *[(F.count_if(d <= x) * 100.0 / F.count(d)).alias(f"within_{x}_pct") for x in limits])


def most_distinct(df: DataFrame, key: str, x: str) -> DataFrame:
    """The largest number of distinct values that a group has."""
    return df.groupBy(key).agg(F.count_distinct(x).alias("k")).agg(F.max("k").alias("max_distinct"))


def broken_dependency(df: DataFrame, key: str, x: str) -> DataFrame:
    """Groups that have not exactly one value."""
    return df.groupBy(key).agg(F.count_distinct(x).alias("n_values")).where("n_values <> 1")


def fold_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Folds, and mean and sample deviation of each metric."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*keys).agg(F.count("*").alias("n_folds"), *aggs)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def alert_profiles(scored: DataFrame, key: str, order: str, alert: str, target: str, probability: str, to_birth: str) -> DataFrame:
    """What exemplars are chosen by, a row per patient: target, alerts, peak, when the first alert and the last run of alerts begin, and which window these are, counted from 0.

    persistent_at is NULL unless the last window alerts. Windows are numbered along one sort; the running count of
    quiet windows from the end tells the last run.
    """
    w = Window.partitionBy(key)
    flag = F.coalesce(F.col(alert), F.lit(False))
    d = scored.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__quiet": F.sum((~flag).cast("int")).over(w.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0))})
    place = F.struct(F.col("__i").alias("at"), F.col(to_birth).alias("ewt"))
    last, first = F.min(F.when(F.col("__quiet") == 0, place)), F.min(F.when(flag, place))
    top = F.max(F.struct(probability, (-F.col("__i")).alias("neg"), F.col(to_birth).alias("ewt")))
    g = d.groupBy(key).agg(F.max(target).alias("target"), F.count_if(flag).alias("alerts"), F.max(probability).alias("peak"), last.alias("l"), first.alias("f"), top.alias("t"))
    return g.select(key, "target", "alerts", "peak", F.col("l.at").alias("persistent_at"), F.col("l.ewt").alias("ewt"), F.col("f.at").alias("first_at"), F.col("f.ewt").alias("first_ewt"), (-F.col("t.neg")).alias("peak_at"), F.col("t.ewt").alias("peak_ewt"))


def exemplar_positive(profiles: DataFrame, near: float = 50.0) -> DataFrame:
    """Of alert_profiles the positive to show: record, alert_at (the window its curve is marked at), early_warning_min.

    First those whose last run of alerts begins after a quiet window, the one with a warning time nearest to `near`
    minutes, tie by record. Else, by record, one that alerts throughout or whose first alert comes after a quiet
    window and doesn't last. Else the one of the highest probability, marked at it.
    """
    seen, lasting = F.col("persistent_at") > 0, F.col("persistent_at").isNotNull()
    other = lasting | (F.col("first_at") > 0)
    tier = F.when(seen, 0).when(other, 1).otherwise(2)
    at = F.when(lasting, F.col("persistent_at")).when(F.col("first_at") > 0, F.col("first_at")).otherwise(F.col("peak_at"))
    ewt = F.when(lasting, F.col("ewt")).when(F.col("first_at") > 0, F.col("first_ewt")).otherwise(F.col("peak_ewt"))
    order = [tier, F.when(seen, F.abs(F.col("ewt") - near)), F.when(tier == 2, -F.col("peak")).asc_nulls_last(), F.col("record")]
    return profiles.where("target = 1").orderBy(*order).limit(1).select("record", at.alias("alert_at"), ewt.alias("early_warning_min"))


def exemplar_negative(profiles: DataFrame) -> DataFrame:
    """Of alert_profiles the negative to show: one without alerts of the highest peak, else the one of fewest alerts, ties by record: record, alerts, first_at."""
    quiet = F.col("alerts") == 0
    order = [F.col("alerts"), F.when(quiet, -F.col("peak")).asc_nulls_last(), F.col("record")]
    return profiles.where("target = 0").orderBy(*order).limit(1).select("record", "alerts", F.when(~quiet, F.col("first_at")).alias("first_at"))


def print_table(df: DataFrame, rows: int = 50) -> None:
    """A table on the console, its values whole."""
    df.show(rows, truncate=False)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def subset_violations(inner: DataFrame, outer: DataFrame, on: str) -> DataFrame:
    """Keys of inner that outer hasn't: empty if inner is a subset."""
    return inner.select(on).distinct().join(outer.select(on).distinct(), on, "left_anti")


def histogram(df: DataFrame, x: str, lo: float, width: float, bins: int) -> DataFrame:
    """Rows per left-closed bin, empty bins too: what a bar chart needs."""
    b = F.floor((F.col(x) - lo) / width).cast("int")
    counts = df.where((F.col(x) >= lo) & (F.col(x) < lo + width * bins)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counts, "bin", "left").na.fill(0, ["n"])


def box(df: DataFrame, x: str, key: str, reach: float = 1.5) -> DataFrame:
    """Per group what a box plot needs: quartiles, the outermost values within `reach` interquartile ranges of the box, and how many lie beyond. Exact; groups may be large."""
    q = exact_percentiles(df, x, [0.25, 0.5, 0.75], [key]).select(key, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    q = q.withColumns({"__lo": F.col("q1") - reach * (F.col("q3") - F.col("q1")), "__hi": F.col("q3") + reach * (F.col("q3") - F.col("q1"))})
    d = df.where(F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("__x")).join(q, key)
    within = F.col("__x").between(F.col("__lo"), F.col("__hi"))
    ends = [F.min(F.when(within, F.col("__x"))).alias("low"), F.max(F.when(within, F.col("__x"))).alias("high"), F.count_if(~within).alias("beyond")]
    return d.groupBy(key, "q1", "median", "q3").agg(*ends)


def quantile_pairs(df: DataFrame, a: str, b: str, steps: int) -> DataFrame:
    """Exact quantiles of two columns side by side: what a Q-Q plot needs."""
    qs = [i / steps for i in range(steps + 1)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(c).cast("double").alias("x")) for c, n in ((a, "a"), (b, "b"))])).alias("v")).select("v.*")
    found = exact_percentiles(long, "x", qs, ["c"]).select("c", F.posexplode("q").alias("k", "x"))
    return found.groupBy((F.col("k") / steps).alias("q")).agg(*[F.max(F.when(F.col("c") == n, F.col("x"))).alias(n) for n in ("a", "b")])
