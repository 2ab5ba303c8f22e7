"""Splits and folds: ordered by a hash of the key, so they depend on keys and seed alone, never on partitions.

Ranks within a stratum are prefix sums over hash ranges: a stratum of most rows is not one task. Strata are not NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import hash_unit
from .prefix import exact_percentiles, hash_ranks


def stratified_split(members: DataFrame, key: str, stratum: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """Each member with its split, train or test: ceil(test * n) members test, and strata share the others by their sizes, whole parts first and then by largest remainder (ties by stratum).

    Quotas come from one row per stratum, of which there are few.
    """
    r = hash_ranks(members, hash_unit(F.lit(seed), F.col(key)), [stratum], [key])
    every = Window.partitionBy(F.lit(0))
    g = members.groupBy(stratum).agg(F.count("*").alias("__n")).withColumn("__all", F.sum("__n").over(every))
    g = g.withColumn("__train", F.col("__all") - F.ceil(F.lit(test) * F.col("__all")))
    g = g.withColumns({"__part": F.expr("__n * __train div __all"), "__rest": F.expr("__n * __train % __all")})
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("__rest").desc(), stratum))
    g = g.withColumn("__quota", F.col("__part") + (place <= F.col("__train") - F.sum("__part").over(every)).cast("int"))
    return r.join(g.select(stratum, "__quota"), stratum).select(*members.columns, F.when(F.col("__rank") <= F.col("__quota"), "train").otherwise("test").alias("split"))


def group_folds(members: DataFrame, key: str, stratum: str, k: int, seed: int = 42) -> DataFrame:
    """Each member with its fold, every stratum spread evenly."""
    r = hash_ranks(members, hash_unit(F.lit(seed), F.col(key)), [stratum], [key])
    return r.select(*members.columns, ((F.col("__rank") - 1) % k).cast("int").alias("fold"))


def fold_count(members: DataFrame, stratum: str, k: int) -> int:
    """k, but no more than the smallest class has members, and 2 at least."""
    least = members.groupBy(stratum).count().agg(F.min("count")).first()[0] or 0
    if least < 2:
        raise ValueError("a class has fewer than two members")
    return max(2, min(k, least))


def nested_folds(members: DataFrame, key: str, stratum: str, outer: int, inner: int, seed: int = 42) -> DataFrame:
    """Each member with its outer fold and, for every other outer fold, its inner fold: key, outer, test_of, inner."""
    o = group_folds(members, key, stratum, outer, seed).withColumnRenamed("fold", "outer")
    parts = o.withColumn("test_of", F.explode(F.array(*map(F.lit, range(outer))))).where("outer <> test_of")
    r = hash_ranks(parts, hash_unit(F.lit(seed), F.col("test_of"), F.col(key)), ["test_of", stratum], [key])
    return r.select(*parts.columns, ((F.col("__rank") - 1) % inner).cast("int").alias("inner"))


def leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if the split is clean."""
    return a.select(key).intersect(b.select(key))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians, all by one pass of prefix sums; NULL for a column without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    found = exact_percentiles(long, "x", [0.5], ["c"])
    return found.agg(*[F.max(F.when(F.col("c") == c, F.col("q")[0])).alias(c) for c in columns])


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column the median, and mean and population deviation after filling with it."""
    m = medians(train, columns).select(*[F.col(c).alias(f"{c}__med") for c in columns])
    filled = train.select(*columns).crossJoin(F.broadcast(m)).select(*[F.coalesce(c, f"{c}__med").alias(c) for c in columns], *[f"{c}__med" for c in columns])
    return filled.agg(*[x for c in columns for x in (F.first(f"{c}__med").alias(f"{c}__med"), F.avg(c).alias(f"{c}__avg"), F.stddev_pop(c).alias(f"{c}__std"))])


def standardize(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns filled and scaled by a fitted row; a constant column is only centred."""
    rest = [c for c in df.columns if c not in columns]
    sd = lambda c: F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0)
    return df.crossJoin(F.broadcast(scaler)).select(*rest, *[((F.coalesce(c, f"{c}__med") - F.col(f"{c}__avg")) / sd(c)).alias(c) for c in columns])
