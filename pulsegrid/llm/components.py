"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "components", steps: int = 50) -> DataFrame:
    """Rows (id, root) for every node of `edges` (a, b; longs): root is the least id of its component.

    Each step joins every node's neighbours to the least one it knows; a node's least neighbour is an aggregate
    with partial sums, so a node with very many neighbours is split like any skewed join. Every step's edges are
    written, which cuts the lineage; the number of edges never grows. Null nodes and loops are left out.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
        return r.n, r.s

    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = ws.save(e, f"{name}-0")
    before = state(e)
    if not before[0]:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for k in range(1, steps + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: greater neighbours go to the least one; e has a > b, so those of b are its a
        large = e.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node and its lesser neighbours go to the least of them
        pairs = large.join(down, "a")
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = ws.save(small, f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        e, now = new, state(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
