"""What the third review found: each test failed before its finding was mended."""

from pathlib import Path

import duckdb
import pytest

from pulsegrid.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def sql_rows(name, threads, sf=SMALL):
    c = duckdb.connect()
    c.execute(f"SET threads = {threads}")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(ORACLE[name])
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", ["rolling_slope", "entropies"])
def test_sql_agrees_to_the_last_bit(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns, few = sql_rows(name, 1)
    mine = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    assert mine == sorted(map(repr, few)) == sorted(map(repr, sql_rows(name, 8)[1]))


def test_small_tables_are_few_tasks_in_every_fit(spark):
    """Two hundred shuffle partitions were two hundred tasks in each of a forest's jobs."""
    from pulsegrid.operators.prefix import dealt

    assert dealt(spark.range(1000).repartition(200), "id").rdd.getNumPartitions() == 1
    assert dealt(spark.range(100_000), "id").rdd.getNumPartitions() == 4


def test_search_gives_the_scores_that_the_setting_was_chosen_by(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators import metrics, trees

    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 17 > 8).cast("int").alias("y")).cache()
    spec = trees.ModelSpec("RandomForest", trees.specs()[1].build, {"maxDepth": (1, 2), "numTrees": (3,)})
    params, scores = trees.search(spec, df, ["a", "b"], "y", "fold", [0, 1], 2)
    assert scores.count() == 400 and params == trees.tune(spec, df, ["a", "b"], "y", "fold", [0, 1], 2)
    again = trees.out_of_fold(spec, params, df, ["a", "b"], "y", "fold", [0, 1], key="id")
    value = lambda d: metrics.average_precision(d, "probability", "y").first()[0]
    assert value(scores) == pytest.approx(value(again), abs=0.1)


def test_strategy_fidelity_makes_each_replicate_once(spark, monkeypatch):
    """Value counts are made once and kept for the three times that distances read them."""
    from pulsegrid.operators import fidelity

    kept = []
    counts = fidelity.value_counts
    monkeypatch.setattr(fidelity, "value_counts", lambda *a: kept.append(counts(*a)) or kept[-1])
    found = QUERIES["strategy_fidelity"](spark, SMALL)
    assert len(kept) == 1 and found.columns[:3] == ["ks", "wasserstein", "strategy"] and found.count() == 4
    assert kept[0].storageLevel.useMemory is False
