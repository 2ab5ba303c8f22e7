"""Stage tables: what is rebuilt, what is kept, and what two builders leave."""

import threading

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import stages


def source(spark, rows):
    return spark.createDataFrame(rows, "record string, x double")


def stage(built, code="1", **params):
    def build(a, b):
        keys = sorted((str(r.record) for r in a.select("record").distinct().collect()))
        built.append(keys)
        return a.join(b, "record", "left").groupBy("record").agg(F.sum("x").alias("total"), F.max("y").alias("y"))

    return stages.Stage("sums", "record", build, code, params)


def test_only_changed_records_are_built(spark, tmp_path):
    root, built = str(tmp_path / "s"), []
    rows = [(f"r{k}", float(k)) for k in range(100)]
    other = spark.createDataFrame([(f"r{k}", k) for k in range(0, 100, 3)], "record string, y int")
    got = lambda df, s: sorted((r.record, r.total, r.y) for r in stages.refresh(spark, root, s, {"a": df, "b": other}).collect())
    want = lambda rows: sorted((k, x, int(k[1:]) if int(k[1:]) % 3 == 0 and int(k[1:]) < 100 else None) for k, x in rows)
    s = stage(built, p=1)
    assert got(source(spark, rows), s) == want(rows) and len(built[0]) == 100
    # the same again, in another order: nothing is built
    assert got(source(spark, rows[::-1]).repartition(7), s) == want(rows) and len(built) == 1
    changed = [(k, x + 1000) if k == "r42" else (k, x) for k, x in rows]
    assert got(source(spark, changed), s) == want(changed)
    assert "r42" in built[1] and len(built[1]) < 15
    assert len(stages.versions(spark, root)[-1]["built"]) == 1
    fewer = [r for r in changed if r[0] != "r7"] + [("r500", 5.0)]
    assert got(source(spark, fewer), s) == want(fewer) and len(stages.versions(spark, root)[-1]["built"]) <= 2
    # an older state again is another version, built from what changed since the newest
    assert got(source(spark, changed), s) == want(changed)
    # other parameters or code: everything
    n = len(built)
    assert got(source(spark, changed), stage(built, p=2)) == want(changed) and len(built[n]) == 100
    assert got(source(spark, changed), stage(built, code="2", p=2)) == want(changed) and len(built[n + 1]) == 100
    # back to the first: its partitions are still there
    assert got(source(spark, changed), s) == want(changed) and len(built) == n + 2
    assert sorted(map(tuple, stages.current(spark, root).select("record", "total", "y").collect())) == want(changed)
    gone = stages.vacuum(spark, root, keep=1)
    assert gone and sorted(map(tuple, stages.current(spark, root).select("record", "total", "y").collect())) == want(changed)


def test_a_build_that_fails_leaves_the_version_before(spark, tmp_path):
    root, built = str(tmp_path / "s"), []
    b = spark.createDataFrame([("a", 1)], "record string, y int")
    s = stage(built)
    stages.refresh(spark, root, s, {"a": source(spark, [("a", 1.0)]), "b": b})

    def broken(a, b):
        return a.groupBy("record").agg(F.sum("x").alias("total"), F.max(F.raise_error(F.lit("no"))).cast("int").alias("y"))

    with pytest.raises(Exception, match="no"):
        stages.refresh(spark, root, stages.Stage("sums", "record", broken, "1", {}), {"a": source(spark, [("a", 2.0)]), "b": b})
    assert [r.total for r in stages.current(spark, root).collect()] == [1.0] and len(stages.versions(spark, root)) == 1


def test_two_builders_at_once_leave_whole_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    b = spark.createDataFrame([("r1", 1)], "record string, y int")
    results, errors = {}, []

    def work(k):
        try:
            df = source(spark, [(f"r{i}", float(i * k)) for i in range(50)])
            results[k] = sorted((r.record, r.total) for r in stages.refresh(spark, root, stage([], p=0), {"a": df, "b": b}).collect())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert all(results[k] == sorted((f"r{i}", float(i * k)) for i in range(50)) for k in results)
    found = stages.versions(spark, root)
    assert len(found) == 3 and len({m["id"] for m in found}) == 3
    assert sorted((r.record, r.total) for r in stages.current(spark, root).collect()) in results.values()


def test_null_keys_empty_inputs_and_no_stage(spark, tmp_path):
    b = spark.createDataFrame([("a", 1)], "record string, y int")
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        stages.current(spark, root)
    s = stage([])
    assert stages.refresh(spark, root, s, {"a": source(spark, []), "b": b.limit(0)}).collect() == []
    got = stages.refresh(spark, root, s, {"a": source(spark, [(None, 1.0), (None, 2.0), ("a", 1.0), ("a", 1.0)]), "b": b})
    assert sorted((str(r.record), r.total, r.y) for r in got.collect()) == [("None", 3.0, None), ("a", 2.0, 1)]
