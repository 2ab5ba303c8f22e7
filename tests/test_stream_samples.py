"""Streamed windows against the batch operator, and what is left of a record's state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import features as X
from pulsegrid.streaming import monitor as S
from pulsegrid.streaming import samples as L

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "record string, i bigint, ts timestamp, fhr double, uc double, ended boolean"


def signals():
    rng = np.random.default_rng(4)
    out = {}
    for k, n in (("a", 4 * 60 * 9 + 3), ("b", 4 * 60 * 7), ("short", 4 * 60 * 2), ("bad", 4 * 60 * 6)):
        t = np.arange(n) / 4
        fhr, uc = 140 + 8 * np.sin(t / 20) + rng.normal(0, 3, n), 20 + 18 * np.sin(t / 30) + rng.normal(0, 1, n)
        fhr[100:160] += 30
        fhr[rng.random(n) < (0.6 if k == "bad" else 0.05)] = np.nan
        uc[rng.random(n) < 0.1] = 0
        out[k] = (fhr, uc)
    return out


def rows_of(found, started):
    out = []
    for k, (fhr, uc) in found.items():
        for i, (f, u) in enumerate(zip(fhr, uc, strict=True)):
            out.append((k, i, T0 + dt.timedelta(seconds=started.get(k, 0) + i / 4), None if f != f else float(f), float(u), i == len(fhr) - 1))
    return out


def run(spark, tmp_path, batches, name, **options):
    for k, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = L.stream_features(stream, length_min=4, stride_min=1, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        q.processAllAvailable()
        left = next((p["stateOperators"][0]["numRowsTotal"] for p in reversed(q.recentProgress) if p["stateOperators"]), None)
    finally:
        q.stop()
    return spark.table(name).collect(), left


def batch_of(spark, found):
    df = spark.createDataFrame([(k, [None if v != v else float(v) for v in f], u.tolist()) for k, (f, u) in found.items()], "record string, fhr array<double>, uc array<double>")
    return X.window_features(df, length_min=4, stride_min=1).drop("time_to_birth_min").collect()


def equal(got, want):
    key = lambda r: (r.record, r.window_id)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want, strict=True):
        for c in b.asDict():
            x, y = a[c], b[c]
            assert x == y or (x is None or x != x) and (y is None or y != y) or x == pytest.approx(y, rel=1e-9), (c, x, y)


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get(L._PROVIDER)
    yield
    spark.conf.set(L._PROVIDER, before)


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    found = signals()
    rows = rows_of(found, {"b": 45})
    rng = np.random.default_rng(1)
    # in order of time, each up to three minutes late
    order = np.argsort([(r[2] - T0).total_seconds() + 170 * rng.random() for r in rows], kind="stable")
    rows = [rows[k] for k in order]
    end = [("clock", 0, T0 + dt.timedelta(hours=3), None, None, True), ("clock2", 0, T0 + dt.timedelta(hours=9), None, None, True)]
    cuts = np.linspace(0, len(rows), 5).astype(int)
    batches = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got, left = run(spark, tmp_path, [*batches, end[:1], end[1:]], "streamed", late="3 minutes")
    want = batch_of(spark, found)
    assert {r.record for r in want} == {"a", "b"}
    equal(got, want)
    # the two clocks' own rows may be left, of the records nothing is
    assert left <= 4


def test_samples_after_the_end_of_a_window_are_missing_in_it(spark, tmp_path):
    n = 4 * 60 * 6
    found = {"a": (np.full(n, 140.0) + np.arange(n) % 7, np.full(n, 30.0))}
    rows = rows_of(found, {})
    late = [r for r in rows if 300 <= r[1] < 400]
    first = [r for r in rows if r not in late and r[1] < n - 1]
    ahead = [("clock", 0, T0 + dt.timedelta(minutes=4, seconds=62), None, None, False)]
    # by then window 0 (minutes 0 to 4) is over, and window 1 isn't: samples 300 to 400 are in both
    got, _ = run(spark, tmp_path, [[*first, *ahead], ahead, late, rows[-1:], [("clock", 1, T0 + dt.timedelta(hours=2), None, None, True)], [("clock2", 1, T0 + dt.timedelta(hours=5), None, None, True)]], "late", late="1 minutes")
    rate = {r.window_id: r.fhr_invalid_pct for r in got}
    assert set(rate) == {0, 1, 2} and rate[2] == pytest.approx(0, abs=1e-9)
    assert rate[0] == pytest.approx(100 * 100 / 960) and rate[1] == pytest.approx(0, abs=1e-9)


def test_state_of_a_silent_record_goes(spark, tmp_path):
    n = 4 * 60 * 5
    found = {"silent": (np.full(n, 140.0), np.full(n, 30.0))}
    rows = [(*r[:5], False) for r in rows_of(found, {})]
    clock = [[(f"clock{h}", 0, T0 + dt.timedelta(hours=h), None, None, True)] for h in (1, 4, 8)]
    got, left = run(spark, tmp_path, [rows, *clock], "silent", late="1 minutes", idle_min=60)
    assert sorted(r.window_id for r in got) == [0, 1] and left <= 6


def test_monitor_forgets_records(spark, tmp_path):
    """Event time an hour after a record's last window, its trend state is gone."""
    df = spark.createDataFrame([("a", 5.0 * k, float(k), T0 + dt.timedelta(minutes=5 * k)) for k in range(4)] + [("b", 0.0, 1.0, T0 + dt.timedelta(hours=9))], "record string, window_start_min double, value double, ts timestamp")
    for part, cond in enumerate(("record = 'a'", "record = 'b'", "record = 'c'")):
        more = df.where(cond) if part < 2 else df.where("record = 'b'").withColumn("record", F.lit("c")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 HOURS"))
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = S.monitor(S.event_time(stream, late="1 minutes"), 6.0, idle_min=60).writeStream.format("memory").queryName("forgets").outputMode("append").start()
    q.processAllAvailable()
    total = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert spark.table("forgets").count() == 6 and total[0] == 1 and total[-1] == 1
