"""Files in and out, and the streaming monitor against the batch operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import trends as W
from pulsegrid.sources import files
from pulsegrid.streaming import monitor as S


def test_signal_files(spark, tmp_path):
    np.save(tmp_path / "1001_fhr.npy", np.array([140, np.nan, 150, 1], np.float32))
    np.save(tmp_path / "1001_uc.npy", np.array([1, 2, 3], np.float32))
    np.save(tmp_path / "1002_fhr.npy", np.array([1, 2], np.float32))
    (tmp_path / "1003_fhr.npy").write_bytes(b"junk")
    d = str(tmp_path)
    fhr, uc = files.read_npy(spark, d, "_fhr.npy"), files.read_npy(spark, d, "_uc.npy")
    assert [r.record for r in files.list_records(spark, d).collect()] == ["1001", "1002", "1003"]
    assert fhr.where("error IS NOT NULL").count() == 1
    side = str(tmp_path / "bad")
    good = files.quarantine(fhr, "error", side)
    assert good.count() == 2 and spark.read.json(side).count() == 1
    pair = files.pair_channels(good, uc).collect()
    assert [(r.record, r.fhr, r.uc) for r in pair] == [("1001", [140.0, None, 150.0], [1.0, 2.0, 3.0])]
    assert files.pair_channels(good, uc, "null").count() == 2
    with pytest.raises(Exception, match="no contraction"):
        files.pair_channels(good, uc, "error").count()
    assert {r.record: r.n_samples for r in files.npy_lengths(spark, d).collect()}["1001"] == 4


def test_tables_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("1", 7.1), ("2", None)], "record string, ph double")
    p = str(tmp_path / "t")
    files.write_csv(df, p)
    assert sorted(map(tuple, files.read_csv(spark, p, df.schema).collect())) == sorted(map(tuple, df.collect()), key=str)
    assert files.csv_columns(spark, p) == ["record", "ph"]
    calls = []
    build = lambda: (calls.append(1), df)[1]
    for _ in range(2):
        assert files.stage_table(spark, str(tmp_path / "s"), build).count() == 2
    assert len(calls) == 1
    assert files.first_existing(spark, [str(tmp_path / "no"), p]) == p
    with pytest.raises(FileNotFoundError):
        files.require_stage(spark, str(tmp_path / "no"), "stage one")
    doc = files.to_document(df.where("record = '1'")).first()[0]
    assert json.loads(doc) == {"record": "1", "ph": 7.1} and "\n" in doc


def test_demo_series(spark):
    d = files.demo_series(spark, 3).select("record", F.size("x").alias("n"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi"), (F.size(F.filter("x", lambda v: v.isNull())) / F.size("x")).alias("gone"))
    for r in d.collect():
        assert 5000 <= r.n < 20000 and r.lo >= 80 and r.hi <= 200 and 0.03 < r.gone < 0.07


def test_monitor_agrees_with_batch(spark, tmp_path):
    values = [5.0, 4.0, 3.0, 3.0, 2.0, None, 1.0, 0.0, 6.0, 7.0]
    rows = [(k, 5.0 * i, None if v is None else v + j) for j, k in enumerate(("a", "b")) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "record string, window_start_min double, value double")
    for part, cond in enumerate(("window_start_min < 25", "window_start_min >= 25")):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = S.monitor(stream, 6.0).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    live = {(r.record, r.window_start_min): r for r in spark.table("live").collect()}
    assert len(live) == len(rows)
    batch = W.add_trends(df, ["record"], "window_start_min", {"delta": "value"}, {"streak": "value"}, {"slope": "value"}).collect()
    for r in batch:
        x = live[r.record, r.window_start_min]
        assert (x.delta2, x.falling_streak, round(x.slope, 9)) == (r.delta, r.streak, round(r.slope, 9))
    start = W.persistent_start(df.withColumn("alert", F.col("value") >= 6), "alert", "record", "window_start_min")
    for r in start.collect():
        assert live[r.record, 45.0].alert_run_start == r.persistent_start


def test_event_time_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "ev"))
    stream = S.event_time(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")))
    q = S.sliding_means(stream, "event_type", "value").writeStream.format("memory").queryName("slid").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = S.sliding_means(S.event_time(e), "event_type", "value")
    assert spark.table("slid").select("event_type", "start", "n").exceptAll(batch.select("event_type", "start", "n")).isEmpty()
    assert S.sessions(S.event_time(e), "user_id").agg(F.sum("n")).first()[0] == e.count()


def test_headers_and_signals_of_a_folder(spark, tmp_path):
    from pulsegrid.plans import pipelines

    (tmp_path / "a.hea").write_text("a 2 4 3\n#-- Outcome\n#pH           7.14\n#Apgar5   9\n")
    (tmp_path / "b.hea").write_text("b 2 4 3\n#pH           x\n")
    got = {r.record: r for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert (got["a"].pH, got["a"].Apgar5, got["b"].pH, got["b"].Age) == (7.14, 9.0, None, None)
    np.save(tmp_path / "a_fhr.npy", np.array([140, np.nan, 142], np.float32))
    np.save(tmp_path / "a_uc.npy", np.array([10, 11], np.float32))
    np.save(tmp_path / "b_fhr.npy", np.array([1.0]))
    (tmp_path / "c_fhr.npy").write_bytes(b"no array")
    (tmp_path / "c_uc.npy").write_bytes(b"")
    assert [tuple(r) for r in pipelines.read_signals(spark, str(tmp_path)).collect()] == [("a", [140.0, None], [10.0, 11.0], 4)]


def test_wfdb_records(spark, tmp_path):
    raw = np.array([[14000, 50], [-32768, 100], [14200, -32768]], "<i2")
    (tmp_path / "a.dat").write_bytes(raw.tobytes())
    (tmp_path / "a.hea").write_text("a 2 4 3\na.dat 16 100(0)/bpm 12 0 14000 0 0 FHR\na.dat 16 10/nd 12 50 0 0 0 UC\n#pH   7.1\n")
    (tmp_path / "b.dat").write_bytes(raw.tobytes())
    (tmp_path / "b.hea").write_text("b 2 4 3\nb.dat 16 100/bpm 12 0 0 0 0 other\nb.dat 16 100(0)/bpm 12 0 0 0 0 my fhr\n")
    (tmp_path / "c.hea").write_text("c 1 4 3\nc.dat 212 100/bpm 12 0 0 0 0 FHR\n")
    (tmp_path / "c.dat").write_bytes(b"xx")
    got = {r.record: r for r in files.read_wfdb(spark, str(tmp_path)).collect()}
    assert (got["a"].fhr, got["a"].uc, got["a"].fs, got["a"].error) == ([140.0, None, 142.0], [0.0, 5.0, None], 4, None)
    assert got["b"].fhr == [0.5, 1.0, None] and got["b"].uc is None
    assert got["c"].fhr is None and "format" in got["c"].error


def test_channels_status_and_what_is_left(spark):
    names = spark.createDataFrame([(["FHR", "UC"],), (["x", "my uc"],), (["x"],)], "n array<string>")
    assert [tuple(r) for r in names.select(files.channel_of(F.col("n"), "fhr"), files.channel_of(F.col("n"), "uc")).collect()] == [(0, 1), (None, 1), (None, None)]
    rows = [("a", [1.0], [2.0], False, None, "ok"), ("b", [1.0], [None], False, None, "sin_uc"), ("c", [1.0], [1.0], True, None, "ya_existe"), ("d", None, None, False, "bad", "error")]
    df = spark.createDataFrame(rows, "record string, fhr array<double>, uc array<double>, known boolean, error string, want string")
    assert df.where(files.download_status(F.col("fhr"), F.col("uc"), F.col("known"), F.col("error")) != F.col("want")).isEmpty()
    assert [r.record for r in files.not_yet(df, df.where("record <> 'b'")).collect()] == ["b"]
    assert [r.record for r in files.first_pairs(df, 2).collect()] == ["a", "b"]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    files.write_csv(df, str(tmp_path / "marked"), mark=True)
    text = next((tmp_path / "marked").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbf") and text.decode("utf-8-sig").splitlines()[0] == "a,b"


def test_curve_bias_and_columns(spark):
    from pulsegrid.operators import fidelity, tables

    a = spark.createDataFrame([(0, 1.0), (5, 0.5), (9, 0.1)], "lag int, acf double")
    r = fidelity.curve_bias(a, a.withColumn("acf", F.col("acf") - 0.25), "lag", "acf", [0, 5]).orderBy("lag").collect()
    assert [(x.lag, x.bias) for x in r] == [(0, -0.25), (5, -0.25)]
    tables.print_table(a, 1)
