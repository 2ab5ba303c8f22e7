"""Writes that evaluate their input once, and what they count."""

from pyspark.sql import functions as F

from pulsegrid.plans import pipelines as P
from pulsegrid.sources import files


def counted(spark, df):
    """df, and an accumulator of the rows that were made of it."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    return df.mapInArrow(seen, df.schema), runs


def test_a_split_write_evaluates_once_and_can_be_run_again(spark, tmp_path):
    df, runs = counted(spark, spark.range(100).withColumn("v", F.col("id") % 7))
    error = F.when(F.col("v") == 3, F.concat(F.lit("v is "), F.col("v")))
    for turn in (1, 2):
        s = files.split_write(df, error, str(tmp_path / "out"), {"large": F.count_if(F.col("v") > 4)})
        assert runs.value == 100 * turn
        assert s.counts == {"rows": 100, "bad": 14, "large": 28}
        assert s.good.count() == 86 and s.good.columns == ["id", "v"]
        assert {r.error for r in s.bad.collect()} == {"v is 3"} and s.bad.count() == 14
    none = files.split_write(df.limit(0), error, str(tmp_path / "none"))
    assert none.counts["rows"] == 0 and none.good.collect() == none.bad.collect() == []


def test_a_second_quarantine_does_not_double_rejects(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "broken")], "record string, x int, error string")
    for _ in range(2):
        good = files.quarantine(df, "error", str(tmp_path / "bad"))
        assert [tuple(r) for r in good.collect()] == [("a", 1)]
        assert [(r.record, r.error) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [("b", "broken")]


def test_eligibility_is_evaluated_once(spark, tmp_path):
    rows = [("a", 10.0, 60.0, True), ("b", 50.0, 10.0, False), ("c", 5.0, 20.0, True), ("d", 30.0, 30.0, True), ("e", None, 40.0, True)]
    stats = spark.createDataFrame(rows, "record string, fhr_nan_pct double, duration_min double, has_uc boolean")
    once, runs = counted(spark, stats)
    s = P.split_eligible(once, str(tmp_path / "e"))
    want = P.rejected(stats).first()
    assert runs.value == len(rows) and (s.counts["rows"], s.counts["too_many_gaps"], s.counts["too_short"], s.counts["no_uc"], s.counts["rows"] - s.counts["bad"]) == tuple(want)
    assert sorted(r.record for r in s.good.collect()) == sorted(r.record for r in P.eligible(stats).collect()) == ["a", "d"]
    assert {r.record: r.error for r in s.bad.collect()} == {"b": "too_many_gaps, too_short, no_uc", "c": "too_short", "e": "not known"}


def test_augmented_windows_are_counted_as_they_are_written(spark, tmp_path):
    train = spark.createDataFrame([("1", 0, "1", 2.0, "real"), ("2", 1, "2", 3.0, "real")], "record string, target int, group_record string, a double, sample_source string")
    made = spark.createDataFrame([("1_0", "1", 0, 1.0), ("2_0", "2", 1, 4.0), ("9_0", "9", 1, 4.0)], "record string, source_record string, target int, a double")
    for k, synthetic in enumerate((made, None, made.drop("source_record"), made.where("false"))):
        once, runs = counted(spark, synthetic) if synthetic is not None else (None, None)
        rows, report = P.write_augmented(train, once, ["a"], str(tmp_path / f"w{k}"))
        assert runs is None or runs.value <= synthetic.count()
        whole, want = P.augmented(train, synthetic, ["a"])
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect())) and report == want.first().asDict()


def test_parameters_are_stored_by_spark_paths(spark, tmp_path):
    P.save_parameters(f"file://{tmp_path}/p.json", {"a": 1}, name="é")
    assert '"name": "\\u00e9"' in files.read_text(f"file://{tmp_path}/p.json")
