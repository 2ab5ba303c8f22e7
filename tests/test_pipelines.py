"""The lifecycles end to end on small made-up records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as K
from pulsegrid.operators import trees
from pulsegrid.plans import pipelines as P
from pulsegrid.schemas import CLINICAL

FS = 4


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(0)
    rows, heads = [], []
    for k in range(12):
        n = FS * 60 * 31
        t = np.arange(n)
        sick = k % 2
        fhr = 140 + (2 if sick else 8) * np.sin(t / 60) + rng.standard_normal(n)
        uc = 10 + 40 * np.maximum(0, np.sin(2 * np.pi * t / (FS * 180)))
        rows.append((str(k), fhr.tolist(), uc.tolist(), FS))
        heads.append({"record": str(k), "pH": 7.0 if sick else 7.3, "Apgar5": 9.0, "Age": 20.0 + k, "Sex": float(k % 3), "Sig2Birth": 60.0})
    signals = spark.createDataFrame(rows, "record string, fhr array<double>, uc array<double>, fs int")
    clinical = spark.createDataFrame([tuple(h.get(f.name) for f in CLINICAL) for h in heads], CLINICAL)
    return signals.cache(), clinical.cache()


@pytest.fixture(scope="module")
def matrix(records, tmp_path_factory):
    signals, clinical = records
    path = str(tmp_path_factory.mktemp("m") / "w")
    P.clean_windows(signals, clinical, length_min=2, stride_min=5).write.parquet(path)
    return signals.sparkSession.read.parquet(path)


def test_window_matrix(matrix):
    assert matrix.groupBy("record").count().where("count <> 6").isEmpty()
    assert not set(matrix.columns) & {"pH", "Apgar5", "Weight_g"}
    assert matrix.where("target <> cast(record AS int) % 2").isEmpty()
    r = matrix.where("record = '1' AND window_id = 5").first()
    assert r.window_start_min == 25 and r.time_to_birth_min == pytest.approx(31 + 1 - 27)
    found = P.candidate_features(matrix)
    assert "signal_duration_min" not in found and "Age" in found and "target" not in found
    d = P.variable_dictionary(matrix.sparkSession, matrix.columns)
    assert d.where("variable = 'delta_sampen'").first().kind == "trend" and d.where("variable = 'fhr_apen'").first().kind == "nonlinear complexity"
    assert [r.variable for r in d.orderBy("position").collect()] == [c for c in P.predictor_names() if c in matrix.columns]
    assert d.where("variable = 'Age'").first().kind == "baseline" and d.count() == len([c for c in matrix.columns if c in P.predictor_names()])


def test_bootstrap_dataset(records):
    signals, clinical = records
    some = signals.where("record < '2'")
    d = P.bootstrap_dataset(some, clinical, 2).cache()
    assert d.where("is_synthetic").count() == 2 * some.count() and d.where("is_synthetic AND pH IS NULL").isEmpty()
    c = P.metadata_concordance(d).first()
    assert c.within_5_pct > 90 and c.max_distinct == 1
    made = d.where("is_synthetic").select("record", "fhr")
    r = P.fidelity_report(some.select("record", "fhr"), {"stationary_bootstrap": made}, 50).first()
    assert r.ks < 0.1 and r.ks_verdict in ("good", "fair") and r.acf_r > 0.5 and "xcorr_r" not in r
    both = P.fidelity_report(some, {"same": some}, 50).first()
    assert both.ks == 0 and both.xcorr_r == pytest.approx(1) and both.xcorr_r_verdict == "good" and both.psd_r == pytest.approx(1)


def test_fidelity_of_all_strategies_side_by_side(spark, tmp_path):
    rng = np.random.default_rng(5)
    own = [(str(i), (140 + np.cumsum(rng.normal(0, 1, 300))).tolist(), rng.normal(20, 3, 300).tolist()) for i in range(4)]
    own.append(("short", [1.0, None, float("nan")], [1.0, 2.0]))  # channels of unlike length, no curve
    own.append(("none", None, None))
    df = spark.createDataFrame(own, "record string, fhr array<double>, uc array<double>")
    noise = spark.createDataFrame([("a", rng.normal(150, 9, 300).tolist())], "record string, fhr array<double>")
    got = {r.strategy: r for r in P.fidelity_report(df, {"same": df, "noise": noise, "nothing": df.where("false")}, 30, str(tmp_path / "sets")).collect()}
    assert set(got) == {"same", "noise", "nothing"}
    assert got["same"].ks == got["same"].wasserstein == 0 and [got["same"][c] for c in ("acf_r", "psd_r", "xcorr_r")] == pytest.approx([1, 1, 1])
    n = got["noise"]
    x, y = np.array([v for _, f, _ in own[:4] for v in f] + [1.0]), np.array(noise.first().fhr)
    grid = np.unique([*x, *y])
    gap = abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y))
    assert n.ks == pytest.approx(gap.max()) and n.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum()) and n.xcorr_r is None
    acf = np.mean([K.autocorrelation(np.array(f), 30) for _, f, _ in own[:4]], axis=0)
    psd = [np.log1p(np.mean([K.welch(np.array(f))[1] for f in fs], axis=0)) for fs in ([f for _, f, _ in own[:4]], [y])]
    assert n.acf_r == pytest.approx(np.corrcoef(acf, K.autocorrelation(y, 30))[0, 1]) and n.psd_r == pytest.approx(np.corrcoef(*psd)[0, 1])
    assert got["nothing"].ks is None and got["nothing"].psd_r is None and got["nothing"].ks_verdict == "poor"


def test_rejected(spark):
    rows = [("a", 10.0, 40.0, True), ("b", 40.0, 20.0, True), ("c", 0.0, 60.0, False), ("d", 30.0, 30.0, True)]
    stats = spark.createDataFrame(rows, "record string, fhr_nan_pct double, duration_min double, has_uc boolean")
    assert tuple(P.rejected(stats).first()) == (4, 1, 1, 1, 2)
    assert sorted(r.record for r in P.eligible(stats).collect()) == ["a", "d"]


def test_record_features(records):
    signals, clinical = records
    r = {x.record: x for x in P.record_features(signals, clinical).collect()}
    assert len(r) == 12 and r["3"].Age == 23 and r["3"].signal_duration_min == 31 and r["3"].fhr_baseline_mean_bpm == pytest.approx(140, abs=3)


def test_synthetic_windows_follow_their_source(records):
    signals, clinical = records
    made = signals.where("record < '2'").selectExpr("concat(record, '_boot_0') AS record", "fhr", "uc", "fs", "record AS source_record", "0 AS bootstrap_idx")
    w = P.clean_windows(made, clinical, "synthetic", length_min=2, stride_min=10)
    r = w.where("record = '1_boot_0'").orderBy("window_id").first()
    assert (r.group_record, r.source_record, r.bootstrap_idx, r.sample_source, r.target) == ("1", "1", 0, "synthetic", 1)
    assert w.where("sequence_id <> record").isEmpty()


def test_cleaned_samples(spark):
    df = spark.createDataFrame([("a", [100.0, 0.0, 104.0, 250.0])], "record string, fhr array<double>")
    assert [r.fhr for r in P.cleaned_samples(df).orderBy("i").collect()] == [100, 102, 104, None]
    assert [r.fhr for r in P.cleaned_samples(df, max_gap=0).orderBy("i").collect()] == [100, None, 104, None]


def test_phase_one(matrix):
    train = matrix.where("cast(record AS int) < 10").withColumn("fold", F.expr("cast(cast(record AS int) / 2 AS int) % 2"))
    # unclear, so that a fit exists
    train = train.withColumn("target", F.when(F.col("window_id") == 0, 1 - F.col("target")).otherwise(F.col("target"))).cache()
    got = P.phase_one(train, ["fhr_baseline_std_bpm", "fhr_sampen", "Age"]).collect()
    assert [r.feature for r in got][-1] == "Age" and got[0].auroc_cv >= got[1].auroc_cv > 0.7 and got[0].folds == 2
    assert all(r.odds_ratio is None or r.ci_lower <= r.odds_ratio <= r.ci_upper for r in got) and any(r.odds_ratio for r in got)


def test_phase_two(matrix):
    mixed = matrix.withColumn("target", F.when(F.col("window_id") == 0, 1 - F.col("target")).otherwise(F.col("target"))).withColumn("group_record", F.col("record"))
    train, test = mixed.where("cast(record AS int) < 8"), mixed.where("cast(record AS int) >= 8")
    chosen, table, report = P.phase_two(train, test, ["fhr_baseline_std_bpm", "Age", "fhr_apen"])
    assert chosen and [r["feature"] for r in table] == ["intercept", *chosen]
    r = report.first()
    assert 0.5 < r.auroc <= 1 and 0 <= r.brier <= 0.5 and r.patient_recall is not None
    _, path = P.logit.forward_selection(P.split.standardize(train, P.split.fit_scaler(train, ["Age", "fhr_apen"]), ["Age", "fhr_apen"]), ["Age", "fhr_apen"], "target")
    order = P.selection_order(train.sparkSession, path).collect()
    assert [r.step for r in order] == list(range(1, len(path) + 1)) and all(r.gain is None or r.gain > 0 for r in order)


def test_nested_validation(matrix):
    options = P.arguments(["--folds", "2", "--inner-folds", "2", "--n-iter", "1"])
    spec = trees.ModelSpec("RandomForest", trees.specs()[1].build, {"maxDepth": (2,), "numTrees": (3,)})
    rows, summary = P.nested_validation(matrix, spec, options)
    got = rows.collect()
    assert sorted(r.fold for r in got) == [0, 1] and all(r.auroc > 0.8 for r in got) and sum(r.tp + r.fp + r.fn + r.tn for r in got) == matrix.count()
    assert summary.first().n_folds == 2
    with pytest.raises(ValueError, match="targets"):
        P.nested_validation(matrix.withColumn("target", F.col("window_id") % 2), spec, options)


def test_rebuild_and_augmentation(matrix, tmp_path):
    train, test = matrix.where("cast(record AS int) < 8"), matrix.where("cast(record AS int) >= 8")
    path, features = str(tmp_path / "best.json"), ["fhr_baseline_std_bpm", "Age"]
    P.save_parameters(path, {"maxDepth": 2, "numTrees": 5}, name="RandomForest", features=features, threshold=0.5)
    scored, threshold = P.rebuild(path, train, test)
    assert threshold == 0.5 and scored.count() == test.count() and scored.where("alert <> (probability >= 0.5)").isEmpty()
    direct = trees.score(trees.fit_model(trees.specs()[1], {"maxDepth": 2, "numTrees": 5}, train, features, "target"), test)
    assert sorted(r.probability for r in scored.collect()) == pytest.approx(sorted(r.probability for r in direct.collect()))
    P.save_parameters(path, {}, name="RandomForest", features=["pH"], threshold=0.5)
    with pytest.raises(ValueError, match="pH"):
        P.rebuild(path, train, test)
    risk = P.risk_profile(scored, "9").collect()
    assert [r.window_end_min for r in risk] == sorted(r.window_end_min for r in risk) and {r.birth_min for r in risk} == {32.0}
    made = train.limit(3).union(test.limit(2)).drop("fhr_baseline_std_bpm").withColumns({"source_record": F.col("record"), "record": F.concat("record", F.lit("_boot_0"))})
    whole, report = P.augmented(train, made, features)
    r = report.first()
    assert (r.rows, r.positives + r.negatives) == (3, 3) and whole.count() == train.count() + 3
    assert whole.where("sample_source = 'synthetic' AND fhr_baseline_std_bpm IS NOT NULL").isEmpty()
    for other in (None, made.drop("source_record"), made.where("false")):
        same, report = P.augmented(train, other, features)
        assert same.count() == train.count() and report.first().rows == 0 and report.first().note
    named = train.sparkSession.createDataFrame([("GBT - a",), ("GBT",), ("Forest - a",)], "model string")
    assert [r.model for r in P.models_of(named, "GBT -").collect()] == ["GBT - a"]


def test_models(matrix, tmp_path):
    spark = matrix.sparkSession
    train, test = matrix.where("cast(record AS int) < 8"), matrix.where("cast(record AS int) >= 8")
    spec = trees.ModelSpec("RandomForest", trees.specs()[1].build, {"maxDepth": (2,), "numTrees": (5,)})
    params, report, importance = P.phase_three(train, test, spec, folds=2, draws=1)
    row = report.withColumn("model", F.lit("RandomForest"))
    assert row.first().auroc > 0.9 and row.first().patient_recall == 1.0 and importance[0][1] > 0
    old = spark.createDataFrame([("RandomForest", 0.1, 0.1), ("BIC", 0.2, 0.2)], "model string, auroc double, average_precision double")
    table = P.comparison(old, [row], ["model", "auroc", "average_precision", "brier", "threshold"])
    assert table.count() == 2 and P.winner(table).first().model == "RandomForest"
    P.save_parameters(str(tmp_path / "p.json"), params, n=1)
    assert json.loads((tmp_path / "p.json").read_text())["params"] == params
    ranking = spark.createDataFrame([("a",), ("Age",)], "feature string")
    assert P.best_univariate(ranking, ["Age"]) == "Age"


def test_arguments():
    assert P.arguments([]).folds == 5
    for bad in (["--folds", "1"], ["--n-iter", "0"], ["--seed", "x"]):
        with pytest.raises(SystemExit):
            P.arguments(bad)


def test_tree_report_tunes_its_forest(spark, monkeypatch):
    from pulsegrid.plans.registry import QUERIES

    fitted, chosen, fit, tune = [], [], trees.fit_model, trees.tune
    spec = trees.ModelSpec("RandomForest", trees.specs()[1].build, {"maxDepth": (1, 4), "numTrees": (3,)})
    monkeypatch.setattr(trees, "specs", lambda: [spec])
    monkeypatch.setattr(trees, "fit_model", lambda s, p, *a: (fitted.append(p), fit(s, p, *a))[1])
    monkeypatch.setattr(trees, "tune", lambda *a, **k: (chosen.append(tune(*a, **k)), chosen[-1])[1])
    assert QUERIES["tree_report"](spark, "/root/testdata/sf0.001").count() == 1
    # two settings on two folds, then the best one on two folds and on all
    assert {p["maxDepth"] for p in fitted[:4]} == {1, 4} and len(fitted) == 7
    assert chosen == [fitted[-1]] and fitted[4:] == chosen * 3
