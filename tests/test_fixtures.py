"""Hand-worked cases of the operators' rules."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import clinical as C
from pulsegrid.functions import kernels as K
from pulsegrid.operators import bootstrap as B
from pulsegrid.operators import features as X
from pulsegrid.operators import fidelity as D
from pulsegrid.operators import logit as L
from pulsegrid.operators import metrics as M
from pulsegrid.operators import series as S
from pulsegrid.operators import split as P
from pulsegrid.operators import tables as T
from pulsegrid.operators import trends as W
from pulsegrid.sources import files

N = None


def frame(spark, values, name="x"):
    return spark.createDataFrame([("r", i, None if v is None else float(v)) for i, v in enumerate(values)], f"k string, i bigint, {name} double")


def column(df, c, order="i"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_trends(spark):
    t = spark.createDataFrame([("r", 5.0 * i, v) for i, v in enumerate([5.0, 4.0, 3.0, 3.0, 2.0, N, 1.0, 0.0])], "k string, t double, v double")
    d = W.add_trends(t, ["k"], "t", {"delta": "v"}, {"streak": "v"}, {"slope": "v"}).orderBy("t").collect()
    assert [r.streak for r in d] == [0, 1, 2, 0, 1, 0, 0, 1]
    assert [r.delta for r in d] == [0, 0, -2, -1, -1, 0, -1, 0]
    assert [round(r.slope, 6) for r in d] == [0, 0, 0, 0, 0, -0.14, -0.116216, -0.123256]
    gap = W.add_trends(t.where("t <> 15"), ["k"], "t", None, {"streak": "v"}, {"slope": "v"}).orderBy("t").collect()
    assert all(r.slope == 0 for r in gap)
    assert [r.streak for r in gap] == [0, 1, 2, 3, 0, 0, 1]


def test_gap_fill(spark):
    v = [N, 140, N, N, 146, 0, 150, N]
    df = frame(spark, v).withColumn("x", S.clean_range(F.col("x"), 50, 240))
    assert column(S.interpolate(df, "x", "k", "y"), "y") == [140, 140, 142, 144, 146, 148, 150, 150]
    assert column(S.interpolate(df, "x", "k", "y", max_gap=1), "y") == [N, 140, N, N, 146, 148, 150, N]
    filled, gone = K.clean(np.array([np.nan if x is None else x for x in v], float), 50, 240, True)
    assert filled.tolist() == [140, 140, 142, 144, 146, 148, 150, 150] and gone == 62.5
    none = frame(spark, [N, N])
    assert column(S.interpolate(none, "x", "k", "y"), "y") == [N, N]
    assert column(S.interpolate(none, "x", "k", "y", on_all_missing=140.0), "y") == [140, 140]
    again = S.interpolate(S.interpolate(df, "x", "k", "y"), "y", "k", "z")
    assert column(again, "z") == column(again, "y")


def test_filters_that_hold_the_ends(spark):
    rng = np.random.default_rng(9)
    for n in (1, 3, 30):
        x = rng.standard_normal(n)
        assert column(S.moving(frame(spark, x), "x", "k", "y", -4, 3, hold=True), "y") == pytest.approx(K.moving_average(x, 8).tolist())
        assert column(S.moving(frame(spark, x), "x", "k", "y", -3, 3, "median", hold=True), "y") == pytest.approx(K.median_filter(x, 7).tolist())


def test_window_bounds(spark):
    n = spark.createDataFrame([("a", 7300), ("b", 4800), ("c", 4799)], "k string, n int")
    got = sorted((r.k, r.start, r.end) for r in S.window_bounds(n, "k", "n", 4800, 1200).collect())
    assert got == [("a", 0, 4800), ("a", 1200, 6000), ("a", 2400, 7200), ("b", 0, 4800)]


def test_window_ids_skip_bad_windows(spark):
    v = [1.0] * 4 + [N] * 4 + [1.0] * 8
    got = S.quality_windows(frame(spark, v), "k", 4, 4, ["x"], 30).orderBy("start").collect()
    assert [(r.start, r.window_id) for r in got] == [(0, 0), (8, 1), (12, 2)]


def test_sustained_events(spark):
    d = np.full(60, -20.0)
    d[10] = -25
    assert K.sustained(d, above=False) == [(0, 60, 10, 25.0)]
    assert K.sustained(d[:59], above=False) == []
    assert len(K.sustained(np.full(60, -15.0), above=False)) == 1
    r = S.sustained_events(frame(spark, d.tolist()), "x", "k", 15, 60, above=False).collect()
    assert [(x.start, x.end, x.peak, x.amplitude) for x in r] == [(0, 60, 10, 25.0)]
    assert S.sustained_events(frame(spark, d[:59].tolist()), "x", "k", 15, 60, above=False).count() == 0


def test_deceleration_classes(spark):
    nadirs, tops = [430, 500, 340, 330, 700, 2000], np.array([400, 1000])
    got = K.classify(nadirs, tops)
    assert [got[f"decelerations_{c}_count"] for c in ("early", "late", "variable")] == [2, 2, 2]
    assert got["deceleration_uc_lag_mean_s"] == pytest.approx(54.1667, abs=1e-4) and got["deceleration_uc_lag_median_s"] == 16.25
    left = spark.createDataFrame([("r", x) for x in nadirs], "k string, i bigint")
    right = spark.createDataFrame([("r", x) for x in (400, 1000)], "k string, p bigint")
    near = S.nearest(left, right, "k", "i", "p").orderBy("i").collect()
    assert [r.nearest for r in near] == [400, 400, 400, 400, 400, 1000]
    assert K.classify(nadirs, np.zeros(0, int))["decelerations_variable_count"] == 6
    alone = S.nearest(left, right.where("false"), "k", "i", "p")
    assert alone.where("nearest IS NOT NULL").count() == 0


def test_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert M.auroc(df, "s", "y").first()[0] == 0.5625
    assert M.average_precision(df, "s", "y").first()[0] == pytest.approx(0.770833, abs=1e-6)
    assert M.brier(df, "s", "y").first()[0] == pytest.approx(0.231667, abs=1e-6)
    assert M.recall_threshold(df, "s", "y", 0.75).first()[0] == 0.7
    assert M.youden_threshold(df, "s", "y").first()[0] == 0.9
    neg = df.withColumn("s", -F.col("s"))
    assert M.auroc(df, "s", "y").first()[0] + M.auroc(neg, "s", "y").first()[0] == 1
    one = df.where("y = 1")
    assert M.auroc(one, "s", "y").first()[0] is None and M.youden_threshold(one, "s", "y").first()[0] == 0.5
    c = M.confusion(df, F.col("s") > 2, "y").first()
    assert math.isinf(c.nna) and c.ppv == 0 and c.f1 == 0


def test_composite_target_ignores_missing(spark):
    nan = float("nan")
    rows = [(7.05, 9.0, 0.0, 1), (7.20, 9.0, nan, 0), (nan, nan, nan, 0), (7.10, 7.0, 0.0, 0), (7.20, 6.0, nan, 1), (7.20, 9.0, 1.0, 1), (N, N, N, 0)]
    df = spark.createDataFrame(rows, "ph double, a double, n double, want int")
    assert df.where(C.composite_target(F.col("ph"), F.col("a"), F.col("n")) != F.col("want")).count() == 0
    assert C.normalize_nan(df).where("isnan(ph) OR isnan(n)").count() == 0


def test_persistent_suffix(spark):
    for alerts, start, ewt in (("FTFTT", 3, 45), ("TTTTF", N, N), ("TTTTT", 0, 60)):
        df = spark.createDataFrame([("p", i, a == "T", 1, 60.0 - 5 * i) for i, a in enumerate(alerts)], "k string, i bigint, alert boolean, target int, birth double")
        assert W.persistent_start(df, "alert", "k", "i").first().persistent_start == start
        assert W.patient_rollup(df, "k", "i", "alert", "target", "birth").first().ewt == ewt
        calm = W.patient_rollup(df.withColumn("target", F.lit(0)), "k", "i", "alert", "target", "birth")
        assert calm.first().ewt is None
        assert math.isinf(W.live_metrics(calm).first().nna) or alerts == ""


def test_left_closed_bins_and_crosstab(spark):
    df = spark.createDataFrame([(7.00, "a"), (7.05, "a"), (7.20, "b"), (N, "b")], "ph double, g string")
    binned = df.withColumn("bin", C.left_closed_bins(F.col("ph"), [7.0, 7.05, 7.1, 7.2, 99], ["7.00-7.05", "7.05-7.10", "7.10-7.20", ">=7.20"]))
    assert [r.bin for r in binned.collect()] == ["7.00-7.05", "7.05-7.10", ">=7.20", N]
    x = {(r.bin, r.g): r.n for r in T.crosstab(binned, "bin", "g").collect()}
    assert x["TOTAL", "TOTAL"] == 3 and x["TOTAL", "a"] == 2 and x[">=7.20", "TOTAL"] == 1
    assert C.apgar_class(F.lit(4)) is not None


def test_missing_apgar_both_ways(spark):
    r = spark.range(1).select(C.apgar_class(F.lit(None).cast("double")).alias("a"), C.apgar_class(F.lit(None).cast("double"), missing=None).alias("b")).first()
    assert (r.a, r.b) == ("no data", "7-10")


def test_header_lines(spark):
    lines = ["-- Outcome", "pH           7.14", "Gest. weeks   37", "Unknown   5", "pH 7.14", "", "# Apgar5\t9", "Main diag.   none"]
    df = files.parse_headers(spark.createDataFrame([("1001", x) for x in lines], "record string, line string")).first()
    assert (df.record, df.pH, df.Gest_weeks, df.Apgar5, df.Main_diag, df.Age) == ("1001", 7.14, 37.0, 9.0, "none", N)


def test_block_length(spark):
    t = np.arange(3000)
    wave = np.sin(2 * np.pi * t / 1600) * 10 + 140
    rows = [("wave", wave.tolist()), ("short", [140.0, 141.0] * 100), ("constant", [140.0] * 3000), ("slow", (t / 10.0).tolist()), ("gaps", [v if i % 2 else None for i, v in enumerate(wave.tolist())])]
    df = spark.createDataFrame(rows, "record string, fhr array<double>")
    got = {r.record: r.block for r in B.optimal_block(df).collect()}

    def plain(x, low=240, high=1200):
        x = np.array([v for v in x if v is not None]) - np.mean([v for v in x if v is not None])
        if len(x) < 2 * low:
            return low
        c = [np.mean(x[: len(x) - k] * x[k:]) if k < len(x) else 0.0 for k in range(high + 1)]
        c = [v / c[0] if c[0] else v for v in c]
        first = next((k for k in range(1, high + 1) if abs(c[k]) < 0.05), high // 2)
        return min(max(2 * first, low), high)

    assert got == {k: plain(v) for k, v in rows}
    assert got["short"] == got["constant"] == 240 and 240 < got["wave"] < 1200
    # the same in long form, for short blocks
    small = [1.0, 2, 4, 3, 1, 5, 2, 2, 7, 1]
    assert S.first_small_lag(frame(spark, small), "x", "k", 0.05, 2, 6).first().block == plain(small, 2, 6)


def test_autocorrelation_is_of_mean_products(spark):
    got = column(S.autocorrelation(frame(spark, [1, 2, 4, 3]), "x", "k", 5), "acf", "lag")
    assert got == pytest.approx([1, 0.2, -1.0, -0.6, 0, 0]) and K.autocorrelation(np.array([1.0, 2, 4, 3]), 5).tolist() == pytest.approx(got)
    flat = column(S.autocorrelation(frame(spark, [2, 2, 2]), "x", "k", 2), "acf", "lag")
    assert flat == [0, 0, 0] and K.autocorrelation(np.full(3, 2.0), 2).tolist() == flat
    gap = S.autocorrelation(frame(spark, [1, N, 3]), "x", "k", 2)
    assert column(gap, "acf", "lag") == [1, N, -1]
    assert S.autocorrelation(frame(spark, [1, N, 3]), "x", "k", 2, drop_missing=True, long_enough=True).isEmpty()


def test_correlation_of_constant_groups_is_missing(spark):
    rows = [(k, float(i), 5.0 if k == "flat" else float(i * i)) for k in ("flat", "bent") for i in range(12)] + [("few", float(i), float(i)) for i in range(5)] + [("holes", float(i), None if i % 2 else 3.0) for i in range(24)]
    got = {r.k: r["corr"] for r in T.pair_correlation(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", "k").collect()}
    x = np.arange(12.0)
    assert got["bent"] == pytest.approx(np.corrcoef(x, x * x)[0, 1]) and got["flat"] is got["few"] is got["holes"] is None
    a = spark.createDataFrame([(i, float(i)) for i in range(4)], "at int, c double")
    assert D.curve_correlation(a, a.withColumn("c", F.lit(1.0)), "at", "c").first().r is None
    assert D.curve_correlation(a, a.withColumn("c", 2 - F.col("c")), "at", "c").first().r == pytest.approx(-1)


def test_outcome_flags_and_category(spark):
    cases = [
        # pH, Apgar at 1 and 5, HIE, NICU days; flags that hold; category
        ((6.95, 3.0, 5.0, 0.0, 2.0), "ph_severe apgar1_lt_7 apgar5_lt_7 apgar1_lt_4 acog wide ph705_apgar5 gold", "confirmed asphyxia"),
        ((7.04, 6.0, 6.0, 0.0, 0.0), "ph_severe apgar1_lt_7 apgar5_lt_7 wide ph705_apgar5", "confirmed asphyxia"),
        ((7.04, 8.0, 9.0, 1.0, 1.0), "ph_severe", "acidosis without depression"),
        ((7.05, 9.0, 3.0, 1.0, 0.0), "ph_moderate apgar5_lt_7 apgar5_lt_4", "depression without severe acidosis"),
        ((7.09, 6.0, 7.0, 0.0, 0.0), "ph_moderate apgar1_lt_7 wide", "borderline"),
        ((7.10, 6.0, 7.0, 0.0, 0.0), "ph_mild apgar1_lt_7", "normal"),
        ((7.20, 9.0, 9.0, 3.0, 9.0), "", "normal"),
        ((7.00, None, 6.0, None, 1.0), "ph_severe apgar5_lt_7 ph705_apgar5 gold", "incomplete data"),
        ((None, 2.0, 2.0, 1.0, 1.0), "apgar1_lt_7 apgar5_lt_7 apgar1_lt_4 apgar5_lt_4", "incomplete data"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _, _) in enumerate(cases)], "i int, ph double, a1 double, a5 double, hie double, nicu double")
    values = [F.col(c) for c in ("ph", "a1", "a5", "hie", "nicu")]
    flags = C.outcome_flags(*values)
    for r, (_, want, category) in zip(df.withColumns(flags).withColumn("c", C.outcome_category(*values[:3])).orderBy("i").collect(), cases, strict=True):
        assert {k for k in flags if r[k]} == set(want.split()) and r.c == category
    counts = {r.criterion: r.n for r in T.criteria_counts(df, C.outcome_criteria(*values)).collect()}
    assert counts == {"ph_severe": 4, "ph_lt_710": 6, "apgar1_lt_7": 5, "apgar5_lt_7": 5, "apgar1_lt_4": 2, "apgar5_lt_4": 2, "acog": 1, "ph705_apgar5": 3, "wide": 3, "gold": 2}


def test_contraction_gaps_count(spark):
    filled, gone = K.clean(np.array([0.0, 20, 151, -1, 150]), *K.UC_RANGE, True)
    assert gone == 60 and filled.tolist() == pytest.approx([20, 20, 20 + 130 / 3, 20 + 260 / 3, 150])
    n = 4 * 60 * 20
    fhr = (140 + 5 * np.sin(np.arange(n) / 40)).tolist()
    uc = lambda step, bad: [bad if i % step == 0 else 10.0 for i in range(n)]
    df = spark.createDataFrame([("half", fhr, uc(2, 0.0)), ("high", fhr, uc(2, 151.0)), ("third", fhr, uc(4, 0.0))], "record string, fhr array<double>, uc array<double>")
    got = X.window_features(df).collect()
    assert [(r.record, r.uc_invalid_pct) for r in got] == [("third", 25.0)]


def test_fluctuation_is_of_the_thinned_signal():
    rng = np.random.default_rng(2)
    fhr = 140 + np.cumsum(rng.standard_normal(4 * 3600)) / 20
    slow = fhr.reshape(-1, 4).mean(axis=1)
    thin = slow[np.linspace(0, len(slow) - 1, 1200).astype(int)]
    got = K.features(fhr, np.full(len(fhr), 10.0))
    assert {k: got[k] for k in got if k.startswith("dfa")} == pytest.approx(K.fluctuation(thin))
    assert got["dfa_alpha"] != pytest.approx(K.fluctuation(slow)["dfa_alpha"])


def test_jitter_warp_by_hand():
    x = np.sin(np.arange(600) / 30) * 10 + 140
    rng = np.random.Generator(np.random.Philox(7))
    noisy = x + 1.5 * rng.standard_normal(600)
    moved = np.sort(np.clip(np.linspace(0, 599, 12) + 0.05 * 600 * rng.standard_normal(12), 0, 599))
    along = [np.interp(np.interp(t, np.linspace(0, 599, 12), moved), np.arange(600), noisy) for t in range(600)]
    assert K.jitter_warp(x, 600, 7).tolist() == pytest.approx(along)
    assert K.jitter_warp(x, 400, 7).tolist() == pytest.approx(along[:400]) and K.jitter_warp(x, 700, 7).tolist() == pytest.approx(along + along[:100])
    assert K.jitter_warp(np.array([np.nan, 3.0]), 3, 1).tolist() == [3, 3, 3]


def test_long_names_do_not_share_draws(spark):
    name = "a-very-long-record-name-that-ends-alike"
    df = spark.createDataFrame([(f"{k}{name}", [float(i) for i in range(40)], [1.0] * 40, 8) for k in "xy"], "record string, fhr array<double>, uc array<double>, block int")
    a, b = (r.fhr for r in B.replicates(df, 1, "jitter_warp").collect())
    assert a != b


def test_exemplars(spark):
    def curve(record, target, alerts, top=0.9):
        n = len(alerts)
        return [(record, 5.0 * i, a == "T", target, top if a == "T" else 0.1 * top, 5.0 * (n - i) + 20) for i, a in enumerate(alerts)]

    kind = "record string, start double, alert boolean, target int, p double, birth double"
    show = lambda rows: T.exemplar_positive(T.alert_profiles(spark.createDataFrame(rows, kind), "record", "start", "alert", "target", "p", "birth")).first()
    # alerts from the first window on never win over a visible transition, however near their warning time
    always, late, early, brief, calm = curve("1", 1, "TTTTTT"), curve("2", 1, "FFFFFT"), curve("3", 1, "FTTTTT"), curve("0", 1, "FTFFFF"), curve("9", 1, "FFFFFF", 0.5)
    assert tuple(show(always + late + early + brief)) == ("3", 1, 45.0)
    assert tuple(show(always + late + brief)) == ("2", 5, 25.0)
    assert tuple(show(always + brief + calm)) == ("0", 1, 45.0) and tuple(show(always + calm)) == ("1", 0, 50.0)
    assert tuple(show(calm + curve("8", 1, "FFF", 0.4))) == ("9", 0, 50.0)
    quiet = lambda rows: tuple(T.exemplar_negative(T.alert_profiles(spark.createDataFrame(rows, kind), "record", "start", "alert", "target", "p", "birth")).first())
    noisy = curve("2", 0, "FTT") + curve("1", 0, "TFT") + curve("0", 0, "TTT")
    assert quiet(noisy) == ("1", 2, 0) and quiet(noisy + curve("7", 0, "FFF", 0.3) + curve("6", 0, "FFF", 0.2)) == ("7", 0, None)


def test_rates_without_cases_are_missing(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 0)], "s double, y int")
    r = M.confusion(df, F.col("s") > 0.5, "y").first()
    assert r.sensitivity is None and r.specificity == 0.5
    r = M.confusion(df.withColumn("y", F.lit(1)), F.col("s") > 0.5, "y").first()
    assert r.specificity is None and r.sensitivity == 0.5


def test_split_sizes_of_the_cohort(spark):
    m = spark.range(552).select(F.col("id").cast("string").alias("record"), (F.col("id") < 67).cast("int").alias("y"))
    s = P.stratified_split(m, "record", "y")
    assert {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()} == {(1, "train"): 47, (0, "train"): 339, (1, "test"): 20, (0, "test"): 146}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.1 else float(np.round(rng.standard_normal(), 1))) for k in ("a", "b") for _ in range(500)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    qs = [0, 0.05, 0.25, 0.5, 0.9, 1]
    from pulsegrid.operators.prefix import exact_percentiles

    got = {r.k: list(r.q) for r in exact_percentiles(df, "x", qs, ["k"]).collect()}
    want = {k: np.percentile([x for n, x in rows if n == k and x is not None], [100 * q for q in qs]).tolist() for k in ("a", "b", "one")}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    r = T.describe(df, "x").first()
    assert r.p50 == pytest.approx(np.median([x for _, x in rows if x is not None])) and T.describe(df.where("false"), "x").first().p50 is None
    assert P.medians(df.withColumn("z", F.lit(None).cast("double")), ["x", "z"]).first().z is None


def test_logits_side_by_side(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), None if i % 9 == 0 else float(a + b), int(rng.random() < 1 / (1 + np.exp(-a)))) for i, (a, b) in enumerate(rng.standard_normal((300, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)
    both = L.fit_each(df, [["a"], ["a", "b"], ["c"], [], ["a", "a"]], "y")
    alone = [L.fit(df, f, "y") for f in (["a"], ["a", "b"], ["c"], [])]
    assert all(x.coef == pytest.approx(z.coef) and x.n == z.n for x, z in zip(both, alone, strict=False)) and both[4] is None
    assert both[2].n == 266
    assert 1 / (1 + math.exp(-both[3].coef[0])) == pytest.approx(np.mean([r[3] for r in rows]))
    # separated classes: the predictive model falls back to balanced classes and stays finite
    split = df.withColumn("s", F.col("y") * 2.0)
    assert L.fit(split, ["s"], "y") is None
    f = L.predictive(split, ["s"], "y")
    p = L.predict(split, f).groupBy("y").agg(F.avg("probability").alias("p")).orderBy("y").collect()
    assert p[0].p < 0.4 < 0.6 < p[1].p
    assert L.predictive(df, [], "y").coef == pytest.approx(both[3].coef)
    assert L.predictive(df.where("y = 1"), ["a"], "y") is None


def test_readable_signals(spark):
    df = spark.createDataFrame([("a", [1.0, None, 100.0]), ("b", [None, None, 100.0]), ("c", [])], "record string, fhr array<double>")
    assert [r.record for r in X.readable(df).collect()] == ["a"]
    assert sorted(r.record for r in X.readable(df, over=30, low=60, high=200).collect()) == ["a", "b"]


def test_fold_summary_uses_sample_deviation(spark):
    df = spark.createDataFrame([("m", "d", x) for x in (0.1, 0.2, 0.4)], "model string, data string, auprc double")
    r = T.fold_summary(df, ["model", "data"], ["auprc"]).first()
    assert r.auprc_std == pytest.approx(np.std([0.1, 0.2, 0.4], ddof=1)) and r.n_folds == 3


def test_scaler_is_population_and_leaves_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0), (4, 8.0, 5.0), (5, N, 5.0)], "id int, x double, c double")
    z = P.standardize(df, P.fit_scaler(df, ["x", "c"]), ["x", "c"]).orderBy("id").collect()
    v = np.array([1, 2, 4, 8, 3.0])
    assert [r.x for r in z] == pytest.approx(((v - v.mean()) / v.std()).tolist())
    assert all(r.c == 0 for r in z)


def test_bootstrap_is_synchronous_and_partition_free(spark):
    n = 50
    df = spark.createDataFrame([(str(k), [float(100 * k + i) for i in range(n)], [float(i) for i in range(n)], 8) for k in range(4)], "record string, fhr array<double>, uc array<double>, block int")
    for name in B.STRATEGIES:
        got = [sorted(map(str, B.replicates(df.repartition(p), 2, name).select("record", "fhr", "uc").collect())) for p in (1, 4)]
        assert got[0] == got[1]
        for r in B.replicates(df, 2, name).collect():
            assert [v - 100 * int(r.source_record) for v in r.fhr] == r.uc and len(r.fhr) == n
    saved = B.replicates(df, 2)
    assert B.replay_differences(saved, B.replicates(df.repartition(3), 2)).isEmpty()
    with pytest.raises(ValueError):
        B.replicates(df, 1, "other")
    warped = B.replicates(df, 1, "jitter_warp")
    assert warped.count() == 4 and all(len(r.fhr) == n for r in warped.collect())


def test_kernels_by_hand():
    assert K.median_filter(np.array([1.0, 9, 2, 8, 3]), 3).tolist() == [1, 2, 8, 3, 3]
    assert K.moving_average(np.arange(4.0), 2).tolist() == [0, 0.5, 1.5, 2.5]
    x = np.array([0, 3, 0, 5, 5, 5, 0, 4, 0], float)
    assert K.peaks(x, 1, 1, 0.5).tolist() == [1, 4, 7]
    assert K.peaks(x, 1, 4, 0.5).tolist() == [4]
    assert K.peaks(x, 1, 1, 3.5).tolist() == [4, 7]
    apen, sampen = K.entropies(np.sin(np.arange(300) / 5))
    assert 0 < sampen < apen * 3
    assert np.isnan(K.entropies(np.ones(50))).all()
    noise = np.random.default_rng(0).standard_normal(4000)
    assert K.fluctuation(noise)["dfa_alpha"] == pytest.approx(0.5, abs=0.08)
    assert K.fluctuation(np.cumsum(noise))["dfa_alpha"] == pytest.approx(1.5, abs=0.12)
    assert np.isnan(K.fluctuation(noise[:255])["dfa_alpha"])
    f, p = K.welch(np.sin(2 * np.pi * 0.5 * np.arange(4000) / 4), 4)
    assert f[p.argmax()] == pytest.approx(0.5, abs=0.02)
    c = K.cross_correlation(noise, np.roll(noise, 3), 5)
    assert c.argmax() in (2, 8) and c.max() == pytest.approx(1, abs=0.01)
    assert len(K.FEATURES) == 28
    assert K.autocorrelation(np.array([1.0, 2, 4]), 1).tolist() == pytest.approx([1, ((1 - 7 / 3) * (2 - 7 / 3) + (2 - 7 / 3) * (4 - 7 / 3)) / sum((v - 7 / 3) ** 2 for v in (1, 2, 4)) * 3 / 2])
    full = K.features(140 + noise[:2400], np.abs(noise[:2400]))
    assert full["fhr_invalid_pct"] == 0 and full["ltv_valid_windows"] == 10 and full["signal_duration_min"] == 10


def test_long_autocorrelation_is_that_of_the_windows_and_the_kernel(spark):
    rng = np.random.default_rng(4)
    rows = [(k, 3 * i + 1, None if i % 11 == 5 else float(v)) for k, n in (("a", 700), ("b", 9), (None, 40)) for i, v in enumerate(rng.standard_normal(n))]
    rows += [("flat", i, 0.1) for i in range(50)] + [("gone", i, N) for i in range(3)] + [("nan", i, float("nan") if i == 1 else float(i * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, i bigint, x double").repartition(3)
    clean = df.withColumn("x", F.nanvl("x", F.lit(None)))
    for options in ({}, {"drop_missing": True}, {"drop_missing": True, "long_enough": True}):
        got = {(r.k, r.lag): r.acf for r in S.long_autocorrelation(df, "x", "k", 12, chunk=20, **options).collect()}
        want = {(r.k, r.lag): r.acf for r in S.autocorrelation(clean, "x", "k", 12, **options).collect()}
        assert got.keys() == want.keys()
        for key in got.keys() - {("flat", lag) for lag in range(13)}:
            assert got[key] == (want[key] if want[key] is None else pytest.approx(want[key], abs=1e-12)), key
        assert all(v == 0 for (k, _), v in got.items() if k == "flat")
    assert S.long_autocorrelation(df.where("false"), "x", "k", 5).isEmpty()


def test_a_long_series_has_1200_lags_in_chunks(spark):
    x = np.cumsum(np.random.default_rng(5).standard_normal(30_000)) + 100
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i bigint, x double")
    curve = S.long_autocorrelation(df, "x", "k", 1200)
    assert column(curve, "acf", "lag") == pytest.approx(K.autocorrelation(x, 1200).tolist(), abs=1e-9)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(curve) < 1.05 * size(S.long_autocorrelation(df, "x", "k", 8))
    block = S.first_small_lag(df, "x", "k", 0.05, 240, 1200).first().block
    small = np.flatnonzero(np.abs(K.autocorrelation(x, 1200)[1:]) < 0.05) + 1
    assert block == (min(max(2 * small[0], 240), 1200) if len(small) else 1200)


def test_entropy_of_a_long_series_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal(900), 1)  # with many ties, also at the limit
    for m, r in ((2, 0.2), (3, 0.5), (1, 0.0)):
        runs = np.lib.stride_tricks.sliding_window_view(x, m)
        assert K._within(x, m, r).tolist() == (np.abs(runs[:, None] - runs[None]).max(axis=2) <= r).sum(axis=1).tolist()
    long = rng.standard_normal(20_000)
    tracemalloc.start()
    whole = K.entropies(long, most=None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and 2.0 < whole[1] < 2.4 and whole != K.entropies(long)


def test_rounds_stop_when_means_hold_still(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(f"r{i}", [float(v) for v in 140 + i + rng.standard_normal(60)], [1.0] * 60, 8, i) for i in range(12)] + [("none", [N] * 5, [N] * 5, 8, 1), ("empty", [], [], 8, 2)]
    df = spark.createDataFrame(rows, "record string, fhr array<double>, uc array<double>, block int, age int")
    out = f"{tmp_path}/rounds"
    (tmp_path / "rounds" / "bootstrap_idx=9").mkdir(parents=True)  # of an earlier run
    made, done = B.replicates_until_stable(df, out, "moving_block", tolerance=0.05, cap=8)
    assert done[-1].stop and 1 < len(done) < 8 and [r.n for r in done] == [12 * r.m for r in done]
    assert sorted(p.name for p in (tmp_path / "rounds").iterdir()) == [f"bootstrap_idx={k}" for k in [*range(len(done)), 9]]
    key = ["record", "bootstrap_idx"]
    want = B.replicates(df, len(done), "moving_block")
    assert made.columns == want.columns and made.orderBy(*key).collect() == want.orderBy(*key).collect()
    means = want.select("bootstrap_idx", B.mean_of("fhr").alias("mean")).where("mean IS NOT NULL")
    values = [r["mean"] for r in means.collect()]
    assert done[-1].std == pytest.approx(np.std(values)) and done[-1].mean == pytest.approx(np.mean(values))
    assert B.converged_multiplier(B.replicates(df, 8, "moving_block").select("bootstrap_idx", B.mean_of("fhr").alias("mean")).where("mean IS NOT NULL"), 0.05, 8).first()[0] == len(done)
    assert len(list(B.rounds(df.where("record = 'none'"), "moving_block", cap=2))) == 2
    first, _ = B.replicates_until_stable(df, None, "jitter_warp", tolerance=1e9, cap=4)
    assert first.where("bootstrap_idx = 1").count() == len(rows) and first.where("record = 'none_boot_0'").first().fhr == [N] * 5


def test_entropy_against_brute_force():
    x = np.random.default_rng(1).standard_normal(60)
    r = 0.2 * x.std()

    def phi(m):
        n = len(x) - m + 1
        counts = [sum(max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r for j in range(n)) for i in range(n)]
        return np.mean(np.log(np.array(counts) / n)), sum(c - 1 for c in counts) / 2

    (a, b), (c, d) = phi(2), phi(3)
    apen, sampen = K.entropies(x)
    assert apen == pytest.approx(a - c)
    assert (np.isnan(sampen) and d == 0) or sampen == pytest.approx(-np.log(d / b))


def test_window_features(spark):
    n = 4 * 60 * 20 + 4 * 60 * 5
    fhr = (140 + 5 * np.sin(np.arange(n) / 40)).tolist()
    df = spark.createDataFrame([("1", fhr, [10.0] * n), ("2", [0.0] * n, [10.0] * n), ("3", fhr[:100], [1.0] * 100)], "record string, fhr array<double>, uc array<double>")
    clinical = spark.createDataFrame([("1", 600.0)], "record string, Sig2Birth double")
    got = X.window_features(df, clinical).orderBy("window_id").collect()
    assert [(r.record, r.window_id, r.window_start_min, r.window_end_min, r.time_to_birth_min) for r in got] == [("1", 0, 0, 20, 15), ("1", 1, 5, 25, 10)]


def test_ks_and_wasserstein(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 3.0, 4.0, 9.0, 9.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, o boolean")
    grid = sorted(set(a + b))
    cdf = lambda s, x: sum(v <= x for v in s) / len(s)
    assert D.ks(df, "v", F.col("o")).first().ks == pytest.approx(max(abs(cdf(a, x) - cdf(b, x)) for x in grid))
    area = sum(abs(cdf(a, x) - cdf(b, x)) * (y - x) for x, y in zip(grid[:-1], grid[1:], strict=True))
    assert D.wasserstein(df, "v", F.col("o")).first().wasserstein == pytest.approx(area)


def test_logit_matches_closed_form(spark):
    rows = [(float(x), y, k % 5) for x, y, n in ((0, 1, 10), (0, 0, 30), (1, 1, 20), (1, 0, 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "x double, y int, g int")
    f = L.fit(df, ["x"], "y")
    assert f.coef[0] == pytest.approx(math.log(10 / 30), abs=1e-6) and f.coef[1] == pytest.approx(math.log(3), abs=1e-6)
    assert f.cov[1, 1] == pytest.approx(1 / 10 + 1 / 30 + 1 / 20 + 1 / 20, rel=1e-5)
    assert f.criterion("bic") - f.criterion("aic") == pytest.approx(2 * (math.log(80) - 2))
    assert L.fit(df.withColumn("x", F.col("y").cast("double")), ["x"], "y") is None  # separated
    assert L.fit(df, ["x"], "y", cluster="g").cov.shape == (2, 2)
    chosen, path = L.forward_selection(df.withColumn("z", F.lit(1.0) * (F.col("g") % 2)), ["z", "x"], "y", "bic")
    assert chosen == ["x"] and len(path) == 1


def test_joins_check_cardinality(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    assert T.one_to_many(a, b, "k").count() == 2
    for bad in (lambda: T.one_to_many(b, a, "k").count(), lambda: T.one_to_one(a, b, "k").count(), lambda: T.strict_lookup(a, b, "k", "w").count()):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|duplicate|not found"):
            bad()
    with pytest.raises(ValueError):
        T.require_columns(a, ["k", "nope"])
    assert T.predictors(a.withColumn("c", F.lit(1)).withColumn("p", F.col("k") * 2.0), None, ("k",)) == ["p"]


def test_splits(spark):
    m = spark.createDataFrame([(str(i), i % 4 == 0) for i in range(400)], "record string, y boolean")
    s = P.stratified_split(m, "record", "y")
    assert {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()} == {(True, "train"): 70, (True, "test"): 30, (False, "train"): 210, (False, "test"): 90}
    assert P.leaks(s.where("split = 'train'"), s.where("split = 'test'"), "record").isEmpty()
    again = P.stratified_split(m.repartition(7), "record", "y")
    assert s.exceptAll(again).isEmpty()
    f = P.group_folds(m, "record", "y", 5)
    assert {r["count"] for r in f.groupBy("y", "fold").count().collect()} == {20, 60}
    assert P.fold_count(m.where("record < '11'"), "y", 50) <= 50
    nested = P.nested_folds(m, "record", "y", 3, 2)
    assert nested.where("outer = test_of").isEmpty() and nested.count() == 800


def test_optional_and_sampled_parameters():
    from pulsegrid.operators import trees

    assert trees.optional("no_such_booster") is None
    spec = trees.specs()[0]
    assert trees.sample_params(spec.space, 4) == trees.sample_params(spec.space, 4)
    assert len({str(p) for p in trees.sample_params(spec.space, 4)}) == 4


def test_out_of_fold_scores_every_row(spark):
    from pulsegrid.operators import trees

    rows = [(str(i), float(i % 10), float(i % 3), int(i % 10 > 6), i // 10 % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "record string, a double, b double, y int, fold int").cache()
    extra = df.withColumns({"source_record": F.col("record"), "record": F.concat(F.col("record"), F.lit("_boot_0"))}).drop("fold")
    spec = trees.specs()[1]
    oof = trees.out_of_fold(spec, {"maxDepth": 3, "numTrees": 5}, df, ["a", "b"], "y", "fold", [0, 1], extra)
    assert oof.count() == 120 and oof.where("record LIKE '%boot%'").isEmpty()
    assert M.auroc(oof, "probability", "y").first()[0] > 0.9
    model = trees.fit_model(spec, {"maxDepth": 3, "numTrees": 5}, df, ["a", "b"], "y")
    assert trees.importances(model, ["a", "b"])[0][0] == "a"


def test_lag_delta_by_row(spark):
    w = Window.partitionBy("k").orderBy("i")
    assert column(frame(spark, [1, N, 4, 8]).withColumn("d", W.lag_delta("x", w)), "d") == [N, N, 3, N]
