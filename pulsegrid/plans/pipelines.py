"""The three long lifecycles as plans over stage tables: signals to a clean window matrix, bootstrap to fidelity, models to a report.

Each stage is a DataFrame or a Parquet table built once; the driver only orchestrates.
"""

from __future__ import annotations

import argparse
import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.clinical import composite_target
from ..operators import boosting, bootstrap, fidelity, logit, metrics, series, split, tables, trees, trends
from ..operators.features import array_kernel, extract, pair_kernel, window_features
from ..schemas import BASELINE, DELTAS, PROHIBITED, SLOPES, STREAKS, TRENDS
from ..sources import files

TRACKING = ("record", "sequence_id", "group_record", "sample_source", "source_record", "bootstrap_idx", "window_id", "target", "window_start_min", "window_end_min", "time_to_birth_min")


def record_features(signals: DataFrame, clinical: DataFrame) -> DataFrame:
    """One row of features per record, joined one to one with its header."""
    return tables.one_to_one(clinical, extract(signals, ["record"]), "record")


def clean_windows(signals: DataFrame, clinical: DataFrame, sample_source: str = "real", **options) -> DataFrame:
    """The window matrix: features of valid windows, target, trends, and only columns that may predict.

    Synthetic signals come with source_record and bootstrap_idx; their headers are the sources'. Sequences are
    records or replicates, groups are source records.
    """
    synthetic = "source_record" in signals.columns
    lineage = signals.select("record", "source_record", "bootstrap_idx") if synthetic else signals.select("record", F.col("record").alias("source_record"), F.lit(None).cast("int").alias("bootstrap_idx"))
    header = lineage.join(clinical.withColumnRenamed("record", "source_record"), "source_record")
    w = window_features(signals.select("record", "fhr", "uc"), header.select("record", "Sig2Birth"), **options)
    w = tables.one_to_many(header, w, "record")
    w = w.withColumns({"target": composite_target(F.col("pH"), F.col("Apgar5"), F.col("NICU_days")), "sequence_id": F.col("record"), "group_record": F.col("source_record"), "sample_source": F.lit(sample_source)})
    w = trends.add_trends(w, ["sequence_id"], "window_start_min", DELTAS, STREAKS, SLOPES)
    return tables.select_existing(w, [*TRACKING, *predictor_names()])


def predictor_names() -> list[str]:
    """The whitelist: baseline, signal and trend columns, without the prohibited."""
    return [c for c in (*BASELINE, *kernels.FEATURES, *TRENDS) if c not in PROHIBITED]


def candidate_features(train: DataFrame) -> list[str]:
    """Whitelisted numeric columns that aren't constant on the training windows."""
    return tables.predictors(train, predictor_names(), PROHIBITED)


def eligible(stats: DataFrame, most_nan: float = 30, least_min: float = 30) -> DataFrame:
    """Records fit for a bootstrap: few gaps, long enough, with contractions."""
    return stats.where((F.col("fhr_nan_pct") <= most_nan) & (F.col("duration_min") >= least_min) & F.col("has_uc"))


def rejected(stats: DataFrame, most_nan: float = 30, least_min: float = 30) -> DataFrame:
    """One row: records, and how many have too many gaps, are too short, have no contractions, and are eligible. A record may be rejected for several reasons."""
    gaps, short, none = F.col("fhr_nan_pct") > most_nan, F.col("duration_min") < least_min, ~F.coalesce(F.col("has_uc"), F.lit(False))
    good = (F.col("fhr_nan_pct") <= most_nan) & (F.col("duration_min") >= least_min) & F.col("has_uc")
    return stats.agg(F.count("*").alias("records"), F.count_if(gaps).alias("too_many_gaps"), F.count_if(short).alias("too_short"), F.count_if(none).alias("no_uc"), F.count_if(good).alias("eligible"))


def split_eligible(stats: DataFrame, path: str, most_nan: float = 30, least_min: float = 30) -> files.Split:
    """eligible() and rejected() from one evaluation: records written once with their reasons, and counted."""
    reasons = {"too_many_gaps": F.col("fhr_nan_pct") > most_nan, "too_short": F.col("duration_min") < least_min, "no_uc": ~F.coalesce(F.col("has_uc"), F.lit(False))}
    good = F.coalesce((F.col("fhr_nan_pct") <= most_nan) & (F.col("duration_min") >= least_min) & F.col("has_uc"), F.lit(False))
    why = F.concat_ws(", ", *[F.when(c, n) for n, c in reasons.items()])
    error = F.when(~good, F.when(why == "", "not known").otherwise(why))
    return files.split_write(stats, error, path, {n: F.count_if(c) for n, c in reasons.items()})


def signal_stats(signals: DataFrame, fs: int = kernels.FS) -> DataFrame:
    """Statistics of both channels per record, from arrays, without exploding them."""

    def stats(c: str) -> list:
        good = F.filter(c, lambda v: v.isNotNull() & ~F.isnan(v))
        # one pass: count, sum and sum of squares about 100, which is near every value
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        sums = F.aggregate(good, zero, lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v - 100).alias("s"), (a["q"] + (v - 100) * (v - 100)).alias("q")))
        ends = [F.array_min(good).alias(f"{c}_min"), F.array_max(good).alias(f"{c}_max")]
        return [sums.alias(f"__{c}"), *ends]

    def final(c: str) -> list:
        a, size = F.col(f"__{c}"), F.size(c)
        mean = F.when(a["n"] > 0, a["s"] / a["n"])
        std = F.when(a["n"] > 0, F.sqrt(F.greatest(a["q"] / a["n"] - mean * mean, F.lit(0.0))))
        return [(mean + 100).alias(f"{c}_mean"), std.alias(f"{c}_std"), f"{c}_min", f"{c}_max", F.when(size > 0, (size - a["n"]) * 100.0 / size).otherwise(100.0).alias(f"{c}_nan_pct")]

    n = F.size("fhr").cast("bigint")
    has = F.exists(F.coalesce("uc", F.array().cast("array<double>")), lambda v: v.isNotNull())
    wide = signals.select("record", "fhr", "uc", n.alias("n_samples"), (n / (60.0 * fs)).alias("duration_min"), F.lit(fs).alias("fs_hz"), has.alias("has_uc"), *stats("fhr"), *stats("uc"))
    return wide.select("record", "n_samples", "duration_min", "fs_hz", "has_uc", *final("fhr"), *final("uc"))


def bootstrap_dataset(signals: DataFrame, clinical: DataFrame, m: int | None = 2, seed: int = 42, out: str | None = None) -> DataFrame:
    """Originals and m synchronous replicates of each eligible record, with headers inherited and statistics made anew. With m=None as many as the means' deviation needs, stored in `out` round by round if that is given."""
    good = tables.in_split(signals, eligible(signal_stats(signals)), "record")
    blocks = bootstrap.optimal_block(good)
    blocked = good.join(blocks, "record")
    made = bootstrap.replicates(blocked, m, seed=seed) if m is not None else bootstrap.replicates_until_stable(blocked, out, seed=seed)[0]
    both = tables.union_all([good.withColumns({"source_record": F.col("record"), "bootstrap_idx": F.lit(None).cast("int"), "is_synthetic": F.lit(False)}), made])
    return both.join(clinical.withColumnRenamed("record", "source_record"), "source_record", "left").join(signal_stats(both.select("record", "fhr", "uc")), "record")


def metadata_concordance(dataset: DataFrame) -> DataFrame:
    """How near replicates' means are to their sources', and that inherited columns didn't change."""
    synthetic, originals = dataset.where("is_synthetic"), dataset.where("NOT is_synthetic")
    pair = synthetic.select("source_record", F.col("fhr_mean").alias("a"), "pH").join(originals.select("source_record", F.col("fhr_mean").alias("b")), "source_record", "left")
    return tables.concordance(pair, "a", "b").crossJoin(F.broadcast(tables.most_distinct(dataset.where("pH IS NOT NULL"), "source_record", "pH")))  # one row each


def fidelity_report(originals: DataFrame, synthetics: dict[str, DataFrame], max_lag: int = 200, out: str | None = None) -> DataFrame:
    """A row per strategy: KS, Wasserstein, correlations of mean autocorrelation, of mean log spectrum and, where there is a channel uc, of mean cross-correlation, and verdicts.

    All strategies go side by side: values are counted and curves are added up over originals and
    replicates together, which are kept for that time, or stored in `out` if that is given, so that a replicate is made
    once. The report is made at once. A strategy without replicates has a row of NULLs, with verdicts "poor".
    """
    spark, names = originals.sparkSession, list(synthetics)
    channels = ["fhr", *["uc"] * ("uc" in originals.columns and any("uc" in made.columns for made in synthetics.values()))]
    column = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("array<double>").alias(c)
    parts = [(None, originals), *synthetics.items()]
    sets = tables.union_all([df.select(F.lit(name).cast("string").alias("strategy"), *[column(df, c) for c in channels]) for name, df in parts])
    if out is None:
        sets = sets.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        sets.write.mode("overwrite").parquet(out)
        sets = spark.read.parquet(out)
    try:
        near = fidelity.distances_from(sets.select("strategy", F.explode("fhr").alias("v")), "v", names)
        like = fidelity.curve_correlations(fidelity.mean_curves(sets, max_lag), ["acf", "psd", *["xcorr"] * (len(channels) > 1)])
        every = spark.createDataFrame([(n,) for n in names], "strategy string")
        report = fidelity.summary(every.join(near, "strategy", "left").join(like, "strategy", "left"))
        return spark.createDataFrame(report.collect(), report.schema)  # a row per strategy
    finally:
        sets.unpersist()


def phase_one(train: DataFrame, features: list[str], fold: str = "fold") -> DataFrame:
    """A row per feature: cross-validated AUROC, odds ratio, limits and p-value, best first."""
    auc = metrics.cv_auroc(train, features, "target", fold)
    stats = train.sparkSession.createDataFrame([(r["feature"], *(None if r[c] != r[c] else float(r[c]) for c in ("odds_ratio", "ci_lower", "ci_upper", "p_value"))) for r in logit.univariate(train, features, "target", "group_record")], "feature string, odds_ratio double, ci_lower double, ci_upper double, p_value double")
    return auc.join(F.broadcast(stats), "feature", "left").orderBy(F.col("auroc_cv").desc_nulls_last(), F.col("p_value").asc_nulls_last())  # a row per feature


def best_univariate(ranking: DataFrame, available: list[str]) -> str:
    """The first feature of the ranking that is there."""
    return ranking.where(F.col("feature").isin(available)).limit(1).first()["feature"]


def phase_two(train: DataFrame, test: DataFrame, features: list[str], criterion: str = "bic") -> tuple[list[str], list[dict], DataFrame]:
    """Forward selection on imputed, standardised training windows; coefficients; one report row of the held-out windows."""
    scaler = split.fit_scaler(train, features).cache()
    a, b = split.standardize(train, scaler, features), split.standardize(test, scaler, features)
    chosen, _ = logit.forward_selection(a, features, "target", criterion)
    model = logit.predictive(a, chosen, "target")
    if model is None:
        raise ValueError("the training windows have one class only")
    model = logit.clustered(a, [model], "target", "group_record")[0]
    threshold = trees.calibrate(logit.predict(a, model), "target")
    return chosen, model.table(), live_report(logit.predict(b, model), threshold)


def live_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Window metrics and patient metrics of the chronological simulation, as one row."""
    alert = scored.withColumn("alert", F.col("probability") >= threshold)
    patients = trends.patient_rollup(alert, "record", "window_start_min", "alert", "target", "time_to_birth_min")
    live = trends.live_metrics(patients).withColumnsRenamed({"nna": "patient_nna", "recall": "patient_recall"})
    return trees.evaluate(scored, "target", threshold).crossJoin(F.broadcast(live))  # one row each


def phase_three(train: DataFrame, test: DataFrame, spec: trees.ModelSpec, folds: int = 5, draws: int = 20, synthetic: DataFrame | None = None, seed: int = 42) -> tuple[dict, DataFrame, list[tuple[str, float]]]:
    """Tune by grouped out-of-fold average precision, calibrate on those scores, fit on all, report on held-out windows: parameters, report row, importances."""
    features = candidate_features(train)
    members = train.groupBy("group_record").agg(F.max("target").alias("target"))
    k = split.fold_count(members, "target", folds)
    in_folds = train.join(split.group_folds(members, "group_record", "target", k, seed).select("group_record", "fold"), "group_record").cache()
    ids = list(range(k))
    params = trees.tune(spec, in_folds, features, "target", "fold", ids, draws, seed, synthetic)
    oof = trees.out_of_fold(spec, params, in_folds, features, "target", "fold", ids, synthetic, "group_record")
    if oof.count() != in_folds.count():
        raise ValueError("some windows got no out-of-fold score")
    threshold = trees.calibrate(oof, "target")
    in_folds.unpersist()
    whole = train if synthetic is None else tables.union_all([train, tables.synthetic_of_training(synthetic, train, "source_record", "group_record")])
    model = trees.fit_model(spec, params, whole, features, "target")
    return params, live_report(trees.score(model, test), threshold), trees.importances(model, features)


def phase_three_boosted(train: DataFrame, test: DataFrame, symmetric: bool = False, folds: int = 5, draws: int = 20, synthetic: DataFrame | None = None, seed: int = 42, rounds: tuple = (100, 200, 300, 500)) -> tuple[boosting.Setting, DataFrame, list[tuple[str, float]]]:
    """phase_three with boosted trees of the library's own: all settings and folds are fitted side by side. Synthetic windows train where their source record does and are never scored."""
    features = candidate_features(train)
    members = train.groupBy("group_record").agg(F.max("target").alias("target"))
    k = split.fold_count(members, "target", folds)
    of = split.group_folds(members, "group_record", "target", k, seed).select("group_record", "fold")
    keep = ["record", "window_id", *features, "target", "group_record"]
    rows = train.select(*keep).withColumn("__real", F.lit(1))
    if synthetic is not None:
        own = tables.synthetic_of_training(synthetic, train, "source_record", "group_record").withColumn("group_record", F.col("source_record"))
        rows = rows.unionByName(tables.add_missing(own, keep).select(*keep).withColumn("__real", F.lit(0)))
    rows = rows.join(of, "group_record").withColumn("__id", F.xxhash64("record", "window_id", "__real"))
    options = boosting.settings(train, "target", symmetric, draws, rounds, seed)
    setting, _, threshold, model = boosting.tuned(rows, features, "target", "fold", list(range(k)), options, "__id", "__real")
    return setting, live_report(test.withColumn("probability", model.probability()), threshold), model.importances()


def comparison(baselines: DataFrame, rows: list[DataFrame], columns: list[str]) -> DataFrame:
    """Baseline rows and new rows in one table of fixed columns, missing ones as NULL; a model's new row replaces its old one."""
    new = tables.union_all([tables.add_missing(r, columns) for r in rows])
    return tables.upsert(tables.add_missing(baselines, columns), new, ["model"]).select(columns)


def winner(report: DataFrame) -> DataFrame:
    """The best model: by average precision, then AUROC."""
    return tables.top_n(report, 1, F.col("average_precision").desc_nulls_last(), F.col("auroc").desc_nulls_last(), F.col("model"))


def save_parameters(path: str, params: dict, **facts) -> None:
    """Write a model's parameters with what else is needed to build it again (name, features, threshold) as JSON."""
    files.write_text(path, json.dumps({"params": params} | facts, indent=2, sort_keys=True))


def rebuild(path: str, train: DataFrame, test: DataFrame, synthetic: DataFrame | None = None, label: str = "target") -> tuple[DataFrame, float]:
    """The stored model fitted again on the training windows: scored test windows with probability and alert, and the threshold. All stored features must be there."""
    stored = json.loads(files.read_text(path))
    if absent := [c for c in stored["features"] if c not in candidate_features(train)]:
        raise ValueError(f"features that can't be rebuilt: {absent}")
    spec = next((s for s in trees.specs() if s.name == stored["name"]), None)
    if spec is None:
        raise ValueError(f"no model {stored['name']}")
    whole = train if synthetic is None else tables.union_all([train, tables.synthetic_of_training(synthetic, train, "source_record", "group_record")])
    scored = trees.score(trees.fit_model(spec, stored["params"], whole, stored["features"], label), test)
    return scored.withColumn("alert", F.col("probability") >= stored["threshold"]), stored["threshold"]


def augmented(train: DataFrame, synthetic: DataFrame | None, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training windows with the synthetic rows of training records, and a report row: rows, positives, negatives, note. Features that synthetic rows lack are NULL; without source_record none enters, since it might come from a test record."""
    spark = train.sparkSession
    report = lambda rows, positives, note: spark.createDataFrame([(rows, positives, rows - positives, note)], "rows bigint, positives bigint, negatives bigint, note string")
    real, own, note = _augmentation(train, synthetic, features)
    if own is None:
        return real, report(0, 0, note)
    n = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0)).alias("p")).first()
    return real.unionByName(own), report(n.n, n.p, note if n.n else "none comes from a training record")


def write_augmented(train: DataFrame, synthetic: DataFrame | None, features: list[str], path: str) -> tuple[DataFrame, dict]:
    """augmented(), evaluated once: the training windows written and read back, and the report's numbers from what was written."""
    real, own, note = _augmentation(train, synthetic, features)
    both = real if own is None else real.unionByName(own)
    made = F.col("sample_source") == "synthetic"
    wrote = files.split_write(both, F.lit(None), path, {"synthetic": F.count_if(made), "positives": F.count_if(made & (F.col("target") == 1))})
    n, p = wrote.counts["synthetic"], wrote.counts["positives"]
    return wrote.good, {"rows": n, "positives": p, "negatives": n - p, "note": note if own is None or n else "none comes from a training record"}


def _augmentation(train: DataFrame, synthetic: DataFrame | None, features: list[str]) -> tuple[DataFrame, DataFrame | None, str]:
    """Real windows, the synthetic ones that may join them if any, and a note."""
    keep = [*features, "target", "group_record", "sample_source"]
    real = train.select(*keep)
    if synthetic is None:
        return real, None, "no synthetic rows: real windows only"
    if "source_record" not in synthetic.columns:
        return real, None, "left out: without source_record they may come from test records"
    own = tables.synthetic_of_training(synthetic, train, "source_record", "group_record")
    if "target" not in own.columns:
        own = own.withColumn("target", composite_target(F.col("pH"), F.col("Apgar5"), F.col("NICU_days")))
    own = tables.add_missing(own, features).withColumns({"group_record": F.col("source_record"), "sample_source": F.lit("synthetic")}).select(*keep)
    return real, own, "of training records only"


def selection_order(spark: SparkSession, path: list[dict]) -> DataFrame:
    """The path of a forward selection as a table, with what each step gained."""
    rows = [(p["step"], p["feature"], float(p["criterion"])) for p in path]
    steps = spark.createDataFrame(rows, "step int, feature string, criterion double")
    # a row per selected feature
    return steps.withColumn("gain", F.lag("criterion").over(Window.partitionBy(F.lit(0)).orderBy("step")) - F.col("criterion")).orderBy("step")


def models_of(report: DataFrame, prefix: str) -> DataFrame:
    """Report rows of the models whose name begins so."""
    return report.where(F.col("model").startswith(prefix))


def risk_profile(scored: DataFrame, record: str) -> DataFrame:
    """A patient's windows on an elapsed axis that ends at the median birth time: what a risk curve needs."""
    w = scored.where(F.col("record") == record)
    birth = w.agg(F.median(F.col("window_end_min") + F.col("time_to_birth_min")).alias("birth_min"))
    return w.crossJoin(F.broadcast(birth)).select("window_end_min", "probability", "birth_min").orderBy("window_end_min")  # one row


def risk_profiles(scored: DataFrame) -> DataFrame:
    """risk_profile of every record: record, window_end_min, probability, birth_min."""
    birth = scored.groupBy("record").agg(F.median(F.col("window_end_min") + F.col("time_to_birth_min")).alias("birth_min"))
    return scored.join(birth, "record").select("record", "window_end_min", "probability", "birth_min")


#: Kinds of the signal features that aren't plain morphology.
_KINDS = {
    "signal quality": ("fhr_invalid_pct", "uc_invalid_pct", "ltv_valid_windows"),
    "contractions and coupling": ("uc_contractions_count", "decelerations_early_count", "decelerations_late_count", "decelerations_variable_count", "deceleration_uc_lag_mean_s", "deceleration_uc_lag_median_s"),
    "nonlinear complexity": ("fhr_apen", "fhr_sampen", "dfa_alpha", "dfa_intercept", "dfa_alpha_short", "dfa_alpha_long"),
}

#: What each predictor says.
MEANINGS = {
    "Age": "mother's age in years",
    "Gravidity": "pregnancies before this birth",
    "Parity": "births before this one",
    "Diabetes": "1 if the mother has diabetes",
    "Pyrexia": "1 if the mother has a fever",
    "Gest_weeks": "weeks of gestation",
    "Sex": "code of the child's sex",
    "signal_duration_min": "minutes of signal in the window",
    "fhr_invalid_pct": "percent of heart rate samples that are missing, zero or outside 50 to 240",
    "uc_invalid_pct": "percent of contraction samples that are missing, zero or outside 0 to 150",
    "fhr_baseline_mean_bpm": "mean of the twice median-filtered heart rate",
    "fhr_baseline_median_bpm": "median of that baseline",
    "fhr_baseline_std_bpm": "deviation of that baseline",
    "fhr_baseline_slope_bpm_min": "slope of that baseline, beats per minute and minute",
    "accelerations_count": "rises of 15 bpm over the baseline for 15 s or longer",
    "accelerations_mean_amp_bpm": "their mean height",
    "accelerations_mean_duration_s": "their mean duration",
    "decelerations_count": "falls of 15 bpm under the baseline for 15 s or longer",
    "decelerations_mean_amp_bpm": "their mean depth",
    "decelerations_mean_duration_s": "their mean duration",
    "uc_contractions_count": "contractions found in the window",
    "fhr_apen": "approximate entropy at 1 Hz, order 2, 0.2 deviations",
    "fhr_sampen": "sample entropy at 1 Hz, order 2, 0.2 deviations",
    "ltv_mean_amp_bpm": "mean of the amplitudes of whole minutes without decelerations",
    "ltv_median_amp_bpm": "median of those amplitudes",
    "ltv_valid_windows": "minutes that these come from",
    "decelerations_early_count": "decelerations within 15 s of a contraction's peak",
    "decelerations_late_count": "decelerations 15 to 90 s after one",
    "decelerations_variable_count": "all other decelerations",
    "deceleration_uc_lag_mean_s": "mean lag from contraction to deceleration",
    "deceleration_uc_lag_median_s": "median lag from contraction to deceleration",
    "dfa_alpha": "fluctuation exponent over scales of 4 to 128 s",
    "dfa_intercept": "intercept of that fit",
    "dfa_alpha_short": "exponent of the short scales",
    "dfa_alpha_long": "exponent of the long scales",
    "delta_baseline_std_bpm": "change of the baseline's deviation over two windows",
    "delta_sampen": "change of sample entropy over two windows",
    "fhr_std_falling_streak": "windows in a row in which the baseline's deviation fell",
    "fhr_sampen_falling_streak": "windows in a row in which sample entropy fell",
    "slope_sampen_30min": "slope of sample entropy over six windows",
    "slope_baseline_mean_30min": "slope of the baseline's mean over six windows",
}


def variable_dictionary(spark: SparkSession, columns: list[str]) -> DataFrame:
    """A row per predictor that is there, in the fixed order of predictors: position, variable, kind, description."""

    def kind(c: str) -> str:
        if c in BASELINE:
            return "baseline"
        return "trend" if c in TRENDS else next((k for k, names in _KINDS.items() if c in names), "morphology")

    known = [c for c in predictor_names() if c in columns]
    return spark.createDataFrame([(i, c, kind(c), MEANINGS[c]) for i, c in enumerate(known)], "position int, variable string, kind string, description string")


def arguments(argv: list[str]) -> argparse.Namespace:
    """Options of the nested validation."""
    p = argparse.ArgumentParser()
    for name, default in (("folds", 5), ("inner-folds", 3), ("n-iter", 8), ("seed", 42), ("n-jobs", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    a = p.parse_args(argv)
    if min(a.folds, a.inner_folds) < 2 or a.n_iter < 1:
        p.error("folds are 2 at least, draws 1 at least")
    return a


def nested_validation(matrix: DataFrame, spec: trees.ModelSpec, options: argparse.Namespace, synthetic: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold rows of the nested cross-validation and their summary."""
    if bad := [c for c in candidate_features(matrix) if c in PROHIBITED]:
        raise ValueError(f"prohibited predictors: {bad}")
    members = matrix.groupBy(F.col("group_record").alias("record")).agg(F.max("target").alias("target"))
    if not tables.broken_dependency(matrix, "group_record", "target").isEmpty():
        raise ValueError("a patient has several targets")
    nested = split.nested_folds(members, "record", "target", options.folds, options.inner_folds, options.seed)
    rows = trees.nested_cv(spec, matrix.withColumn("record", F.col("group_record")), nested, candidate_features(matrix), "target", "record", options.n_iter, synthetic)
    return rows, tables.fold_summary(rows, ["model"], ["auroc", "average_precision", "sensitivity"])


def read_signals(spark: SparkSession, folder: str, missing: str = "skip") -> DataFrame:
    """Paired channels of a folder of NumPy files; unreadable files are left out."""
    fhr, uc = (files.read_npy(spark, folder, s).where("error IS NULL") for s in ("_fhr.npy", "_uc.npy"))
    return files.pair_channels(fhr, uc, missing)


def cleaned_samples(signals: DataFrame, low: float = 60, high: float = 200, max_gap: int = 60) -> DataFrame:
    """Samples in long form with range cleaning and short gaps filled: record, i, fhr."""
    long = signals.select("record", F.posexplode("fhr").alias("i", "x")).withColumn("x", series.clean_range(F.col("x"), low, high))
    return series.interpolate(long, "x", "record", "fhr", max_gap=max_gap).select("record", "i", "fhr")
