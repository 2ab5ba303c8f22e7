"""Tree models behind one interface: sampled parameters, grouped folds, out-of-fold scores, thresholds, report rows.

The learners are Spark ML's; where xgboost is installed its Spark estimator can be named instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import average_precision, auroc, brier, class_weight, confusion, recall_threshold
from .prefix import dealt
from .tables import synthetic_of_training, union_all


def optional(name: str):
    """An optional module, or None: an absent booster is a model that is left out, not an error."""
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError:
        return None


@dataclass(frozen=True)
class ModelSpec:
    """A learner's name, how to build it from parameters, and the values to sample from."""

    name: str
    build: Callable[[dict], object]
    space: dict[str, tuple] = field(default_factory=dict)


def specs() -> list[ModelSpec]:
    gbt = ModelSpec("GBT", lambda p: GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=42, **p), {"maxDepth": (2, 3, 4), "maxIter": (10, 20, 40), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.85, 1.0), "minInstancesPerNode": (1, 5, 10)})
    forest = ModelSpec("RandomForest", lambda p: RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=42, **p), {"maxDepth": (3, 5, 7), "numTrees": (20, 50, 100), "subsamplingRate": (0.7, 1.0), "minInstancesPerNode": (1, 5, 10)})
    return [gbt, forest]


def sample_params(space: dict[str, tuple], draws: int, seed: int = 42) -> list[dict]:
    """Distinct parameter settings, the same for the same seed."""
    out: list[dict] = []
    for i in range(draws * 5):
        p = {k: v[int(hashlib.md5(f"{seed}|{i}|{k}".encode()).hexdigest()[:8], 16) % len(v)] for k, v in space.items()}
        if p not in out:
            out.append(p)
        if len(out) == draws:
            break
    return out


def weighted(train: DataFrame, label: str) -> DataFrame:
    """Balanced class weights: negatives per positive for positives, 1 for negatives."""
    w = class_weight(train, label).first()[0]
    return train.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(w))).otherwise(1.0)).withColumn("label", F.col(label).cast("double"))


def fit_model(spec: ModelSpec, params: dict, train: DataFrame, features: list[str], label: str):
    """A fitted pipeline; missing features are kept as NaN, on their own side of a split."""
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assemble, spec.build(params)]).fit(weighted(train, label))


def score(model, df: DataFrame, out: str = "probability") -> DataFrame:
    d = model.transform(df)
    return d.withColumn(f"__{out}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed(f"__{out}", out)


def out_of_fold(spec: ModelSpec, params: dict, df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], extra: DataFrame | None = None, key: str = "record") -> DataFrame:
    """Each row scored by a model that hasn't seen its fold; synthetic rows (extra) join where their source trains, and are never scored."""
    parts = []
    for k in folds:
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if extra is not None:
            train = union_all([train, synthetic_of_training(extra, train, "source_record", key)])
        parts.append(score(fit_model(spec, params, train, features, label), test))
    return union_all(parts)


def search(spec: ModelSpec, df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], draws: int = 20, seed: int = 42, extra: DataFrame | None = None, key: str = "record") -> tuple[dict, DataFrame]:
    """The sampled setting with the best mean average precision over the folds (the first of equals), and its out-of-fold scores: fold, label, probability.

    Rows of a fold are put together and weighted once for all settings. Fits go side by side, as many as leave no core
    idle, and all settings are scored and judged in one pass.
    """
    options = sample_params(spec.space, draws, seed)
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    parts = {}
    for k in folds:
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if extra is not None:
            train = union_all([train, synthetic_of_training(extra, train, "source_record", key)])
        train = dealt(assemble.transform(weighted(train, label)).select("features", "label", "weight"), "features").persist(StorageLevel.MEMORY_AND_DISK)
        parts[k] = train, dealt(assemble.transform(test.select(fold, label, *features)).drop(*features), "features").persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    try:
        tasks = max(train.rdd.getNumPartitions() for train, _ in parts.values())
        jobs = [(i, k) for i in range(len(options)) for k in folds]
        fits = inheritable_thread_target(spark)(lambda job: spec.build(options[job[0]]).fit(parts[job[1]][0]))
        with ThreadPool(min(len(jobs), 8, max(2, spark.sparkContext.defaultParallelism // tasks))) as pool:
            models = pool.map(fits, jobs, chunksize=1)
        scored = [score(m, parts[k][1]).withColumn("__setting", F.lit(i)) for (i, k), m in zip(jobs, models, strict=True)]
        scores = union_all(scored)
        # a plan of many models is planned once, here
        scores = scores.checkpoint() if spark.sparkContext.getCheckpointDir() else scores.localCheckpoint()
        by = average_precision(scores, "probability", label, ["__setting", fold]).groupBy("__setting").agg(F.avg("average_precision").alias("ap")).where("ap IS NOT NULL").collect()  # a row per setting
        if not by:
            raise ValueError("no fold has both classes")
        best = max(by, key=lambda r: (r.ap, -r["__setting"]))["__setting"]
        return options[best], scores.where(F.col("__setting") == best).drop("__setting")
    finally:
        for held in (x for pair in parts.values() for x in pair):
            held.unpersist()


def tune(spec: ModelSpec, df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], draws: int = 20, seed: int = 42, extra: DataFrame | None = None) -> dict:
    """The setting that `search` finds."""
    return search(spec, df, features, label, fold, folds, draws, seed, extra)[0]


def calibrate(oof: DataFrame, label: str, least_recall: float = 0.75) -> float:
    return float(recall_threshold(oof, "probability", label, least_recall).first()[0])


def evaluate(scored: DataFrame, label: str, threshold: float) -> DataFrame:
    """One report row: areas, Brier score, confusion and rates at the threshold."""
    m = auroc(scored, "probability", label)
    for other in (average_precision(scored, "probability", label), brier(scored, "probability", label), confusion(scored, F.col("probability") >= threshold, label)):
        m = m.crossJoin(F.broadcast(other))  # one row each
    return m.withColumn("threshold", F.lit(threshold))


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance, ties by name."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))


def nested_cv(spec: ModelSpec, df: DataFrame, nested: DataFrame, features: list[str], label: str, key: str = "record", draws: int = 8, extra: DataFrame | None = None) -> DataFrame:
    """A report row per outer fold: parameters are tuned, and the threshold set, on inner folds of the other outer folds."""
    outer = sorted(r[0] for r in nested.select("test_of").distinct().collect())
    inner = sorted(r[0] for r in nested.select("inner").distinct().collect())
    rows = []
    for k in outer:
        train = df.join(nested.where(F.col("test_of") == k).select(key, "inner"), key)
        test = df.join(nested.where(F.col("test_of") == k).select(key).distinct(), key, "left_anti")
        params = tune(spec, train, features, label, "inner", inner, draws, extra=extra)
        threshold = calibrate(out_of_fold(spec, params, train, features, label, "inner", inner, extra), label)
        whole = train if extra is None else union_all([train, synthetic_of_training(extra, train, "source_record", key)])
        scored = score(fit_model(spec, params, whole, features, label), test)
        rows.append(evaluate(scored, label, threshold).withColumns({"model": F.lit(spec.name), "fold": F.lit(k)}))
    return union_all(rows)
