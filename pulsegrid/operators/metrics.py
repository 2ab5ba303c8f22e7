"""Metrics of scores against labels as relational plans: one sort by score, no driver-side loop over thresholds.

All take df with a score and a 0/1 label and give one row, or one per group of `by`. Rows without a score are left
out of the curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums


def _per_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """A row per distinct score with its positives and negatives, and both counted at or above it, and in total."""
    rows = df.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("s"), F.col(label).cast("long").alias("p"), (1 - F.col(label).cast("long")).alias("n"))
    g = rows.groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    names = {"p_run": "tp", "n_run": "fp", "p_all": "all_p", "n_all": "all_n"}
    return running_sums(rows, g, "s", ["p", "n"], by, descending=True).withColumnsRenamed(names)


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve: pairs won, ties half; NULL with one class."""
    by = by or []
    s = _per_score(df, score, label, by)
    won = F.sum(F.col("p") * (F.col("all_n") - F.col("fp")) + F.col("p") * F.col("n") / 2.0)
    return s.groupBy(*by).agg(F.try_divide(won, (F.max("all_p") * F.max("all_n")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Step-wise average precision over distinct scores; NULL without positives."""
    by = by or []
    s = _per_score(df, score, label, by)
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_p").cast("double")).alias("average_precision"))


def brier(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def confusion(df: DataFrame, alert: Column, label: str, by: list[str] | None = None) -> DataFrame:
    """Counts and rates. Sensitivity and specificity without cases are NULL, other rates 0; the number needed to alert is infinite without true positives."""
    y = F.col(label) == 1
    g = df.groupBy(*(by or [])).agg(F.count_if(alert & y).alias("tp"), F.count_if(alert & ~y).alias("fp"), F.count_if(~alert & y).alias("fn"), F.count_if(~alert & ~y).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    g = g.withColumns({"sensitivity": F.try_divide(tp.cast("double"), tp + fn), "specificity": F.try_divide(tn.cast("double"), tn + fp), "ppv": rate(tp, tp + fp), "accuracy": rate(tp + tn, tp + fp + fn + tn)})
    return g.withColumns({"f1": rate(2 * tp, 2 * tp + fp + fn), "nna": F.when(tp > 0, (tp + fp) / tp).otherwise(float("inf"))})


def youden_threshold(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """The score with the greatest TPR - FPR, the highest of ties; 0.5 with one class."""
    by = by or []
    s = _per_score(df, score, label, by).withColumn("j", F.try_divide(F.col("tp").cast("double"), F.col("all_p")) - F.try_divide(F.col("fp").cast("double"), F.col("all_n")))
    return s.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("j").isNotNull(), F.struct("j", "s")))["s"].cast("double"), F.lit(0.5)).alias("threshold"))


def recall_threshold(df: DataFrame, score: str, label: str, least: float = 0.75, by: list[str] | None = None) -> DataFrame:
    """The highest score at which recall is `least` or more, else the lowest score."""
    by = by or []
    s = _per_score(df, score, label, by)
    ok = F.try_divide(F.col("tp").cast("double"), F.col("all_p")) >= least
    return s.groupBy(*by).agg(F.coalesce(F.max(F.when(ok, F.col("s"))), F.min("s")).alias("threshold"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive; 1 without positives."""
    p = F.count_if(F.col(label) == 1)
    return df.agg(F.when(p > 0, F.count_if(F.col(label) == 0) / p).otherwise(1.0).alias("scale_pos_weight"))


def cv_auroc(df: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """Mean fold AUROC of each feature alone, and folds that count: the rank AUC of the feature, turned round if on the training folds positives have the lower mean.

    A one-feature logistic score is monotone in its feature, so nothing needs to be fitted. Missing values take
    the training folds' exact median. Training folds are all but one: their counts and sums are those of all folds
    less the one's, so rows are unpivoted once and never multiplied by folds. There are a handful of folds.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = df.select(F.col(fold).alias("fold"), F.col(label).alias("y"), pairs.alias("v")).select("fold", "y", "v.*")
    valid = long.where(F.col("x").isNotNull()).select("feature", "x", *[(F.col("fold") == k).cast("long").alias(f"c{i}") for i, k in enumerate(folds)])
    names = [f"c{i}" for i in range(len(folds))]
    runs = running_sums(valid, valid.groupBy("feature", "x").agg(*[F.sum(c).alias(c) for c in names]), "x", names, ["feature"])
    less = lambda i, kind: sum((F.col(f"{c}_{kind}") for j, c in enumerate(names) if j != i), F.lit(0))
    at = lambda i, place: F.min(F.when(less(i, "run") >= place, F.col("x")))
    middle = [((at(i, F.floor((less(i, "all") + 1) / 2)) + at(i, F.floor(less(i, "all") / 2) + 1)) / 2).alias(f"m{i}") for i in range(len(folds))]
    # a row per feature, and one per feature and fold: small enough for the driver, which keeps the last plan short
    med = {r.feature: r for r in runs.groupBy("feature").agg(*middle).collect()}
    side = lambda y: F.col("y") == y
    parts = (("s", lambda y: F.sum(F.when(side(y), F.col("x")))), ("v", lambda y: F.count(F.when(side(y), F.col("x")))), ("a", lambda y: F.count_if(side(y))))
    sums = long.groupBy("feature", "fold").agg(*[f(y).alias(f"{n}{y}") for y in (0, 1) for n, f in parts]).collect()
    known = []
    for f in features:
        for i, k in enumerate(folds):
            rest = [r for r in sums if r.feature == f and r.fold != k]
            m = med[f][f"m{i}"] if f in med else None
            mean = []
            for y in (0, 1):
                total, values, rows = (sum(r[f"{n}{y}"] or 0 for r in rest) for n in "sva")
                gaps = (rows - values) * m if rows > values and m is not None else 0.0
                mean.append((total + gaps) / rows if rows else 0.0)
            known.append((f, k, m, -1.0 if mean[1] < mean[0] else 1.0))
    kind = long.schema["fold"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(known, f"feature string, fold {kind}, m double, way double")
    test = long.join(table, ["feature", "fold"]).withColumn("s", F.coalesce("x", "m") * F.col("way"))
    return auroc(test.where("s IS NOT NULL"), "s", "y", ["feature", "fold"]).groupBy("feature").agg(F.avg("auroc").alias("auroc_cv"), F.count("auroc").alias("folds"))
