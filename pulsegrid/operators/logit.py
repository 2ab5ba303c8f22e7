"""Logistic regression by Newton steps whose sums Spark gathers: one pass per step for any number of models, and a k x k system each on the driver.

What a pass brings back is as long as the coefficients, whatever the rows. Standard errors can be clustered, from
sums of scores per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """Names (intercept first), coefficients, their covariance, log-likelihood, rows."""

    names: tuple[str, ...]
    coef: np.ndarray
    cov: np.ndarray
    ll: float
    n: int

    def criterion(self, kind: str) -> float:
        k = len(self.coef)
        return -2 * self.ll + (2 * k if kind == "aic" else k * math.log(self.n))

    def table(self) -> list[dict]:
        """Per name: coefficient, odds ratio with 95 % limits, p-value of the normal test."""
        out = []
        for name, b, v in zip(self.names, self.coef, np.diag(self.cov), strict=True):
            se = math.sqrt(max(v, 0.0))
            z = b / se if se > 0 else math.nan
            odds = lambda x: math.exp(x) if x < 709 else math.inf
            out.append({"feature": name, "coef": float(b), "std_err": se, "odds_ratio": odds(b), "ci_lower": odds(b - 1.959963984540054 * se), "ci_upper": odds(b + 1.959963984540054 * se), "p_value": math.erfc(abs(z) / math.sqrt(2)) if se > 0 else math.nan})
        return out


def linear(names: tuple[str, ...], coef: np.ndarray) -> Column:
    """The linear predictor as a column."""
    out = F.lit(float(coef[0]))
    for n, b in zip(names[1:], coef[1:], strict=True):
        out = out + F.lit(float(b)) * F.col(n)
    return out


def predict(df: DataFrame, fit: Fit, out: str = "probability") -> DataFrame:
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-linear(fit.names, fit.coef))))


def _pack(n: float, ll: float, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.concatenate([[n, ll], g, h[np.triu_indices(len(g))]])


def _unpack(v: np.ndarray, k: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    h = np.zeros((k, k))
    h[np.triu_indices(k)] = v[2 + k :]
    return v[0], v[1], v[2 : 2 + k], h + np.triu(h, 1).T


def _step_sums(df: DataFrame, models: dict[int, tuple[list[str], np.ndarray]], label: str, weight: str | None) -> dict[int, np.ndarray]:
    """Of each model (its features and coefficients) rows, log-likelihood, score and information, in one pass over df for all of them.

    Each task adds up its batches; what it gives is as long as the models have sums, and Spark adds up the tasks'. A
    row counts for the models all of whose features it has.
    """
    columns = sorted({f for names, _ in models.values() for f in names})
    at = {c: i for i, c in enumerate(columns)}
    plan = [(m, [at[f] for f in names], coef) for m, (names, coef) in models.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.float64)
            y, w, x = x[0], x[1], x[2:].T.reshape(batch.num_rows, len(columns))
            for m, which, coef in plan:
                z = np.column_stack([np.ones(len(y)), x[:, which]])
                ok = ~np.isnan(z).any(axis=1) & ~np.isnan(y) & ~np.isnan(w)
                z, yy, ww = z[ok], y[ok], w[ok]
                p = 1.0 / (1.0 + np.exp(-np.clip(z @ coef, -700, 700)))
                ll = (ww * (yy * np.log(np.maximum(p, 1e-300)) + (1 - yy) * np.log(np.maximum(1 - p, 1e-300)))).sum()
                v = _pack(len(yy), ll, z.T @ (ww * (yy - p)), z.T @ (z * (ww * p * (1 - p))[:, None]))
                total[m] = total[m] + v if m in total else v
        rows = [(m, i, float(e)) for m, v in total.items() for i, e in enumerate(v)]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["m", "i", "v"])

    data = df.select(F.col(label).cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    out: dict[int, np.ndarray] = {}
    # as many rows as the models have sums
    for r in data.mapInArrow(run, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.m, np.zeros(2 + len(models[r.m][1]) + len(models[r.m][1]) * (len(models[r.m][1]) + 1) // 2))[r.i] = r.v
    return out


def fit_each(df: DataFrame, feature_sets: list[list[str]], label: str, weight: str | None = None, steps: int = 50, tol: float = 1e-10, ridge: float = 0.0) -> list[Fit | None]:
    """A model per set of features, or None for those without convergence, with a singular system, or with separated classes. Newton steps go side by side: one pass over df per step, whatever the number of models."""
    coef = {m: np.zeros(1 + len(f)) for m, f in enumerate(feature_sets)}
    before, out, running = dict.fromkeys(coef, math.inf), [None] * len(coef), set(coef)
    for _ in range(steps):
        if not running:
            break
        sums = _step_sums(df, {m: (feature_sets[m], coef[m]) for m in sorted(running)}, label, weight)
        for m in sorted(running):
            k = len(coef[m])
            n, ll, g, h = _unpack(sums[m], k) if m in sums else (0, 0.0, coef[m], np.zeros((k, k)))
            penalty = ridge * np.eye(k)
            penalty[0, 0] = 0
            if not n or np.linalg.cond(h + penalty) > 1e14:
                running.discard(m)
                continue
            move = np.linalg.solve(h + penalty, g - penalty @ coef[m])
            if np.abs(move).max() < 1e-8 or abs(before[m] - ll) <= tol * (1 + abs(ll)):
                running.discard(m)
                out[m] = Fit(("intercept", *feature_sets[m]), coef[m], np.linalg.inv(h + penalty), float(ll), int(n))
                continue
            coef[m], before[m] = coef[m] + move, ll
            # separated classes: the likelihood has no maximum
            if (ll > -1e-6 * n and not ridge) or np.abs(coef[m]).max() > 1e3:
                running.discard(m)
    return out


def clustered(df: DataFrame, fits: list[Fit], label: str, cluster: str, weight: str | None = None) -> list[Fit]:
    """The fits with the sandwich covariance of score sums per group, times G / (G - 1) * (n - 1) / (n - k): one pass for all of them."""
    w, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(label).cast("double")

    def scores(m: int, f: Fit) -> Column:
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in f.names[1:]]]
        rest = w * (y - 1.0 / (1.0 + F.exp(-linear(f.names, f.coef))))
        parts = [rest * v for v in x]
        whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in parts])
        return F.when(whole, F.struct(F.lit(m).alias("m"), F.array(*parts).alias("s")))

    most = max((len(f.coef) for f in fits), default=0)
    if not fits:
        return []
    long = df.select(F.col(cluster).alias("__c"), F.explode(F.array(*[scores(m, f) for m, f in enumerate(fits)])).alias("v")).where("v IS NOT NULL")
    sums = long.groupBy("v.m", "__c").agg(*[F.sum(F.get("v.s", F.lit(i))).alias(f"s{i}") for i in range(most)])
    pairs = list(combinations_with_replacement(range(most), 2))
    meat = {r.m: r for r in sums.groupBy("m").agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).collect()}
    out = []
    for m, f in enumerate(fits):
        k, r, middle = len(f.coef), meat.get(m), np.zeros((most, most))
        if r is None or r.g < 2 or f.n <= k:
            out.append(f)
            continue
        for i, j in pairs:
            middle[i, j] = middle[j, i] = r[f"m{i}_{j}"] or 0.0
        out.append(replace(f, cov=f.cov @ middle[:k, :k] @ f.cov * (r.g / (r.g - 1)) * ((f.n - 1) / (f.n - k))))
    return out


def fit(df: DataFrame, features: list[str], label: str, cluster: str | None = None, weight: str | None = None, steps: int = 50, tol: float = 1e-10, ridge: float = 0.0) -> Fit | None:
    """One fitted model, or None; see fit_each. With `cluster` its covariance is that of clustered()."""
    found = fit_each(df, [features], label, weight, steps, tol, ridge)[0]
    return clustered(df, [found], label, cluster, weight)[0] if found and cluster else found


def forward_selection(df: DataFrame, candidates: list[str], label: str, criterion: str = "aic", least_gain: float = 1e-8) -> tuple[list[str], list[dict]]:
    """Features in order of entry, and the criterion after each: the best candidate enters while it lowers the criterion by more than least_gain.

    A round fits all candidates side by side: some Newton steps, each one pass over the cached matrix, which never moves.
    """
    df = df.select(label, *candidates).cache()
    try:
        base = fit(df, [], label)
        best, chosen, path = (base.criterion(criterion) if base else math.inf), [], []
        while len(chosen) < len(candidates):
            left = [c for c in candidates if c not in chosen]
            tried = [(f.criterion(criterion), c) for c, f in zip(left, fit_each(df, [[*chosen, c] for c in left], label), strict=True) if f]
            if not tried or min(tried)[0] >= best - least_gain:
                break
            best, name = min(tried)
            chosen.append(name)
            path.append({"step": len(chosen), "feature": name, "criterion": best})
        return chosen, path
    finally:
        df.unpersist()


def univariate(df: DataFrame, features: list[str], label: str, cluster: str | None = None) -> list[dict]:
    """One row per feature: its odds ratio, limits and p-value; NaN where no fit is possible. All features side by side, each over the rows that have it."""
    fits = fit_each(df, [[f] for f in features], label)
    known = [f for f in fits if f]
    named = {f.names[1]: f for f in (clustered(df, known, label, cluster) if cluster else known)}
    none = dict.fromkeys(("coef", "std_err", "odds_ratio", "ci_lower", "ci_upper", "p_value"), math.nan)
    return [named[f].table()[1] if f in named else {"feature": f, **none} for f in features]


def predictive(train: DataFrame, features: list[str], label: str) -> Fit | None:
    """A model for predictions: unpenalised; where that has no fit, a lightly penalised one with balanced classes. Without features it is the prevalence."""
    found = fit(train, features, label)
    if found or not features:
        return found
    y = F.col(label).cast("double")
    n = train.agg(F.count(label).alias("n"), F.sum(y).alias("p")).first()
    if not n.p or n.p == n.n:
        return None
    balanced = train.withColumn("__balance", F.when(y == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p))))
    return fit(balanced, features, label, weight="__balance", ridge=1.0)
