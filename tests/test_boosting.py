"""Boosted trees against loops over rows, and against what must hold of ordered boosting."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import boosting as B
from pulsegrid.operators import split, trees


def table(spark, n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(12), rng.choice([None, float("nan"), 1.5, 2.5, 3.5, 9.0]), rng.random() // 0.1
        odds = (a > 7) * 2 + (b is None) * 1.5 - (c < 3) * 2
        rows.append((i * 7919 - 5, float(a), b, c, int(rng.random() < 1 / (1 + math.exp(-odds))), i % 3, i % 17))
    return rows, spark.createDataFrame(rows, "id bigint, a double, b double, c double, y int, fold int, record int").repartition(5)


def plain(rows, names, s, cuts, drawn_rows=lambda i, turn: True, drawn_columns=lambda turn: None):
    """The same trees by loops: a list of nested dicts."""
    bins = [[None if v is None or math.isnan(v) else sum(c <= v for c in cuts[k]) for k, v in enumerate(r[1 : 1 + len(names)])] for r in rows]
    margin, out = [0.0] * len(rows), []
    unit = B.UNIT

    def leaf(g, h):
        return -g / (h + s.ridge) * s.rate

    def grow(at, depth, slopes, columns):
        g, h = (sum(slopes[i][k] for i in at) / unit for k in (0, 1))
        best = None
        for f in columns if depth < s.depth else ():
            for cut in sorted({bins[i][f] for i in at} - {None}):
                for to_left in (False, True):
                    left = [i for i in at if (to_left if bins[i][f] is None else bins[i][f] <= cut)]
                    gl, hl = (sum(slopes[i][k] for i in left) / unit for k in (0, 1))
                    if min(hl, h - hl) < s.least or min(hl, h - hl) <= 0:
                        continue
                    gain = round((gl**2 / (hl + s.ridge) + (g - gl) ** 2 / (h - hl + s.ridge) - g**2 / (h + s.ridge)) / 2, 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, cut, to_left, left)
        if best is None:
            return leaf(g, h)
        gain, f, cut, to_left, left = best
        rest = [i for i in at if i not in set(left)]
        return {"feature": f, "cut": cut, "left": to_left, "gain": gain, "children": (grow(left, depth + 1, slopes, columns), grow(rest, depth + 1, slopes, columns))}

    def value(t, i):
        while isinstance(t, dict):
            b = bins[i][t["feature"]]
            t = t["children"][(not t["left"]) if b is None else int(b > t["cut"])]
        return t

    for turn in range(s.rounds):
        slopes = []
        for i, r in enumerate(rows):
            p, w = 1 / (1 + math.exp(-margin[i])), s.weight if r[1 + len(names)] == 1 else 1.0
            slopes.append((float(np.rint((p - r[1 + len(names)]) * w * unit)), float(np.rint(p * (1 - p) * w * unit))))
        t = grow([i for i in range(len(rows)) if drawn_rows(rows[i][0], turn)], 0, slopes, drawn_columns(turn) or range(len(names)))
        margin = [m + value(t, i) for i, m in enumerate(margin)]
        out.append(t)
    return out, margin


def unfold(t, k=0):
    if t.feature[k] < 0:
        return float(t.value[k])
    return {"feature": int(t.feature[k]), "cut": int(t.cut[k]), "left": bool(t.left[k]), "gain": pytest.approx(t.gain[k], abs=1e-8), "children": (unfold(t, 2 * k + 1), unfold(t, 2 * k + 2))}


def same(a, b):
    if isinstance(a, dict) != isinstance(b, dict):
        return False
    if not isinstance(a, dict):
        return a == pytest.approx(b, abs=1e-6)
    return all(a[x] == b[x] for x in ("feature", "cut", "left")) and b["gain"] == a["gain"] and all(same(x, y) for x, y in zip(a["children"], b["children"], strict=True))


NAMES = ["a", "b", "c"]


@pytest.mark.parametrize("s", [B.Setting(depth=3, rate=0.3, rounds=3, least=2.0, ridge=1.5, weight=1.7), B.Setting(depth=2, rate=0.5, rounds=4, rows=0.6, columns=0.7)])
def test_trees_are_those_of_loops_over_rows(spark, s):
    rows, df = table(spark, 200)
    cuts = B.bin_cuts(df, NAMES)
    assert cuts[0] == [float(k) for k in range(1, 12)] and cuts[1] == [2.5, 3.5, 9.0]
    model = B.fit(df, NAMES, "y", s, "id")
    draw = lambda i, turn: s.rows == 1 or B._even(np.array([i]), s.seed, turn, 5)[0] < s.rows
    chosen = lambda turn: None if s.columns == 1 else np.sort(np.argsort(B._even(np.arange(3), s.seed, turn, 3))[: round(s.columns * 3)]).tolist()
    want, margin = plain(rows, NAMES, s, cuts, draw, chosen)
    assert all(same(x, unfold(y)) for x, y in zip(want, model.trees, strict=True))
    got = {r.id: r.m for r in df.select("id", model.margin().alias("m")).collect()}
    assert all(got[r[0]] == pytest.approx(m, abs=1e-5) for r, m in zip(rows, margin, strict=True))
    share = dict(model.importances())
    assert sum(share.values()) == pytest.approx(1) and min(share.values()) >= 0


def test_trees_do_not_depend_on_partitions_or_on_other_models(spark):
    _, df = table(spark, 300, 3)
    s = B.Setting(depth=3, rounds=9, rate=0.2, rows=0.8)
    other = B.Setting(symmetric=True, depth=2, rounds=4, noise=1.0)
    alone = B.fit(df.coalesce(1), NAMES, "y", s, "id")
    cuts = B.bin_cuts(df, NAMES)
    blocks = B.pack(df.withColumns({"f": F.lit(0), "__scored": F.lit(0)}).repartition(7), NAMES, cuts, "y", "id", ["f", "__scored"])
    both = B.Fit(blocks, NAMES, cuts, [B.Run(other), B.Run(s)], 2)
    assert [unfold(t) for t in alone.trees] == [unfold(t) for t in both.models[1].trees]
    both.close()


def test_symmetric_trees_split_a_level_at_once(spark):
    rows, df = table(spark, 300, 5)
    s = B.Setting(symmetric=True, depth=3, rate=0.3, rounds=2, ridge=2.0)
    model = B.fit(df, NAMES, "y", s, "id")
    for t in model.trees:
        for level in range(3):
            at = slice((1 << level) - 1, (2 << level) - 1)
            assert len({*zip(t.feature[at].tolist(), t.cut[at].tolist(), strict=True)}) == 1
    # the first level by loops: balanced classes, missing values below all others
    n = [sum(r[4] == k for r in rows) for k in (0, 1)]
    g = [(0.5 - r[4]) * max(n) / n[r[4]] for r in rows]
    h = [0.25 * max(n) / n[r[4]] for r in rows]
    part = lambda at: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + 2.0)
    bin_of = lambda k, v: -1 if v is None or math.isnan(v) else sum(c <= v for c in model.cuts[k])
    best = max((part([i for i, r in enumerate(rows) if bin_of(k, r[1 + k]) <= cut]) + part([i for i, r in enumerate(rows) if bin_of(k, r[1 + k]) > cut]), -k, -cut) for k in range(3) for cut in range(len(model.cuts[k])))
    assert (-best[1], -best[2]) == (model.trees[0].feature[0], model.trees[0].cut[0])
    got = {r.id: r.m for r in df.select("id", model.margin().alias("m")).collect()}
    x = np.array([[B.MISSING if bin_of(k, r[1 + k]) < 0 else bin_of(k, r[1 + k]) for k in range(3)] for r in rows], np.uint8)
    want = sum(t.value[t.place(x)] for t in model.trees)
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-6)
    plan = df.select(model.margin().alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_own_label_never_enters_a_residual(spark):
    """With the same splits, turning one row's label round changes no margin of its own and none of a row before it."""
    rows, df = table(spark, 120, 7)
    s = B.Setting(symmetric=True, depth=2, rate=0.5, rounds=1, ridge=1.0)
    cuts = B.bin_cuts(df, NAMES)
    run = B.Run(s)

    def margins(data):
        blocks = B.pack(data.withColumns({"f": F.lit(0), "__scored": F.lit(0)}), NAMES, cuts, "y", "id", ["f", "__scored"])
        done = B.Fit(blocks, NAMES, cuts, [], 2)
        done.runs, done.models, done.pending = [run], [B.Booster(NAMES, cuts, s)], [[]]
        done._weights()
        done.weights = [(1.0, 1.0)]
        for k in range(4):
            t = B.Tree.of(2)
            t.feature[:3], t.left[:3] = [k % 3, 2, 2], True
            t.cut[:3] = [1, 3, 3]
            done._ordered_values({0: t})
            done.pending[0].append(t)
        out = {}
        for r in done.blocks.collect():
            b = B._Rows(r.asDict(), 3, 2, 1)
            out |= dict(zip(b.id.tolist(), b.margin(0, run, done.pending[0])[0].tolist(), strict=True))
        done.close()
        return out

    base = margins(df)
    segment = {r[0]: int(B._segment(np.array([r[0]]), s.seed)[0]) for r in rows}
    assert len(set(segment.values())) > 3 and all(base[i] == 0 for i in base if segment[i] == 0)
    changed = 0
    for r in sorted(rows, key=lambda r: segment[r[0]])[::17]:
        other = margins(df.withColumn("y", F.when(F.col("id") == r[0], 1 - F.col("y")).otherwise(F.col("y"))))
        assert all(other[i] == base[i] for i in base if segment[i] <= segment[r[0]])
        changed += other != base
    assert changed >= 3


def test_search_and_out_of_fold_scores(spark):
    rows, df = table(spark, 500, 9)
    for symmetric in (False, True):
        options = B.settings(df, "y", symmetric, 4, rounds=(3, 6))
        assert len(set(options)) == 4 and all(o.symmetric == symmetric for o in options)
        setting, ap, threshold, model = B.tuned(df, NAMES, "y", "fold", [0, 1, 2], options, "id")
        assert setting in options and ap > 0.5 and 0 < threshold < 1 and len(model.trees) == setting.rounds
        assert model.importances()[0][1] > 0.2
    assert {k for k in B.own_space(3.0)} == {"depth", "rate", "rounds", "rows", "columns", "least", "ridge", "weight"}
    one = B.search(df, NAMES, "y", {"fold": [0, 1, 2]}, options[:1], "id")
    got = {r.id: r.probability for r in one.scores("y").collect()}
    assert set(got) == {r[0] for r in rows}
    alone = B.fit(df.where("fold <> 1"), NAMES, "y", options[0], "id")
    # the cuts are those of all rows here, of two folds there, and the same for few values
    want = {r.id: r.p for r in df.where("fold = 1").select("id", alone.probability().alias("p")).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-5) for i, p in want.items())
    one.fit.close()


def test_no_rows_of_a_class_and_no_rows(spark):
    _, df = table(spark, 40)
    s = B.Setting(depth=2, rounds=2)
    flat = B.fit(df.withColumn("y", F.lit(0)), NAMES, "y", s, "id")
    assert all(r.p < 0.5 for r in df.select(flat.probability().alias("p")).collect())
    none = B.fit(df.limit(0), NAMES, "y", s, "id")
    assert none.trees == [] or all((t.feature < 0).all() for t in none.trees)
    with pytest.raises(ValueError):
        B.tuned(df.withColumn("y", F.lit(0)), NAMES, "y", "fold", [0, 1, 2], [s], "id")


def test_nested_validation_side_by_side_is_faster(spark):
    """5 outer folds, 3 inner ones and 8 settings at once, with synthetic rows of training records; the other way takes one fit after the other."""
    _, df = table(spark, 400, 11)
    members = df.groupBy("record").agg(F.max("y").alias("y"))
    nested = split.nested_folds(members, "record", "y", 5, 3, 42).cache()
    extra = df.limit(60).select((F.col("id") + 10**9).alias("id"), *NAMES, "y", F.col("record").alias("source_record"), F.lit(None).cast("int").alias("record"))
    options = B.settings(df, "y", False, 8, rounds=(2, 3))
    start = time.time()
    report = B.nested_cv(df, nested, NAMES, "y", options, "record", "id", extra).collect()
    took = time.time() - start
    assert sorted(r.fold for r in report) == [0, 1, 2, 3, 4] and all(r.tp + r.fp + r.fn + r.tn > 0 for r in report)
    assert sum(r.tp + r.fp + r.fn + r.tn for r in report) == 400
    # one of its 125 fits, the other way
    spec = trees.specs()[0]
    start = time.time()
    trees.fit_model(spec, {"maxDepth": 3, "maxIter": 3}, df.na.fill(0.0, ["b"]), NAMES, "y")
    assert took < 125 * (time.time() - start) / 2
