"""Every registered query of the library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pulsegrid.functions import kernels as K
from pulsegrid.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "-"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(norm, r)) for r in df.select(cols).collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


def rows(spark, name):
    return QUERIES[name](spark, DIR).collect()


def arrays_of(spark):
    """Every user's series as the kernels get it, read with DuckDB."""
    got = duckdb.sql(f"SELECT user_id, list(CASE WHEN event_id % 7 <> 0 THEN value END ORDER BY ts, event_id) AS v FROM '{DIR}/events.parquet' GROUP BY user_id").fetchall()
    return {str(k): np.array([np.nan if x is None else x for x in v]) for k, v in got}


def test_signal_features_are_those_of_the_kernel(spark):
    got = {r.record: r for r in rows(spark, "signal_features")}
    series = arrays_of(spark)
    assert set(got) == set(series)
    for k, x in series.items():
        want = K.features(x / 4 + 90, x / 10)
        assert all((math.isnan(w) and got[k][n] is None) or got[k][n] == pytest.approx(w) for n, w in want.items())


def test_window_features_are_those_of_the_kernel(spark):
    got = {(r.record, r.window_start_min): r for r in rows(spark, "window_features")}
    assert len(got) > 10
    series = arrays_of(spark)
    for (k, start), r in got.items():
        at = round(start * 240)
        want = K.features((series[k] / 4 + 90)[at : at + 48], (series[k] / 10)[at : at + 48])
        assert all((math.isnan(w) and r[n] is None) or r[n] == pytest.approx(w) for n, w in want.items())


def vectors():
    return {k: np.array(v, float) for k, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").fetchall()}


def test_entropies_against_pairs(spark):
    for r in rows(spark, "entropies")[:25]:
        x = vectors()[r.vec_id]
        tol, phi, count = 0.2 * x.std(), [], []
        for m in (2, 3):
            n = len(x) - m + 1
            c = [sum(max(abs(x[i : i + m] - x[j : j + m])) <= tol for j in range(n)) for i in range(n)]
            phi.append(np.mean(np.log(np.array(c) / n)))
            count.append(sum(v - 1 for v in c) / 2)
        assert r.apen_sampen[0] == pytest.approx(phi[0] - phi[1])
        assert math.isnan(r.apen_sampen[1]) if not all(count) else r.apen_sampen[1] == pytest.approx(-math.log(count[1] / count[0]))


def test_mean_spectrum_against_plain_sums(spark):
    total = np.zeros(9)
    for x in vectors().values():
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
        parts = []
        for a in range(0, 49, 8):
            d = (x[a : a + 16] - x[a : a + 16].mean()) * w
            f = np.array([abs(sum(d * np.exp(-2j * np.pi * k * np.arange(16) / 16))) ** 2 for k in range(9)]) / (4 * (w * w).sum())
            f[1:-1] *= 2
            parts.append(f)
        total += np.mean(parts, axis=0)
    got = [r.psd for r in sorted(rows(spark, "welch_psd"), key=lambda r: r.bin)]
    assert got == pytest.approx((total / len(vectors())).tolist())


def test_jitter_warp_moves_each_series_a_little(spark):
    series = arrays_of(spark)
    got = rows(spark, "jitter_warp")
    assert len(got) == 3 * len(series) and len({tuple(r.fhr) for r in got}) == len(got)
    for r in got:
        x = series[r.source_record] / 4 + 90
        y = np.array(r.fhr, float)
        assert len(y) == len(x) and np.nanmin(x) - 9 < y.min() and y.max() < np.nanmax(x) + 9
    assert [r.fhr for r in rows(spark, "jitter_warp")] == [r.fhr for r in got]


def test_strategies_are_near_the_originals(spark):
    got = {r.strategy: r for r in rows(spark, "strategy_fidelity")}
    assert set(got) == {"block_bootstrap", "moving_block", "stationary_bootstrap", "jitter_warp"}
    own = np.concatenate([x[~np.isnan(x)] / 4 + 90 for x in arrays_of(spark).values()])
    made = np.array([v for r in rows(spark, "jitter_warp") for v in r.fhr])
    grid = np.sort(np.concatenate([own, made]))
    f, g = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (own, made))
    assert got["jitter_warp"].ks == pytest.approx(abs(f - g).max())
    assert got["jitter_warp"].wasserstein == pytest.approx((abs(f - g)[:-1] * np.diff(grid)).sum())
    assert all(r.ks < 0.3 and r.ks_verdict for r in got.values())


def matrix(spark):
    from pulsegrid.plans.analytic import _matrix

    return [r.asDict() for r in _matrix(spark, DIR).collect()]


def newton(x, y, steps=60):
    z = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (y - p))
    p = 1 / (1 + np.exp(-z @ b))
    return b, z, p, (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_univariate_logit_against_newton(spark):
    m = matrix(spark)
    y = np.array([r["y"] for r in m], float)
    group = np.array([r["c_nationkey"] for r in m])
    for r in rows(spark, "univariate_logit"):
        b, z, p, _ = newton(np.array([v[r.feature] for v in m])[:, None], y)
        bread = np.linalg.inv(z.T @ (z * (p * (1 - p))[:, None]))
        s = np.array([(z * (y - p)[:, None])[group == g].sum(axis=0) for g in np.unique(group)])
        n, g = len(y), len(s)
        cov = bread @ (s.T @ s) @ bread * (g / (g - 1)) * ((n - 1) / (n - 2))
        assert r.coef == pytest.approx(b[1], rel=1e-5) and r.std_err == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-5)
        assert r.odds_ratio == pytest.approx(math.exp(b[1]), rel=1e-5)
        assert r.p_value == pytest.approx(math.erfc(abs(b[1]) / math.sqrt(2 * cov[1, 1])), rel=1e-4)


def test_forward_selection_against_newton(spark):
    m = matrix(spark)
    y, names = np.array([r["y"] for r in m], float), ["bal", "n", "price"]
    bic = lambda fs: -2 * newton(np.array([[v[f] for f in fs] for v in m]).reshape(len(m), len(fs)), y)[3] + (len(fs) + 1) * math.log(len(m))
    chosen, best, path = [], bic([]), []
    while left := [c for c in names if c not in chosen]:
        value, name = min((bic([*chosen, c]), c) for c in left)
        if value >= best - 1e-8:
            break
        chosen, best = [*chosen, name], value
        path.append((len(chosen), name, value))
    got = sorted(map(tuple, rows(spark, "forward_selection")))
    assert [r[:2] for r in got] == [r[:2] for r in path] and [r[2] for r in got] == pytest.approx([r[2] for r in path])


def test_importances_fall_and_add_up(spark):
    got = sorted(rows(spark, "plot_importance"), key=lambda r: r["rank"])
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True) and sum(r.importance for r in got) == pytest.approx(1)
    # the label depends on the balance, the others only fill splits
    assert {r.feature for r in got} == {"bal", "n", "price"} and got[0].feature == "bal"


def test_boosted_report_has_both_kinds(spark):
    """Trees themselves are held against loops over rows in test_boosting."""
    got = {r.model: r for r in rows(spark, "boosted_report")}
    held_out = duckdb.sql(f"SELECT count(*) FROM '{DIR}/customer.parquet'").fetchall()[0][0]
    assert set(got) == {"boosted", "symmetric"}
    for r in got.values():
        assert 0 < r.tp + r.fp + r.fn + r.tn < held_out and 0 < r.cv_average_precision <= 1 and 0 < r.threshold < 1
        assert r.depth in (2, 3, 4, 5) and r.rounds in (2, 4) and r.first_feature in ("bal", "n", "price") and 0 < r.first_share <= 1


def test_every_query_has_a_test():
    text = Path(__file__).read_text() + (Path(__file__).parent / "test_pipelines.py").read_text()
    assert all(f'"{name}"' in text for name in set(QUERIES) - set(ORACLE))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
