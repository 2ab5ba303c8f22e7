"""Queries of series, trend, metric, fidelity, bootstrap, split, model and streaming operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import kernels as K
from ..operators import boosting
from ..operators import bootstrap as B
from ..operators import features as X
from ..operators import fidelity as D
from ..operators import logit as L
from ..operators import metrics as M
from ..operators import series as S
from ..operators import split as P
from ..operators import tables, trees
from ..operators import trends as T
from ..operators.prefix import dealt
from .common import SERIES, arrays, query, series, table

# --- series


@query("clean_range", SERIES + " SELECT user_id, i, CASE WHEN x BETWEEN 20 AND 200 AND x <> 0 THEN x END AS clean FROM s")
def clean_range(spark, sf_dir):
    return series(spark, sf_dir).select("user_id", "i", S.clean_range(F.col("x"), 20, 200).alias("clean"))


_FILL = """, f AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS p, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
 first_value(x IGNORE NULLS) OVER a AS n, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM s
 WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS
   BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interpolate_all", SERIES + _FILL + " SELECT user_id, i, CASE WHEN x IS NOT NULL THEN x WHEN p IS NOT NULL AND n IS NOT NULL THEN p + (n - p) * (i "
    "- pi) / (ni - pi) ELSE coalesce(p, n, 140) END AS filled FROM f")
def interpolate_all(spark, sf_dir):
    return S.interpolate(series(spark, sf_dir).select("user_id", "i", "x"), "x", "user_id", "filled", on_all_missing=140.0).drop("x")


@query("interpolate_short_gaps", SERIES + _FILL + " SELECT user_id, i, CASE WHEN x IS NOT NULL THEN x WHEN p IS NOT NULL AND n IS NOT NULL AND ni - pi - 1 <= 1 "
    "THEN p + (n - p) * (i - pi) / (ni - pi) END AS filled FROM f")
def interpolate_short_gaps(spark, sf_dir):
    return S.interpolate(series(spark, sf_dir).select("user_id", "i", "x"), "x", "user_id", "filled", max_gap=1).drop("x")


_RUNS = ", r AS (SELECT user_id, i, {e} AS hit, {x} AS v FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, hit ORDER BY i) AS isl FROM r)"


@query("gap_runs", SERIES + _RUNS.format(e="x IS NULL", x="x") + " SELECT user_id, min(i) AS start, count(*) AS length FROM g WHERE hit GROUP BY user_id, isl")
def gap_runs(spark, sf_dir):
    return S.gap_runs(series(spark, sf_dir), "x", "user_id")


@query("gap_summary", SERIES + _RUNS.format(e="x IS NULL", x="x") + ", l AS (SELECT user_id, count(*) AS n FROM g WHERE hit GROUP BY user_id, isl) SELECT u.user_id, count(n) AS "
    "n_gaps, count(*) FILTER (n > 1) AS n_long, coalesce(max(n), 0) AS max_gap FROM (SELECT DISTINCT user_id FROM "
    "s) u LEFT JOIN l USING (user_id) GROUP BY u.user_id")
def gap_summary(spark, sf_dir):
    return S.gap_summary(series(spark, sf_dir), "x", "user_id", 1)


@query("sustained_events", SERIES + _RUNS.format(e="value - 250 <= -15", x="value - 250") + " SELECT user_id, min(i) AS start, max(i) + 1 AS \"end\", arg_min(i, (v, i)) AS peak, -min(v) AS amplitude "
    "FROM g WHERE hit GROUP BY user_id, isl HAVING count(*) >= 3")
def sustained_events(spark, sf_dir):
    d = series(spark, sf_dir).withColumn("d", F.col("value") - 250)
    return S.sustained_events(d, "d", "user_id", 15, 3, above=False)


@query("moving_average", SERIES + " SELECT user_id, i, round(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING), 8) AS smooth FROM s")
def moving_average(spark, sf_dir):
    return S.moving(series(spark, sf_dir).select("user_id", "i", "x"), "x", "user_id", "smooth", -20, 19).select("user_id", "i", F.round("smooth", 8).alias("smooth"))


@query("moving_median", SERIES + " SELECT user_id, i, median(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS base FROM s")
def moving_median(spark, sf_dir):
    return S.moving(series(spark, sf_dir).select("user_id", "i", "x"), "x", "user_id", "base", -3, 3, "median").drop("x")


_HELD = SERIES + """, e AS (SELECT user_id, i, value, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER a AS f, last_value(value) OVER a AS l
   FROM s WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 h AS (SELECT user_id, i, greatest(20 - i, 0) AS b, greatest(i + 19 - (n - 1), 0) AS a, f, l, value FROM e)
 SELECT user_id, i, round((sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) + b * f + a * l) /
   40.0::DOUBLE, 8) AS smooth FROM h"""


@query("moving_average_held", _HELD)
def moving_average_held(spark, sf_dir):
    return S.moving(series(spark, sf_dir).select("user_id", "i", "value"), "value", "user_id", "smooth", -20, 19, hold=True).select("user_id", "i", F.round("smooth", 8).alias("smooth"))


@query("sliding_bounds", SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id) SELECT user_id, CAST(unnest(range(0, n - 24 + "
    "1, 6)) AS INT) AS start, CAST(unnest(range(0, n - 24 + 1, 6)) + 24 AS INT) AS \"end\" FROM n WHERE n >= 24")
def sliding_bounds(spark, sf_dir):
    n = series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return S.window_bounds(n, "user_id", "n", 24, 6)


@query("window_quality_filter", SERIES + """, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), b AS (SELECT user_id, unnest(range(0, n - 24 + 1, 6)) AS start FROM n WHERE n >= 24),
 q AS (SELECT b.user_id, b.start, count(*) FILTER (s.x IS NULL) * 100.0::DOUBLE / count(*) AS x_invalid_pct FROM b JOIN s ON s.user_id =
   b.user_id AND s.i >= b.start AND s.i < b.start + 24 GROUP BY 1, 2)
 SELECT user_id, start, x_invalid_pct, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS INT) AS window_id FROM q WHERE
   x_invalid_pct <= 16""")
def window_quality_filter(spark, sf_dir):
    return S.quality_windows(series(spark, sf_dir).select("user_id", "i", "x"), "user_id", 24, 6, ["x"], 16)


@query("first_below", SERIES + " SELECT user_id, min(i) FILTER (x < 50) AS first_below FROM s GROUP BY user_id")
def first_below(spark, sf_dir):
    return S.first_below(series(spark, sf_dir), "x", "i", "user_id", 50)


@query("nearest_event_join", SERIES + """, e AS (SELECT user_id, i FROM s WHERE event_type = 'error'), p AS (SELECT user_id, i AS p FROM s WHERE event_type = 'purchase')
 SELECT e.user_id, e.i, arg_min(p.p, (abs(p.p - e.i), p.p)) AS nearest FROM e LEFT JOIN p ON p.user_id = e.user_id GROUP BY 1, 2""")
def nearest_event_join(spark, sf_dir):
    s = series(spark, sf_dir)
    left, right = s.where("event_type = 'error'").select("user_id", "i"), s.where("event_type = 'purchase'").select("user_id", F.col("i").alias("p"))
    return S.nearest(left, right, "user_id", "i", "p")


@query("deceleration_classes", SERIES + """, e AS (SELECT user_id, i FROM s WHERE event_type = 'error'), p AS (SELECT user_id, i AS p FROM s WHERE event_type = 'purchase'),
 n AS (SELECT e.user_id, e.i, (e.i - arg_min(p.p, (abs(p.p - e.i), p.p))) * 5.0::DOUBLE AS lag FROM e LEFT JOIN p ON p.user_id = e.user_id
   GROUP BY 1, 2)
 SELECT user_id, count(*) FILTER (abs(lag) <= 15) AS early, count(*) FILTER (lag > 15 AND lag <= 90) AS late, count(*) - count(*) FILTER
   (abs(lag) <= 15) - count(*) FILTER (lag > 15 AND lag <= 90) AS variable, avg(lag) AS lag_mean_s, median(lag) AS lag_median_s FROM n
   GROUP BY user_id""")
def deceleration_classes(spark, sf_dir):
    n = nearest_event_join(spark, sf_dir).withColumn("lag", (F.col("i") - F.col("nearest")) * 5.0)
    return S.decelerations(n, "user_id", "lag")


@query("coarse_grain", SERIES + " SELECT user_id, i // 4 AS block, avg(x) AS mean FROM s GROUP BY 1, 2 HAVING count(*) = 4")
def coarse_grain(spark, sf_dir):
    return S.block_stat(series(spark, sf_dir), "x", "user_id", 4)


_LAGS = """, c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS i, x - avg(x) OVER (PARTITION BY user_id) AS c, count(*)
   OVER (PARTITION BY user_id) AS n FROM s{where}),
 k AS (SELECT CAST(unnest(range(0, {lags} + 1)) AS INT) AS lag),
 m AS (SELECT a.user_id, k.lag, avg(a.c * b.c) AS m FROM c a JOIN k ON true JOIN c b ON b.user_id = a.user_id AND b.i = a.i - k.lag GROUP BY 1, 2),
 a AS (SELECT u.user_id, k.lag, u.n, CASE WHEN k.lag >= u.n OR z.m = 0 THEN 0 ELSE m.m / z.m END AS acf
  FROM (SELECT DISTINCT user_id, n FROM c) u JOIN k ON true LEFT JOIN m ON m.user_id = u.user_id AND m.lag = k.lag LEFT JOIN m z ON
   z.user_id = u.user_id AND z.lag = 0)"""


@query("acf", SERIES + _LAGS.format(where="", lags=8) + " SELECT user_id, lag, acf FROM a")
def acf(spark, sf_dir):
    return S.autocorrelation(series(spark, sf_dir), "x", "user_id", 8)


@query("mean_acf", SERIES + _LAGS.format(where=" WHERE x IS NOT NULL", lags=8) + " SELECT lag, avg(acf) AS acf FROM a WHERE n > 8 GROUP BY lag")
def mean_acf(spark, sf_dir):
    return D.mean_curve(S.autocorrelation(series(spark, sf_dir), "x", "user_id", 8, drop_missing=True, long_enough=True), "lag", "acf")


@query("acf_long", """WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events),
 c AS (SELECT event_type, i, x - avg(x) OVER (PARTITION BY event_type) AS c, count(*) OVER (PARTITION BY event_type) AS n FROM s),
 m AS (SELECT a.event_type, a.i - b.i AS lag, avg(a.c * b.c) AS m FROM c a JOIN c b ON b.event_type = a.event_type AND b.i <= a.i AND b.i >= a.i - 1200 GROUP BY 1, 2)
 SELECT u.event_type, k.lag, CASE WHEN k.lag >= u.n OR z.m = 0 THEN 0 ELSE m.m / z.m END AS acf FROM (SELECT DISTINCT event_type, n FROM c) u JOIN (SELECT CAST(unnest(range(0,
   1201)) AS INT) AS lag) k ON true LEFT JOIN m ON m.event_type = u.event_type AND m.lag = k.lag LEFT JOIN m z ON z.event_type = u.event_type AND z.lag = 0""")
def acf_long(spark, sf_dir):
    """Five minutes of lags of long series: all events of a type in a row."""
    e = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return S.long_autocorrelation(e, "x", "event_type", 1200, at="event_id")


_BLOCK = """, b AS (SELECT user_id, min(lag) AS lag FROM a WHERE lag > 0 AND abs(acf) < 0.05 GROUP BY user_id)
 SELECT a.user_id, CAST(CASE WHEN any_value(a.n) < 8 THEN 4 ELSE coalesce(greatest(least(2 * any_value(b.lag), 20), 4), 20) END AS INT) AS
   block FROM a LEFT JOIN b USING (user_id) GROUP BY a.user_id"""


@query("optimal_block", SERIES + _LAGS.format(where=" WHERE x IS NOT NULL", lags=20) + _BLOCK)
def optimal_block(spark, sf_dir):
    """Block lengths by the kernel, which the SQL's sums over lags are held against."""
    a = arrays(spark, sf_dir).where(F.exists("fhr", lambda v: v.isNotNull())).select(F.col("record").cast("bigint").alias("user_id"), "fhr")
    return B.optimal_block(a, "fhr", "user_id", threshold=0.05, low=4, high=20)


@query("optimal_block_by_lags", SERIES + _LAGS.format(where=" WHERE x IS NOT NULL", lags=20) + _BLOCK)
def optimal_block_by_lags(spark, sf_dir):
    return S.first_small_lag(series(spark, sf_dir), "x", "user_id", 0.05, 4, 20)


# --- trends and alerts


@query("lag2_delta", SERIES + " SELECT user_id, i, coalesce(x - lag(x, 2) OVER (PARTITION BY user_id ORDER BY i), 0) AS delta FROM s")
def lag2_delta(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    return series(spark, sf_dir).select("user_id", "i", F.coalesce(T.lag_delta("x", w), F.lit(0.0)).alias("delta"))


@query("falling_streak", SERIES + """, d AS (SELECT user_id, i, CASE WHEN x < lag(x) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS d FROM s),
 g AS (SELECT *, sum(1 - d) OVER (PARTITION BY user_id ORDER BY i) AS g FROM d) SELECT user_id, i, CAST(sum(d) OVER (PARTITION BY user_id,
   g ORDER BY i) AS BIGINT) AS streak FROM g""")
def falling_streak(spark, sf_dir):
    return T.falling_streak(series(spark, sf_dir).select("user_id", "i", "x"), "x", ["user_id"], "i", "streak").drop("x")


#: Sums over the last six rows in their order, of those with a value: what is added is written with y and d, the value and its time less that of the last row.
_SIX = lambda term: " + ".join(["0.0::DOUBLE", *["CASE WHEN {y} IS NOT NULL THEN {t} ELSE 0 END".format(y=f"x{k}", t=term.format(y=f"x{k}", d=f"(t{k} - t)")) for k in range(5, -1, -1)]])


@query("rolling_slope", SERIES + """, t AS (SELECT user_id, (i + i // 20) * 5.0::DOUBLE AS t, x FROM s), l AS (SELECT *, CASE WHEN abs(t - lag(t) OVER (PARTITION BY user_id
   ORDER BY t) - 5) < 1e-4 THEN 1 ELSE 0 END AS ok FROM t),
 h AS (SELECT user_id, t, sum(ok) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND count(*) OVER
   w = 6 AND count(x) OVER w >= 2 AS use, """ + ", ".join(f"lag(x, {k}) OVER v AS x{k}, lag(t, {k}) OVER v AS t{k}" for k in range(6)) + """ FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS
   BETWEEN 5 PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY t)),
 q AS (SELECT *, """ + _SIX("1") + " AS n, " + _SIX("{d}") + " AS st, " + _SIX("{d} * {d}") + """ AS stt FROM h)
 SELECT user_id, t, CASE WHEN use THEN (""" + _SIX("(n * {d} - st) * {y}") + """) / (n * stt - st * st) END AS slope FROM q""")
def rolling_slope(spark, sf_dir):
    s = series(spark, sf_dir).select("user_id", ((F.col("i") + F.floor(F.col("i") / 20)) * 5.0).alias("t"), "x")
    return T.rolling_slope(s, "x", "t", ["user_id"], "slope").drop("x")


@query("persistent_suffix", SERIES + ", q AS (SELECT *, sum(CASE WHEN value >= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i DESC) AS "
    "quiet FROM s) SELECT user_id, min(i) FILTER (quiet = 0) AS persistent_start FROM q GROUP BY user_id")
def persistent_suffix(spark, sf_dir):
    return T.persistent_start(series(spark, sf_dir).withColumn("alert", F.col("value") >= 60), "alert", "user_id", "i")


_ROLL = SERIES + """, q AS (SELECT user_id, i, value >= 60 AS alert, CAST(user_id % 3 = 0 AS INT) AS target, 100.0::DOUBLE - i AS birth, sum(CASE WHEN value >=
   60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i DESC) AS quiet FROM s),
 p AS (SELECT user_id, max(target) AS target, max(CAST(alert AS INT)) AS any_alert, min(i) FILTER (quiet = 0) AS persistent_start, CASE
   WHEN max(target) = 1 THEN max(birth) FILTER (quiet = 0) END AS ewt FROM q GROUP BY user_id)"""


def _patients(spark, sf_dir):
    s = series(spark, sf_dir).select("user_id", "i", (F.col("value") >= 60).alias("alert"), (F.col("user_id") % 3 == 0).cast("int").alias("target"), (F.lit(100.0) - F.col("i")).alias("birth"))
    return T.patient_rollup(s, "user_id", "i", "alert", "target", "birth")


@query("patient_rollup", _ROLL + " SELECT * FROM p")
def patient_rollup(spark, sf_dir):
    return _patients(spark, sf_dir)


@query("live_rollup", _ROLL + """ SELECT CASE WHEN count(*) FILTER (target = 1 AND any_alert = 1) > 0 THEN sum(any_alert) / CAST(count(*) FILTER (target = 1 AND any_alert =
   1) AS DOUBLE) ELSE 'Infinity'::DOUBLE END AS nna,
 CAST(count(*) FILTER (target = 1 AND any_alert = 1) AS DOUBLE) / sum(target) AS recall, CAST(count(*) FILTER (target = 1 AND
   persistent_start IS NOT NULL) AS DOUBLE) / sum(target) AS persistent_recall, median(ewt) AS ewt_median, avg(ewt) AS ewt_mean FROM p""")
def live_rollup(spark, sf_dir):
    return T.live_metrics(_patients(spark, sf_dir))


_PROFILE = SERIES + """, q AS (SELECT user_id AS record, i, value, CAST(user_id % 3 = 0 AS INT) AS target, 100.0::DOUBLE - i AS birth, value >= 60 AS alert,
   sum(CASE WHEN value >= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i DESC) AS quiet FROM s),
 p AS (SELECT record, max(target) AS target, count(*) FILTER (alert) AS alerts, max(value) AS peak, min(i) FILTER (quiet = 0) AS last_at,
   min(i) FILTER (alert) AS first_at, arg_min(i, (-value, i)) AS peak_at FROM q GROUP BY record)"""


def _profiles(spark, sf_dir):
    s = series(spark, sf_dir).select(F.col("user_id").alias("record"), "i", "value", (F.col("value") >= 60).alias("alert"), (F.col("user_id") % 3 == 0).cast("int").alias("target"), (F.lit(100.0) - F.col("i")).alias("birth"))
    return tables.alert_profiles(s, "record", "i", "alert", "target", "value", "birth")


@query("exemplars", _PROFILE + """, c AS (SELECT record, peak, CASE WHEN last_at > 0 THEN 0 WHEN last_at = 0 OR first_at > 0 THEN 1 ELSE 2 END AS tier,
  CASE WHEN last_at IS NOT NULL THEN last_at WHEN first_at > 0 THEN first_at ELSE peak_at END AS pos FROM p WHERE target = 1)
 SELECT record, pos AS alert_at, 100.0::DOUBLE - pos AS early_warning_min FROM c ORDER BY tier, CASE WHEN tier = 0 THEN abs(100 - pos - 50)
   END, CASE WHEN tier = 2 THEN -peak END, record LIMIT 1""")
def exemplars(spark, sf_dir):
    return tables.exemplar_positive(_profiles(spark, sf_dir))


@query("exemplar_negative", _PROFILE + " SELECT record, alerts, CASE WHEN alerts > 0 THEN first_at END AS first_at FROM p WHERE target = 0 ORDER BY "
    "alerts, CASE WHEN alerts = 0 THEN -peak END, record LIMIT 1")
def exemplar_negative(spark, sf_dir):
    return tables.exemplar_negative(_profiles(spark, sf_dir))


# --- metrics: score is a document's scaled length, label its toxicity

_SCORED = "WITH d AS (SELECT l.doc_id, l.toxic AS y, round_even(n_chars / 500.0::DOUBLE, 0) / 100 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_CURVE = _SCORED + """, g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM d GROUP BY s),
 c AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM g)"""


def _scored(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("toxic").alias("y"), (F.bround(F.col("n_chars") / 500.0, 0) / 100).alias("s"))


@query("auroc", _SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM d) "
    "SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auroc FROM r")
def auroc(spark, sf_dir):
    return M.auroc(_scored(spark, sf_dir), "s", "y")


@query("avg_precision", _CURVE + " SELECT sum(p * tp / CAST(tp + fp AS DOUBLE)) / max(pp) AS average_precision FROM c")
def avg_precision(spark, sf_dir):
    return M.average_precision(_scored(spark, sf_dir), "s", "y")


@query("brier", _SCORED + " SELECT avg((s - y) * (s - y)) AS brier FROM d")
def brier(spark, sf_dir):
    return M.brier(_scored(spark, sf_dir), "s", "y")


@query("confusion", _SCORED + """, k AS (SELECT count(*) FILTER (s >= 0.03 AND y = 1) AS tp, count(*) FILTER (s >= 0.03 AND y = 0) AS fp, count(*) FILTER (s < 0.03 AND y =
   1) AS fn, count(*) FILTER (s < 0.03 AND y = 0) AS tn FROM d)
 SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, coalesce(CAST(tp
   AS DOUBLE) / nullif(tp + fp, 0), 0) AS ppv,
 coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp +
   fn, 0), 0) AS f1, CASE WHEN tp > 0 THEN CAST(tp + fp AS DOUBLE) / tp ELSE 'Infinity'::DOUBLE END AS nna FROM k""")
def confusion(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir), F.col("s") >= 0.03, "y")


@query("youden", _CURVE + " SELECT s AS threshold FROM c ORDER BY CAST(tp AS DOUBLE) / pp - CAST(fp AS DOUBLE) / nn DESC, s DESC LIMIT 1")
def youden(spark, sf_dir):
    return M.youden_threshold(_scored(spark, sf_dir), "s", "y")


@query("recall_threshold", _CURVE + " SELECT coalesce(max(s) FILTER (CAST(tp AS DOUBLE) / pp >= 0.75), min(s)) AS threshold FROM c")
def recall_threshold(spark, sf_dir):
    return M.recall_threshold(_scored(spark, sf_dir), "s", "y", 0.75)


@query("class_weight", "SELECT CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN CAST(count(*) FILTER (toxic = 0) AS DOUBLE) / count(*) FILTER (toxic = 1) ELSE 1.0 END AS scale_pos_weight FROM labels")
def class_weight(spark, sf_dir):
    return M.class_weight(table(spark, sf_dir, "labels"), "toxic")


# --- distances of distributions

_BOTH = """WITH g AS (SELECT value AS v, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1),
 c AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) AS f, sum(b) OVER (ORDER BY v)
   / CAST(sum(b) OVER () AS DOUBLE) AS g, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM g)"""
_TAIL = " + ".join(f"({2 * (-1) ** (k - 1)}) * exp(-{2 * k * k} * z * z)" for k in range(1, 40))


@query("ks_statistic", _BOTH + f", k AS (SELECT max(abs(f - g)) AS ks, max(n1) AS n1, max(n2) AS n2 FROM c), z AS (SELECT ks, ks * sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE)) AS z FROM k) SELECT ks, CASE WHEN z < 0.2 THEN 1.0 ELSE greatest(least({_TAIL}, 1.0), 0.0) END AS p_value FROM z")
def ks_statistic(spark, sf_dir):
    return D.ks(table(spark, sf_dir, "events"), "value", F.col("event_type") == "click")


@query("wasserstein1", _BOTH + " SELECT sum(abs(f - g) * (nx - v)) AS wasserstein FROM c WHERE nx IS NOT NULL")
def wasserstein1(spark, sf_dir):
    return D.wasserstein(table(spark, sf_dir, "events"), "value", F.col("event_type") == "click")


@query("fidelity_verdicts", "SELECT l_shipmode, ks, wasserstein, acf_r, psd_r, CASE WHEN ks < 0.05 THEN 'good' WHEN ks < 0.1 THEN 'fair' "
    "ELSE 'poor' END AS ks_verdict, CASE WHEN wasserstein < 1 THEN 'good' WHEN wasserstein < 3 THEN 'fair' ELSE "
    "'poor' END AS wasserstein_verdict, CASE WHEN acf_r > 0.98 THEN 'good' WHEN acf_r > 0.9 THEN 'fair' ELSE "
    "'poor' END AS acf_r_verdict, CASE WHEN psd_r > 0.95 THEN 'good' WHEN psd_r > 0.85 THEN 'fair' ELSE 'poor' END "
    "AS psd_r_verdict FROM (SELECT l_returnflag AS l_shipmode, l_discount AS ks, l_quantity / 10 AS wasserstein, 1 "
    "- l_tax AS acf_r, 1 - l_discount AS psd_r FROM lineitem)")
def fidelity_verdicts(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), F.col("l_discount").alias("ks"), (F.col("l_quantity") / 10).alias("wasserstein"), (1 - F.col("l_tax")).alias("acf_r"), (1 - F.col("l_discount")).alias("psd_r"))
    return D.summary(m)


# --- bootstrap

_H = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("stationary_index", SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT user_id, n, unnest(range(0, n)) AS i "
    "FROM n), d AS (SELECT *, i = 0 OR " + _H.format("'jump|42|' || user_id || '|0|' || i") + " < 1 / 8.0::DOUBLE AS jump, CAST(floor(" + _H.format("'start|42|' || user_id || '|0|' || i") + " * n) AS BIGINT) AS st FROM p), b AS (SELECT *, max(CASE WHEN jump THEN i END) OVER (PARTITION BY user_id "
    "ORDER BY i) AS at FROM d) SELECT x.user_id, x.i, CAST((y.st + x.i - x.at) % x.n AS INT) AS source_i FROM b x "
    "JOIN d y ON y.user_id = x.user_id AND y.i = x.at")
def stationary_index(spark, sf_dir):
    n = series(spark, sf_dir).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    ix = B.stationary_index(F.col("n"), F.lit(8.0), F.lit(42), F.col("user_id"), F.lit(0))
    return n.select("user_id", F.posexplode(ix).alias("i", "source_i")).select("user_id", F.col("i").cast("bigint").alias("i"), "source_i")


def _block_sql(over: bool) -> str:
    choices, unit = ("greatest(n - 8, 1)", "1") if over else ("greatest(CAST(ceil((n - 8) / 8.0::DOUBLE) AS BIGINT), 1)", "8")
    return SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT user_id, n, unnest(range(0, n)) AS i FROM n) SELECT user_id, i, CAST(CASE WHEN n <= 8 THEN i % n ELSE (CAST(floor(" + _H.format("'block|42|' || user_id || '|0|' || (i // 8)") + f" * {choices}) AS BIGINT) * {unit} + i % 8) % n END AS INT) AS source_i FROM p"


def _block(over: bool):
    def run(spark, sf_dir):
        n = series(spark, sf_dir).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
        ix = B.block_index(F.col("n"), F.col("n"), F.lit(8), F.lit(42), F.col("user_id"), F.lit(0), over)
        return n.select("user_id", F.posexplode(ix).alias("i", "source_i")).select("user_id", F.col("i").cast("bigint").alias("i"), F.col("source_i").cast("int").alias("source_i"))

    return run


query("moving_block_index", _block_sql(True))(_block(True))
query("block_index", _block_sql(False))(_block(False))


@query("block_gather", SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1) SELECT s.user_id, s.i, t.x / 4 + 90 AS x FROM s JOIN "
    "n USING (user_id) JOIN s t ON t.user_id = s.user_id AND t.i = (s.i * 7 + 3) % n.n")
def block_gather(spark, sf_dir):
    a = arrays(spark, sf_dir)
    ix = F.transform(F.sequence(F.lit(0), F.size("fhr") - 1), lambda i: (i * 7 + 3) % F.size("fhr"))
    return a.select(F.col("record").cast("bigint").alias("user_id"), F.posexplode(B.gather(F.col("fhr"), ix)).alias("i", "x")).select("user_id", F.col("i").cast("bigint").alias("i"), "x")


def _replicas(spark, sf_dir, strategy):
    a = arrays(spark, sf_dir).withColumn("block", F.lit(8))
    return B.replicates(a, 3, strategy)


@query("bootstrap_replicates", SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT user_id, n, r, unnest(range(0, n)) AS "
    "i FROM n, (SELECT unnest(range(0, 3)) AS r)), d AS (SELECT *, i = 0 OR " + _H.format("'jump|42|' || user_id || '|' || r || '|' || i") + " < 1 / 8.0::DOUBLE AS jump, CAST(floor(" + _H.format("'start|42|' || user_id || '|' || r || '|' || i") + """ * n) AS BIGINT) AS st FROM p), b AS (SELECT *, max(CASE WHEN jump THEN i END) OVER (PARTITION BY user_id, r ORDER BY i) AS at FROM d),
 g AS (SELECT x.user_id, x.r, x.i, (y.st + x.i - x.at) % x.n AS src FROM b x JOIN d y ON y.user_id = x.user_id AND y.r = x.r AND y.i = x.at)
 SELECT g.user_id || '_boot_' || g.r AS record, CAST(g.user_id AS VARCHAR) AS source_record, CAST(g.r AS INT) AS bootstrap_idx, true AS
   is_synthetic, CAST(g.i AS INT) AS i, s.x / 4 + 90 AS fhr, s.x / 10 AS uc FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.src""")
def bootstrap_replicates(spark, sf_dir):
    r = _replicas(spark, sf_dir, "stationary_bootstrap")
    return r.select("record", "source_record", "bootstrap_idx", "is_synthetic", F.posexplode(F.arrays_zip("fhr", "uc")).alias("i", "v")).select("record", "source_record", "bootstrap_idx", "is_synthetic", "i", "v.fhr", "v.uc")


@query("jitter_warp")
def jitter_warp(spark, sf_dir):
    return _replicas(spark, sf_dir, "jitter_warp").select("record", "source_record", "bootstrap_idx", "fhr")


_MOVED = SERIES + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT user_id, n, r, unnest(range(0, n)) AS i FROM n, (SELECT unnest(range(0, 3)) AS r)), g AS (SELECT user_id, r, CASE WHEN n <= 8 THEN i % n ELSE (CAST(floor(" + _H.format("'block|42|' || user_id || '|' || r || '|' || (i // 8)") + """ * greatest(n - 8, 1)) AS BIGINT) + i % 8) % n END AS src FROM p),
 m AS (SELECT g.user_id, g.r, avg(s.x / 4 + 90) AS mean FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.src GROUP BY 1, 2)"""


@query("replica_convergence", _MOVED + """, d AS (SELECT r, sqrt(greatest(sum(q) OVER w / sum(n) OVER w - (sum(t) OVER w / sum(n) OVER w) ^ 2, 0)) AS sd FROM (SELECT r, count(mean)
   AS n, sum(mean) AS t, sum(mean * mean) AS q FROM m GROUP BY r) WINDOW w AS (ORDER BY r)),
 c AS (SELECT r, abs(sd - lag(sd) OVER (ORDER BY r)) AS change FROM d) SELECT CAST(coalesce(min(r + 1) FILTER (change < 0.5), 3) AS INT) AS
   multiplier FROM c""")
def replica_convergence(spark, sf_dir):
    r = _replicas(spark, sf_dir, "moving_block")
    good = F.filter("fhr", lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(good, F.lit(0.0), lambda a, v: a + v), F.size(good))
    return B.converged_multiplier(r.select("bootstrap_idx", mean.alias("mean")).where("mean IS NOT NULL"), 0.5, 3)


@query("replica_rounds", _MOVED + """, d AS (SELECT r + 1 AS round, sum(n) OVER w AS n, sum(t) OVER w / sum(n) OVER w AS mean, sqrt(greatest(sum(q) OVER w / sum(n) OVER w - (sum(t) OVER w
   / sum(n) OVER w) ^ 2, 0)) AS std FROM (SELECT r, count(mean) AS n, sum(mean) AS t, sum(mean * mean) AS q FROM m GROUP BY r) WINDOW w AS (ORDER BY r)),
 c AS (SELECT *, abs(std - lag(std) OVER (ORDER BY round)) AS change FROM d) SELECT CAST(round AS INT) AS round, CAST(n AS BIGINT) AS n, mean, std, coalesce(change < 0.5, false) AS stop FROM c WHERE
   round <= (SELECT coalesce(min(round) FILTER (change < 0.5), 3) FROM c)""")
def replica_rounds(spark, sf_dir):
    """A row per round that was made: none after the one at which the means' deviation holds still."""
    done = B.rounds(arrays(spark, sf_dir).withColumn("block", F.lit(8)), "moving_block", tolerance=0.5, cap=3)
    return spark.createDataFrame([(r.m, r.n, r.mean, r.std, r.stop) for r in done], "round int, n bigint, mean double, std double, stop boolean")


@query("strategy_fidelity")
def strategy_fidelity(spark, sf_dir):
    """KS and Wasserstein of each strategy's replicates against the originals, with verdicts: series are gathered once, each replicate is made once, and its values' counts are kept."""
    names = [*B.STRATEGIES, "jitter_warp"]
    own = arrays(spark, sf_dir).persist()
    made = [B.replicates(own.withColumn("block", F.lit(8)), 3, name).select(F.lit(name).alias("strategy"), F.explode("fhr").alias("v")) for name in names]
    counts = D.value_counts(tables.union_all([own.select(F.lit(None).cast("string").alias("strategy"), F.explode("fhr").alias("v")), *made]), "v").persist()
    near = D.summary(D.distances_of(counts, names))
    report = near.select("ks", "wasserstein", "strategy", *[c for c in near.columns if c.endswith("_verdict")])
    found = report.collect()  # a row per strategy
    for held in (counts, own):
        held.unpersist()
    return spark.createDataFrame(found, report.schema)


def _comparison_sql() -> str:
    """Records of 512 events, a replicate of each by every strategy of blocks, and all measures of the report by plain sums."""
    jump, start, block = (_H.format(f"'{what}|42|' || rec || '|0|' || {i}") for what, i in (("jump", "i"), ("start", "i"), ("block", "(i // 32)")))
    return f"""WITH e AS (SELECT event_id // 512 AS rec, event_id % 512 AS i, value / 4 + 90 AS x, CAST(user_id % 40 AS DOUBLE) AS y FROM events QUALIFY count(*) OVER (PARTITION BY event_id // 512) = 512),
 d AS (SELECT rec, i, i = 0 OR {jump} < 1 / 32.0::DOUBLE AS jump, CAST(floor({start} * 512) AS BIGINT) AS st FROM e),
 b AS (SELECT *, max(CASE WHEN jump THEN i END) OVER (PARTITION BY rec ORDER BY i) AS pos FROM d),
 ix AS (SELECT 'block_bootstrap' AS strategy, rec, i, (CAST(floor({block} * 15) AS BIGINT) * 32 + i % 32) % 512 AS src FROM e
   UNION ALL SELECT 'moving_block', rec, i, (CAST(floor({block} * 480) AS BIGINT) + i % 32) % 512 FROM e
   UNION ALL SELECT 'stationary_bootstrap', p.rec, p.i, (q.st + p.i - p.pos) % 512 FROM b p JOIN d q ON q.rec = p.rec AND q.i = p.pos),
 s AS (SELECT 'original' AS strategy, rec, i, x, y FROM e UNION ALL SELECT strategy, ix.rec, ix.i, x, y FROM ix JOIN e ON e.rec = ix.rec AND e.i = ix.src),
 k AS (SELECT DISTINCT strategy FROM ix),
 g AS (SELECT k.strategy, x AS v, count(*) FILTER (s.strategy = 'original') AS a, count(*) FILTER (s.strategy <> 'original') AS b FROM s JOIN k ON s.strategy IN ('original', k.strategy) GROUP BY 1, 2),
 f AS (SELECT strategy, v, lead(v) OVER w AS nx, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY strategy) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY strategy) AS DOUBLE)) AS gap FROM g WINDOW w AS (PARTITION BY strategy ORDER BY v)),
 near AS (SELECT strategy, max(gap) AS ks, sum(gap * (nx - v)) FILTER (nx IS NOT NULL) AS wasserstein FROM f GROUP BY 1),
 c AS (SELECT strategy, rec, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, stddev_pop(x) OVER w AS dx, stddev_pop(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY strategy, rec)),
 acf AS (SELECT p.strategy, p.rec, p.i - q.i AS pos, avg(p.x * q.x) / any_value(p.dx * p.dx) AS value FROM c p JOIN c q ON q.strategy = p.strategy AND q.rec = p.rec AND p.i - q.i BETWEEN 0 AND 20 GROUP BY 1, 2, 3),
 xcorr AS (SELECT p.strategy, p.rec, p.i - q.i + 20 AS pos, sum(p.x * q.y) / (512 * any_value(p.dx * p.dy)) AS value FROM c p JOIN c q ON q.strategy = p.strategy AND q.rec = p.rec AND p.i - q.i BETWEEN -20 AND 20 WHERE p.dx * p.dy > 0 GROUP BY 1, 2, 3),
 w AS (SELECT strategy, rec, h, i - h AS t, (x - avg(x) OVER (PARTITION BY strategy, rec, h)) * (0.5 - 0.5 * cos(pi() * (i - h) / 64)) AS x FROM s JOIN (SELECT unnest(range(0, 385, 64)) AS h) ON i BETWEEN h AND h + 127),
 z AS (SELECT strategy, rec, h, pos, sum(x * cos(pi() * pos * t / 64)) AS re, sum(x * sin(pi() * pos * t / 64)) AS im FROM w, (SELECT unnest(range(0, 65)) AS pos) GROUP BY 1, 2, 3, 4),
 m AS (SELECT strategy, 'acf' AS curve, pos, avg(value) AS value FROM acf GROUP BY 1, 3 UNION ALL SELECT strategy, 'xcorr', pos, avg(value) FROM xcorr GROUP BY 1, 3
   UNION ALL SELECT strategy, 'psd', pos, ln(1 + avg((re * re + im * im) / 192 * CASE WHEN pos IN (0, 64) THEN 1 ELSE 2 END)) FROM z GROUP BY 1, 3),
 r AS (SELECT m.strategy, m.curve, corr(o.value, m.value) AS r FROM m JOIN m o ON o.strategy = 'original' AND o.curve = m.curve AND o.pos = m.pos WHERE m.strategy <> 'original' GROUP BY 1, 2),
 a AS (SELECT near.*, max(r) FILTER (curve = 'acf') AS acf_r, max(r) FILTER (curve = 'psd') AS psd_r, max(r) FILTER (curve = 'xcorr') AS xcorr_r FROM near JOIN r USING (strategy) GROUP BY ALL)
 SELECT *, CASE WHEN ks < 0.05 THEN 'good' WHEN ks < 0.1 THEN 'fair' ELSE 'poor' END AS ks_verdict, CASE WHEN wasserstein < 1 THEN 'good' WHEN wasserstein < 3 THEN 'fair' ELSE 'poor' END AS wasserstein_verdict,
   CASE WHEN acf_r > 0.98 THEN 'good' WHEN acf_r > 0.9 THEN 'fair' ELSE 'poor' END AS acf_r_verdict, CASE WHEN psd_r > 0.95 THEN 'good' WHEN psd_r > 0.85 THEN 'fair' ELSE 'poor' END AS psd_r_verdict,
   CASE WHEN xcorr_r > 0.9 THEN 'good' ELSE 'poor' END AS xcorr_r_verdict FROM a"""


@query("strategy_comparison", _comparison_sql())
def strategy_comparison(spark, sf_dir):
    """The whole report, with all curves, of a replicate of each whole record of 512 events by every strategy of blocks."""
    from . import pipelines

    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 512).cast("bigint").cast("string").alias("record"), "event_id", (F.col("value") / 4 + 90).alias("x"), (F.col("user_id") % 40).cast("double").alias("y"))
    v = e.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("event_id", "x", "y"))).alias("v")).where(F.size("v") == 512)
    whole = v.select("record", F.transform("v", lambda p: p["x"]).alias("fhr"), F.transform("v", lambda p: p["y"]).alias("uc"), F.lit(32).alias("block"))
    return pipelines.fidelity_report(whole, {name: B.replicates(whole, 1, name) for name in B.STRATEGIES}, 20)


# --- splits and preparation


def _h(seed: str, key: str) -> str:
    return _H.format(f"'{seed}|' || {key}")


_QUOTA = """WITH q AS (SELECT *, n * tr // total AS part, n * tr % total AS rest FROM (SELECT c_mktsegment, count(*) AS n, sum(count(*)) OVER () AS
   total, sum(count(*)) OVER () - CAST(ceil(0.3::DOUBLE * sum(count(*)) OVER ()) AS BIGINT) AS tr FROM customer GROUP BY 1)),
 z AS (SELECT c_mktsegment, part + CASE WHEN row_number() OVER (ORDER BY rest DESC, c_mktsegment) <= tr - sum(part) OVER () THEN 1 ELSE 0
   END AS quota FROM q), """


@query("strat_split", _QUOTA + "h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY " + _h("42", "c_custkey") + ", c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, "
    "h.c_mktsegment, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS split FROM h JOIN z USING (c_mktsegment)")
def strat_split(spark, sf_dir):
    return P.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query("group_folds", "SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY " + _h("42", "c_custkey") + ", c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def group_folds(spark, sf_dir):
    return P.group_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5)


@query("nested_folds", "WITH o AS (SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY " + _h("42", "c_custkey") + ", c_custkey) - 1) % 3 AS INT) AS o FROM customer), t AS (SELECT *, CAST(unnest(range(0, 3)) AS INT) AS "
    "test_of FROM o) SELECT c_custkey, c_mktsegment, o AS \"outer\", test_of, CAST((row_number() OVER (PARTITION "
    "BY test_of, c_mktsegment ORDER BY " + _h("42", "test_of || '|' || c_custkey") + ", c_custkey) - 1) % 2 AS INT) AS inner FROM t WHERE o <> test_of".replace("AS inner", 'AS "inner"'))
def nested_folds(spark, sf_dir):
    return P.nested_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 3, 2)


@query("median_impute_standardize", "WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS x FROM customer), m AS "
    "(SELECT median(x) AS m FROM g), f AS (SELECT c_custkey, coalesce(x, m) AS x FROM g, m), z AS (SELECT avg(x) "
    "AS mu, stddev_pop(x) AS sd FROM f) SELECT c_custkey, (x - mu) / sd AS x FROM f, z")
def median_impute_standardize(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("x"))
    return P.standardize(g, P.fit_scaler(g, ["x"]), ["x"])


def _matrix(spark, sf_dir, fill=150000.0):
    """Customers with three predictors and a label from their orders; `fill` is the price of those without."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))
    j = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    y = (C.hash_unit(F.lit("y"), F.col("c_custkey")) < 0.25 + F.when(F.col("c_acctbal") > 5000, 0.4).otherwise(0.0)).cast("int")
    return j.select("c_custkey", (F.col("c_acctbal") / 1000).alias("bal"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("n"), (F.coalesce(F.col("price"), F.lit(fill).cast("double")) / 100000).alias("price"), "c_nationkey", y.alias("y"))


_MATRIX = "WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY 1), m AS (SELECT c_custkey, c_acctbal / 1000 AS bal, CAST(coalesce(n, 0) AS DOUBLE) AS n, price / 100000 AS price, CAST(" + _h("y", "c_custkey") + " < 0.25 + CASE WHEN c_acctbal > 5000 THEN 0.4 ELSE 0.0 END AS INT) AS y FROM customer LEFT JOIN o USING (c_custkey))"
_RANKED = """, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY """ + _h("42", "c_custkey") + """, c_custkey) - 1) % 5 AS INT) AS fold FROM m),
 l AS (SELECT c_custkey, fold, y, feature, x FROM (SELECT c_custkey, fold, y, 'bal' AS feature, bal AS x FROM f UNION ALL SELECT c_custkey,
   fold, y, 'n', n FROM f UNION ALL SELECT c_custkey, fold, y, 'price', price FROM f)),
 k AS (SELECT CAST(unnest(range(0, 5)) AS INT) AS k),
 med AS (SELECT feature, k, median(x) AS m FROM l JOIN k ON fold <> k GROUP BY 1, 2),
 sgn AS (SELECT feature, k, any_value(m) AS m, CASE WHEN avg(coalesce(x, m)) FILTER (y = 1) < avg(coalesce(x, m)) FILTER (y = 0) THEN -1
   ELSE 1 END AS way FROM l JOIN med USING (feature) WHERE fold <> k GROUP BY 1, 2),
 t AS (SELECT feature, fold, y, coalesce(x, m) * way AS s FROM l JOIN sgn USING (feature) WHERE fold = k),
 r AS (SELECT feature, fold, y, rank() OVER (PARTITION BY feature, fold ORDER BY s) + (count(*) OVER (PARTITION BY feature, fold, s) - 1) /
   2.0::DOUBLE AS r FROM t),
 a AS (SELECT feature, fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY 1, 2)
 SELECT feature, avg(auc) AS auroc_cv, count(auc) AS folds FROM a GROUP BY feature"""


@query("cv_auroc", _MATRIX + _RANKED)
def cv_auroc(spark, sf_dir):
    m = P.group_folds(_matrix(spark, sf_dir, fill=None), "c_custkey", "y", 5).cache()  # read several times
    return M.cv_auroc(m, ["bal", "n", "price"], "y", "fold")


_LONG = """, l AS (SELECT feature, c_nationkey AS g, x, y FROM (SELECT c_custkey, 'bal' AS feature, bal AS x, y FROM m UNION ALL SELECT c_custkey, 'n', n, y
   FROM m UNION ALL SELECT c_custkey, 'price', coalesce(price, 1.5), y FROM m) JOIN customer USING (c_custkey)),"""
#: Newton steps of an intercept and a slope; u is a row's share in the slope's sandwich covariance.
_SLOPES = """
 t(step, feature, a, b) AS (SELECT DISTINCT 0, feature, 0.0::DOUBLE, 0.0::DOUBLE FROM l UNION ALL SELECT step + 1, feature, a + (h2 * g0 - h1 * g1) /
   (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (SELECT step, feature, a, b, sum(y - p) AS g0, sum((y - p) * x) AS g1,
   sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM (SELECT t.*, x, y, 1 / (1 + exp(-a - b * x)) AS p FROM t
   JOIN l USING (feature) WHERE step < 12) GROUP BY ALL)),
 p AS (SELECT l.*, b, 1 / (1 + exp(-a - b * x)) AS p FROM t JOIN l USING (feature) WHERE step = 12),
 h AS (SELECT feature, count(*) AS n, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM p GROUP BY 1),
 u AS (SELECT feature, g, n, any_value(b) AS b, sum((y - p) * (h0 * x - h1)) / any_value(h0 * h2 - h1 * h1) AS u FROM p JOIN h USING (feature) GROUP BY 1, 2, 3),
 e AS (SELECT feature, any_value(b) AS b, sqrt(sum(u * u) * count(*) / (count(*) - 1) * any_value((n - 1) / CAST(n - 2 AS DOUBLE))) AS se FROM u GROUP BY 1),
 z AS (SELECT *, abs(b) / se / sqrt(2) AS z FROM e)"""
#: The complement of the error function of z, by trapezoids of width 1/2 with their correction.
_ERFC = "z / (2 * pi()) * exp(-z * z) * (1 / (z * z) + " + " + ".join(f"2 * exp(-{k * k / 4}::DOUBLE) / ({k * k / 4} + z * z)" for k in range(1, 14)) + ") + CASE WHEN z < 2 * pi() THEN 2 / (1 - exp(4 * pi() * z)) ELSE 0 END"
_RECURSIVE = _MATRIX.replace("WITH ", "WITH RECURSIVE ", 1)


@query("univariate_logit", _RECURSIVE + _LONG + _SLOPES + f" SELECT feature, b AS coef, se AS std_err, exp(b) AS odds_ratio, exp(b - 1.959963984540054 * se) AS ci_lower, exp(b + 1.959963984540054 * se) AS ci_upper, {_ERFC} AS p_value FROM z")
def univariate_logit(spark, sf_dir):
    rows = L.univariate(_matrix(spark, sf_dir), ["bal", "n", "price"], "y", "c_nationkey")
    cols = ("feature", "coef", "std_err", "odds_ratio", "ci_lower", "ci_upper", "p_value")
    return spark.createDataFrame([tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in cols) for r in rows], "feature string, coef double, std_err double, odds_ratio double, ci_lower double, ci_upper double, p_value "
    "double")


def _determinant(m: list[list[str]]) -> str:
    """A determinant as SQL, along its first row."""
    if len(m) == 1:
        return m[0][0]
    minors = [_determinant([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {minor}" for j, minor in enumerate(minors)) + ")"


def _newton_sql() -> str:
    """Newton steps of the eight models of three features: a model's other features are zero, with a one on the diagonal that keeps them so."""
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    move = [_determinant([[f"g{i}" if j == k else h[i][j] for j in range(4)] for i in range(4)]) for k in range(4)]
    sums = [f"sum((y - p) * x{i}) AS g{i}" for i in range(4)]
    sums += [f"sum(p * (1 - p) * x{i} * x{j})" + (f" + CASE WHEN sum(abs(x{i})) = 0 THEN 1 ELSE 0 END" if i == j else "") + f" AS h{i}{j}" for i in range(4) for j in range(i, 4)]
    at = "1 / (1 + exp(-b0 - b1 * x1 - b2 * x2 - b3 * x3))"
    return f""", l AS (SELECT k, y, 1.0::DOUBLE AS x0, bal * (k & 1) AS x1, n * ((k >> 1) & 1) AS x2, coalesce(price, 1.5) * (k >> 2) AS x3 FROM m, (SELECT unnest(range(0, 8)) AS k)),
 t(step, k, b0, b1, b2, b3) AS (SELECT 0, unnest(range(0, 8)), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT step + 1, k, {", ".join(f"b{i} + {move[i]} / {_determinant(h)}" for i in range(4))}
   FROM (SELECT step, k, b0, b1, b2, b3, {", ".join(sums)} FROM (SELECT t.*, y, x0, x1, x2, x3, {at} AS p FROM t JOIN l USING (k) WHERE step < 12) GROUP BY ALL)),
 v AS (SELECT k, -2 * sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) + (bit_count(k) + 1) * ln(count(*)) AS v FROM (SELECT k, y, {at} AS p FROM t JOIN l USING (k) WHERE step = 12) GROUP BY k),
 c AS (SELECT feature, bit FROM (VALUES ('bal', 1), ('n', 2), ('price', 4)) AS c(feature, bit)),
 s(step, k, feature, criterion) AS (SELECT 0, k, '', v FROM v WHERE k = 0 UNION ALL SELECT step + 1, arg_min(v.k, (v, c.feature)), arg_min(c.feature, (v, c.feature)), min(v)
   FROM s JOIN c ON s.k & bit = 0 JOIN v ON v.k = s.k | bit WHERE v < criterion - 1e-8 GROUP BY step)
 SELECT CAST(step AS INT) AS step, feature, criterion FROM s WHERE step > 0"""


@query("forward_selection", _RECURSIVE + _newton_sql())
def forward_selection(spark, sf_dir):
    _, path = L.forward_selection(_matrix(spark, sf_dir), ["bal", "n", "price"], "y", "bic")
    return spark.createDataFrame([(p["step"], p["feature"], float(p["criterion"])) for p in path], "step int, feature string, criterion double")


@query("tree_report")
def tree_report(spark, sf_dir):
    """A forest tuned by out-of-fold average precision on the training patients, its threshold set there, scored on the others."""
    names = ["bal", "n", "price"]
    m = P.stratified_split(_matrix(spark, sf_dir), "c_custkey", "y").select("c_custkey", *names, "y", "split").persist()
    every = P.group_folds(m.where("split = 'train'"), "c_custkey", "y", 2).persist()
    train = dealt(every, "c_custkey").persist()
    spec = next(s for s in trees.specs() if s.name == "RandomForest")
    params, oof = trees.search(spec, train, names, "y", "fold", [0, 1], key="c_custkey")
    threshold = trees.calibrate(oof, "y")
    model = trees.fit_model(spec, params, train, names, "y")
    scored = trees.score(model, m.where("split = 'test'")).select("y", "probability").persist()
    report = trees.evaluate(scored, "y", threshold)
    found = report.collect()  # one row
    for held in (train, every, scored, m):
        held.unpersist()
    return spark.createDataFrame(found, report.schema)


_ROOT = """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(ceil(l_quantity / 5) AS DOUBLE) AS quantity,
   CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS line, CAST(round(l_discount * 100) AS DOUBLE) AS discount FROM lineitem),
 l AS (SELECT 0 AS k, 'quantity' AS feature, quantity AS x, y FROM r UNION ALL SELECT 1, 'line', line, y FROM r UNION ALL SELECT 2, 'discount', discount, y FROM r),
 t AS (SELECT sum(0.5::DOUBLE - y) AS g, 0.25::DOUBLE * count(*) AS h FROM r),
 c AS (SELECT DISTINCT k, feature, x AS cut FROM l WHERE x IS NOT NULL AND x > (SELECT min(x) FROM l AS o WHERE o.k = l.k)),
 s AS (SELECT c.k, c.feature, cut, to_left, sum(0.5::DOUBLE - y) AS gl, 0.25::DOUBLE * count(*) AS hl
   FROM l JOIN c ON l.k = c.k, (VALUES (false), (true)) AS w(to_left) WHERE x < cut OR (x IS NULL AND to_left) GROUP BY ALL),
 a AS (SELECT s.*, g, h, round((gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2, 9) AS gain FROM s, t WHERE hl >= 1 AND h - hl >= 1)
 SELECT feature, cut, to_left, gain, -gl / (hl + 1) AS left_value, -(g - gl) / (h - hl + 1) AS right_value FROM a WHERE gain > 0
 ORDER BY gain DESC, k, cut, to_left LIMIT 1"""


@query("boosted_root", _ROOT)
def boosted_root(spark, sf_dir):
    """The first split of boosted trees, with the side of missing values and both leaves: what the histograms say, against all cuts in SQL."""
    li = table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber"))
    rows = li.select(F.ceil(F.col("l_quantity") / 5).alias("quantity"), line.alias("line"), F.round(F.col("l_discount") * 100).alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    names = ["quantity", "line", "discount"]
    model = boosting.fit(rows, names, "y", boosting.Setting(depth=1, rate=1.0, rounds=1), "id")
    t = model.trees[0]
    found = [(names[t.feature[0]], model.cuts[t.feature[0]][t.cut[0]], bool(t.left[0]), float(t.gain[0]), float(t.value[1]), float(t.value[2]))] if t.feature[0] >= 0 else []
    return spark.createDataFrame(found, "feature string, cut double, to_left boolean, gain double, left_value double, right_value double")


@query("boosted_report")
def boosted_report(spark, sf_dir):
    """Both kinds of boosted trees: the whole search (20 draws of all parameters, 100 to 500 rounds, five folds of the training patients where the smaller class has as many), scored on the others."""
    m = P.stratified_split(_matrix(spark, sf_dir, fill=None), "c_custkey", "y").withColumn("id", F.col("c_custkey").cast("long")).persist()
    k = P.fold_count(m.where("split = 'train'"), "y", 5)
    every = P.group_folds(m.where("split = 'train'"), "c_custkey", "y", k).persist()
    train = dealt(every, "c_custkey").persist()
    test = dealt(m.where("split = 'test'"), "c_custkey").persist()
    names, found = ["bal", "n", "price"], []
    for symmetric in (False, True):
        options = boosting.settings(train, "y", symmetric, 20)
        setting, ap, threshold, model = boosting.tuned(train, names, "y", "fold", list(range(k)), options, "id")
        best, share = model.importances()[0]
        facts = {"model": F.lit("symmetric" if symmetric else "boosted"), "cv_average_precision": F.lit(ap), "depth": F.lit(setting.depth), "rounds": F.lit(setting.rounds), "first_feature": F.lit(best), "first_share": F.lit(share)}
        scored = model.scored(test, "y", "id").persist()
        report = trees.evaluate(scored, "y", threshold).withColumns(facts)
        found += report.collect()  # a row per kind
        scored.unpersist()
    for held in (train, test, every, m):
        held.unpersist()
    return spark.createDataFrame(found, report.schema)


# --- kernels


@query("signal_features")
def signal_features(spark, sf_dir):
    """The 28 features of every user's series, which stands for a signal at 4 Hz."""
    return X.extract(arrays(spark, sf_dir), ["record"])


#: Series as signals with faults: heart rates that are zero or outside 50 to 240, contractions that are zero or outside 0 to 150.
_FAULTS = SERIES + """, v AS (SELECT user_id, i, coalesce(CASE WHEN event_id % 11 = 0 THEN 0 ELSE x + 60 END BETWEEN 50 AND 240 AND event_id % 11 <> 0, false) AS f,
 coalesce(CASE WHEN event_id % 5 = 0 THEN 0 ELSE x / 2 END BETWEEN 0 AND 150 AND event_id % 5 <> 0 AND x <> 0, false) AS u, count(*) OVER
   (PARTITION BY user_id) AS n FROM s)"""


def _faulty(spark, sf_dir):
    e = F.col("event_id")
    s = series(spark, sf_dir).select("user_id", "i", F.when(e % 11 == 0, 0.0).otherwise(F.col("x") + 60).alias("fhr"), F.when(e % 5 == 0, 0.0).otherwise(F.col("x") / 2).alias("uc"))
    a = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "fhr", "uc"))).alias("v"))
    return a.select(F.col("user_id").cast("string").alias("record"), F.transform("v", lambda p: p["fhr"]).alias("fhr"), F.transform("v", lambda p: p["uc"]).alias("uc"))


@query("signal_quality", _FAULTS + " SELECT CAST(user_id AS VARCHAR) AS record, any_value(n) / 240.0::DOUBLE AS signal_duration_min, count(*) "
    "FILTER (NOT f) * 100.0::DOUBLE / count(*) AS fhr_invalid_pct, count(*) FILTER (NOT u) * 100.0::DOUBLE / "
    "count(*) AS uc_invalid_pct FROM v GROUP BY user_id")
def signal_quality(spark, sf_dir):
    """What the feature extractor says about gaps in both channels."""
    return X.extract(_faulty(spark, sf_dir), ["record"]).select("record", "signal_duration_min", "fhr_invalid_pct", "uc_invalid_pct")


_SIDE = "avg({x}) AS {n}_mean, stddev_pop({x}) AS {n}_std, min({x}) AS {n}_min, max({x}) AS {n}_max, (count(*) - count({x})) * 100.0::DOUBLE / count(*) AS {n}_nan_pct"


@query("signal_stats", SERIES + ", g AS (SELECT user_id, x / 4 + 90 AS f, x / 10 AS u FROM s) SELECT CAST(user_id AS VARCHAR) AS record, "
    "count(*) AS n_samples, count(*) / 240.0::DOUBLE AS duration_min, 4 AS fs_hz, count(u) > 0 AS has_uc, " + _SIDE.format(x="f", n="fhr") + ", " + _SIDE.format(x="u", n="uc") + " FROM g GROUP BY user_id")
def signal_stats(spark, sf_dir):
    """Statistics of both channels from arrays."""
    from .pipelines import signal_stats as stats

    return stats(arrays(spark, sf_dir))


@query("window_features")
def window_features(spark, sf_dir):
    """Features of windows of 12 s by 3 s over the users' series."""
    return X.window_features(arrays(spark, sf_dir), length_min=0.2, stride_min=0.05)


@query("window_ids", _FAULTS + """, b AS (SELECT user_id, any_value(n) AS n, unnest(range(0, any_value(n) - 24 + 1, 12)) AS st FROM v GROUP BY user_id HAVING any_value(n) >= 24),
 q AS (SELECT b.user_id, b.st, any_value(b.n) AS n, count(*) FILTER (NOT f) * 100.0::DOUBLE / 24 AS fp, count(*) FILTER (NOT u) *
   100.0::DOUBLE / 24 AS up FROM b JOIN v ON v.user_id = b.user_id AND v.i >= b.st AND v.i < b.st + 24 GROUP BY 1, 2)
 SELECT CAST(user_id AS VARCHAR) AS record, CAST(row_number() OVER (PARTITION BY user_id ORDER BY st) - 1 AS INT) AS window_id, st /
   240.0::DOUBLE AS window_start_min, (st + 24) / 240.0::DOUBLE AS window_end_min, (n - st - 24) / 240.0::DOUBLE AS time_to_birth_min, fp
   AS fhr_invalid_pct, up AS uc_invalid_pct FROM q WHERE fp <= 40 AND up <= 40""")
def window_ids(spark, sf_dir):
    """Which windows of 6 s by 3 s are kept, and their numbers, by the window extractor."""
    w = X.window_features(_faulty(spark, sf_dir), length_min=0.1, stride_min=0.05, most_pct=40)
    return w.select("record", "window_id", "window_start_min", "window_end_min", "time_to_birth_min", "fhr_invalid_pct", "uc_invalid_pct")


_RUNS = """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
 p AS (SELECT *, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, 0.2::DOUBLE * stddev_pop(x) OVER (PARTITION BY vec_id) AS r FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
 c AS (SELECT p.vec_id, p.i, count(*) FILTER (abs(p.x1 - q.x1) <= p.r) AS low, count(*) FILTER (abs(p.x1 - q.x1) <= p.r AND abs(p.x2 - q.x2) <= p.r) AS high
   FROM p JOIN p AS q ON q.vec_id = p.vec_id AND abs(p.x - q.x) <= p.r GROUP BY 1, 2),
 k AS (SELECT vec_id, avg(ln(low)) FILTER (low > 0) - ln(count(*) FILTER (low > 0)) AS f2, avg(ln(high)) FILTER (high > 0) - ln(count(*) FILTER (high > 0)) AS f3,
   sum(low - 1) FILTER (low > 0) AS b, sum(high - 1) FILTER (high > 0) AS a FROM c GROUP BY 1)"""


@query("entropies", _RUNS + " SELECT vec_id, [round(f2 - f3, 9) + 0, CASE WHEN a > 0 THEN round(-ln(a / CAST(b AS DOUBLE)), 9) + 0 ELSE 'NaN'::DOUBLE END] AS apen_sampen FROM k")
def entropies(spark, sf_dir):
    """Both entropies of each vector, of all its values, to nine decimals: logarithms and the order of their sum, which engines differ in, reach the fifteenth."""
    e = table(spark, sf_dir, "embeddings")
    found = X.array_kernel(e, ["vec_id"], "embedding", lambda x: list(K.entropies(x, most=None)), "apen_sampen", "array<double>")
    return found.withColumn("apen_sampen", F.transform("apen_sampen", lambda v: F.when(F.isnan(v), v).otherwise(F.round(v, 9) + F.lit(0.0))))


_WELCH = """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64),
 w AS (SELECT vec_id, s, i - s AS t, x - avg(x) OVER (PARTITION BY vec_id, s) AS x FROM e JOIN (SELECT unnest(range(0, 49, 8)) AS s) ON i BETWEEN s AND s + 15),
 y AS (SELECT vec_id, s, t, x * (0.5 - 0.5 * cos(pi() * t / 8)) AS y FROM w),
 f AS (SELECT vec_id, s, k, sum(y * cos(pi() * k * t / 8)) AS re, sum(y * sin(pi() * k * t / 8)) AS im FROM y, (SELECT CAST(unnest(range(0, 9)) AS INT) AS k) GROUP BY 1, 2, 3)
 SELECT k AS bin, avg((re * re + im * im) / 24 * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) AS psd FROM f GROUP BY k"""


@query("welch_psd", _WELCH)
def welch_psd(spark, sf_dir):
    p = X.array_kernel(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", lambda x: K.welch(x, least=64)[1], "psd", "array<double>")
    return D.mean_curve(p.select(F.posexplode("psd").alias("bin", "psd")), "bin", "psd")


_XCORR = """WITH e AS (SELECT vec_id, list_slice(embedding, 1, 32)::DOUBLE[] AS a, list_slice(embedding, 33, 64)::DOUBLE[] AS b FROM embeddings),
 p AS (SELECT vec_id, unnest(range(0, 32)) AS i, unnest(a) - list_avg(a) AS x, unnest(b) - list_avg(b) AS y FROM e), k AS (SELECT
   CAST(unnest(range(-4, 5)) AS INT) AS lag),
 d AS (SELECT vec_id, stddev_pop(x) * stddev_pop(y) * 32 AS d FROM p GROUP BY vec_id),
 c AS (SELECT p.vec_id, k.lag, sum(p.x * q.y) / any_value(d.d) AS xcorr FROM p JOIN k ON true JOIN p q ON q.vec_id = p.vec_id AND q.i = p.i
   - k.lag JOIN d ON d.vec_id = p.vec_id GROUP BY 1, 2)"""


@query("cross_correlation", _XCORR + " SELECT vec_id, lag, xcorr FROM c")
def cross_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    x = X.pair_kernel(e, ["vec_id"], "a", "b", lambda x, y: K.cross_correlation(x, y, 4), "xcorr")
    return x.select("vec_id", F.posexplode("xcorr").alias("k", "xcorr")).select("vec_id", (F.col("k") - 4).alias("lag"), "xcorr")


@query("plot_cross_correlation", _XCORR + " SELECT lag, avg(xcorr) AS xcorr FROM c GROUP BY lag")
def plot_cross_correlation(spark, sf_dir):
    """The mean curve over all pairs of channels."""
    return D.mean_curve(cross_correlation(spark, sf_dir), "lag", "xcorr")


@query("plot_acf_bias", SERIES + _LAGS.format(where=" WHERE x IS NOT NULL", lags=8) + """, o AS (SELECT lag, avg(acf) FILTER (user_id % 2 = 0) AS original, avg(acf) FILTER (user_id % 2 = 1) AS synthetic FROM a WHERE n > 8 GROUP BY lag)
 SELECT lag, original, synthetic, synthetic - original AS bias FROM o WHERE lag IN (0, 1, 2, 4, 8)""")
def plot_acf_bias(spark, sf_dir):
    """Mean autocorrelation of two groups of series, and its bias at some lags."""
    a = S.autocorrelation(series(spark, sf_dir), "x", "user_id", 8, drop_missing=True, long_enough=True)
    curve = lambda odd: D.mean_curve(a.where(F.col("user_id") % 2 == odd), "lag", "acf")
    return D.curve_bias(curve(0), curve(1), "lag", "acf", [0, 1, 2, 4, 8])


@query("plot_importance")
def plot_importance(spark, sf_dir):
    """Features of a fixed forest by falling importance."""
    m, names = _matrix(spark, sf_dir), ["bal", "n", "price"]
    spec = next(s for s in trees.specs() if s.name == "RandomForest")
    model = trees.fit_model(spec, {"maxDepth": 3, "numTrees": 10}, m, names, "y")
    return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(trees.importances(model, names))], "rank int, feature string, importance double")


@query("dfa", """WITH v AS (SELECT event_id // 512 AS record, value, row_number() OVER w AS t, count(*) OVER (PARTITION BY event_id // 512) AS n, avg(value)
   OVER (PARTITION BY event_id // 512) AS mu FROM events WINDOW w AS (PARTITION BY event_id // 512 ORDER BY ts, event_id)),
 p AS (SELECT record, t, n, sum(value - mu) OVER (PARTITION BY record ORDER BY t) AS y FROM v WHERE n >= 256), s AS (SELECT unnest([4, 8,
   16, 32, 64, 128]) AS s),
 g AS (SELECT record, s, (t - 1) // s AS b, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) AS rss, count(*) AS k FROM p,
   s WHERE (t - 1) // s < n // s GROUP BY 1, 2, 3),
 f AS (SELECT record, s, 0.5 * ln(sum(rss) / sum(k)) AS lf, ln(s) AS ls FROM g GROUP BY 1, 2)
 SELECT r.record, round(regr_slope(lf, ls), 6) AS dfa_alpha, round(regr_intercept(lf, ls), 6) AS dfa_intercept, round(regr_slope(lf, ls)
   FILTER (s <= 16), 6) AS dfa_alpha_short, round(regr_slope(lf, ls) FILTER (s >= 32), 6) AS dfa_alpha_long
 FROM (SELECT DISTINCT record FROM v) r LEFT JOIN f USING (record) GROUP BY r.record""")
def dfa(spark, sf_dir):
    """Fluctuation analysis of records of 512 events, in order of time; short records have none."""
    record = F.floor(F.col("event_id") / 512).cast("bigint")
    e = table(spark, sf_dir, "events").groupBy(record.alias("record")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    d = X.array_kernel(e.select("record", F.transform("v", lambda p: p["value"]).alias("x")), ["record"], "x", lambda x: list(K.fluctuation(x).values()), "dfa", "array<double>")
    names = ("dfa_alpha", "dfa_intercept", "dfa_alpha_short", "dfa_alpha_long")
    return d.select("record", *[F.round(C.null_nan(F.col("dfa")[i]), 6).alias(n) for i, n in enumerate(names)])


# --- streaming logic on a batch


@query("stream_windows", "SELECT event_type, count(value) AS n, avg(value) AS mean, date_trunc('hour', ts) AS start FROM events GROUP BY event_type, date_trunc('hour', ts)")
def stream_windows(spark, sf_dir):
    from ..streaming.monitor import event_time, sliding_means

    e = event_time(table(spark, sf_dir, "events"))
    out = sliding_means(e, "event_type", "value", length="1 hour", stride="1 hour")
    return out.select("event_type", "n", "mean", F.col("start").cast("timestamp_ntz").alias("start"))
