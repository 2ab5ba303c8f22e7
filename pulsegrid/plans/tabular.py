"""Queries of outcome, table, join, aggregate, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..operators import tables as T
from ..sources import files
from . import pipelines
from .common import query, series, table

_Q = ("0.05", "0.25", "0.5", "0.75", "0.95")


def _clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: a pH, two Apgar scores and NICU days from prices and keys, with gaps."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        F.when(k % 11 != 0, F.lit(6.9) + F.pmod(F.floor(F.col("o_totalprice")), F.lit(50)) / 100.0).alias("ph"),
        F.when(k % 5 != 0, F.pmod(k, F.lit(11)).cast("double")).alias("apgar1"),
        F.when(k % 7 != 0, F.pmod(k + 3, F.lit(11)).cast("double")).alias("apgar5"),
        F.when(k % 3 != 0, F.pmod(k, F.lit(4)).cast("double") - 2).alias("nicu"),
        F.when(k % 4 != 0, F.pmod(k, F.lit(13)).cast("double") - 11).alias("hie"),
    )


_CLINICAL = """WITH c AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 11 <> 0 THEN 6.9::DOUBLE + (CAST(floor(o_totalprice) AS BIGINT) % 50) / 100.0::DOUBLE END AS ph,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS apgar1,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey + 3) % 11 AS DOUBLE) END AS apgar5,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 4 AS DOUBLE) - 2 END AS nicu,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 13 AS DOUBLE) - 11 END AS hie FROM orders)"""


@query("composite_target", _CLINICAL + " SELECT o_orderkey, CAST(coalesce(ph < 7.10, false) OR coalesce(apgar5 < 7, false) OR coalesce(nicu > 0, false) AS INT) AS target FROM c")
def composite_target(spark, sf_dir):
    return _clinical(spark, sf_dir).select("o_orderkey", C.composite_target(F.col("ph"), F.col("apgar5"), F.col("nicu")).alias("target"))


_FLAGS = {
    "ph_severe": "ph < 7.05",
    "ph_moderate": "ph >= 7.05 AND ph < 7.10",
    "ph_mild": "ph >= 7.10 AND ph < 7.20",
    "apgar1_lt_7": "apgar1 < 7",
    "apgar5_lt_7": "apgar5 < 7",
    "apgar1_lt_4": "apgar1 < 4",
    "apgar5_lt_4": "apgar5 < 4",
    "acog": "ph < 7.00 AND apgar5 < 7",
    "wide": "ph < 7.10 AND apgar1 < 7",
    "ph705_apgar5": "ph < 7.05 AND apgar5 < 7",
    "gold": "ph < 7.05 AND apgar5 < 7 AND (coalesce(hie > 0, false) OR coalesce(nicu > 0, false))",
}
_CRITERIA = {k: "ph < 7.10" if k == "ph_lt_710" else _FLAGS[k] for k in ("ph_severe", "ph_lt_710", "apgar1_lt_7", "apgar5_lt_7", "apgar1_lt_4", "apgar5_lt_4", "acog", "ph705_apgar5", "wide", "gold")}
_OUTCOME = ("ph", "apgar1", "apgar5", "hie", "nicu")


@query("outcome_flags", _CLINICAL + " SELECT o_orderkey, " + ", ".join(f"CAST(coalesce({v}, false) AS INT) AS {k}" for k, v in _FLAGS.items()) + " FROM c")
def outcome_flags(spark, sf_dir):
    return _clinical(spark, sf_dir).withColumns(C.outcome_flags(*map(F.col, _OUTCOME))).select("o_orderkey", *_FLAGS)


_COUNTED = " UNION ALL ".join(f"SELECT '{k}' AS criterion, count(*) FILTER ({v}) AS n, count(*) AS total FROM c" for k, v in _CRITERIA.items())


@query("flag_counts", _CLINICAL + f", u AS ({_COUNTED}) SELECT criterion, n, n * 100.0::DOUBLE / total AS pct, CASE WHEN n > 0 THEN CAST(total - n AS DOUBLE) / n END AS others_per_case FROM u")
def flag_counts(spark, sf_dir):
    return T.criteria_counts(_clinical(spark, sf_dir), C.outcome_criteria(*map(F.col, _OUTCOME)))


_CATEGORY = """CASE WHEN ph IS NULL OR apgar1 IS NULL OR apgar5 IS NULL THEN 'incomplete data'
 WHEN ph < 7.05 AND apgar5 < 7 THEN 'confirmed asphyxia' WHEN ph < 7.05 THEN 'acidosis without depression'
 WHEN apgar5 < 7 THEN 'depression without severe acidosis' WHEN ph < 7.10 AND apgar1 < 7 THEN 'borderline' ELSE 'normal' END"""


@query("first_match_category", _CLINICAL + f" SELECT o_orderkey, {_CATEGORY} AS category FROM c")
def first_match_category(spark, sf_dir):
    return _clinical(spark, sf_dir).select("o_orderkey", C.outcome_category(F.col("ph"), F.col("apgar1"), F.col("apgar5")).alias("category"))


@query("acog_rules", _CLINICAL + " SELECT o_orderkey, coalesce(ph < 7.00, false) AND coalesce(apgar5 < 7, false) AS acog_all, coalesce(ph < "
    "7.00, false) OR coalesce(apgar5 < 7, false) OR coalesce(hie > 0, false) AS acog_any FROM c")
def acog_rules(spark, sf_dir):
    ph, a5, hie = F.col("ph"), F.col("apgar5"), F.col("hie")
    return _clinical(spark, sf_dir).select("o_orderkey", C.acog_all(ph, a5).alias("acog_all"), C.acog_any(ph, a5, hie).alias("acog_any"))


def _ph_sql(cuts):
    return f"CASE WHEN ph IS NULL THEN 'no data' WHEN ph < {cuts[0]} THEN 'severe' WHEN ph < {cuts[1]} THEN 'moderate' WHEN ph < {cuts[2]} THEN 'mild' ELSE 'normal' END"


@query("classes", _CLINICAL + f" SELECT o_orderkey, {_ph_sql(C.PH_CUTS_EDA)} AS ph_eda, {_ph_sql(C.PH_CUTS_EARLY)} AS ph_early," + """
 CASE WHEN apgar5 IS NULL THEN 'no data' WHEN apgar5 < 4 THEN '0-3' WHEN apgar5 < 7 THEN '4-6' ELSE '7-10' END AS apgar5_class,
 CASE WHEN apgar1 < 4 THEN '0-3' WHEN apgar1 < 7 THEN '4-6' ELSE '7-10' END AS apgar1_class FROM c""")
def classes(spark, sf_dir):
    ph = F.col("ph")
    return _clinical(spark, sf_dir).select("o_orderkey", C.ph_class(ph).alias("ph_eda"), C.ph_class(ph, C.PH_CUTS_EARLY).alias("ph_early"), C.apgar_class(F.col("apgar5")).alias("apgar5_class"), C.apgar_class(F.col("apgar1"), missing=None).alias("apgar1_class"))


@query("bin_left_closed", "SELECT c_custkey, CASE WHEN c_acctbal >= -1000 AND c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 0 AND "
    "c_acctbal < 2500 THEN 'low' WHEN c_acctbal >= 2500 AND c_acctbal < 7500 THEN 'middle' WHEN c_acctbal >= 7500 "
    "AND c_acctbal < 20000 THEN 'high' END AS bin FROM customer")
def bin_left_closed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.left_closed_bins(F.col("c_acctbal"), [-1000, 0, 2500, 7500, 20000], ["debt", "low", "middle", "high"]).alias("bin"))


@query("crosstab_margins", """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
 FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_margins(spark, sf_dir):
    return T.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("code_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status, "
    "'syn_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS sid, CAST(o_orderkey AS VARCHAR) || '_boot_' || "
    "CAST(o_orderkey % 3 AS VARCHAR) AS rid, starts_with(o_orderpriority, '1-') AS urgent FROM orders")
def code_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.code_label(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other").alias("status"), C.synthetic_id(k % 1000).alias("sid"), C.replicate_id(k.cast("string"), k % 3).alias("rid"), F.col("o_orderpriority").startswith("1-").alias("urgent"))


@query("header_parse", r"""WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '-- ' || p_name WHEN 1 THEN 'pH           ' || CAST(p_size AS VARCHAR) WHEN 2
   THEN p_type || chr(9) || p_brand WHEN 3 THEN 'pH 7.14' ELSE 'Gest. weeks   ' || p_brand END AS line FROM part)
SELECT p_partkey, lower(trim(string_split_regex(line, '\s{2,}|\t')[1])) AS key, trim(string_split_regex(line, '\s{2,}|\t')[2]) AS value,
   TRY_CAST(trim(string_split_regex(line, '\s{2,}|\t')[2]) AS DOUBLE) AS number
FROM l WHERE line NOT LIKE '--%' AND len(string_split_regex(line, '\s{2,}|\t')) = 2""")
def header_parse(spark, sf_dir):
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("-- "), "p_name")).when(k == 1, F.concat(F.lit("pH           "), F.col("p_size").cast("string"))).when(k == 2, F.concat("p_type", F.lit("\t"), "p_brand")).when(k == 3, "pH 7.14").otherwise(F.concat(F.lit("Gest. weeks   "), "p_brand"))
    e = table(spark, sf_dir, "part").select("p_partkey", C.header_entry(line).alias("e")).where("e IS NOT NULL").select("p_partkey", "e.*")
    return e.withColumn("number", F.col("value").try_cast("double"))


@query("lenient_cast", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def lenient_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("nan_rules", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio, "
    "CAST(coalesce(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END > 1, false) AS INT) AS over FROM lineitem")
def nan_rules(spark, sf_dir):
    ratio = C.null_nan(F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).otherwise(float("nan")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), C.yes(ratio > 1).cast("int").alias("over"))


@query("round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, greatest(least(l_extendedprice, "
    "50000), 1000) AS clipped, ln(1 + l_tax) AS l1p, sqrt(abs(l_discount - 0.05)) AS root FROM lineitem")
def round_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("half"), F.greatest(F.least("l_extendedprice", F.lit(50000.0)), F.lit(1000.0)).alias("clipped"), F.log1p("l_tax").alias("l1p"), F.sqrt(F.abs(F.col("l_discount") - 0.05)).alias("root"))


@query("guarded_exp", "SELECT c_custkey, CASE WHEN c_acctbal > 709 THEN 'Infinity'::DOUBLE WHEN c_acctbal < -745 THEN 0.0 ELSE exp(c_acctbal) END AS odds FROM customer")
def guarded_exp(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.safe_odds(F.col("c_acctbal")).alias("odds"))


@query("birth_minutes", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 240.0 + CASE WHEN o_totalprice > 100000 THEN o_totalprice / 60.0 ELSE 0 END AS birth_min FROM orders")
def birth_minutes(spark, sf_dir):
    late = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.birth_minute(F.col("o_custkey").cast("double"), late).alias("birth_min"))


@query("subsample_array", "SELECT vec_id, CAST(list_transform(range(0, 16), lambda k: embedding[CAST(floor(k * (len(embedding) - 1) / "
    "15.0::DOUBLE) AS BIGINT) + 1]) AS FLOAT[]) AS thin FROM embeddings")
def subsample_array(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", C.subsample(F.col("embedding"), 16).alias("thin"))


_MODELS = "SELECT l_linestatus || ' - ' || l_returnflag AS model, avg(l_discount) AS auroc FROM lineitem GROUP BY 1"


@query("models_by_prefix", f"SELECT * FROM ({_MODELS}) WHERE starts_with(model, 'O -')")
def models_by_prefix(spark, sf_dir):
    report = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_linestatus", F.lit(" - "), "l_returnflag").alias("model")).agg(F.avg("l_discount").alias("auroc"))
    return pipelines.models_of(report, "O -")


@query("eligibility", """WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 = 0) * 100.0::DOUBLE / count(*) AS nan_pct FROM events GROUP BY user_id)
SELECT count(*) FILTER (nan_pct <= 15 AND n >= 60) AS eligible, count(*) FILTER (nan_pct > 15) AS too_many_gaps, count(*) FILTER (n < 60)
   AS too_short FROM r""")
def eligibility(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_id") % 7 == 0) * 100.0 / F.count("*")).alias("nan_pct"))
    stats = r.select(F.col("nan_pct").alias("fhr_nan_pct"), F.col("n").alias("duration_min"), F.lit(True).alias("has_uc"))
    return pipelines.rejected(stats, 15, 60).select("eligible", "too_many_gaps", "too_short")


@query("eligible_records", """SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 7 = 0) * 100.0::DOUBLE / count(*) <= 15
 AND count(*) >= 60 AND count(*) FILTER (event_type = 'click') > 0""")
def eligible_records(spark, sf_dir):
    """Series fit for a bootstrap, by the library's rule."""
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_id") % 7 == 0) * 100.0 / F.count("*")).alias("fhr_nan_pct"), (F.count_if(F.col("event_type") == "click") > 0).alias("has_uc"))
    return pipelines.eligible(r.withColumn("duration_min", F.col("n")), 15, 60).select("user_id", "n")


@query("apgar_two_classes", _CLINICAL + " SELECT o_orderkey, CASE WHEN apgar5 IS NULL THEN 'no data' WHEN apgar5 < 7 THEN 'depression' ELSE 'normal' END AS apgar5_class FROM c")
def apgar_two_classes(spark, sf_dir):
    return _clinical(spark, sf_dir).select("o_orderkey", C.apgar_class(F.col("apgar5"), ("depression", "normal"), cuts=C.APGAR_TWO).alias("apgar5_class"))


@query("risk_profiles", """WITH w AS (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events),
 e AS (SELECT user_id, 20.0::DOUBLE + 5.0::DOUBLE * i AS window_end_min, 1 / (1 + exp(-value / 100.0::DOUBLE)) AS probability, 700.0::DOUBLE - 4.5::DOUBLE * i AS time_to_birth_min FROM w),
 b AS (SELECT user_id, median(window_end_min + time_to_birth_min) AS birth_min FROM e GROUP BY user_id)
 SELECT user_id AS record, window_end_min, probability, birth_min FROM e JOIN b USING (user_id)""")
def risk_profiles(spark, sf_dir):
    """What risk curves are drawn from, of every series: windows on an elapsed axis that ends at the median birth time."""
    s = series(spark, sf_dir)
    i = F.col("i")
    return pipelines.risk_profiles(s.select(F.col("user_id").alias("record"), (20.0 + 5.0 * i).alias("window_end_min"), (1 / (1 + F.exp(-F.col("value") / 100.0))).alias("probability"), (700.0 - 4.5 * i).alias("time_to_birth_min")))


@query("freq_with_nulls", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def freq_with_nulls(spark, sf_dir):
    return T.frequencies(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind")), "kind")


@query("freq_without_nulls", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def freq_without_nulls(spark, sf_dir):
    return T.frequencies(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind")), "kind", keep_null=False)


@query("score_histogram", _CLINICAL + ", a AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS score) SELECT score, (SELECT count(*) FROM c WHERE apgar1 "
    "= score) AS n_apgar1, (SELECT count(*) FROM c WHERE apgar5 = score) AS n_apgar5 FROM a")
def score_histogram(spark, sf_dir):
    return T.score_histogram(_clinical(spark, sf_dir), ["apgar1", "apgar5"])


@query("recovery_rates", _CLINICAL + " SELECT count(*) FILTER (apgar1 < 7) AS depressed, count(*) FILTER (apgar1 < 7 AND apgar5 >= 7) AS recovered, "
    "count(*) FILTER (apgar1 < 7 AND apgar5 >= 7) * 100.0::DOUBLE / nullif(count(*) FILTER (apgar1 < 7), 0) AS pct "
    "FROM c")
def recovery_rates(spark, sf_dir):
    low = F.col("apgar1") < 7
    both = low & (F.col("apgar5") >= 7)
    return _clinical(spark, sf_dir).agg(F.count_if(low).alias("depressed"), F.count_if(both).alias("recovered"), F.try_divide(F.count_if(both) * 100.0, F.count_if(low)).alias("pct"))


@query("describe_exact", "SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    "quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, "
    "max(value) AS max FROM events GROUP BY event_type")
def describe_exact(spark, sf_dir):
    return T.describe(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("missing_counts", _CLINICAL + " " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) FILTER ({x} IS NULL) AS n_missing FROM c" for x in ("ph", "apgar1", "apgar5", "nicu", "hie")))
def missing_counts(spark, sf_dir):
    return T.missing_counts(_clinical(spark, sf_dir), ["ph", "apgar1", "apgar5", "nicu", "hie"])


@query("risk_prevalence", _CLINICAL + " " + " UNION ALL ".join(f"SELECT '{x}' AS criterion, count(*) FILTER ({x} = 1) AS n, count(*) FILTER ({x} = 1) * 100.0::DOUBLE / count(*) AS pct, CAST(count(*) - count(*) FILTER ({x} = 1) AS DOUBLE) / nullif(count(*) FILTER ({x} = 1), 0) AS others_per_case FROM c" for x in ("nicu", "hie", "apgar1")))
def risk_prevalence(spark, sf_dir):
    return T.criteria_counts(_clinical(spark, sf_dir), {x: F.col(x) == 1 for x in ("nicu", "hie", "apgar1")})


@query("group_comparison", "SELECT l_returnflag = 'R' AS is_synthetic, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, count(*) AS n FROM lineitem GROUP BY 1")
def group_comparison(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("is_synthetic")).agg(F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"), F.count("*").alias("n"))


@query("record_stats", "SELECT user_id, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, count(*) "
    "FILTER (x IS NULL) * 100.0::DOUBLE / count(*) AS nan_pct FROM (SELECT user_id, CASE WHEN event_id % 7 <> 0 "
    "THEN value END AS x FROM events) GROUP BY user_id")
def record_stats(spark, sf_dir):
    return T.record_stats(series(spark, sf_dir).select("user_id", "x"), "x", "user_id", digits=12)


@query("moments_percentiles", """WITH m AS (SELECT user_id, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY user_id)
SELECT e.user_id, any_value(mu) AS mean, any_value(sd) AS std, avg(((value - mu) / sd) ** 3) AS skew, avg(((value - mu) / sd) ** 4) - 3 AS kurtosis, """ + ", ".join(f"round(quantile_cont(value, {q}), 8) AS p{round(float(q) * 100):02d}" for q in _Q) + " FROM events e JOIN m ON m.user_id = e.user_id GROUP BY e.user_id")
def moments_percentiles(spark, sf_dir):
    m = T.moments(table(spark, sf_dir, "events"), "value", "user_id")
    return m.withColumns({c: F.round(c, 8) for c in m.columns if c.startswith("p")})


@query("pair_correlation", "SELECT l_shipdate AS day, CASE WHEN count(*) > 10 AND stddev_pop(l_quantity) > 0 AND "
    "stddev_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) END AS corr FROM lineitem GROUP BY 1")
def pair_correlation(spark, sf_dir):
    return T.pair_correlation(table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "day"), "l_quantity", "l_extendedprice", "day")


@query("concordance", "SELECT avg(d) AS mean_abs_diff, max(d) AS max_abs_diff, count(*) FILTER (d <= 5) * 100.0::DOUBLE / count(d) "
    "AS within_5_pct, count(*) FILTER (d <= 10) * 100.0::DOUBLE / count(d) AS within_10_pct FROM (SELECT "
    "abs(l_quantity - p_size) AS d FROM lineitem JOIN part ON p_partkey = l_partkey)")
def concordance(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return T.concordance(j, "l_quantity", "p_size")


@query("nunique_max", "SELECT max(k) AS max_distinct FROM (SELECT count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_partkey)")
def nunique_max(spark, sf_dir):
    return T.most_distinct(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("broken_dependency", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1")
def broken_dependency(spark, sf_dir):
    return T.broken_dependency(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("fold_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n_folds, avg(l_discount) AS l_discount_mean, "
    "stddev_samp(l_discount) AS l_discount_std, avg(l_tax) AS l_tax_mean, stddev_samp(l_tax) AS l_tax_std FROM "
    "lineitem GROUP BY 1, 2")
def fold_summary(spark, sf_dir):
    return T.fold_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"])


@query("max_by_group", "SELECT n_nationkey, arg_max(c_mktsegment, (total, c_mktsegment)) AS top_segment FROM (SELECT c_nationkey AS "
    "n_nationkey, c_mktsegment, sum(c_acctbal) AS total FROM customer GROUP BY 1, 2) GROUP BY 1")
def max_by_group(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.sum("c_acctbal").alias("total"))
    return g.groupBy("n_nationkey").agg(F.max_by("c_mktsegment", F.struct("total", "c_mktsegment")).alias("top_segment"))


@query("prevalence", "SELECT count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives, avg(toxic) AS prevalence FROM labels")
def prevalence(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.sum("toxic").alias("positives"), F.avg("toxic").alias("prevalence"))


@query("dedup_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY "
    "l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def dedup_first(spark, sf_dir):
    return T.first_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")])


@query("one_to_many_validated", "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def one_to_many_validated(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return T.one_to_many(c, o, "c_custkey")


@query("one_to_one_validated", "SELECT n_nationkey, n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def one_to_one_validated(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return T.one_to_one(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), n, "n_nationkey")


@query("left_lookup", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return T.lookup(table(spark, sf_dir, "customer").select("c_custkey"), n, "c_custkey", {"n_orders": 0})


@query("strict_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return T.strict_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("semi_train", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_train(spark, sf_dir):
    train = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return T.synthetic_of_training(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), train, "o_custkey", "c_custkey")


@query("anti_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0")
def anti_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return T.upsert(old, old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("union_missing_cols", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def union_missing_cols(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return T.union_all([s, c])


@query("missing_and_fallback_cols", "SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END, p_retailprice) AS size_or_price, NULL::DOUBLE AS extra FROM part")
def missing_and_fallback_cols(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("size_or_price"), "p_retailprice")
    return T.select_existing(T.add_missing(T.fallback_columns(p, {"size_or_price": "p_retailprice"}), ["extra"]), ["p_partkey", "size_or_price", "extra", "absent"])


@query("intersect_keys", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def intersect_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.where("l_quantity > 45").select("l_partkey").intersect(l.where("l_discount > 0.08").select("l_partkey"))


@query("subset_violations", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def subset_violations(spark, sf_dir):
    outer = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return T.subset_violations(table(spark, sf_dir, "orders"), outer, "o_custkey")


@query("topk_nulls_last", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY CASE WHEN p_size > 5 THEN p_retailprice END DESC NULLS LAST, p_partkey LIMIT 20")
def topk_nulls_last(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return T.top_n(p, 20, F.when(F.col("p_size") > 5, F.col("p_retailprice")).desc_nulls_last(), F.col("p_partkey"))


@query("best_two_keys", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC NULLS LAST, s_acctbal DESC NULLS LAST, s_suppkey LIMIT 1")
def best_two_keys(spark, sf_dir):
    return T.top_n(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), 1, F.col("s_nationkey").desc_nulls_last(), F.col("s_acctbal").desc_nulls_last(), F.col("s_suppkey"))


@query("most_stable", "SELECT arg_min(l_returnflag, sd) AS flag FROM (SELECT l_returnflag, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1)")
def most_stable(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.stddev_samp("l_extendedprice").alias("sd"))
    return g.agg(F.min_by("l_returnflag", "sd").alias("flag"))


@query("unpivot_metrics", "UNPIVOT (SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax "
    "FROM lineitem GROUP BY 1) ON quantity, discount, tax INTO NAME metric VALUE value")
def unpivot_metrics(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return T.unpivot(g, ["l_returnflag"], ["quantity", "discount", "tax"])


@query("plot_histogram", "WITH b AS (SELECT CAST(unnest(range(0, 20)) AS INT) AS bin) SELECT bin, (SELECT count(*) FROM events WHERE "
    "value >= 0 AND value < 500 AND CAST(floor(value / 25) AS INT) = bin) AS n FROM b")
def plot_histogram(spark, sf_dir):
    return T.histogram(table(spark, sf_dir, "events"), "value", 0.0, 25.0, 20)


@query("plot_quantiles", "WITH q AS (SELECT CAST(unnest(range(0, 21)) AS INT) AS k) SELECT k / 20.0::DOUBLE AS q, (SELECT "
    "list_extract(quantile_cont(l_extendedprice, "
    "[0,.05,.1,.15,.2,.25,.3,.35,.4,.45,.5,.55,.6,.65,.7,.75,.8,.85,.9,.95,1]), k + 1) FROM lineitem) AS a, "
    "(SELECT list_extract(quantile_cont(l_quantity, "
    "[0,.05,.1,.15,.2,.25,.3,.35,.4,.45,.5,.55,.6,.65,.7,.75,.8,.85,.9,.95,1]), k + 1) FROM lineitem) AS b FROM q")
def plot_quantiles(spark, sf_dir):
    return T.quantile_pairs(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 20)


@query("plot_box", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM
   events GROUP BY 1),
 d AS (SELECT e.event_type, q1, median, q3, value, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS within
   FROM events e JOIN q ON q.event_type = e.event_type WHERE value IS NOT NULL)
 SELECT event_type, q1, median, q3, min(value) FILTER (within) AS low, max(value) FILTER (within) AS high, count(*) FILTER (NOT within) AS
   beyond FROM d GROUP BY event_type, q1, median, q3""")
def plot_box(spark, sf_dir):
    return T.box(table(spark, sf_dir, "events"), "value", "event_type")


@query("rename_and_constants", "SELECT s_suppkey AS record, s_acctbal AS balance, 'real' AS sample_source, NULL::INT AS bootstrap_idx FROM supplier")
def rename_and_constants(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "record", "s_acctbal": "balance"})
    return s.select("record", "balance", F.lit("real").alias("sample_source"), F.lit(None).cast("int").alias("bootstrap_idx"))


@query("originals", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', true)")
def originals(spark, sf_dir):
    """The rows that a flag doesn't mark; rows without the flag are on neither side."""
    return table(spark, sf_dir, "lineitem").withColumn("is_synthetic", F.col("l_returnflag") == "R").where(~F.col("is_synthetic")).select("l_orderkey", "l_linenumber")


@query("record_paths", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS record FROM customer")
def record_paths(spark, sf_dir):
    path = F.concat(F.lit("file:///data.v1/raw/"), F.col("c_custkey").cast("string"), F.lit("_fhr.npy"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.record_of_path(path).alias("record"))


@query("summary_document", "SELECT to_json({n: count(*), open: count(*) FILTER (o_orderstatus = 'O'), \"by\": {low: min(o_orderkey), high: max(o_orderkey)}})::VARCHAR AS document FROM orders")
def summary_document(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.struct(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).alias("by"))
    # the document is indented
    return files.to_document(facts).select(F.regexp_replace("document", r"\s", "").alias("document"))
