"""Queries of scored tables, intake rules, features and series, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import clean
from tallyforge.operators import canonical, evaluate, features, kpi, profile, segments, series, whatif

from .queries import DAILY, SCORED, _scored, query

TWO = "SELECT event_id, event_type, least(value / 100, 1) AS a, least(value / 100, 1) * 0.8 + 0.1 * (event_id % 3) AS b FROM events WHERE value IS NOT NULL"


def _two(t) -> DataFrame:
    """Events with a score before and after a change."""
    a = F.least(F.col("value") / 100, F.lit(1.0))
    return t("events").where("value IS NOT NULL").select("event_id", "event_type", a.alias("a"), (a * 0.8 + 0.1 * (F.col("event_id") % 3)).alias("b"))


@query("a27_prediction_stats", f"SELECT count(p) AS count, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, max(p) AS max, quantile_cont(p, .5) AS median, avg(c) AS confidence_mean, min(c) AS confidence_min, max(c) AS confidence_max, count(*) FILTER (WHERE c < 0.7) AS low_confidence, count(*) FILTER (WHERE c > 0.9) AS high_confidence FROM (SELECT p, greatest(p, 1 - p) AS c FROM ({SCORED}))")
def a27(t):
    return kpi.prediction_stats(_scored(t).withColumn("c", F.greatest(F.col("p"), 1 - F.col("p"))), "p", "c")


@query("a25_segment_differences", """WITH g AS (SELECT avg(o_totalprice) AS a, avg(o_orderkey) AS b, avg(o_custkey) AS c FROM orders), d AS (SELECT o_orderstatus AS segment, unnest(['o_totalprice', 'o_orderkey', 'o_custkey']) AS feature, unnest([avg(o_totalprice) - min(a), avg(o_orderkey) - min(b), avg(o_custkey) - min(c)]) AS difference FROM orders, g GROUP BY 1)
SELECT segment, feature, difference, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(difference) DESC, feature) AS rank FROM d) WHERE rank <= 2""")
def a25(t):
    return kpi.segment_differences(t("orders"), "o_orderstatus", ["o_totalprice", "o_orderkey", "o_custkey"], 2)


@query("a11_positive_label", """SELECT event_type AS label, count(*) AS rows FROM events GROUP BY 1 HAVING event_type = 'purchase'""")
def a11(t):
    return profile.positive_label(t("events"), "event_type")


@query("a11_minority_label", """SELECT o_orderstatus AS label, count(*) AS rows FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def a11m(t):
    return profile.positive_label(t("orders"), "o_orderstatus")


@query("a12_task_type", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS labels, CASE WHEN count(DISTINCT {c}) <= least(20, greatest(2, floor(count({c}) * 0.1))) THEN 'classification' ELSE 'regression' END AS task FROM orders""" for c in ("o_orderstatus", "o_totalprice", "o_custkey")))
def a12(t):
    return profile.task_type(t("orders"), ["o_orderstatus", "o_totalprice", "o_custkey"])


@query("p9_generic", r"SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, value AS amount, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone, lower(event_type) AS channel, CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE 'maybe' END AS target FROM events")
def p9(t):
    won = F.when(F.col("event_id") % 3 == 0, " Converted ").when(F.col("event_id") % 3 == 1, "did_not_convert").otherwise("maybe")
    raw = t("events").select("event_id", "ts", F.concat(F.lit("$ "), F.col("value").cast("string")).alias("Amt"), F.col("event_type").alias("utm_source"), won.alias("outcome"))
    return canonical.generic(raw, {"id": "event_id"})


@query("p12_file_health", """SELECT c AS "column", c <> 'coupon' AS present, CASE c WHEN 'o_orderkey' THEN avg(CASE WHEN o_orderkey IS NULL THEN 1.0 ELSE 0 END) WHEN 'o_totalprice' THEN avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0 END) END AS null_rate,
count(*) AS rows, count(o_custkey) - count(DISTINCT o_custkey) AS duplicate_keys, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders, (SELECT unnest(['o_orderkey', 'o_totalprice', 'coupon']) AS c) GROUP BY c""")
def p12(t):
    return canonical.file_health(t("orders"), ["o_orderkey", "o_totalprice", "coupon"], "o_custkey", "o_orderdate")


@query("p14_allowed_columns", "SELECT event_id, user_id, event_type, ts FROM (SELECT *, value AS refund, value AS spend_next FROM events)")
def p14(t):
    raw = t("events").withColumn("refund", F.col("value")).withColumn("spend_next", F.col("value"))
    return raw.select(canonical.allowed_columns(raw.columns, deny=["value", "props"]))


@query("p16_aligned", "SELECT o_totalprice, 0 AS discount, o_orderkey FROM orders")
def p16(t):
    return canonical.align_columns(t("orders"), ["o_totalprice", "discount", "o_orderkey"])


@query("t14_base_units", "SELECT l_orderkey, l_linenumber, l_quantity AS q_lb, l_quantity * 453.592 AS q_g, l_tax AS v_ml, l_tax * 0.001 AS v_l FROM lineitem")
def t14(t):
    return clean.base_units(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q_lb"), F.col("l_tax").alias("v_ml")))


@query("t23_masks", r"SELECT c_custkey, regexp_replace(c_custkey || '.1.2.3', '^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$', '\1.*') AS ip, left(c_name, 2) || '***@x.org' AS email, '***-***-' || right(regexp_replace(c_name, '\D', '', 'g'), 4) AS phone FROM customer")
def t23(t):
    ip = F.concat(F.col("c_custkey").cast("string"), F.lit(".1.2.3"))
    return t("customer").select("c_custkey", clean.mask_ipv4(ip).alias("ip"), clean.mask_email(F.concat("c_name", F.lit("@x.org"))).alias("email"), clean.mask_phone(F.col("c_name")).alias("phone"))


@query("t24_missing_flags", "SELECT event_id, value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value__is_missing FROM events")
def t24(t):
    return features.missing_flags(t("events").select("event_id", "value"), ["value"])


@query("t26_stabilized", "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) ELSE -ln(1 - c_acctbal) END AS c_acctbal_log FROM customer")
def t26(t):
    return clean.stabilized(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("f1_encoding_plan", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS values, CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 80 THEN 'onehot' ELSE 'hash' END AS plan FROM events""" for c in ("event_type", "user_id")))
def f1(t):
    return features.encoding_plan(t("events"), ["event_type", "user_id"])


@query("f2_one_hot", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "__oh__o_orderstatus_F", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "__oh__o_orderstatus_O" FROM orders""")
def f2(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    known = features.fitted_values(o.where("o_orderstatus <> 'P'"), "o_orderstatus")
    return features.one_hot(o, "o_orderstatus", known).drop("o_orderstatus")


@query("f5_safe_bundle", "SELECT event_id, coalesce(value, (SELECT quantile_cont(value, .5) FROM events)) AS value, coalesce(props, '-1') AS props FROM events")
def f5(t):
    return features.safe_bundle(t("events").select("event_id", "value", "props"), ["value"], ["props"])


@query("f8_label_codes", "SELECT o_orderkey, o_orderstatus, CAST(c AS INTEGER) AS o_orderstatus_code FROM orders JOIN (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM orders GROUP BY 1) ON o_orderstatus = s")
def f8(t):
    return features.label_codes(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("f9_binary_target", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bought, CASE WHEN value > 0 THEN 1 ELSE 0 END AS positive FROM events")
def f9(t):
    return t("events").select("event_id", features.binary_target(F.col("event_type"), "purchase").alias("bought"), features.binary_target(F.col("value")).alias("positive"))


SETS = f"SELECT *, CASE WHEN p >= 0.3 AND 1 - p >= 0.3 THEN CASE WHEN p >= 0.5 THEN ['1', '0'] ELSE ['0', '1'] END WHEN p >= 0.3 THEN ['1'] ELSE ['0'] END AS labels FROM ({SCORED})"


def _sets(t) -> DataFrame:
    scored = _scored(t).where("p IS NOT NULL").withColumn("label", F.col("y").cast("string"))
    return evaluate.prediction_sets(scored, {"1": F.col("p"), "0": 1 - F.col("p")}, 0.7)


@query("e6_prediction_sets", f"SELECT count(*) AS n, avg(CASE WHEN list_contains(labels, CAST(y AS VARCHAR)) THEN 1.0 ELSE 0 END) AS coverage, avg(len(labels)) AS avg_set_size, CAST(0 AS DOUBLE) AS abstention_rate FROM ({SETS}) WHERE p IS NOT NULL")
def e6(t):
    return evaluate.set_metrics(_sets(t), "label")


NEAR = "SELECT event_id, least(value / 100, 1) AS a, least(value / 100, 1) + ((event_id * 7919) % 1000 - 499.5) / 2000 AS b FROM events WHERE value IS NOT NULL"


def _near(t) -> DataFrame:
    """Events with a score before and after a change that hardly moves the mean."""
    a = F.least(F.col("value") / 100, F.lit(1.0))
    return t("events").where("value IS NOT NULL").select("event_id", a.alias("a"), (a + (F.col("event_id") * 7919 % 1000 - 499.5) / 2000).alias("b"))


# Tails by midpoints: of Student's t over the angle whose tangent is t over the root of v, of the normal over its value.
@query("e9_paired_means", f"""WITH r AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(b - a) AS md, stddev_samp(b - a) AS sd FROM ({NEAR})), s AS (SELECT *, md / (sd / sqrt(n)) AS t, n - 1.0 AS v, 1.959963984540054 AS z FROM r),
g AS (SELECT *, atan(abs(t) / sqrt(v)) AS lo, least(pi() / 2, atan(abs(t) / sqrt(v)) + 12 / sqrt(v)) AS hi, z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) AS q FROM s),
p AS (SELECT 2 * exp(lgamma((min(v) + 1) / 2) - lgamma(min(v) / 2)) / sqrt(pi()) * sum(power(cos(lo + (hi - lo) * (i + 0.5) / 200000), v - 1) * (hi - lo) / 200000) AS p FROM g, range(200000) k(i))
SELECT n AS rows, round(ma, 4) AS original_mean, round(mb, 4) AS modified_mean, round((mb - ma) / ma * 100, 2) AS percent_change, t AS t_statistic, p AS p_value, p < 0.05 AS is_significant, md - q * sd / sqrt(n) AS ci_low, md + q * sd / sqrt(n) AS ci_high,
round((mb - ma) / sqrt((sa * sa + sb * sb) / 2), 4) AS effect_size, round(sb - sa, 4) AS variance_change, CASE WHEN round(sb - sa, 4) > 0 THEN 'higher_risk' WHEN round(sb - sa, 4) < 0 THEN 'lower_risk' ELSE 'similar_risk' END AS risk_assessment, round((round(mb, 4) - round(ma, 4)) * n * 20, 2) AS estimated_revenue_impact FROM g, p""")
def e9(t):
    return evaluate.paired_means(_near(t), "a", "b")


@query("e9_paired_rates", f"""WITH r AS (SELECT count(*) AS n, avg(CASE WHEN a >= 0.5 THEN 1.0 ELSE 0 END) AS ra, avg(CASE WHEN b >= 0.5 THEN 1.0 ELSE 0 END) AS rb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM ({NEAR})), s AS (SELECT *, abs(rb - ra) / sqrt((ra + rb) / 2 * (1 - (ra + rb) / 2) * 2 / n) AS z FROM r),
p AS (SELECT 2 * sum(exp(-power(z + 12 * (i + 0.5) / 200000, 2) / 2)) * 12 / 200000 / sqrt(2 * pi()) AS p FROM s, range(200000) k(i))
SELECT n AS rows, round(ra, 4) AS original_rate, round(rb, 4) AS modified_rate, round((rb - ra) / ra * 100, 2) AS percent_change, 'z-test' AS test, p AS p_value, p < 0.05 AS is_significant, round(sb - sa, 4) AS variance_change, CASE WHEN round(sb - sa, 4) > 0 THEN 'higher_risk' WHEN round(sb - sa, 4) < 0 THEN 'lower_risk' ELSE 'similar_risk' END AS risk_assessment FROM s, p""")
def e9r(t):
    return evaluate.paired_rates(_near(t), "a", "b")


@query("e10_percentiles", " UNION ALL ".join(f"SELECT {p} AS percentile, quantile_cont(a, .{p:02d}) AS original, quantile_cont(b, .{p:02d}) AS modified FROM ({TWO})" for p in (25, 50, 75)))
def e10(t):
    return evaluate.percentile_summary(_two(t), "a", "b")


@query("e10_risk_shift", " UNION ALL ".join(f"SELECT '{n}' AS bucket, avg(CASE WHEN a >= {lo} AND a < {hi} THEN 1.0 ELSE 0 END) AS original_pct, avg(CASE WHEN b >= {lo} AND b < {hi} THEN 1.0 ELSE 0 END) AS modified_pct FROM ({TWO})" for n, lo, hi in (("High Risk", 0.8, 9), ("Medium Risk", 0.4, 0.8), ("Low Risk", -9, 0.4))))
def e10r(t):
    return evaluate.risk_shift(_two(t), "a", "b")


@query("e10_class_shares", f"WITH c AS (SELECT CAST(a >= 0.5 AS VARCHAR) AS o, CAST(b >= 0.5 AS VARCHAR) AS m FROM ({TWO})) SELECT l AS label, (count(*) FILTER (WHERE m = l) - count(*) FILTER (WHERE o = l)) / count(*) * 100 AS change FROM c, (SELECT unnest(['true', 'false']) AS l) GROUP BY 1")
def e10c(t):
    return evaluate.class_share_change(_two(t).select((F.col("a") >= 0.5).alias("a"), (F.col("b") >= 0.5).alias("b")), "a", "b")


@query("e10_interval", f"SELECT avg(b - a) - 1.96 * stddev_samp(b - a) / sqrt(count(*)) AS low, avg(b - a) + 1.96 * stddev_samp(b - a) / sqrt(count(*)) AS high FROM ({TWO})")
def e10i(t):
    return evaluate.mean_difference_interval(_two(t), "a", "b")


# Scores, sets and reliability bins by a list of groups.
def _calibration_sql(groups: str) -> str:
    return f"""s AS ({groups}), r AS (SELECT g, greatest(p, 1 - p) AS q, CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0 END AS hit, (CASE WHEN p >= 0.3 THEN 1 ELSE 0 END + CASE WHEN 1 - p >= 0.3 THEN 1 ELSE 0 END) AS size, CASE WHEN y = 1 THEN p ELSE 1 - p END >= 0.3 AS covered FROM s),
e AS (SELECT g, quantile_cont(q, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS e, count(*) AS n, avg(CASE WHEN covered THEN 1.0 ELSE 0 END) AS coverage, avg(size) AS avg_set_size, avg(CASE WHEN size = 0 THEN 1.0 ELSE 0 END) AS abstention_rate FROM r GROUP BY 1),
b AS (SELECT r.g, i, count(*) AS m, abs(avg(hit) - avg(q)) AS gap FROM r JOIN e ON r.g IS NOT DISTINCT FROM e.g, range(1, 11) k(i) WHERE q >= e[i] AND CASE WHEN i < 10 THEN q < e[i + 1] + 1e-12 ELSE q <= e[i + 1] + 1e-12 END GROUP BY 1, 2),
c AS (SELECT e.*, (SELECT sum(m * gap) / sum(m) FROM b WHERE b.g IS NOT DISTINCT FROM e.g) AS ece FROM e)"""


def _labelled(t) -> DataFrame:
    p = F.least(F.col("value") / 100, F.lit(1.0))
    return t("events").where("value IS NOT NULL").select("event_id", "event_type", (F.col("user_id") % 40).alias("cohort"), "ts", (F.col("event_type") == "purchase").cast("int").alias("y"), F.array(1 - p, p).alias("p"))


@query("e8_segments", f"""WITH {_calibration_sql("SELECT g, y, p FROM (SELECT unnest(['event_type=' || event_type, 'cohort=' || CAST(user_id % 40 AS VARCHAR)]) AS g, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(value / 100, 1) AS p FROM events WHERE value IS NOT NULL)")},
f AS (SELECT g AS name, n, ece, coverage, avg_set_size, abstention_rate, (n >= 200 AND ece > 0.08) OR coverage < 0.88 AS alarm, n < 200 AS low_n, row_number() OVER (PARTITION BY split_part(g, '=', 1) ORDER BY n DESC, split_part(g, '=', 2)) AS top FROM c)
SELECT * EXCLUDE (top), CAST(row_number() OVER (ORDER BY alarm DESC, n DESC, name) AS INTEGER) AS rank FROM f WHERE top <= 30""")
def e8(t):
    return segments.segment_table(_labelled(t), "y", "p", [0, 1], 0.7, ["event_type", "cohort"])


@query("w4_weekly_trend", f"""WITH {_calibration_sql("SELECT CAST(ts AS DATE) + CAST((8 - isodow(ts)) % 7 AS INTEGER) AS g, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(value / 100, 1) AS p FROM events WHERE value IS NOT NULL")}
SELECT CAST(g AS VARCHAR) AS week, n, ece, coverage FROM c""")
def w4(t):
    return segments.weekly_calibration(_labelled(t), "y", "p", [0, 1], 0.7, "ts").withColumn("week", F.col("week").cast("string"))


@query("c3_category_boost", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') + least(CAST(floor(count(o_orderstatus) * 0.075) AS BIGINT), count(*) FILTER (WHERE o_orderstatus <> 'F')) AS in_category FROM orders")
def c3(t):
    boosted = whatif.category_boost(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F", 7.5, ["o_orderkey"])
    return boosted.agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("in_category"))


CHANGE = "o_totalprice * 1.1 - o_totalprice"


@query("c5_change_summary", " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, {by} AS o_orderstatus, '{w}' AS which, avg({c}) AS mean, quantile_cont({c}, .5) AS median, stddev_samp({c}) AS std, avg({CHANGE}) AS mean_change, avg({CHANGE}) - 1.96 * stddev_samp({CHANGE}) / sqrt(count(*)) AS ci_low, avg({CHANGE}) + 1.96 * stddev_samp({CHANGE}) / sqrt(count(*)) AS ci_high FROM orders{end}"
    for scope, by, end in (("all", "CAST(NULL AS VARCHAR)", ""), ("group", "o_orderstatus", " GROUP BY o_orderstatus")) for w, c in (("before", "o_totalprice"), ("after", "o_totalprice * 1.1"))
))
def c5(t):
    return whatif.change_summary(t("orders").withColumn("after", F.col("o_totalprice") * 1.1), "o_totalprice", "after", "o_orderstatus")


@query("c5_category_summary", """WITH s AS (SELECT unnest(['before', 'after']) AS which, unnest([event_type, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END]) AS value FROM events), c AS (SELECT which, value, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT which, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY which ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 5""")
def c5c(t):
    return whatif.category_summary(t("events").withColumn("after", whatif.replace_category(F.col("event_type"), "view", "click")), "event_type", "after")


@query("e12_change_correlation", f"SELECT 'third' AS feature, corr(CAST(event_id % 3 AS DOUBLE), b - a) AS correlation FROM ({TWO})")
def e12(t):
    return evaluate.change_correlation(_two(t), {"third": (F.col("event_id") % 3).cast("double"), "nothing": F.lit(1.0)}, F.col("b") - F.col("a"))


@query("w3_autocorrelation", f"""WITH d AS (SELECT user_id, day, y - lag(y) OVER (PARTITION BY user_id ORDER BY day) AS diff FROM ({DAILY})), c AS (SELECT user_id, day, diff - avg(diff) OVER (PARTITION BY user_id) AS c, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d WHERE diff IS NOT NULL),
s AS (SELECT user_id, sum(c * c) AS v, max(n) AS total FROM c GROUP BY 1)
SELECT s.user_id, CAST(k AS INTEGER) AS lag, coalesce(sum(a.c * b.c), 0) / min(v) AS acf FROM s, range(1, 6) r(k) LEFT JOIN c a ON a.user_id = s.user_id AND a.i > k LEFT JOIN c b ON b.user_id = s.user_id AND b.i = a.i - k WHERE k <= total // 4 GROUP BY 1, 2""")
def w3(t):
    return series.autocorrelation(series.daily(t("events"), "user_id", "ts", "value"), "user_id", "day", "y", 5)


@query("y7_frequency", f"""WITH g AS (SELECT user_id, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM ({DAILY})), c AS (SELECT user_id, gap, count(*) AS n FROM g GROUP BY 1, 2),
b AS (SELECT user_id, CAST(arg_min(gap, (-n, gap)) FILTER (WHERE gap IS NOT NULL) AS DOUBLE) AS gap_days, sum(n) AS n FROM c GROUP BY 1),
f AS (SELECT *, CASE WHEN gap_days IS NULL THEN NULL WHEN gap_days <= 4 THEN 'D' WHEN gap_days <= 15 THEN 'W' WHEN gap_days <= 60 THEN 'M' WHEN gap_days <= 200 THEN 'Q' ELSE 'Y' END AS freq FROM b),
l AS (SELECT *, CAST(CASE freq WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'Q' THEN 4 WHEN 'Y' THEN 1 ELSE 0 END AS INTEGER) AS season_length FROM f)
SELECT user_id, gap_days, freq, season_length, season_length > 0 AND n >= 3 * season_length AS seasonal FROM l""")
def y7(t):
    return series.frequency(series.daily(t("events"), "user_id", "ts", "value"), "user_id", "day")
