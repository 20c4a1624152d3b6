"""Queries of the business operators over the given tables, each with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import clean
from tallyforge.operators import canonical, evaluate, features, keys, kpi, profile, series, whatif
from tallyforge.sources import tables
from tallyforge.streaming import events as stream_events

AS_OF = "2001-08-02 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return add


ORDER_MAP = {"order_id": "o_orderkey", "customer_id": "o_custkey", "order_date": "o_orderdate", "amount": "o_totalprice"}
AGG = f"""SELECT CAST(o_custkey AS VARCHAR) AS customer_id, round(sum(o_totalprice), 2) AS total_spent, min(o_orderdate) AS first_activity, max(o_orderdate) AS last_activity, count(*) AS visits,
  greatest(CAST(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) AS BIGINT), 1) AS days_active,
  CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS idle FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey"""


def _orders(t) -> DataFrame:
    return canonical.orders(t("orders"), ORDER_MAP, ["o_orderdate"])


def _agg(t) -> DataFrame:
    return kpi.customer_aggregate(_orders(t), "customer_id", "amount", "order_date")


@query("p7_canonical_orders", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS order_date, o_totalprice AS amount FROM orders WHERE o_totalprice > 0")
def p7(t):
    return _orders(t)


@query("p6_canonical_customers", "SELECT CAST(c_custkey AS VARCHAR) AS customer_id, lower(replace(c_name, '#', '@')) || '.org' AS email, CASE WHEN length(regexp_replace(c_name, '\\D', '', 'g')) >= 10 THEN regexp_replace(c_name, '\\D', '', 'g') END AS phone, CAST(NULL AS TIMESTAMP) AS created_at FROM customer")
def p6(t):
    raw = t("customer").select("c_custkey", F.concat(F.replace("c_name", F.lit("#"), F.lit("@")), F.lit(".ORG ")).alias("mail"), F.col("c_name").alias("tel"))
    return canonical.customers(raw, {"customer_id": "c_custkey", "email": "mail", "phone": "tel"}, ["mail"])


@query("p8_canonical_marketing", "SELECT CAST(event_id AS VARCHAR) AS campaign_id, CAST(user_id AS VARCHAR) AS customer_id, lower(event_type) AS channel, ts AS sent_date, 1 AS opened, CAST(NULL AS INTEGER) AS clicked, CAST(NULL AS INTEGER) AS converted, coalesce(value, 0) AS cost FROM events")
def p8(t):
    raw = t("events").withColumn("yes", F.lit("Yes"))
    return canonical.marketing(raw, {"campaign_id": "event_id", "customer_id": "user_id", "channel": "event_type", "sent_date": "ts", "opened": "yes", "cost": "value"}, ["ts"])


@query("p11_minimal_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(value, 0.0) AS value, ts AS timestamp, CAST(user_id AS VARCHAR) AS entity_id FROM events")
def p11(t):
    return canonical.minimal_events(t("events"), {"event_id": "event_id", "value": "value", "timestamp": "ts", "entity_id": "user_id"})


@query("k1_keep_last", "SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def k1(t):
    return keys.keep_last(t("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("k2_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def k2(t):
    return keys.distinct_rows(t("lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query("k3_duplicate_keys", "SELECT CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS duplicates FROM lineitem")
def k3(t):
    return keys.duplicate_keys(t("lineitem"), "l_orderkey")


@query("k4_duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def k4(t):
    return profile.duplicate_rows(t("lineitem").select("l_orderkey", "l_linenumber"))


@query("k7_margin_join", f"SELECT a.customer_id, total_spent, m.margin FROM ({AGG}) a LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS c, round(avg(l_extendedprice * (1 - l_discount)), 6) AS margin FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) m ON a.customer_id = m.c")
def k7(t):
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    margin = kpi.mean_margin(lines, "o_custkey", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _agg(t).join(margin, "customer_id", "left").select("customer_id", "total_spent", "margin")


@query("k8_referrals", f"SELECT customer_id, coalesce(n, 0) AS referrals, coalesce(n, 0) / (visits + 1) AS referral_score FROM ({AGG}) LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events GROUP BY user_id) ON customer_id = u")
def k8(t):
    agg = kpi.referral_counts(_agg(t), t("events").select(F.col("user_id").cast("string").alias("code")), "code")
    return agg.select("customer_id", "referrals", kpi.kpi("referral_score", AS_OF).alias("referral_score"))


@query("k9_canonical_join", """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date, o_totalprice AS amount, CAST(event_id AS VARCHAR) AS campaign_id, channel, sent_date FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 0) ON c_custkey = o_custkey
LEFT JOIN (SELECT event_id, user_id, lower(event_type) AS channel, ts AS sent_date FROM events WHERE event_type = 'purchase') ON user_id = c_custkey""")
def k9(t):
    sends = canonical.marketing(t("events").where("event_type = 'purchase'"), {"campaign_id": "event_id", "customer_id": "user_id", "channel": "event_type", "sent_date": "ts"}, ["ts"]).select("campaign_id", "customer_id", "channel", "sent_date")
    return keys.canonical_join(t("customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_mktsegment"), _orders(t), sends)


@query("k5_union", "SELECT event_id, value, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, user_id FROM events WHERE event_id % 2 = 1")
def k5(t):
    return keys.union_tables(t("events").where("event_id % 2 = 0").select("event_id", "value"), t("events").where("event_id % 2 = 1").select("user_id", "event_id", "value"))


@query("k6_common_columns", "SELECT event_id, value FROM events")
def k6(t):
    return keys.common_columns(t("events").select("event_id", "props", "value"), t("events").select("value", "ts", "event_id"))[0]


@query("k13_confidence_sample", "SELECT event_id, value FROM events ORDER BY value NULLS LAST, event_id LIMIT 25")
def k13(t):
    return keys.sample_by_confidence(t("events").select("event_id", "value"), "value", "event_id", 25)


@query("p15_with_target", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE value IS NOT NULL")
def p15(t):
    return keys.with_target(t("events"), "value", ["props"])


@query("k10_nearest", "SELECT v.t AS moment, (SELECT event_id FROM events ORDER BY abs(floor(epoch(ts)) - v.t), floor(epoch(ts)), event_id LIMIT 1) AS event_id FROM (VALUES (1704200000.0), (1705000000.0)) v(t)")
def k10(t):
    rows = t("events").select((F.unix_timestamp("ts")).cast("double").alias("s"), "event_id").groupBy("s").agg(F.min("event_id").alias("event_id"))
    return keys.nearest(rows, "s", [1704200000.0, 1705000000.0]).select(F.col("at").alias("moment"), "event_id")


@query("k11_top_values", """SELECT * FROM (SELECT col AS "column", value, n AS count, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value NULLS FIRST) AS INTEGER) AS rank FROM (
SELECT 'event_type' AS col, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)) WHERE rank <= 10""")
def k11(t):
    return keys.top_values(t("events"), ["event_type", "user_id"])


@query("k12_newest", "SELECT user_id, event_type, event_id, rank FROM (SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def k12(t):
    return keys.newest(t("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")]).drop("ts")


DRAW = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT)"


@query("k15_split", f"SELECT o_orderkey, o_orderstatus, CASE WHEN {DRAW} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM orders")
def k15(t):
    return keys.hashed_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("k15_stratified", f"SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {DRAW}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def k15s(t):
    return keys.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("k15_time_split", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'test' ELSE 'train' END AS split FROM orders")
def k15t(t):
    return keys.time_split(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-01-01").drop("o_orderdate")


@query("k14_stratified_quota", f"SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {DRAW}, o_orderkey) AS r, round(count(*) OVER (PARTITION BY o_orderstatus) / (SELECT count(*) FROM orders) * 500) AS q FROM orders) WHERE r <= q")
def k14(t):
    return keys.stratified_quota(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 500)


@query("t1_missing_markers", "SELECT doc_id, CASE WHEN trim(lang) IN ('', 'na', 'NA', 'Na', '-') THEN NULL ELSE trim(lang) END AS lang FROM documents")
def t1(t):
    return t("documents").select("doc_id", clean.missing_to_null(F.col("lang")).alias("lang"))


@query("t6_money", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def t6(t):
    return t("orders").select("o_orderkey", clean.money(F.concat(F.lit("$"), F.col("o_totalprice").cast("string"))).alias("amount"))


@query("t9_slug", "SELECT p_partkey, nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM part")
def t9(t):
    return t("part").select("p_partkey", clean.slug(F.col("p_name")).alias("slug"))


@query("t12_date_features", """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, isodow(o_orderdate) - 1 AS dow, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend,
CASE WHEN day(o_orderdate) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN last_day(o_orderdate) = CAST(o_orderdate AS DATE) THEN 1 ELSE 0 END AS is_month_end,
CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate)) / 86400) AS BIGINT) AS recency_days FROM orders""")
def t12(t):
    return features.date_features(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("t19_mask_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
'\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b', '[phone]', 'g'), '\b(?:\d[ -]*?){13,19}\b', '[card]', 'g') AS text FROM documents""")
def t19(t):
    return t("documents").select("doc_id", clean.mask_text(F.col("text")).alias("text"))


@query("t20_pii_scan", " UNION ALL ".join(rf"""SELECT '{c}' AS "column", avg(CASE WHEN regexp_full_match({c}, '[^@\s]+@[^@\s]+\.[^@\s]{{2,}}') THEN 1.0 ELSE 0 END) AS email, avg(CASE WHEN regexp_full_match({c}, '\+?[\d\-\s().]{{7,}}') THEN 1.0 ELSE 0 END) AS phone,
avg(CASE WHEN regexp_full_match({c}, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}') THEN 1.0 ELSE 0 END) AS ipv4 FROM documents WHERE {c} IS NOT NULL""" for c in ("text", "source")))
def t20(t):
    return profile.pii_scan(t("documents"), ["text", "source"])


@query("t22_salted_hash", "SELECT c_custkey, sha256(c_name || 'pepper') AS c_name_hashed FROM customer")
def t22(t):
    return t("customer").select("c_custkey", clean.salted_hash(F.col("c_name"), "pepper").alias("c_name_hashed"))


@query("t22_keyed_hash", """WITH k AS (SELECT rpad('key', 64, chr(0)) AS key), p AS (SELECT unhex(string_agg(printf('%02x', xor(ascii(key[i]), 54)), '' ORDER BY i)) AS ip, unhex(string_agg(printf('%02x', xor(ascii(key[i]), 92)), '' ORDER BY i)) AS op FROM k, range(1, 65) r(i))
SELECT c_custkey, sha256(op || unhex(sha256(ip || encode(c_name)))) AS c_name_hashed FROM customer, p""")
def t22k(t):
    return t("customer").select("c_custkey", clean.keyed_hash(F.col("c_name"), b"key").alias("c_name_hashed"))


@query("t27_risk_tier", "SELECT event_id, CASE WHEN value / 100 >= .8 THEN 'Extreme' WHEN value / 100 >= .5 THEN 'High' WHEN value / 100 >= .2 THEN 'Medium' ELSE 'Low' END AS tier FROM events")
def t27(t):
    return t("events").select("event_id", clean.risk_tier(F.col("value") / 100).alias("tier"))


@query("a1_health", f"""SELECT * FROM (SELECT 'warn' AS severity, 'o_orderdate' AS field, 'in the future' AS message, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1999-01-01') AS count FROM orders
UNION ALL SELECT 'warn', 'o_totalprice', 'negative', count(*) FILTER (WHERE o_totalprice < 0) FROM orders UNION ALL SELECT 'error', 'o_orderkey', 'missing', count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders) WHERE count > 0""")
def a1(t):
    return profile.health(t("orders"), "o_orderkey", "o_orderdate", "o_totalprice", "1999-01-01")


def _numeric_report(table: str, c: str) -> str:
    quantiles = ", ".join(f"CAST(quantile_cont({c}, {q}) AS DOUBLE) AS p{100 * q:02.0f}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, count({c}) AS non_nulls, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) AS null_rate, count(DISTINCT {c}) AS "distinct", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, {quantiles}, CAST(NULL AS INTEGER) AS min_len, CAST(NULL AS INTEGER) AS max_len, CAST(NULL AS DOUBLE) AS avg_len FROM {table}"""


def _text_report(table: str, c: str) -> str:
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min", "max", "mean", "p05", "p25", "p50", "p75", "p95"))
    return f"""SELECT '{c}' AS "column", 'text' AS kind, count({c}) AS non_nulls, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) AS null_rate, count(DISTINCT {c}) AS "distinct", {nulls}, CAST(min(length({c})) AS INTEGER) AS min_len, CAST(max(length({c})) AS INTEGER) AS max_len, avg(length({c})) AS avg_len FROM {table}"""


@query("a2_column_report", " UNION ALL ".join([*[_numeric_report("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")], _text_report("lineitem", "l_returnflag")]))
def a2(t):
    return profile.column_report(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"], exact=True)


@query("a1_dataset_health", """SELECT count(*) AS row_count, count(*) FILTER (WHERE value IS NULL OR user_id IS NULL) AS missing_required, sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) / (count(*) * 6) AS null_rate, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date, count(*) - count(DISTINCT user_id) AS duplicate_keys FROM events""")
def a1d(t):
    return profile.dataset_health(t("events"), "user_id", ["value", "user_id"], ["when", "ts"])[0]


@query("a3_issues", """WITH r AS (SELECT lower(event_type) || CASE WHEN event_id % 3 = 0 THEN '@x.org' ELSE '@x' END AS email, value - 5 AS amount, ts FROM events), i AS (SELECT 'error' AS severity, 'coupon' AS field, 'Missing required values' AS message, count(*) AS count FROM r
UNION ALL SELECT 'error', 'email', 'Invalid email format', count(*) FILTER (WHERE NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) FROM r UNION ALL SELECT 'error', 'amount', 'Negative amounts found', count(*) FILTER (WHERE amount < 0) FROM r UNION ALL SELECT 'warn', 'ts', 'Dates in the future detected', count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-03') FROM r)
SELECT *, CAST(row_number() OVER (ORDER BY severity, count DESC, field, message) AS INTEGER) AS rank FROM i WHERE count > 0""")
def a3(t):
    raw = t("events").select(F.concat(F.lower("event_type"), F.when(F.col("event_id") % 3 == 0, "@x.org").otherwise("@x")).alias("email"), (F.col("value") - 5).alias("amount"), "ts")
    return profile.dataset_health(raw, None, ["coupon"], ["ts"], "2024-01-03")[1]


@query("a4_iqr_outliers", """WITH q AS (SELECT quantile_cont(l_extendedprice, .25) AS a, quantile_cont(l_extendedprice, .75) AS b FROM lineitem)
SELECT 'l_extendedprice' AS "column", count(*) FILTER (WHERE l_extendedprice < 2.5 * a - 1.5 * b OR l_extendedprice > 2.5 * b - 1.5 * a) AS outliers FROM lineitem, q""")
def a4(t):
    return profile.iqr_outliers(t("lineitem"), ["l_extendedprice"])


@query("a6_null_rate", "SELECT (count(*) - count(value) + count(*) - count(props)) / (2.0 * count(*)) AS null_rate FROM events")
def a6(t):
    return profile.null_rate(t("events").select("value", "props"))


@query("a18_customer_aggregate", f"SELECT customer_id, total_spent, first_activity, last_activity, visits, days_active FROM ({AGG})")
def a18(t):
    return _agg(t)


LIFETIME = "CAST(floor((epoch(last_activity) - epoch(first_activity)) / 86400) AS BIGINT)"


@query("a19_kpis", f"""SELECT customer_id, total_spent / visits * (visits / days_active) * (days_active / 30) AS clv, total_spent / visits AS revenue_per_customer, total_spent / visits AS aov, visits / days_active AS purchase_frequency, CASE WHEN idle > 60 THEN 1 ELSE 0 END AS churn,
{LIFETIME} AS customer_lifetime, idle AS recency, visits / days_active * 0.6 + 0.4 / greatest(idle, 1) AS loyalty_score, visits / days_active AS engagement_score, CASE WHEN visits > 1 THEN 1 ELSE 0 END AS repeat_purchase_rate,
CASE WHEN idle > 90 THEN 1 ELSE 0 END AS inactivity_risk_score, CASE WHEN total_spent > 500 THEN 1 ELSE 0 END AS vip_flag, total_spent / visits + 2 * days_active AS custom FROM ({AGG})""")
def a19(t):
    agg = _agg(t)
    named = ("clv", "revenue_per_customer", "aov", "purchase_frequency", "churn", "customer_lifetime", "recency", "loyalty_score", "engagement_score", "repeat_purchase_rate", "inactivity_risk_score", "vip_flag")
    return agg.select("customer_id", *[kpi.kpi(k, AS_OF).alias(k) for k in named], kpi.kpi("total_spent / visits + 2 * days_active", AS_OF, columns=agg.columns).alias("custom"))


@query("a19_profit", f"SELECT a.customer_id, total_spent * m.margin AS profit_per_customer FROM ({AGG}) a LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS c, round(avg(l_discount), 6) AS margin FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) m ON a.customer_id = m.c")
def a19p(t):
    lines = t("lineitem").select("l_orderkey", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    agg = _agg(t).join(kpi.mean_margin(lines, "o_custkey", F.col("l_discount")), "customer_id", "left")
    return agg.select("customer_id", kpi.kpi("profit_per_customer", AS_OF).alias("profit_per_customer"))


FLAGS = f"""WITH a AS (SELECT *, total_spent / visits * (visits / days_active) * (days_active / 30) AS clv FROM ({AGG})), e AS (SELECT min(clv) AS c0, max(clv) AS c1, min(idle) AS r0, max(idle) AS r1 FROM a)
SELECT customer_id, total_spent, clv, idle AS recency, CASE WHEN total_spent > 250000 THEN 1 ELSE 0 END AS is_vip, CASE WHEN idle > 90 THEN 1 ELSE 0 END AS is_at_risk,
coalesce(0.7 * ((clv - c0) / nullif(c1 - c0, 0)) + 0.3 * (1 - (idle - r0) / nullif(r1 - r0, 0)), 0) AS upsell_score FROM a, e"""


@query("a20_flags", FLAGS)
def a20(t):
    return kpi.customer_flags(_agg(t), AS_OF, 250_000)


@query("a21_customer_summary", f"SELECT count(*) AS total_customers, count(*) FILTER (WHERE is_vip = 1) AS vip_count, count(*) FILTER (WHERE is_at_risk = 1) AS at_risk_customers, count(*) FILTER (WHERE upsell_score > 0.7) AS high_upsell_score, round(avg(clv), 2) AS average_clv, round(avg(recency), 2) AS average_recency FROM ({FLAGS})")
def a21(t):
    return kpi.customer_summary(kpi.customer_flags(_agg(t), AS_OF, 250_000))


AB = "SELECT l_returnflag AS variant, count(*) AS total_users, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS conversions FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1"
CHI = """s AS (SELECT sum(total_users) AS n, sum(conversions) AS c, count(*) AS k FROM t),
x AS (SELECT sum(power(conversions - total_users * c / n, 2) / (total_users * c / n) + power(conversions - total_users * c / n, 2) / (total_users * (n - c) / n)) AS chi2, max(k) - 1 AS df FROM t, s)"""


def _ab(t) -> DataFrame:
    return kpi.ab_table(t("lineitem"), "l_returnflag", F.col("l_linestatus") == "F")


@query("a22_ab_table", f"SELECT variant, total_users, conversions, conversions / total_users AS conversion_rate FROM ({AB})")
def a22(t):
    return _ab(t)


@query("a22_ab_chi_square", f"WITH t AS ({AB}), {CHI} SELECT chi2, df FROM x")
def a22c(t):
    return kpi.ab_chi_square(_ab(t))


@query("a22_ab_test", f"""WITH t AS ({AB}), {CHI}, b AS (SELECT max(conversions / total_users) AS best, min(conversions / total_users) AS low FROM t)
SELECT (SELECT min(variant) FROM t, b WHERE conversions / total_users = best) AS winner, best - low AS lift, chi2, df, exp(-chi2 / 2) AS p_value FROM x, b""")
def a22t(t):
    return kpi.ab_test(_ab(t))


@query("a22_ab_two_variants", """WITH t AS (SELECT l_linestatus AS variant, count(*) AS u, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM lineitem GROUP BY 1), s AS (SELECT sum(u) AS n, sum(c) AS k FROM t)
SELECT sum(power(greatest(abs(c - u * k / n) - least(0.5, abs(c - u * k / n)), 0), 2) * (1 / (u * k / n) + 1 / (u * (n - k) / n))) AS chi2, CAST(1 AS BIGINT) AS df FROM t, s""")
def a22y(t):
    return kpi.ab_chi_square(kpi.ab_table(t("lineitem"), "l_linestatus", F.col("l_quantity") > 25))


@query("a23_crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def a23(t):
    return profile.crosstab(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("a24_segment_stats", " UNION ALL ".join(f"SELECT c_mktsegment AS segment, '{c}' AS feature, round(avg({c}), 2) AS mean, round(quantile_cont({c}, .5), 2) AS median, round(stddev_samp({c}), 2) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM customer GROUP BY 1" for c in ("c_acctbal", "c_nationkey")))
def a24(t):
    return profile.segment_statistics(t("customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])


@query("a28_risk_metrics", "SELECT avg(value / 100) AS mean, quantile_cont(value / 100, .5) AS median, min(value / 100) AS min, max(value / 100) AS max, stddev_pop(value / 100) AS std, count(*) FILTER (WHERE value / 100 > .7) AS high_count, 100 * count(*) FILTER (WHERE value / 100 > .7) / count(value) AS high_pct FROM events")
def a28(t):
    return profile.risk_metrics(t("events"), F.col("value") / 100)


@query("a29_histogram", """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), n AS (SELECT least(CAST(floor((o_totalprice - a) / (b - a) * 20) AS INTEGER), 19) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, a + i * ((b - a) / 20) AS low, a + (i + 1) * ((b - a) / 20) AS high, coalesce(n, 0) AS n FROM e, range(20) r(i) LEFT JOIN n ON bin = i""")
def a29(t):
    return profile.histogram(t("orders"), "o_totalprice")


@query("a32_billing", "SELECT event_id, 74.1 * ln(1 + value / 1000) + 0.5 * value / 60 AS cost, sum(74.1 * ln(1 + value / 1000) + 0.5 * value / 60) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def a32(t):
    return kpi.usage_billing(t("events"), "user_id", ["ts", "event_id"], F.col("value") / 1000, F.col("value") / 60).select("event_id", "cost", "running")


@query("w1_difference", "SELECT o_custkey, o_orderkey, d AS diff FROM (SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL")
def w1(t):
    return series.differences(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "diff")


DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS y FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2"


@query("w2_lag_matrix", f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM (SELECT user_id, day, y, {', '.join(f'lag(y, {i}) OVER (PARTITION BY user_id ORDER BY day) AS lag_{i}' for i in range(1, 6))} FROM ({DAILY})) WHERE lag_5 IS NOT NULL")
def w2(t):
    return series.lag_matrix(series.daily(t("events"), "user_id", "ts", "value"), "user_id", "day", "y").withColumn("day", F.col("day").cast("string"))


@query("w6_rare_values", "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) <= greatest(10, ceil(.001 * (SELECT count(*) FROM orders))) THEN '__RARE__' ELSE CAST(o_custkey AS VARCHAR) END AS c FROM orders")
def w6(t):
    return features.rare_to_token(t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c")), "c")


@query("w7_capped", "WITH q AS (SELECT quantile_cont(o_totalprice, .01) AS a, quantile_cont(o_totalprice, .99) AS b FROM orders) SELECT o_orderkey, o_totalprice, least(greatest(o_totalprice, a), b) AS o_totalprice_capped FROM orders, q")
def w7(t):
    return features.capped(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("w5_quantile_bins", f"""WITH q AS (SELECT quantile_cont(o_totalprice, [{', '.join(str(i / 10) for i in range(11))}]) AS e FROM orders)
SELECT o_orderkey, o_totalprice, CAST(len(list_filter(e[2:10], lambda x: x < o_totalprice)) AS INTEGER) AS bin FROM orders, q""")
def w5(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return o.withColumn("bin", features.bin_by_edges(F.col("o_totalprice"), features.quantile_edges(o, "o_totalprice")))


# The table of CRC-32, and a token's CRC from it.
CRC = "tab AS (SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"
CRC_OF = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(token, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT))"


@query("f3_text_hash", f"""WITH {CRC}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM documents), h AS (SELECT token, CAST({CRC_OF} % 1024 AS BIGINT) AS bucket FROM (SELECT DISTINCT token FROM w), tab) SELECT doc_id, bucket, count(*) AS n FROM w JOIN h USING (token) GROUP BY 1, 2""")
def f3(t):
    return features.text_hash_counts(t("documents"), "doc_id", "text")


@query("f11_scaled", "SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS c_acctbal FROM customer")
def f11(t):
    return features.scaled(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


SCORED = "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(value / 100, 1) AS p FROM events"


def _scored(t) -> DataFrame:
    return t("events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))


@query("e1_confusion", f"SELECT y, CASE WHEN p >= .5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2")
def e1(t):
    return evaluate.confusion(_scored(t).withColumn("h", (F.col("p") >= 0.5).cast("int")), "y", "h")


@query("e2_losses", f"SELECT avg(CASE WHEN (p >= .5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM ({SCORED})")
def e2(t):
    return evaluate.losses(_scored(t), "y", "p")


RELIABILITY = f"""WITH s AS (SELECT greatest(p, 1 - p) AS q, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END AS r FROM ({SCORED})), e AS (SELECT quantile_cont(q, [{', '.join(str(i / 10) for i in range(11))}]) AS e FROM s), b AS (SELECT i AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM e, range(10) r(i))
SELECT CAST(bin AS INTEGER) AS bin, (min(lo) + min(hi)) / 2 AS center, avg(q) AS conf, avg(r) AS acc, count(q) AS n FROM b LEFT JOIN s ON q >= lo AND q < hi + 1e-12 GROUP BY 1"""


@query("e3_reliability", RELIABILITY)
def e3(t):
    return evaluate.reliability_bins(_scored(t), "y", "p")


@query("e4_calibration_error", f"SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM ({RELIABILITY})")
def e4(t):
    return evaluate.calibration_error(evaluate.reliability_bins(_scored(t), "y", "p"))


@query("e5_conformal", f"SELECT y, quantile_cont(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, .9) AS threshold FROM ({SCORED}) GROUP BY y")
def e5(t):
    return evaluate.conformal_threshold(_scored(t), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), 0.1, "y")


@query("e7_decision_curve", f"""SELECT v.t AS threshold, count(*) FILTER (WHERE p >= v.t) AS volume, count(*) FILTER (WHERE p >= v.t AND y = 1) / nullif(count(*) FILTER (WHERE p >= v.t), 0) AS precision,
count(*) FILTER (WHERE p >= v.t AND y = 1) / nullif(sum(y), 0) AS recall, CAST(100 * count(*) FILTER (WHERE p >= v.t AND y = 1) - 10 * count(*) FILTER (WHERE p >= v.t AND y = 0) AS DOUBLE) AS expected_profit
FROM ({SCORED}), (SELECT CAST(i AS DOUBLE) / 10 AS t FROM range(1, 10) r(i)) v GROUP BY v.t""")
def e7(t):
    return evaluate.decision_curve(_scored(t), "y", "p")


@query("c1_change", "SELECT o_orderkey, o_totalprice * 1.1 AS raised, o_totalprice + 5 AS more, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def c1(t):
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", whatif.change(p, "percentage", 10).alias("raised"), whatif.change(p, "additive", 5).alias("more"), whatif.replace_category(F.col("o_orderstatus"), "O", "P").alias("status"))


@query("c2_rescale", "WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT c_custkey, (c_acctbal - a) / (b - a) * 10 AS c_acctbal FROM customer, e")
def c2(t):
    return whatif.rescale(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0, 10)


@query("y1_daily_series", f"SELECT user_id, CAST(day AS VARCHAR) AS day, y FROM ({DAILY})")
def y1(t):
    return series.daily(t("events"), "user_id", "ts", "value").withColumn("day", F.col("day").cast("string"))


@query("y2_regular_days", f"""WITH d AS ({DAILY}), x AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1), f AS (SELECT x.user_id, x.day, y FROM x LEFT JOIN d ON x.user_id = d.user_id AND x.day = d.day),
g AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER b AS pd, last_value(y IGNORE NULLS) OVER b AS py, first_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER a AS nd, first_value(y IGNORE NULLS) OVER a AS ny FROM f
WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, day, coalesce(y, py + (day - pd) / (nd - pd) * (ny - py)) AS y FROM g""")
def y2(t):
    return series.regular_days(series.daily(t("events"), "user_id", "ts", "value"), "user_id")


@query("y4_naive_forecast", f"SELECT user_id, CAST(CAST(max(day) + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS day, arg_max(y, day) AS forecast FROM ({DAILY}), range(1, 8) r(i) GROUP BY user_id, i")
def y4(t):
    return series.naive_forecast(series.daily(t("events"), "user_id", "ts", "value"), "user_id").withColumn("day", F.col("day").cast("string"))


@query("r1_running_health", "SELECT event_type, count(*) AS rows, count(*) - count(value) AS nulls, min(value) AS min, max(value) AS max, sum(value) AS total FROM events GROUP BY 1")
def r1(t):
    return stream_events.running_health(t("events"), "event_type", "value")


@query("r2_weekly_windows", "SELECT CAST(CAST(ts AS DATE) - CAST((isodow(ts) + 5) % 7 AS INTEGER) AS TIMESTAMP) AS week_start, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def r2(t):
    return stream_events.weekly(t("events"), "ts", "value")


@query("s9_storage_types", """SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN CASE WHEN (SELECT greatest(max(o_orderkey), max(o_custkey)) FROM orders) < 2147483648 THEN 'Integer' ELSE 'BigInteger' END WHEN column_type = 'DOUBLE' THEN 'Float' ELSE 'Text' END AS storage_type FROM (DESCRIBE orders)""")
def s9(t):
    return tables.storage_types(t("orders"))


@query("s8_preview", "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders ORDER BY o_orderkey LIMIT 10")
def s8(t):
    return tables.preview(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), ["o_orderkey"])
