"""Queries of column types and roles, JSON cells, standardised values and forecasts, with equal SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import forecast, infer, series

from .queries import DAILY, query

NUMBER = r"TRY_CAST(replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN NOT regexp_matches(ltrim(v), '^[{\[]') THEN regexp_replace(trim(v), '%+$', '') END, '[\"''\s]', '', 'g'), '[()%$€£¥₹]', '', 'g'), '^(USD|EUR|GBP|JPY|INR|CAD|AUD)|(USD|EUR|GBP|JPY|INR|CAD|AUD)$', '', 'gi'), ',', '') AS DOUBLE)"
TESTS = {
    "email": r"regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$')", "phone": r"length(regexp_replace(trim(v), '\D', '', 'g')) >= 10 AND NOT regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(trim(v), '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$')",
    "url": r"regexp_matches(v, '(?i)^(?:https?://|www\.)\S+$')", "ipv4": r"regexp_matches(v, '^(?:\d{1,3}\.){3}\d{1,3}$')", "boolean": "lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', '1', '0')", "zero_one": "trim(v) IN ('0', '1')",
    "json": r"regexp_matches(ltrim(v), '^[{\[]') AND json_valid(v)", "timestamp": r"regexp_matches(trim(v), '[-/:]') AND NOT regexp_matches(ltrim(v), '^[{\[]') AND TRY_CAST(trim(v) AS TIMESTAMP) IS NOT NULL", "symbol": "regexp_matches(v, '[$€£¥]')", "numeric": f"{NUMBER} IS NOT NULL",
    "digits": r"regexp_matches(v, '^\d+$')", "short": "length(v) <= 64", "from_0_to_1": f"coalesce({NUMBER} BETWEEN 0 AND 1, false)", "from_0_to_100": f"coalesce({NUMBER} BETWEEN 0 AND 100, false)", "over_1": f"coalesce({NUMBER} > 1, false)", "uuid": r"regexp_matches(v, '^[0-9a-fA-F\-]{16,}$')", "hyphen": "contains(v, '-')",
    "epoch": f"coalesce({NUMBER} BETWEEN 1e9 AND 1e10 OR {NUMBER} BETWEEN 1e12 AND 1e13, false)", "point": "contains(v, '.')",
}


def _facts_sql(table: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS v FROM {table}""" for c in columns)
    rates = ", ".join(f"coalesce(avg(CASE WHEN {t} THEN 1.0 ELSE 0 END) FILTER (WHERE v IS NOT NULL), 0) AS {name}" for name, t in TESTS.items())
    return f"""SELECT "column", count(*) AS rows, count(v) AS non_nulls, count(DISTINCT v) AS "distinct", coalesce(count(DISTINCT v) / nullif(count(v), 0), 0) AS unique_ratio, coalesce(avg(length(v)), 0) AS avg_len, {rates} FROM ({cells}) GROUP BY 1"""


SEMANTIC = """CASE WHEN email > 0.6 THEN {0} WHEN timestamp > 0.5 THEN {1} WHEN phone > 0.6 THEN {2} WHEN url > 0.6 THEN {3} WHEN ipv4 > 0.6 THEN {4} WHEN boolean > 0.8 OR zero_one > 0.95 THEN {5} WHEN json > 0.6 THEN {6}
WHEN unique_ratio > 0.9 AND email < 0.2 AND phone < 0.2 AND timestamp < 0.2 AND short > 0.7 AND (numeric < 0.3 OR digits > 0.9) THEN {7} WHEN symbol > 0.1 THEN {8}
WHEN "column" IN ('amount', 'revenue', 'price', 'value', 'total', 'charge', 'cost', 'net', 'gross', 'amt', 'order_amount') AND numeric > 0.85 THEN {9} WHEN contains("column", 'rate') AND numeric > 0.5 THEN {10} WHEN numeric > 0.85 THEN {11} WHEN unique_ratio <= 0.05 AND "distinct" <= 50 THEN {12} WHEN avg_len > 40 THEN {13} ELSE {14} END"""
NAMES = [f"'{n}'" for n in ("email", "timestamp", "phone", "url", "ip", "boolean", "json", "id", "money", "money", "percent", "numeric", "categorical", "text", "categorical")]
VALUES = ["email", "timestamp", "phone", "url", "ipv4", "greatest(boolean, zero_one)", "json", "unique_ratio", "symbol", "numeric", "numeric", "numeric", "1 - unique_ratio", "0.6", "0.5"]


def _types_sql(table: str, columns: list[str]) -> str:
    return f"""SELECT "column", {SEMANTIC.format(*NAMES)} AS semantic, CAST({SEMANTIC.format(*VALUES)} AS DOUBLE) AS valid_rate, unique_ratio, false AS suspect FROM ({_facts_sql(table, columns)})"""


EVENTS, LINES = ["event_id", "ts", "user_id", "event_type", "value", "props"], ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


@query("a7_types_events", _types_sql("events", EVENTS))
def a7(t):
    return infer.semantic_types(infer.column_facts(t("events"), EVENTS))


@query("a7_types_customers", _types_sql("(SELECT *, lower(replace(c_name, '#', '@')) || '.org' AS mail, '$' || c_acctbal AS money, 'www.x.org/' || c_name AS page, c_custkey % 2 AS flag FROM customer)", ["mail", "money", "page", "flag", "c_mktsegment"]))
def a7c(t):
    made = {"mail": F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("@"))), F.lit(".org")), "money": F.concat(F.lit("$"), F.col("c_acctbal").cast("string")), "page": F.concat(F.lit("www.x.org/"), F.col("c_name")), "flag": F.col("c_custkey") % 2}
    return infer.semantic_types(infer.column_facts(t("customer").withColumns(made), ["mail", "money", "page", "flag", "c_mktsegment"]))


ROLE = """CASE WHEN (non_nulls <= 0.02 * rows OR "distinct" <= 1) AND NOT regexp_matches("column", '(?:^id|_id)$') AND unique_ratio < 0.9 THEN 'Ignore' WHEN kind = 'time' OR (kind = 'text' AND timestamp >= 0.6) THEN 'Date'
WHEN non_nulls > 0 AND email <= 0.3 AND url <= 0.3 AND ipv4 <= 0.3 AND NOT (kind = 'double' AND point > 0.2) AND unique_ratio >= CASE WHEN regexp_matches("column", '(?:^id|_id)$') OR uuid > 0.5 OR hyphen > 0.3 THEN 0.85 ELSE 0.95 END AND avg_len <= CASE WHEN uuid > 0.5 OR hyphen > 0.3 THEN 80 ELSE 64 END THEN 'ID'
WHEN kind IN ('double', 'int') THEN CASE WHEN "distinct" >= 30 OR "distinct" / rows >= 0.05 OR regexp_matches("column", 'age|tenure|amount|price|cost|revenue|qty|quantity|score|margin|days|duration|time|rate') THEN 'Numerical' ELSE 'Categorical' END
WHEN "distinct" > 30 AND "distinct" / rows > 0.05 AND avg_len >= 20 THEN 'Text' ELSE 'Categorical' END"""


def _roles_sql(table: str, kinds: dict[str, str]) -> str:
    kind = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in kinds.items()) + " END"
    return f"""SELECT "column", {ROLE} AS role FROM (SELECT *, {kind} AS kind FROM ({_facts_sql(table, list(kinds))}))"""


@query("a8_roles_events", _roles_sql("events", {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "double", "props": "text"}))
def a8(t):
    return infer.column_roles(infer.column_facts(t("events"), EVENTS))


@query("a8_roles_lines", _roles_sql("lineitem", dict(zip(LINES, ["int", "double", "double", "double", "text", "time"], strict=True))))
def a8l(t):
    return infer.column_roles(infer.column_facts(t("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), LINES))


@query("t17_json_cells", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def t17(t):
    return infer.expand_json(t("events").select("event_id", "props"))


@query("t17_nested_json", """SELECT event_id, 1 AS "j.v", CAST(json_extract(props, '$.k') AS BIGINT) AS "j.in.k", event_type AS "j.in.kind", CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ',1]' END AS "j.list", value AS "j.v_2" FROM events""")
def t17n(t):
    kind = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind"))
    cell = F.to_json(F.struct(kind.alias("in"), F.when(F.col("event_id") % 2 == 0, F.array("event_id", F.lit(1).cast("long"))).alias("list"), F.col("value").alias("v")))
    return infer.expand_json(t("events").select("event_id", cell.alias("j"), F.lit(1).alias("j.v")), ["j"])


@query("t18_standardized", r"""SELECT event_id, ts, value * 1 AS value_num, CASE WHEN (SELECT avg(CASE WHEN user_id % 90 > 1 THEN 1.0 ELSE 0 END) FROM events) > 0.5 THEN (user_id % 90) / 100 ELSE user_id % 90 END AS share_rate, lower(replace(event_type, '_', '-')) AS event_type_slug, event_id % 2 = 0 AS flag, lower(event_type) || '@x.org' AS mail FROM events""")
def t18(t):
    yes = F.when(F.col("event_id") % 2 == 0, " Yes").otherwise("F")
    raw = t("events").select("event_id", F.col("ts").cast("string").alias("ts"), F.concat(F.lit("$"), F.col("value").cast("string")).alias("value"), F.concat((F.col("user_id") % 90).cast("string"), F.lit("%")).alias("share"), "event_type", yes.alias("flag"), F.concat(F.lit(" "), F.upper("event_type"), F.lit("@x.org")).alias("mail"))
    types = {"ts": "timestamp", "value": "money", "share": "percent", "event_type": "categorical", "flag": "boolean", "mail": "email"}
    out = infer.standardized(raw.withColumn("share", F.regexp_replace("share", "%", "")), types)
    return out.select("event_id", "ts", "value_num", "share_rate", "event_type_slug", "flag", "mail")


DAYS = f"SELECT * FROM ({DAILY}) WHERE user_id IS NOT NULL"


@query("y3_spikes", f"""WITH d AS ({DAILY}), m AS (SELECT user_id, quantile_cont(y, .5) AS m FROM d GROUP BY 1), a AS (SELECT d.user_id, quantile_cont(abs(y - m), .5) AS mad FROM d JOIN m USING (user_id) GROUP BY 1),
g AS (SELECT d.user_id, day, CASE WHEN coalesce(0.6745 * abs(y - m) / nullif(mad, 0) > 2, false) THEN NULL ELSE y END AS y FROM d JOIN m USING (user_id) JOIN a USING (user_id)),
f AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER b AS pd, last_value(y IGNORE NULLS) OVER b AS py, first_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS) OVER n AS nd, first_value(y IGNORE NULLS) OVER n AS ny FROM g
  WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT user_id, day, coalesce(y, py + (day - pd) / (nd - pd) * (ny - py), py, ny) AS y FROM f), e AS (SELECT user_id, quantile_cont(y, .001) AS lo, quantile_cont(y, .999) AS hi FROM i GROUP BY 1)
SELECT user_id, CAST(day AS VARCHAR) AS day, greatest(least(y, hi), lo) AS y FROM i JOIN e USING (user_id)""")
def y3(t):
    return series.spikes_removed(series.daily(t("events"), "user_id", "ts", "value"), "user_id", 2.0).withColumn("day", F.col("day").cast("string"))


@query("y5_lag_forest")
def y5(t):
    return forecast.lag_forest_forecast(series.daily(t("events"), "user_id", "ts", "value"), "user_id", "day", "y")


@query("y6_holt_winters")
def y6(t):
    return forecast.holt_winters_forecast(series.daily(t("events"), "user_id", "ts", "value"), "user_id", "day", "y", season=7)
