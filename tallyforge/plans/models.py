"""Queries of clustering, fold training, survival, anomalies and counterfactuals, with equal SQL where SQL can say it."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, cluster, evaluate, features, kpi, models, prepare, survival

from .queries import SCORED, _scored, query

STARTS = [[-0.5, 2.0], [2.0, 20.0], [5.0, 6.0], [8.0, 15.0]]


def _points(t) -> DataFrame:
    return t("customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


def _kmeans_sql(steps: int) -> str:
    """Lloyd's steps, written out one by one."""
    parts = ["p AS (SELECT c_custkey, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)", "s0 AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for j, (a, b) in enumerate(STARTS)) + ") v(j, a, b))"]
    near = "SELECT c_custkey, x, y, arg_min(j, (power(x - a, 2) + power(y - b, 2), j)) AS j FROM p, {s} GROUP BY ALL"
    for i in range(steps):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT s.j, coalesce(m.a, s.a) AS a, coalesce(m.b, s.b) AS b FROM s{i} s LEFT JOIN (SELECT j, avg(x) AS a, avg(y) AS b FROM ({near.format(s=f's{i}')}) GROUP BY j) m USING (j))")
    return "WITH " + ", ".join(parts) + f" SELECT c_custkey, j AS cluster FROM ({near.format(s=f's{steps}')})"


@query("m5_kmeans", _kmeans_sql(6))
def m5(t):
    centres = cluster.lloyd(_points(t), ["x", "y"], {4: STARTS}, steps=6, tolerance=0.0)
    return cluster.kmeans(_points(t), ["x", "y"], centres[4]).select("c_custkey", "cluster")


@query("m5_k_curve")
def m5k(t):
    scaled = features.scaled(t("customer").select("c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])
    return cluster.k_curve(scaled, ["c_acctbal", "c_nationkey"])[0]


@query("m6_cluster_metrics", """WITH p AS (SELECT event_type AS c, value AS x, CAST(user_id AS DOUBLE) AS y FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, avg(x) AS a, avg(y) AS b, var_pop(x) + var_pop(y) AS v FROM p GROUP BY 1),
g AS (SELECT avg(x) AS a, avg(y) AS b, count(*) AS n FROM p), k AS (SELECT count(*) AS k FROM s),
d AS (SELECT p.c, q.c AS o, p.x, p.y, power(p.x - q.a, 2) + power(p.y - q.b, 2) + q.v AS d, q.n, q.v FROM p, s q),
r AS (SELECT c, x, y, min(d) FILTER (WHERE o <> c) AS b, min(d * n / (n - 1)) FILTER (WHERE o = c) AS a, min(sqrt(greatest(d - v, 0))) FILTER (WHERE o = c) AS f, min(n) FILTER (WHERE o = c) AS n FROM d GROUP BY ALL),
q AS (SELECT sum(m * (b - a) / greatest(a, b)) / sum(m) AS silhouette FROM (SELECT r.*, m FROM r JOIN (SELECT c, x, y, count(*) AS m FROM p GROUP BY ALL) u USING (c, x, y))),
h AS (SELECT c, avg(sqrt(power(x - a, 2) + power(y - b, 2))) AS f FROM p JOIN s USING (c) GROUP BY 1),
db AS (SELECT avg(w) AS davies_bouldin FROM (SELECT i.c, max((hi.f + hj.f) / sqrt(power(i.a - j.a, 2) + power(i.b - j.b, 2))) AS w FROM s i JOIN s j ON i.c <> j.c JOIN h hi ON hi.c = i.c JOIN h hj ON hj.c = j.c GROUP BY 1))
SELECT any_value(k.k) AS clusters, any_value(g.n) AS rows, sum(s.n * s.v) AS inertia, any_value(silhouette) AS silhouette,
  sum(s.n * (power(s.a - g.a, 2) + power(s.b - g.b, 2))) / (any_value(k.k) - 1) / (sum(s.n * s.v) / (any_value(g.n) - any_value(k.k))) AS calinski_harabasz, any_value(davies_bouldin) AS davies_bouldin FROM s, g, k, q, db""")
def m6(t):
    return cluster.cluster_metrics(t("events").select("event_type", "value", F.col("user_id").cast("double").alias("user_id")), ["value", "user_id"], "event_type")


@query("a26_segment_names", """WITH m AS (SELECT quantile_cont(c_acctbal, .5) AS a, quantile_cont(c_nationkey, .5) AS b FROM customer), s AS (SELECT c_mktsegment, CASE WHEN avg(c_acctbal) > min(a) THEN 'High' ELSE 'Low' END || ' c acctbal & ' || CASE WHEN avg(c_nationkey) > min(b) THEN 'High' ELSE 'Low' END || ' c nationkey' AS segment_name FROM customer, m GROUP BY 1)
SELECT c_custkey, c_mktsegment, segment_name FROM customer JOIN s USING (c_mktsegment)""")
def a26(t):
    return cluster.segment_names(t("customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]).select("c_custkey", "c_mktsegment", "segment_name")


@query("m7_projection", """WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b FROM customer), r AS (SELECT CASE WHEN avg(a * b) >= 0 THEN 1 ELSE -1 END AS s FROM z)
SELECT c_custkey, (a + s * b) / sqrt(2) AS pc1, (a - s * b) / sqrt(2) AS pc2 FROM z, r""")
def m7(t):
    scaled = features.scaled(t("customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b")), ["a", "b"])
    return cluster.principal_components(scaled, ["a", "b"]).select("c_custkey", "pc1", "pc2")


# Customers' lives: months between first and last order, an end if the last one is old.
LIVES = """SELECT o_custkey, greatest((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 2630016.0, 0.001) AS months, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-03-01' THEN 1 ELSE 0 END AS ended,
CAST(count(*) AS DOUBLE) AS visits, avg(o_totalprice) / 100000 AS price, exp(0.1 * (count(*) - 10) - 0.2 * (avg(o_totalprice) / 100000 - 2.5)) AS hazard FROM orders GROUP BY 1"""
CURVE = f"""SELECT t AS time, events, at_risk, sum(events / at_risk) OVER (ORDER BY t) AS cumulative_hazard, exp(-sum(events / at_risk) OVER (ORDER BY t)) AS survival
FROM (SELECT months AS t, CAST(sum(ended) AS DOUBLE) AS events, sum(sum(hazard)) OVER (ORDER BY months DESC) AS at_risk FROM ({LIVES}) GROUP BY 1)"""


def _lives(t) -> DataFrame:
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    agg = t("orders").groupBy("o_custkey").agg(F.greatest(survival.months_between(first, last), F.lit(0.001)).alias("months"), (last < F.lit("2001-03-01").cast("timestamp")).cast("int").alias("ended"), F.count("*").cast("double").alias("visits"), (F.avg("o_totalprice") / 100000).alias("price"))
    return agg.withColumn("hazard", F.exp(0.1 * (F.col("visits") - 10) - 0.2 * (F.col("price") - 2.5)))


@query("v1_survival_table", """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 5 END AS months, value, event_type FROM events), m AS (SELECT quantile_cont(months, .5) AS mm, quantile_cont(value, .5) AS mv FROM r)
SELECT event_id, greatest(coalesce(months, mm), 0.001) AS months, coalesce(value, mv) AS value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ended FROM r, m""")
def v1(t):
    word = F.when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "click", "alive").otherwise("other")
    raw = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") - 5).alias("months"), "value", word.alias("ended"))
    return survival.survival_table(raw, "months", "ended", ["value"])


@query("v2_cox")
def v2(t):
    lives = _lives(t)
    return survival.cox(lives, "months", "ended", ["visits", "price"]).table(lives)


@query("v3_baseline", CURVE)
def v3(t):
    return survival.baseline_survival(_lives(t), "months", "ended", F.col("hazard"))


@query("v3_retention", f"SELECT CAST(m AS DOUBLE) AS months, arg_min(time, (abs(time - m), time)) AS time, round(arg_min(survival, (abs(time - m), time)) * 100, 2) AS rate FROM ({CURVE}), (SELECT unnest([1, 3, 6, 60]) AS m) GROUP BY m")
def v3r(t):
    return survival.retention(survival.baseline_survival(_lives(t), "months", "ended", F.col("hazard")), [1, 3, 6, 60])


@query("v4_risk", f"SELECT o_custkey, (hazard - min(hazard) OVER ()) / (max(hazard) OVER () - min(hazard) OVER ()) AS risk_prob FROM ({LIVES})")
def v4(t):
    return survival.risk_probability(_lives(t), "hazard").select("o_custkey", "risk_prob")


@query("v5_strata", f"""WITH l AS MATERIALIZED ({LIVES}), c AS MATERIALIZED ({CURVE}), q AS (SELECT quantile_cont(hazard, .25) AS lo, quantile_cont(hazard, .75) AS hi FROM l),
d AS (SELECT l.*, lo, hi, coalesce((SELECT min(time) FROM c WHERE cumulative_hazard >= ln(2) / hazard), (SELECT max(time) FROM c)) AS life FROM l, q)
SELECT min(lo) AS low_threshold, min(hi) AS high_threshold, avg(ended) FILTER (WHERE hazard >= hi) AS high_risk_event_rate, avg(ended) FILTER (WHERE hazard <= lo) AS low_risk_event_rate, avg(ended) FILTER (WHERE hazard >= hi) - avg(ended) FILTER (WHERE hazard <= lo) AS risk_separation,
avg(ended) FILTER (WHERE hazard >= hi) AS precision, sum(ended) FILTER (WHERE hazard >= hi) / sum(ended) AS recall, quantile_cont(life, .5) AS median_life, least(greatest(1 - avg(abs(life - months)) / avg(months), 0.0), 1.0) AS time_accuracy FROM d""")
def v5(t):
    lives = _lives(t)
    return survival.risk_strata(lives, "months", "ended", "hazard", survival.baseline_survival(lives, "months", "ended", F.col("hazard")))


@query("v6_concordance", f"""WITH l AS MATERIALIZED (SELECT months AS t, ended AS e, -hazard AS s FROM ({LIVES})), p AS (SELECT a.s AS x, b.s AS y FROM l a JOIN l b ON a.e = 1 AND (a.t < b.t OR a.t = b.t AND b.e = 0))
SELECT CAST(count(*) FILTER (WHERE x < y) AS DOUBLE) AS concordant, CAST(count(*) FILTER (WHERE x = y) AS DOUBLE) AS tied, CAST(count(*) AS DOUBLE) AS pairs, (count(*) FILTER (WHERE x < y) + count(*) FILTER (WHERE x = y) / 2) / count(*) AS index FROM p""")
def v6(t):
    return survival.concordance(_lives(t).withColumn("life", -F.col("hazard")), "months", "ended", "life")


def _bought(t) -> DataFrame:
    """Orders with features, and whether they are finished."""
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"), (F.col("o_totalprice") / 1000).alias("price"), F.year("o_orderdate").cast("double").alias("year"), F.col("o_custkey").cast("double").alias("customer"))


FEATURES = ["price", "year", "customer"]


@query("m1_compare_classifiers")
def m1(t):
    candidates = {"tree": DecisionTreeClassifier(seed=42), "logistic": LogisticRegression(maxIter=20)}
    return models.compare_classifiers(_bought(t), candidates, FEATURES, "done", models.hash_fold(["o_orderkey"]))


@query("m2_score")
def m2(t):
    rows = _bought(t)
    model = models.fit(rows.withColumn("label", F.col("done").cast("double")), LogisticRegression(maxIter=20), FEATURES)
    return models.score(model, rows, ["0", "1"]).drop(*FEATURES)


@query("m3_compare_regressors")
def m3c(t):
    candidates = {"tree": DecisionTreeRegressor(seed=42), "linear": LinearRegression(maxIter=20)}
    return models.compare_regressors(_bought(t), candidates, ["year", "customer", "done"], "price", models.hash_fold(["o_orderkey"]))


# Least squares of the folds that a row is not in.
LINE = """SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey % 5 AS fold, a + b * l_quantity AS prediction FROM lineitem JOIN (SELECT f, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem, (SELECT unnest(range(5)) AS f) WHERE l_orderkey % 5 <> f GROUP BY 1) ON f = l_orderkey % 5"""


def _lined(t) -> DataFrame:
    return models.linear_out_of_fold(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice", (F.col("l_orderkey") % 5).cast("int"))


@query("m3_out_of_fold", f"SELECT l_orderkey, l_linenumber, CAST(fold AS INTEGER) AS fold, prediction FROM ({LINE})")
def m3(t):
    return _lined(t).select("l_orderkey", "l_linenumber", "fold", "prediction")


@query("m4_regression_report", f"SELECT count(*) AS rows, avg(abs(prediction - l_extendedprice)) AS mae, avg(power(prediction - l_extendedprice, 2)) AS mse, sqrt(avg(power(prediction - l_extendedprice, 2))) AS rmse, 1 - avg(power(prediction - l_extendedprice, 2)) / var_pop(l_extendedprice) AS r2 FROM ({LINE})")
def m4(t):
    return evaluate.regression_report(_lined(t), "l_extendedprice", "prediction")


@query("m9_importance")
def m9(t):
    rows = _bought(t)
    model = models.fit(rows.withColumn("label", F.col("done").cast("double")), DecisionTreeClassifier(seed=42), FEATURES)
    return models.importance(model, FEATURES, rows)


@query("m10_partial_dependence", """WITH q AS (SELECT quantile_cont(l_quantity, .05) AS lo, quantile_cont(l_quantity, .95) AS hi FROM lineitem), g AS (SELECT lo + (hi - lo) * i / 4 AS value FROM q, range(5) r(i))
SELECT value, avg(value * 2 + l_tax * value + l_discount) AS mean FROM g, lineitem GROUP BY 1""")
def m10(t):
    model = lambda df: df.withColumn("prediction", F.col("l_quantity") * 2 + F.col("l_tax") * F.col("l_quantity") + F.col("l_discount"))
    return models.partial_dependence(t("lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), "l_tax", "l_discount"), model, "l_quantity", 5)


@query("m11_anomalies")
def m11(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    forest = anomaly.grow_forest(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return anomaly.anomaly_scores(rows, forest).select("l_orderkey", "l_linenumber", "anomaly_score", "anomaly")


@query("m12_counterfactuals")
def m12(t):
    rows = _bought(t)
    model = lambda df: df.withColumn("p", 1 / (1 + F.exp(-(0.02 * (F.col("price") - 250) - 0.5 * (F.col("year") - 1998)))))
    low = model(rows).where("p < 0.5").drop("p")
    return models.counterfactuals(rows, low, "o_orderkey", ["price", "year"], model, F.col("p") >= 0.5, candidates=32)


@query("e1_class_report", f"""WITH s AS (SELECT CAST(y AS INTEGER) AS y, CAST(p >= 0.5 AS INTEGER) AS g FROM ({SCORED}) WHERE p IS NOT NULL), c AS (SELECT unnest([0, 1]) AS c),
m AS (SELECT c, count(*) FILTER (WHERE y = c) AS real, count(*) FILTER (WHERE g = c) AS guessed, count(*) FILTER (WHERE y = c AND g = c) AS hit FROM s, c GROUP BY 1), r AS (SELECT *, CASE WHEN guessed = 0 THEN 0.0 ELSE hit / guessed END AS p, CASE WHEN real = 0 THEN 0.0 ELSE hit / real END AS r FROM m)
SELECT CAST(sum(real) AS BIGINT) AS rows, sum(hit) / sum(real) AS accuracy, sum(real * p) / sum(real) AS precision, sum(real * r) / sum(real) AS recall, sum(real * CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) / sum(real) AS f1, 100 * max(p) FILTER (WHERE c = 1) AS conversion_rate FROM r""")
def e1r(t):
    return evaluate.class_report(_scored(t).where("p IS NOT NULL").withColumn("g", (F.col("p") >= 0.5).cast("int")), "y", "g")


@query("e2_class_losses", f"SELECT count(*) AS rows, avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15))) AS log_loss, avg((power(p - y, 2) + power(1 - p - (1 - y), 2)) / 2) AS brier FROM ({SCORED}) WHERE p IS NOT NULL")
def e2c(t):
    return evaluate.class_losses(_scored(t).where("p IS NOT NULL").withColumn("both", F.array(1 - F.col("p"), F.col("p"))), "y", "both", [0, 1])


@query("e7_best_threshold", f"""WITH c AS (SELECT CAST(i AS DOUBLE) / 10 AS t FROM range(1, 10) r(i)), d AS (SELECT t AS threshold, count(*) FILTER (WHERE p >= t) AS volume, count(*) FILTER (WHERE p >= t AND y = 1) / nullif(count(*) FILTER (WHERE p >= t), 0) AS precision, count(*) FILTER (WHERE p >= t AND y = 1) / nullif(sum(y), 0) AS recall,
CAST(100 * count(*) FILTER (WHERE p >= t AND y = 1) - 10 * count(*) FILTER (WHERE p >= t AND y = 0) AS DOUBLE) AS expected_profit FROM ({SCORED}), c GROUP BY t) SELECT * FROM d ORDER BY expected_profit DESC, threshold LIMIT 1""")
def e7b(t):
    return evaluate.best_threshold(evaluate.decision_curve(_scored(t), "y", "p"))


@query("e6_set_sizes", f"SELECT CAST(s AS INTEGER) AS size, count(*) AS n, count(*) / any_value(t) AS share FROM (SELECT CASE WHEN p >= 0.4 AND 1 - p >= 0.4 THEN 2 WHEN p >= 0.4 OR 1 - p >= 0.4 THEN 1 ELSE 0 END AS s, count(*) OVER () AS t FROM ({SCORED}) WHERE p IS NOT NULL) GROUP BY 1")
def e6s(t):
    rows = _scored(t).where("p IS NOT NULL")
    return evaluate.set_sizes(evaluate.prediction_sets(rows, {"1": F.col("p"), "0": 1 - F.col("p")}, 0.6))


@query("e11_scenario_summary", """SELECT count(*) AS n_samples, avg(b - a) AS pred_delta_mean, quantile_cont(b - a, .5) AS pred_delta_median, avg(abs(b - a)) AS pred_delta_abs_mean, avg(a) AS mean_baseline, avg(b) AS mean_new, avg(b) - avg(a) AS uplift_abs, 100 * (avg(b) - avg(a)) / abs(avg(a)) AS uplift_pct, sum(b - a) AS total_delta, 100 * avg(CASE WHEN sign(60000 - a) = sign(b - a) THEN 1.0 ELSE 0 END) AS moved_toward_goal_pct
FROM (SELECT l_extendedprice AS a, l_extendedprice * (1 + l_tax - l_discount) AS b FROM lineitem)""")
def e11(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("b"))
    return evaluate.scenario_summary(rows, "a", "b", False, 60000)


@query("a17_unit_economics", """WITH c AS (SELECT count(*) AS n, avg(CASE WHEN c_custkey % 3 > 0 THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN c_custkey % 2 > 0 THEN 1.0 ELSE 0 END) AS s FROM customer), o AS (SELECT avg(o_totalprice) AS aov FROM orders)
SELECT n AS eligible_total, e AS emailable_pct, s AS sms_opt_in_pct, aov, CAST(0.4 AS DOUBLE) AS margin_pct, CAST(0.08 AS DOUBLE) AS return_pct, aov * 0.4 * 0.92 AS profit_per_tp, CAST(floor(n * greatest(e, s) * 0.5) AS BIGINT) AS volume, round(floor(n * greatest(e, s) * 0.5) * (aov * 0.4 * 0.92) * 0.1, 2) AS expected_net, CAST(1 AS DOUBLE) AS calc_coverage_pct FROM c, o""")
def a17(t):
    customers = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, "a@b.org").alias("email"), F.when(F.col("c_custkey") % 2 > 0, "1").alias("phone"))
    return kpi.unit_economics(customers, t("orders").select(F.col("o_totalprice").alias("amount")))[0]


@query("f6_preprocessed", """WITH r AS (SELECT event_id, CASE WHEN value < 60 THEN user_id END AS late, value, CASE WHEN event_id % 3 = 0 THEN 1 END AS sparse, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events), m AS (SELECT quantile_cont(late, .5) AS ml, quantile_cont(value, .5) AS mv FROM r),
c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(kind, 'MISSING') AS v FROM r))
SELECT event_id, coalesce(late, ml) AS late, coalesce(value, mv) AS value, CAST(code AS INTEGER) AS kind, CASE WHEN late IS NULL THEN 1 ELSE 0 END AS late_was_missing FROM r JOIN c ON v = coalesce(kind, 'MISSING'), m""")
def f6(t):
    raw = t("events").select("event_id", F.when(F.col("value") < 60, F.col("user_id")).alias("late"), "value", F.when(F.col("event_id") % 3 == 0, 1).alias("sparse"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return prepare.fit_preprocessor(raw, ["event_id"], low=0.001).transform(raw)
