"""Health, reports, splits, economics, pruning and readers on tiny tables, by hand."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, keys, kpi, profile, survival
from tallyforge.sources import tables


def test_health_of_a_small_table(spark):
    rows = [(1, "a@b.org", 5.0, "2024-01-01"), (1, "bad", -1.0, "2030-01-01"), (None, None, None, "never"), (None, "c@d", -2.0, None)]
    df = spark.createDataFrame(rows, "id int, email string, amount double, day string")
    totals, issues = profile.dataset_health(df, "id", ["id", "coupon"], ["when", "day"], "2025-01-01")
    t = totals.first()
    assert (t.row_count, t.duplicate_keys, t.missing_required, t.first_date, t.last_date) == (4, 2, 4, "2024-01-01", "2030-01-01") and t.null_rate == pytest.approx(5 / 16)
    assert [tuple(r) for r in issues.orderBy("rank").collect()] == [("error", "coupon", "Missing required values", 4, 1), ("error", "amount", "Negative amounts found", 2, 2), ("error", "email", "Invalid email format", 2, 3), ("error", "id", "Missing required values", 2, 4), ("warn", "day", "Dates in the future detected", 1, 5)]
    totals, issues = profile.dataset_health(df.select("amount").limit(0), "id")
    assert totals.first().row_count == 0 and totals.first().null_rate is None and issues.count() == 0
    merged = profile.merge_issues(issues.sparkSession.createDataFrame([("info", "a", "m", 2), ("warn", "b", "m", 1), ("info", "a", "m", 3), ("odd", "c", "m", 9)], "severity string, field string, message string, count long"))
    assert [(r.severity, r["count"]) for r in merged.orderBy("rank").collect()] == [("warn", 1), ("info", 5), ("odd", 9)]


def test_column_report(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, None, None), (2, "abcd", None), (None, "ab", None)], "n int, s string, v double")
    n, s, v = profile.column_report(df, ["n", "s", "v"], exact=True).collect()
    assert (n.non_nulls, n.nulls, n.null_rate, n.distinct, n.min, n.max, n.p50, n.p05, n.avg_len) == (3, 1, 0.25, 2, 1.0, 2.0, 2.0, pytest.approx(1.1), None)
    assert (s.kind, s.distinct, s.min_len, s.max_len, s.avg_len, s.mean) == ("text", 2, 2, 4, pytest.approx(8 / 3), None)
    assert (v.non_nulls, v.min, v.p95) == (0, None, None)
    assert profile.histogram(df, "n", 4).orderBy("bin").select("n").toPandas().n.tolist() == [1, 0, 0, 2]
    assert profile.histogram(df, "v").count() == 0 and profile.histogram(df.where("n = 2"), "n", 3).orderBy("bin").first().n == 2
    assert {(r.segment, r.feature): r.median for r in profile.segment_statistics(df, "s", ["n"]).collect()} == {("ab", "n"): 1.0, (None, "n"): 2.0, ("abcd", "n"): 2.0}


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else None, float(i % 7), i // 5) for i in range(200)], "i int, s string, c double, g int")
    out = keys.stratified_split(df.repartition(3), "s", "i", 0.25).toPandas()
    assert len(out) == 200 and (out[out.s == "a"].split == "test").sum() == 45 and (out[out.s.isna()].split == "test").sum() == 5
    assert keys.stratified_split(df, "s", "i", 0.25).where("split = 'test'").select("i").toPandas().i.sort_values().tolist() == out[out.split == "test"].i.sort_values().tolist()
    assert keys.group_split(df, "g").groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert [r.i for r in keys.sample_by_confidence(df, "c", "i", 3).collect()] == [0, 7, 14] and [r.i for r in keys.sample_by_confidence(df, "c", "i", 2, "highest_confidence").collect()] == [6, 13]
    assert keys.sample_by_confidence(df, "c", "i", 9, "random").count() == 9
    both = keys.canonical_join(spark.createDataFrame([("1", "x"), ("2", "y")], "customer_id string, channel string"), spark.createDataFrame([("1", 5.0)], "customer_id string, amount double"), spark.createDataFrame([("2", "sms")], "customer_id string, channel string"))
    assert [tuple(r) for r in both.orderBy("customer_id").collect()] == [("1", "x", 5.0, None), ("2", "y", None, "sms")]


def test_unit_economics_and_its_gaps(spark):
    customers = spark.createDataFrame([("a@b", None), (None, "1"), ("c@d", "2"), ("e@f", None)], "email string, phone string")
    orders = spark.createDataFrame([(50.0,), (150.0,)], "amount double")
    one, gaps = kpi.unit_economics(customers, orders)
    r = one.first()
    assert (r.eligible_total, r.emailable_pct, r.sms_opt_in_pct, r.aov, r.volume, r.calc_coverage_pct) == (4, 0.75, 0.5, 100.0, 1, 1.0) and r.profit_per_tp == pytest.approx(36.8) and r.expected_net == 3.68 and gaps.count() == 0
    one, gaps = kpi.unit_economics(customers.drop("email", "phone"), None)
    assert (one.first().calc_coverage_pct, one.first().volume) == (pytest.approx(1 / 7), 0)
    assert {r.calculation: r.missing for r in gaps.collect()}["threshold_volume.expected_net"] == "aov|contactable_customers"


def test_scenarios_and_sets(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 3.0), (5.0, 5.0)], "a double, b double")
    r = evaluate.scenario_summary(df, "a", "b", False, 10).first()
    assert (r.n_samples, r.total_delta, r.pred_delta_median) == (3, 0.0, 0.0) and r.moved_toward_goal_pct == pytest.approx(100 / 3)
    assert evaluate.scenario_summary(df, "a", "b", True, 5).first().success_rate == pytest.approx(100 / 3)
    sets = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (["b"],)], "labels array<string>")
    assert {r["size"]: (r.n, r.share) for r in evaluate.set_sizes(sets).collect()} == {0: (1, 0.25), 1: (2, 0.5), 2: (1, 0.25)}


def test_pruned_features(spark):
    rows = [(float(i), i % 2, float(i * i % 17), float(i * i % 17), 2.0, 3.0 * i, float(-(i * i % 17)) + (0.01 if i == 3 else 0), float(i * 7 % 13), None if i % 2 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "t double, e int, a double, again double, flat double, late double, minus double, b double, holes double")
    assert survival.pruned_features(df, "t", "e", ["a", "again", "flat", "late", "minus", "b", "holes"]) == ["a", "b"]
    assert survival.pruned_features(df, "t", "e", []) == []


def test_headers_that_are_data(spark, tmp_path):
    for name, text, columns, n in (("data", "1,2024-01-02,x\n3,2024-01-03,y\n", ["col_1", "col_2", "col_3"], 2), ("head", "id,day,kind\n3,2024-01-03,y\n", ["id", "day", "kind"], 1)):
        (tmp_path / f"{name}.csv").write_text(text)
        df = tables.read_csv_checked(spark, str(tmp_path / f"{name}.csv"), share=0.6)
        assert df.columns == columns and df.count() == n
    tables.write_training(df, str(tmp_path / "out"), ["kind"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
