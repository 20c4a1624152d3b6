"""Rules of scored tables, intake and features on tiny frames, where a given table can't show them."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import clean
from tallyforge.operators import canonical, evaluate, features, kpi, profile, series


def test_formulas_are_arithmetic_only(spark):
    df = spark.createDataFrame([(6.0, 3, 2), (1.0, 0, 1)], "total_spent double, visits long, days_active long")
    got = df.select(kpi.kpi("-total_spent / visits + 2 ** days_active", "2001-01-01", columns=df.columns)).collect()
    assert [r[0] for r in got] == [2.0, None]
    for bad in ("java_method('java.lang.System','getProperty','user.home')", "unknown + 1", "visits; visits", "(select 1)", "visits.real", "'a'"):
        with pytest.raises(ValueError):
            kpi.kpi(bad, "2001-01-01", columns=df.columns)
    with pytest.raises(ValueError):
        kpi.kpi("visits", "2001-01-01")


def test_ab_results(spark):
    frame = lambda rows: spark.createDataFrame(rows, "variant string, hit boolean")
    rows = [("a", i < 30) for i in range(100)] + [("b", i < 45) for i in range(100)] + [(None, True), ("a", None)]
    got = kpi.ab_test(kpi.ab_table(frame(rows), "variant", F.col("hit"))).first()
    assert (got.winner, got.df) == ("b", 1) and got.lift == pytest.approx(0.15) and got.p_value == pytest.approx(0.04087, abs=1e-4)
    none = kpi.ab_test(kpi.ab_table(frame([("a", False), ("b", False)]), "variant", F.col("hit"))).first()
    assert (none.winner, none.lift, none.chi2, none.df, none.p_value) == ("a", 0.0, 0.0, 0, 1.0)


def test_constant_customers_have_no_upsell(spark):
    agg = spark.sql("SELECT '1' customer_id, 600D total_spent, TIMESTAMP'2001-01-01' first_activity, TIMESTAMP'2001-01-01' last_activity, 2L visits, 1L days_active")
    flags = kpi.customer_flags(agg, "2001-01-02 00:00:00")
    assert flags.first().upsell_score == 0 and flags.first().is_vip == 1
    assert kpi.customer_summary(flags.limit(0)).first().total_customers == 0


def test_intake_rules(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "c string, n int")
    assert profile.positive_label(df, "c").first().label == "y"
    assert profile.positive_label(df.union(spark.createDataFrame([(" Yes", 4)], df.schema)), "c").first().label == " Yes"
    assert profile.positive_label(df.limit(0), "c").count() == 0
    tasks = {r.column: r.task for r in profile.task_type(df.withColumn("f", (F.col("n") > 1).cast("int")), ["c", "n", "f"]).collect()}
    assert tasks == {"c": "classification", "n": "regression", "f": "classification"}
    assert canonical.allowed_columns(["a", "Label", "a_next", "b", "target"], allow=["target"], deny=["b"]) == ["a", "target"]
    assert canonical.align_columns(df, ["z", "n"]).first().asDict() == {"z": 0, "n": 1}


def test_features_of_a_fit(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, 2.0), (3, "a", 4.0), (4, "b", 9.0)], "i int, c string, v double")
    assert [r.c_code for r in features.label_codes(df, "c", ["i"]).orderBy("i").collect()] == [0, 1, 2, 0]
    assert [r.v for r in features.safe_bundle(df, ["v"], ["c"]).orderBy("i").collect()] == [4.0, 2.0, 4.0, 9.0]
    assert [r[-1] for r in features.one_hot(df, "c", features.fitted_values(df, "c")).orderBy("i").collect()] == [1, 0, 0, 1]
    with pytest.raises(ValueError):
        features.fitted_values(df, "c", 1)
    assert [r.plan for r in features.encoding_plan(df, ["c"], 2).collect()] == ["hash"]


def test_prediction_sets_and_changes(spark):
    df = spark.createDataFrame([(0.9, "1", 1.0, 2.0), (0.5, "0", 2.0, 4.0), (0.1, "1", 3.0, 5.0)], "p double, y string, a double, b double")
    sets = evaluate.prediction_sets(df, {"1": F.col("p"), "0": 1 - F.col("p")}, 0.5)
    assert [r.labels for r in sets.collect()] == [["1"], ["0", "1"], ["0"]]
    m = evaluate.set_metrics(sets, "y").first()
    assert (m.coverage, m.abstention_rate) == (pytest.approx(2 / 3), 0.0)
    same = evaluate.paired_means(df, "a", "a").first()
    assert (same.t_statistic, same.p_value, same.ci_low, same.effect_size, same.risk_assessment) == (None, None, None, 0.0, "similar_risk")


def test_series_rules(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-01-01', 1D), ('a', DATE'2024-01-08', 4D), ('a', DATE'2024-01-15', 4D), ('b', DATE'2024-01-01', 4D) AS t(k, day, y)")
    assert {(r.k, r.freq, r.season_length, r.seasonal) for r in series.frequency(df, "k", "day").collect()} == {("a", "W", 52, False), ("b", None, 0, False)}
    flat = spark.sql("SELECT 'a' k, id day, 3D y FROM range(30)")
    assert {r.acf for r in series.autocorrelation(flat, "k", "day", "y").collect()} == {None}
    signed = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "v double")
    assert [r.v_log for r in clean.stabilized(signed, "v").collect()] == pytest.approx([-0.693147, 0.0, 0.693147], abs=1e-6)


def test_paired_means_by_hand(spark):
    """d = 1, 2, 2: mean 5/3, deviation 0.57735, t = 5 with 2 degrees of freedom, whose tail is 1 - t / sqrt(t^2 + 2)."""
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0)], "a double, b double")
    r = evaluate.paired_means(df, "a", "b").first()
    assert (r.original_mean, r.modified_mean, r.percent_change, r.variance_change, r.risk_assessment, r.estimated_revenue_impact) == (2.0, 3.6667, 83.33, 0.4307, "higher_risk", 100.0)
    assert r.t_statistic == pytest.approx(5.0) and r.p_value == pytest.approx(1 - 5 / 27**0.5) and r.is_significant
    assert (r.ci_low, r.ci_high) == pytest.approx((5 / 3 - 4.302653 / 3, 5 / 3 + 4.302653 / 3), abs=1e-5)
    assert r.effect_size == round(5 / 3 / ((2 / 3 + 14 / 9) / 2) ** 0.5, 4)
    for t, v, p in ((1.0, 1, 0.5), (2.0, 2, 0.1835034), (-2.5, 10, 0.0314464), (0.3, 1000, 0.7642397)):
        assert evaluate.student_tail(t, v) == pytest.approx(p, abs=1e-6)


def test_paired_rates_by_hand(spark):
    """1 and 3 of 4 are few: Fisher's p is (16 + 16 + 1 + 1) / 70. 40 and 60 of 100: z = 2.828."""
    few = spark.createDataFrame([(0.9, 0.9), (0.1, 0.8), (0.2, 0.7), (0.3, 0.4)], "a double, b double")
    r = evaluate.paired_rates(few, "a", "b").first()
    assert (r.test, r.original_rate, r.modified_rate, r.percent_change, r.is_significant) == ("fisher", 0.25, 0.75, 200.0, False) and r.p_value == pytest.approx(34 / 70)
    many = spark.createDataFrame([(float(i < 40), float(i < 60)) for i in range(100)], "a double, b double")
    r = evaluate.paired_rates(many, "a", "b").first()
    assert r.test == "z-test" and r.p_value == pytest.approx(0.0046777, abs=1e-6)


def test_shifts_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0.9), (0.5, 0.4), (0.8, 0.8), (0.39, 0.39)], "a double, b double")
    assert [tuple(r) for r in evaluate.risk_shift(df, "a", "b").collect()] == [("High Risk", 0.25, 0.5), ("Medium Risk", 0.25, 0.25), ("Low Risk", 0.5, 0.25)]
    assert tuple(evaluate.mean_difference_interval(df, "a", "a").first()) == (0.0, 0.0)
    assert [r.original for r in evaluate.percentile_summary(df, "a", "b").collect()] == pytest.approx([0.3175, 0.445, 0.575])
    labels = spark.createDataFrame([("x", "x"), ("x", "y"), ("z", "y"), ("x", "x")], "a string, b string")
    assert {r.label: r.change for r in evaluate.class_share_change(labels, "a", "b").collect()} == {"x": -25.0, "y": 50.0, "z": -25.0}


def test_category_boost_turns_exactly_k(spark):
    from tallyforge.operators import select, whatif

    rows = [(i, None if i % 10 == 0 else "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, c string")
    got = []
    for parts in (1, 7):
        out = whatif.category_boost(df.repartition(parts), "c", "b", 12.34, ["i"]).orderBy("i").collect()
        assert len(out) == 1000 and sum(r.c == "b" for r in out) == 300 + 111 and sum(r.c is None for r in out) == 100
        got.append([r.c for r in out])
    assert got[0] == got[1]
    assert whatif.category_boost(df, "c", "b", 100, ["i"]).where("c = 'b'").count() == 900
    old = select.ENOUGH, select.RANGES
    select.ENOUGH, select.RANGES = 5, 4
    try:
        for k in (1, 17, 500, 999):
            chosen = select.smallest(df, F.floor(F.col("i") / 3) * 1.0, [F.desc("i")], k, "in").where("in").toPandas().i
            assert sorted(chosen) == sorted(sorted(range(1000), key=lambda i: (i // 3, -i))[:k])
    finally:
        select.ENOUGH, select.RANGES = old
    assert whatif.category_summary(df, "c", "c", 1).first().n == 600
    assert [r.x for r in df.select(whatif.boolean_force(F.when(F.col("i") > 0, F.lit(False)), True).alias("x")).orderBy("i").limit(2).collect()] == [None, True]


def test_exact_quantiles(spark):
    import random

    from tallyforge.operators import select

    rng = random.Random(1)
    rows = [(rng.gauss(0, 1) if i % 5 else None, float(i % 3), None) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = select.exact_quantiles(df, ["a", "b", "c"], shares)
    for c in "abc":
        want = df.agg(F.percentile(c, F.array(*[F.lit(v) for v in shares]))).first()[0] or [None] * 6
        assert got[c] == pytest.approx(want) if want[0] is not None else got[c] == want


def test_segments_by_hand(spark):
    from tallyforge.operators import segments

    df = spark.createDataFrame([(1, [0.1, 0.9], "x"), (0, [0.6, 0.4], "x"), (1, [0.7, 0.3], None), (0, [0.45, 0.55], None)], "y int, p array<double>, s string")
    got = {r.name: r for r in segments.segment_table(df, "y", "p", [0, 1], 0.5, ["s"], min_n=1).collect()}
    assert (got["s=x"].coverage, got["s=NA"].coverage, got["s=NA"].alarm, got["s=NA"].avg_set_size) == (1.0, 0.0, True, 1.0)
    assert got["s=NA"]["rank"] == 1 and got["s=x"].ece == pytest.approx(0.25) and got["s=NA"].ece == pytest.approx(0.625)
    own = {r.name: r for r in segments.segment_table(df, "y", "p", [0, 1], {0: 0.6, 1: 0.0}, ["s"]).collect()}
    assert own["s=x"].abstention_rate == 0.5 and own["s=x"].low_n


def test_generic_tables_are_mapped_by_name(spark):
    df = spark.createDataFrame([("Opened", "9,5 EUR", "A@B.org"), ("churned=0", None, None)], "LABEL string, Order_Amount string, emailaddress string")
    assert canonical.generic_mapping(df.columns) == {"id": None, "timestamp": None, "amount": "Order_Amount", "email": "emailaddress", "phone": None, "channel": None, "target": "LABEL"}
    got = canonical.generic(df).collect()
    assert [(r.target, r.amount) for r in got] == [("1", 95.0), ("0", None)] and len({r.id for r in got}) == 2
