import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, cluster, evaluate, features, profile, select, whatif


@pytest.fixture
def no_percentile(monkeypatch):
    """``percentile`` keeps all distinct values in one task."""

    def refuse(*_):
        raise AssertionError("percentile holds a column's distinct values in one task")

    monkeypatch.setattr(F, "percentile", refuse)


def quantile(values, share):
    at = sorted(values)
    k, part = divmod(share * (len(at) - 1), 1)
    return at[int(k)] + part * (at[min(int(k) + 1, len(at) - 1)] - at[int(k)])


@pytest.fixture
def numbers(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.gauss(1, 3), "x" if i % 7 else None if i % 2 else "y") for i in range(3001)]
    return rows, spark.createDataFrame(rows, "a double, b double, g string").repartition(3)


def test_scenario_median_by_brackets(numbers, no_percentile):
    rows, df = numbers
    got = evaluate.scenario_summary(df, "a", "b", False, 0.5).first()
    assert got.n_samples == 3001 and got.pred_delta_median == pytest.approx(quantile([b - a for a, b, _ in rows], 0.5))


def test_capped_by_brackets(spark, numbers, no_percentile):
    rows, df = numbers
    lo, hi = (quantile([a for a, *_ in rows], s) for s in (0.01, 0.99))
    ends = features.capped(df, "a").agg(F.min("a_capped"), F.max("a_capped")).first()
    assert tuple(ends) == pytest.approx((lo, hi))
    few = spark.createDataFrame([(1.0,), (None,), (9.0,)], "a double")
    assert {r.a_capped for r in features.capped(few, "a").collect()} == {1.0, None, 9.0}


def test_outliers_by_brackets(spark, numbers, no_percentile):
    rows, df = numbers
    a, b = (quantile([v for v, *_ in rows], s) for s in (0.25, 0.75))
    want = sum(v < 2.5 * a - 1.5 * b or v > 2.5 * b - 1.5 * a for v, *_ in rows)
    got = profile.iqr_outliers(df.withColumn("none", F.lit(None).cast("double")), ["a", "none"]).collect()
    assert want and {r.column: r.outliers for r in got} == {"a": want, "none": 0}


def test_bin_edges_by_brackets(spark, numbers, no_percentile):
    rows, df = numbers
    assert features.quantile_edges(df, "b", 4) == pytest.approx([quantile([b for _, b, _ in rows], i / 4) for i in range(5)])
    assert features.quantile_edges(df.limit(0), "b") == []


def test_change_summary_for_all_rows_and_each_group(numbers, no_percentile):
    rows, df = numbers
    got = {(r.scope, r.g, r.which): r for r in whatif.change_summary(df, "a", "b", "g").collect()}
    assert set(got) == {(s, g, w) for s, g in (("all", None), ("group", "x"), ("group", "y"), ("group", None)) for w in ("before", "after")}
    for (scope, g, which), r in got.items():
        mine = [row for row in rows if scope == "all" or row[2] == g]
        values, change = [row[which == "after"] for row in mine], [b - a for a, b, _ in mine]
        mean = sum(change) / len(change)
        half = 1.96 * (sum((v - mean) ** 2 for v in change) / (len(change) - 1) / len(change)) ** 0.5
        assert (r["mean"], r["median"], r.mean_change, r.ci_low, r.ci_high) == pytest.approx((sum(values) / len(values), quantile(values, 0.5), mean, mean - half, mean + half))


def test_medians_of_small_and_missing_groups(spark, no_percentile):
    rows = [("one", 4.0), ("two", 1.0), ("two", 2.0), ("gap", None), ("many", 3.0), ("many", None)] + [("many", float(i % 2)) for i in range(5)]
    got = {r.k: r["median"] for r in select.group_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"one": 4.0, "two": 1.5, "gap": None, "many": 0.5}


def counted(spark, df):
    """``df``, and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_lloyd_reads_the_table_once_for_all_steps(spark, numbers):
    rows, df = numbers
    df, made = counted(spark, df.select("a", "b").unionByName(df.select("a", "b")))
    starts = {2: [[0.0, 0.0], [1.0, 1.0]], 3: [[0.0, 0.0], [1.0, 1.0], [-5.0, 2.0]]}
    got = cluster.lloyd(df, ["a", "b"], starts, steps=4, tolerance=0.0)
    assert made.value <= 2 * 2 * len(rows)
    for k, centres in starts.items():
        for _ in range(4):
            own = [min(range(k), key=lambda j: ((a - centres[j][0]) ** 2 + (b - centres[j][1]) ** 2, j)) for a, b, _ in rows]
            centres = [[sum(r[i] for r, o in zip(rows, own, strict=True) if o == j) / own.count(j) for i in (0, 1)] for j in range(k)]
        assert [v for c in got[k] for v in c] == pytest.approx([v for c in centres for v in c])


def test_scores_are_made_once(spark, numbers, no_percentile):
    rows, df = numbers
    forest = anomaly.grow_forest(df, ["a", "b"], trees=5, size=64)
    df, made = counted(spark, df.select("a", "b"))
    got = anomaly.anomaly_scores(df, forest).collect()
    limit = quantile([r.anomaly_score for r in got], 0.9)
    assert made.value == len(rows) and all(r.anomaly == (r.anomaly_score > limit) for r in got)
