"""Rules with thresholds on tiny frames, and batch against stream."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import clean
from tallyforge.operators import evaluate, features, keys, kpi, series, whatif
from tallyforge.sources import tables
from tallyforge.streaming import events


def values(spark, column, cells, kind="string"):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i long, c {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("c"))).collect()]


def test_clean_functions(spark):
    assert values(spark, clean.clean_phone, ["123456789", "(123) 456-7890", None]) == [None, "1234567890", None]
    assert values(spark, clean.clean_email, [" A@B.co ", "no", None]) == ["a@b.co", None, None]
    assert values(spark, clean.to_bool01, ["Yes", "0", "maybe", None]) == [1, 0, None, None]
    assert values(spark, clean.missing_to_null, [" N/A ", "None", "x ", "nOnE"]) == [None, None, "x", "nOnE"]
    assert values(spark, clean.money, ["$1,234.50", "abc"]) == [1234.5, None]
    assert values(spark, clean.locale_number, ["(12.00)", "12%", "USD 5", "abc"]) == [-12.0, 0.12, 5.0, None]
    assert values(spark, lambda c: clean.locale_number(c, ",", "."), ["1.234,50 €"]) == [1234.5]
    assert values(spark, clean.slug, ["A b!", "--", None]) == ["a-b", None, None]
    assert values(spark, clean.formula_safe, ["=1+1", "ok"]) == ["'=1+1", "ok"]
    assert values(spark, clean.mask_text, ["a@b.org and 4111 1111 1111 1111"]) == ["[email] and [card]"]
    assert values(spark, lambda c: clean.keyed_hash(c, b"key"), ["x"]) == [hmac.new(b"key", b"x", hashlib.sha256).hexdigest()]
    assert [str(v) for v in values(spark, clean.parse_timestamp, ["2025-08-09", "08/09/2025", "09-Aug-2025", "junk"])] == ["2025-08-09 00:00:00"] * 3 + ["None"]
    assert values(spark, clean.risk_tier, [0.2, 0.5, 0.8, 0.19], "double") == ["Medium", "High", "Extreme", "Low"]


def test_keep_last_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (2, 1, "d")], "k long, o long, v string")
    assert sorted(r.v for r in keys.keep_last(df, ["k"], ["o"]).collect()) == ["b", "d"]
    assert keys.duplicate_keys(df, "k").first()[0] == 1
    assert keys.keep_last(df.limit(0), ["k"], ["o"]).count() == 0


def test_ab_test(spark):
    rows = [("a", i < 30) for i in range(100)] + [("b", i < 45) for i in range(100)]
    table = kpi.ab_table(spark.createDataFrame(rows, "variant string, hit boolean"), "variant", F.col("hit"))
    got = kpi.ab_chi_square(table).first()
    assert got.df == 1 and got.chi2 == pytest.approx(4.1813333)
    assert kpi.chi_square_tail(got.chi2, 1) == pytest.approx(0.04087, abs=1e-4)
    assert kpi.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)


def test_features(spark):
    df = spark.createDataFrame([(i, "rare" if i < 10 else "often", float(i)) for i in range(100)], "i long, c string, v double")
    assert {r.c for r in features.rare_to_token(df, "c").collect()} == {"__RARE__", "often"}
    edges = features.quantile_edges(df, "v", 4)
    counts = df.groupBy(features.bin_by_edges(F.col("v"), edges).alias("b")).count().collect()
    assert sorted(r["count"] for r in counts) == [25, 25, 25, 25]
    s = features.scaled(df, ["v"]).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert s[0] == pytest.approx(0, abs=1e-9) and s[1] == pytest.approx(1)


def test_reliability_bins_count_inner_edges_twice(spark):
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(101)], "y int, p double")
    assert evaluate.reliability_bins(df, "y", "p").agg(F.sum("n")).first()[0] == 101 + 18  # p and 1 - p are equally sure, so two rows lie on each inner edge
    flat = evaluate.reliability_bins(df.withColumn("p", F.lit(1.0)), "y", "p").collect()
    assert len(flat) == 10 and {r.conf for r in flat} == {1.0}


def test_what_if_inverse(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "v double")
    back = df.select(whatif.change(whatif.change(F.col("v"), "multiplicative", 4), "multiplicative", 0.25).alias("v"))
    assert [r.v for r in back.collect()] == [1.0, None, 5.0]
    assert {r.v for r in whatif.rescale(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 0, 10).collect()} == {5.0}


def test_series(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-01-01', 1D), ('a', DATE'2024-01-04', 4D) AS t(k, day, y)")
    assert [r.y for r in series.regular_days(df, "k").orderBy("day").collect()] == [1.0, 2.0, 3.0, 4.0]
    weeks = spark.sql("SELECT explode(array(TIMESTAMP'2024-01-01 10:00:00', TIMESTAMP'2024-01-02 00:00:00')) AS ts").select(series.week_ending_monday(F.col("ts")).cast("string"))
    assert [r[0] for r in weeks.collect()] == ["2024-01-01", "2024-01-08"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", 1.5), (2, "y", float("nan"))], "id long, t string, v double")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_table(spark, str(tmp_path / "csv"), "csv")
    assert {r.t for r in back.collect()} == {"'=x", "y"}
    (tmp_path / "semi.csv").write_text("a;b;c\n1;2,5;3\n4;5;6\n")
    assert tables.sniff_delimiter(spark, str(tmp_path / "semi.csv")) == ";"
    assert [r.v for r in tables.preview(df, ["id"]).collect()] == [1.5, None]
    with pytest.raises(ValueError):
        tables.select_only(spark, df, "t", "drop table t")
    assert tables.select_only(spark, df, "t", "select count(*) n from t").first().n == 2


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(200).select(F.timestamp_seconds(1704067200 + F.col("id") * 9000).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).alias("k")).repartition(6).write.parquet(src)
    batch = spark.read.parquet(src)
    got = events.collect_stream(spark, src, batch.schema, lambda s: events.running_health(s, "k", "v"), "health", str(tmp_path / "c1"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.running_health(batch, "k", "v").collect()))
    got = events.collect_stream(spark, src, batch.schema, lambda s: events.weekly(s, "ts", "v"), "weeks", str(tmp_path / "c2"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.weekly(batch, "ts", "v").collect()))
