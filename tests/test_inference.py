"""Column types, roles, JSON cells, standardised values and forecasts on small tables, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import forecast, infer, series


def test_types_and_roles(spark):
    rows = [(f"u{i}@x.org", f"2024-01-{i % 28 + 1:02d}", f"+1 (555) 010-{1000 + i}", f"http://x.org/{i}", f"10.0.0.{i % 250}", "yes" if i % 2 else "No", '{"a": 1}', f"ID{i:05d}", f"€ {i},50", str(i), f"{i % 101}%", "ab" if i % 3 else None, "word " * (9 + i % 7) + str(i % 6), float(i % 4), None) for i in range(200)]
    names = ["mail", "day", "tel", "link", "host", "ok", "cell", "code", "paid", "amount", "win_rate", "kind", "note", "level", "void"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'level' else 'string'}" for n in names)).repartition(3)
    for exact in (True, False):
        facts = infer.column_facts(df, exact=exact)
        got = {r.column: r for r in infer.semantic_types(facts).collect()}
        said = {"mail": "email", "day": "timestamp", "tel": "phone", "link": "url", "host": "ip", "ok": "boolean", "cell": "json", "code": "id", "paid": "money", "win_rate": "percent", "kind": "categorical", "note": "text", "level": "numeric", "void": "categorical"}
        assert {c: got[c].semantic for c in said} == said
        assert got["amount"].semantic == "id" and got["mail"].valid_rate == 1.0
        roles = {r.column: r.role for r in infer.column_roles(facts, given={"KIND": "Group"}, deny=["pa.*"], allow=["day"]).collect()}
        assert (roles["day"], roles["code"], roles["level"], roles["note"], roles["void"], roles["kind"], roles["paid"], roles["ok"], roles["cell"]) == ("Date", "ID", "Categorical", "Text", "Ignore", "Group", "Ignore", "Categorical", "Ignore")
    assert infer.semantic_types(infer.column_facts(df.limit(0))).count() == 0
    money = infer.semantic_types(infer.column_facts(df.select((F.col("amount").cast("int") % 50).alias("Price"))))
    assert money.first().semantic == "money"


def test_json_cells_of_any_shape(spark):
    rows = [(1, '{"k": 69, "a b": {"x.y": 1.5, "z": [1, 2], "it\'s": true}}'), (2, '{"k": "s", "n": {}}'), (3, "[1]"), (4, "no"), (5, None), (6, '{"k": null, "a b": {"x.y": 2}, "broken": ')]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("j.k", F.lit("old")).withColumn("plain", F.lit("x"))
    got = infer.expand_json(df).orderBy("i")
    assert set(got.columns) == {"i", "j.k", "plain", "j.k_2", "j.a b.x.y", "j.a b.z", "j.a b.it's", "j.n"}
    one, two, *rest = got.collect()
    assert (one["j.k_2"], one["j.a b.x.y"], one["j.a b.z"], one["j.a b.it's"], one["j.k"]) == ("69", 1.5, "[1,2]", True, "old")
    assert two["j.k_2"] == "s" and all(r["j.k_2"] is None and r["j.a b.x.y"] is None for r in rest)
    assert infer.expand_json(df.select("i", "plain")).columns == ["i", "plain"]
    assert infer.json_paths("OBJECT<`a``<b`: OBJECT<c: DECIMAL(3,1), d: ARRAY<OBJECT<e: BIGINT>>>, f: VARIANT>") == [(("a`<b", "c"), "double"), (("a`<b", "d"), "string"), (("f",), "string")]


def test_standardized_values(spark):
    df = spark.createDataFrame([(" A@B.Org ", "(555) 010-1000", "y", "03/04/2024", "$1,234.5", "40", "New York!"), (None, None, "x", "no", "-", "0.5", None), ("c@d.org", "12", "0", "2024-05-06 07:08:09", "€7", "80%", "B")], "m string, p string, b string, t string, v string, r string, c string")
    got = infer.standardized(df, {"m": "email", "p": "phone", "b": "boolean", "t": "timestamp", "v": "money", "r": "percent", "c": "categorical"}).collect()
    assert [r.m for r in got] == ["a@b.org", None, "c@d.org"] and [r.p for r in got] == ["+15550101000", None, None]
    assert [r.b for r in got] == [True, None, False] and [r.v_num for r in got] == [1234.5, None, 7.0]
    assert [r.r_rate for r in got] == [0.4, 0.005, 0.8] and [r.c_slug for r in got] == ["new-york", None, "b"]
    assert [str(r.t) for r in got] == ["2024-03-04 00:00:00", "None", "2024-05-06 07:08:09"]


def plain_holt_winters(y: list[float], steps: int, m: int) -> list[float]:
    best = None
    for a in forecast.GRID:
        for b in forecast.GRID:
            for g in forecast.GRID:
                level, trend = sum(y[:m]) / m, (sum(y[m : 2 * m]) - sum(y[:m])) / m / m
                s, e = [v - level for v in y[:m]], 0.0
                for i in range(m, len(y)):
                    e += (y[i] - level - trend - s[i % m]) ** 2
                    old, level = level, a * (y[i] - s[i % m]) + (1 - a) * (level + trend)
                    trend = b * (level - old) + (1 - b) * trend
                    s[i % m] = g * (y[i] - level) + (1 - g) * s[i % m]
                if best is None or e < best[0]:
                    best = (e, [level + h * trend + s[(len(y) + h - 1) % m] for h in range(1, steps + 1)])
    return best[1]


def test_holt_winters_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    made = {k: [float(10 + 0.3 * i + 4 * math.sin(i / 2) + rng.normal()) for i in range(n)] for k, n in (("a", 40), ("b", 14), ("c", 5))}
    rows = [(k, i, v) for k, y in made.items() for i, v in enumerate(y)] + [("a", 99, None)]
    got = forecast.holt_winters_forecast(spark.createDataFrame(rows, "k string, t int, y double").repartition(5), "k", "t", "y", 6, 7).orderBy("k", "step").collect()
    assert [r.k for r in got] == ["a"] * 6 + ["b"] * 6
    assert [r.forecast for r in got] == pytest.approx(plain_holt_winters(made["a"], 6, 7) + plain_holt_winters(made["b"], 6, 7))


def test_lag_forest_feeds_its_forecasts_back(spark):
    """A series that repeats every four steps goes on; equal to stepping the model row by row."""
    rows = [(k, i, float((i + k) % 4)) for k in range(3) for i in range(40)] + [(9, 0, 1.0)]
    got = forecast.lag_forest_forecast(spark.createDataFrame(rows, "k int, t int, y double"), "k", "t", "y", 8, 4, 5).orderBy("k", "step").collect()
    assert {r.k for r in got} == {0, 1, 2} and [r.step for r in got[:8]] == list(range(1, 9))
    assert [r.forecast for r in got] == pytest.approx([(40 + h + k) % 4 for k in range(3) for h in range(8)], abs=0.35)
    assert forecast.lag_forest_forecast(spark.createDataFrame(rows[:3], "k int, t int, y double"), "k", "t", "y").count() == 0


def test_spikes_are_interpolated(spark):
    rows = [("a", i, 500.0 if i == 4 else float(i % 3)) for i in range(12)] + [("b", i, 1.0 if i else 900.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, d int, y double").select("k", F.date_add(F.lit("2024-01-01").cast("date"), "d").alias("day"), "y")
    got = {(r.k, r.day.day - 1): r.y for r in series.spikes_removed(df, "k").collect()}
    assert got["a", 4] == pytest.approx(1.0) and max(v for (k, _), v in got.items() if k == "a") <= 2.0
    assert got["b", 0] > 800  # a spread of 0 has no spikes
