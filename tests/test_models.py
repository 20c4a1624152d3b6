"""Clustering, folds, survival, anomalies and counterfactuals against plain NumPy on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, cluster, evaluate, models, scan, survival


def blobs(n: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.4, (n, 2)) for c in ((0, 0), (5, 0), (0, 6))])


def test_k_is_chosen_by_silhouette_and_metrics_equal_pairs(spark):
    x = blobs(60)
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double").repartition(5)
    curve, centres = cluster.k_curve(df, ["x", "y"], 6)
    assert cluster.best_k(curve) == 3 and curve.count() == 5
    again, _ = cluster.k_curve(df.repartition(2), ["x", "y"], 6)
    assert [tuple(r) for r in curve.orderBy("k").collect()] == [pytest.approx(tuple(r)) for r in again.orderBy("k").collect()]
    for r in curve.collect():
        c = np.array(centres[r.k])
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(len(x)):
            mine = (own == own[i]) & (np.arange(len(x)) != i)
            a, b = d[i, mine].mean() if mine.any() else 0, min(d[i, own == j].mean() for j in set(own.tolist()) - {own[i]})
            s.append((b - a) / max(a, b) if mine.any() else 0.0)
        means = np.array([x[own == j].mean(0) for j in sorted(set(own.tolist()))])
        assert r.silhouette == pytest.approx(np.mean(s)) and r.clusters == len(means) and r.rows == len(x)
        assert r.inertia == pytest.approx(sum(((x[own == j] - x[own == j].mean(0)) ** 2).sum() for j in set(own.tolist())))


def test_metrics_of_odd_labellings(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (9.0, "b"), (4.0, None)], "x double, c string")
    got = cluster.cluster_metrics(df, ["x"], "c").first()
    assert (got.clusters, got.rows, got.inertia) == (2, 3, 0.5) and got.silhouette == pytest.approx((1 - 1 / 64 + 1 - 1 / 49) / 3)
    one = cluster.cluster_metrics(df.where("c = 'a'"), ["x"], "c").first()
    assert (one.clusters, one.silhouette, one.davies_bouldin) == (1, None, None)
    assert cluster.k_curve(df.limit(1), ["x"])[0].count() == 0
    named = cluster.segment_names(df, "c", ["x"]).collect()
    assert {(r.c, r.segment_name) for r in named} == {("a", "Low x"), ("b", "High x"), (None, None)}


def test_every_row_is_scored_once_by_a_model_that_did_not_see_it(spark):
    """A label of pure chance that a deep tree learns by heart: fitted rows would be right, out-of-fold rows are not."""
    rng = random.Random(4)
    rows = [(i, float(i), rng.randrange(2), rng.random() * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y int, v double").repartition(4)
    fold = models.hash_fold(["id"])
    scored, fitted = models.out_of_fold(df, DecisionTreeClassifier(maxDepth=14, maxBins=500), ["x"], "y", fold)
    got = scored.select("id", "fold", "y", "prediction", F.element_at("probabilities", 2).alias("p")).toPandas()
    assert sorted(got.id) == list(range(400)) and set(got.fold) == set(range(5)) and len(fitted) == 5
    assert 0.35 < (got.y == got.prediction).mean() < 0.65
    seen = models.applied(fitted[0], df.withColumn("fold", fold).where("fold <> 0")).toPandas()
    assert (seen.y == seen.prediction).mean() > 0.75
    table = models.compare_classifiers(df, {"tree": DecisionTreeClassifier(maxDepth=2)}, ["x"], "y", fold)
    assert models.best_model(table, "f1") == "tree"
    report = models.compare_regressors(df, {"tree": DecisionTreeRegressor(maxDepth=2)}, ["x"], "v", fold).first()
    assert report.rows == 400 and report.rmse == pytest.approx(math.sqrt(report.mse))
    mean = models.fold_mean(fitted[:2], df.select("id", "x"), ["id"])
    assert mean.count() == 400 and set(mean.select("prediction").distinct().toPandas().prediction) <= {0.0, 0.5, 1.0}


def test_linear_folds_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) + [1000, 5]
    y = x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0)], "id int, a double, b double, y double")
    got = models.linear_out_of_fold(df, ["a", "b"], "y", (F.col("id") % 4).cast("int"), 4).orderBy("id").toPandas()
    full = np.c_[np.ones(200), x]
    for f in range(4):
        other = np.arange(200) % 4 != f
        b = np.linalg.lstsq(full[other], y[other], rcond=None)[0]
        assert got.prediction.to_numpy()[~other] == pytest.approx(full[~other] @ b, rel=1e-8)


def test_class_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", None)], "y string, g string")
    got = evaluate.class_report(df, "y", "g", "a").first()
    assert (got.rows, got.accuracy, got.conversion_rate) == (4, 0.5, 50.0)
    assert (got.precision, got.recall, got.f1) == pytest.approx((0.5 * 0.5 + 0.25 * 0.5, 0.5 * 0.5 + 0.25 * 1, 0.5 * 0.5 + 0.25 * 2 / 3))
    assert evaluate.class_report(df.limit(0), "y", "g").first().accuracy is None


def test_running_sums_and_lookups(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(50)), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, v double").repartition(7)
    for down in (False, True):
        for got in scan.running_sums(df, "t", ["v"], descending=down, ranges=6).collect():
            assert got.cum_v == pytest.approx(sum(v for t, v in rows if (t >= got.t if down else t <= got.t)))
    curve = spark.createDataFrame([(0.1 * i, float(i)) for i in range(20)] + [(1.9, 25.0)], "h double, time double")
    found = scan.first_at_or_above(df, "v", curve, "h", "time", "first", ranges=5).collect()
    assert len(found) == 300 and all(r.first == min(float(i) for i in range(20) if 0.1 * i >= r.v) for r in found)
    beyond = scan.first_at_or_above(spark.createDataFrame([(9.0,), (None,)], "v double"), "v", curve, "h", "time", "first")
    assert [r.first for r in beyond.collect()] == [None, None]


def efron(t: np.ndarray, e: np.ndarray, z: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Newton over the Efron likelihood, time by time."""
    beta, n = np.zeros(z.shape[1]), len(t)
    for _ in range(60):
        w, g, h, ll = np.exp(z @ beta), np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), 0.0
        for u in np.unique(t[e == 1]):
            risk, dead = t >= u, (t == u) & (e == 1)
            ll += (z[dead] @ beta).sum()
            g += z[dead].sum(0)
            for k in range(dead.sum()):
                f = k / dead.sum()
                own = w * (risk - f * dead)
                mean = own @ z / own.sum()
                ll -= math.log(own.sum())
                g -= mean
                h += (z * own[:, None]).T @ z / own.sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(h + n * penalty * np.eye(len(beta)), g - n * penalty * beta)
    return beta, ll


@pytest.mark.parametrize("penalty", [0.0, 2.0])
def test_cox_equals_numpy_with_ties(spark, penalty):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2)) * [1, 3] + [0, 10]
    t = np.ceil(rng.exponential(np.exp(-0.8 * x[:, 0] + 0.2 * (x[:, 1] - 10))) * 4)
    e = (rng.random(120) < 0.7).astype(int)
    rows = [(float(a), int(b), *map(float, c), 1.0) for a, b, c in zip(t, e, x, strict=True)] + [(None, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, e int, a double, b double, c double")
    got = survival.cox(df.repartition(6), "t", "e", ["a", "b", "c"], penalty)
    again = survival.cox(df.coalesce(1), "t", "e", ["a", "b", "c"], penalty)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    beta, ll = efron(t, e, z, penalty)
    assert got.coefficients == pytest.approx([*(beta / x.std(0, ddof=1)), 0.0], rel=1e-6)
    assert got.log_likelihood == pytest.approx(ll) and again.coefficients == pytest.approx(got.coefficients, rel=1e-9)
    assert [r.feature for r in got.table(df).collect()] == ["a", "b", "c"]


def test_concordance_equals_pairs(spark):
    rng = random.Random(6)
    rows = [(float(rng.randrange(30)), rng.randrange(2), float(rng.randrange(12))) for _ in range(500)]
    c = d = p = 0
    for t, e, s in rows:
        for u, f, r in rows:
            if e and (t < u or (t == u and not f)):
                p, c, d = p + 1, c + (s < r), d + (s == r)
    df = spark.createDataFrame(rows + [(None, 1, 1.0)], "t double, e int, s double").repartition(5)
    for ranges in (1, 4, 64):
        got = survival.concordance(df, "t", "e", "s", ranges).first()
        assert (got.concordant, got.tied, got.pairs) == (c, d, p) and got["index"] == pytest.approx((c + d / 2) / p)
    assert survival.concordance(df.limit(0), "t", "e", "s").first()["index"] is None
    many = [(rng.random(), 1, rng.random()) for _ in range(3000)]
    t, s = np.array([r[0] for r in many]), np.array([r[2] for r in many])
    got = survival.concordance(spark.createDataFrame(many, "t double, e int, s double"), "t", "e", "s", 2).first()
    assert got.concordant == ((t[:, None] < t[None]) & (s[:, None] < s[None])).sum()


def test_events_and_retention(spark):
    df = spark.createDataFrame([("Yes", "2.5"), ("0.7", None), ("censored", "-1"), (None, "x")], "e string, t string")
    got = survival.survival_table(df.withColumn("f", F.lit(None).cast("string")), "t", "e", ["f"]).collect()
    assert [(r.e, r.t, r.f) for r in got] == [(1, 2.5, 0.0), (1, 0.75, 0.0), (0, 0.001, 0.0), (0, 0.75, 0.0)]
    curve = spark.createDataFrame([(1.0, 0.9), (3.0, 0.5)], "time double, survival double")
    assert [(r.months, r.time, r.rate) for r in survival.retention(curve, [2, 9]).collect()] == [(2.0, 1.0, 90.0), (9.0, 3.0, 50.0)]


def test_planted_outliers_lead(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    x[:40] += rng.choice([-9, 9], (40, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    forest = anomaly.grow_forest(df.repartition(5), ["a", "b", "c"])
    got = anomaly.anomaly_scores(df, forest).toPandas()
    assert got.anomaly[:40].sum() >= 38 and got.anomaly.sum() == 200 and got.anomaly_score.between(0, 1).all()
    again = anomaly.anomaly_scores(df.repartition(3), anomaly.grow_forest(df.repartition(2), ["a", "b", "c"])).orderBy("id").toPandas()
    assert np.array_equal(again.anomaly_score, got.anomaly_score)
    flat = anomaly.grow_forest(df.limit(3).selectExpr("id", "1D a", "1D b", "1D c"), ["a", "b", "c"])
    assert len(set(flat.scores(x).tolist())) == 1
    assert anomaly.grow_forest(df.limit(0), ["a"]).scores(x[:, :1]).shape == (2000,)


def test_counterfactuals_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() * 10, rng.random() * 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(3)
    model = lambda d: d.withColumn("s", F.col("a") - 2 * F.col("b"))
    low = df.where("a - 2 * b < 1")
    got = {r.id: r for r in models.counterfactuals(df, low, "id", ["a", "b"], model, F.col("s") >= 1, 40).collect()}
    lo, hi = [min(r[k] for r in rows) for k in (1, 2)], [max(r[k] for r in rows) for k in (1, 2)]
    tried = models.counterfactual_candidates(low, "id", ["a", "b"], {"a": (lo[0], hi[0]), "b": (lo[1], hi[1])}, 40).collect()
    best = {}
    for r in tried:
        if r.a - 2 * r.b >= 1:
            d = math.hypot((r.a - r._was_a) / (hi[0] - lo[0]), (r.b - r._was_b) / (hi[1] - lo[1]))
            best[r.id] = min(best.get(r.id, (9e9, 0)), (d, r.candidate))
    assert {i: (pytest.approx(r.distance), r.candidate) for i, r in got.items()} == best and len(best) > 20
    assert all(lo[0] <= r.a <= hi[0] and lo[1] <= r.b <= hi[1] and r.a - 2 * r.b >= 1 and r.changed >= 1 for r in got.values())


def test_preprocessor(spark):
    from tallyforge.operators import prepare

    rows = [(i, float(i % 10) if i % 4 else None, float(i), None if i % 3 else "x", ["b", "a", None][i % 3], float("nan") if i >= 85 else 1.0, 5.0 if i < 80 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v double, w double, rare string, c string, n double, late double")
    made = prepare.fit_preprocessor(df, ["id"])
    assert made.dropped == ["rare"] and set(made.flagged) == {"late", "n"} and made.medians["late"] == 5.0
    new = spark.createDataFrame([(1, None, 2.0, "x", "zzz", None, 7.0), (2, 3.0, None, None, None, 2.0, None)], df.schema)
    got = {r.id: r for r in made.transform(new).collect()}
    assert "rare" not in got[1] and (got[1].c, got[1].n_was_missing, got[1].late_was_missing, got[1].n) == (-1, 1, 0, 1.0)
    assert (got[2].c, got[2].late, got[2].late_was_missing, got[2].w) == (0, 5.0, 1, 49.5)
