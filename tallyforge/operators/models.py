"""Training by folds, scoring, importance, partial dependence and counterfactuals.

Models are Spark ML estimators, fitted and applied as Spark jobs. A row's fold
comes from its key's hash, so it does not depend on partitioning. Every row is
scored once, by a model that did not see it; rows never come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluate
from .cluster import _no_gaps

FOLDS = 5


def hash_fold(keys: list[str], folds: int = FOLDS, seed: int = 42) -> Column:
    """A row's fold, 0 to ``folds`` - 1, by the hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int")


def fit(df: DataFrame, estimator: Estimator, features: list[str]) -> Model:
    """A pipeline of the features' vector and the estimator, fitted on rows without a missing feature."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator]).fit(df)


def applied(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``, and ``probabilities`` (an array by class) where the model has them; rows with a missing feature are left out."""
    out = model.transform(df)
    more = [vector_to_array("probability").alias("probabilities")] if "probability" in out.columns else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "prediction", *more)


def out_of_fold(df: DataFrame, estimator: Estimator, features: list[str], target: str, fold: Column, folds: int = FOLDS) -> tuple[DataFrame, list[Model]]:
    """(every row scored by the model of the other folds, the models); ``estimator`` reads ``features`` and ``label``.

    Rows with a missing feature or target are left out. Columns: those of
    ``df``, ``fold``, ``prediction`` and for classifiers ``probabilities``.
    """
    rows = _no_gaps(df, [*features, target]).withColumn("fold", fold)
    slim = rows.select("fold", F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]).persist()
    models = [fit(slim.where(F.col("fold") != f), estimator, features) for f in range(folds)]
    slim.unpersist()
    parts = [applied(m, rows.where(F.col("fold") == f)) for f, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts), models


def compare_classifiers(df: DataFrame, candidates: dict[str, Estimator], features: list[str], target: str, fold: Column, folds: int = FOLDS) -> DataFrame:
    """(model, rows, accuracy, precision, recall, f1, conversion_rate) over the out-of-fold table of each candidate, classes weighted by their rows."""
    made = []
    for name, estimator in candidates.items():
        scored, _ = out_of_fold(df, estimator, features, target, fold, folds)
        report = evaluate.class_report(scored.withColumn("_y", F.col(target).cast("double")), "_y", "prediction")
        made.append(report.withColumn("model", F.lit(name)).select("model", *report.columns))
    return reduce(DataFrame.unionByName, made)


def compare_regressors(df: DataFrame, candidates: dict[str, Estimator], features: list[str], target: str, fold: Column, folds: int = FOLDS) -> DataFrame:
    """(model, rows, mae, mse, rmse, r2) over the out-of-fold table of each candidate."""
    made = []
    for name, estimator in candidates.items():
        report = evaluate.regression_report(out_of_fold(df, estimator, features, target, fold, folds)[0], target, "prediction")
        made.append(report.withColumn("model", F.lit(name)).select("model", *report.columns))
    return reduce(DataFrame.unionByName, made)


def best_model(report: DataFrame, measure: str, largest: bool = True) -> str:
    """The candidate with the best ``measure``, the first by name on a tie; a row per candidate."""
    order = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
    return report.orderBy(order, "model").first().model


def fold_mean(models: list[Model], df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``prediction``, the mean of what the fold models give; ``keys`` tell rows apart."""
    parts = [applied(m, df).select(*keys, "prediction") for m in models]
    mean = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.avg("prediction").alias("prediction"))
    return df.join(mean, keys)


def score(model: Model, df: DataFrame, classes: list[str], positive: int = 1) -> DataFrame:
    """``df`` with prediction, confidence (the probability of the ``positive`` class), risk_tier and prob_class_<name>."""
    out = applied(model, df)
    p = F.get("probabilities", F.lit(positive))
    tier = F.when(p >= 0.8, "Extreme Risk").when(p >= 0.5, "High Risk").when(p >= 0.2, "Medium Risk").otherwise("Low Risk")
    each = {f"prob_class_{c}": F.get("probabilities", F.lit(i)) for i, c in enumerate(classes)}
    return out.withColumns({"confidence": p, "risk_tier": tier} | each).drop("probabilities")


def importance(model: Model, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted tree model, in percent, the largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(((c, float(100 * w)) for c, w in zip(features, weights, strict=True)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def linear_out_of_fold(df: DataFrame, features: list[str], target: str, fold: Column, folds: int = FOLDS, ridge: float = 0.0) -> DataFrame:
    """``df`` with ``fold`` and ``prediction`` of the least squares fit on the other folds.

    The moments of all rows less those of a fold are those of the others, so one
    aggregate by fold fits every model. Features are centred before they are
    multiplied. ``ridge`` is added to the normal equations' diagonal. Rows with
    a missing feature or target are left out.
    """
    rows = _no_gaps(df, [*features, target]).withColumn("fold", fold)
    names = [*features, target]
    centre = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    at = [F.col(c) - F.lit(float(centre[f"m{i}"] or 0.0)) for i, c in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(at)], *[F.sum(at[i] * at[j]).alias(f"s{i}_{j}") for i, j in pairs])
    p = len(features)
    moments = {}
    for r in sums.collect():  # a row per fold
        m = np.zeros((p + 2, p + 2))
        m[0, 0], m[0, 1:], m[1:, 0] = r.n, [r[f"s{i}"] for i in range(p + 1)], [r[f"s{i}"] for i in range(p + 1)]
        for i, j in pairs:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"s{i}_{j}"]
        moments[r.fold] = m
    total = sum(moments.values(), np.zeros((p + 2, p + 2)))
    prediction = F.lit(None).cast("double")
    for f in range(folds):
        m = total - moments.get(f, 0)
        left = m[: p + 1, : p + 1] + ridge * np.diag([0.0] + [1.0] * p)
        b = np.linalg.lstsq(left, m[: p + 1, p + 1], rcond=None)[0]
        line = F.lit(float(b[0] + (centre[f"m{p}"] or 0.0)))
        for v, w in zip(at[:p], b[1:], strict=True):
            line = line + F.lit(float(w)) * v
        prediction = F.when(F.col("fold") == f, line).otherwise(prediction)
    return rows.withColumn("prediction", prediction)


def partial_dependence(df: DataFrame, model: Callable[[DataFrame], DataFrame], feature: str, points: int = 20) -> DataFrame:
    """(value, mean): the mean of what ``model`` adds as ``prediction`` with ``feature`` set to each of ``points`` values from its 5 to its 95 percentile.

    Each row is repeated once a point and falls into a mean; no cross join.
    """
    lo, hi = df.agg(F.percentile(feature, F.array(F.lit(0.05), F.lit(0.95)))).first()[0]
    values = [float(v) for v in np.linspace(lo, hi, points)]
    each = df.withColumn(feature, F.explode(F.array(*[F.lit(v) for v in values])))
    return model(each).groupBy(F.col(feature).alias("value")).agg(F.avg("prediction").alias("mean"))


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 out of the hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def counterfactual_candidates(rows: DataFrame, key: str, features: list[str], limits: dict[str, tuple[float, float]], candidates: int = 256, most: int = 10, seed: int = 42) -> DataFrame:
    """``rows`` repeated ``candidates`` times with some of ``features`` (at most ``most``) drawn anew between ``limits``; ``candidate`` numbers them, 0 is the row itself, put inside the limits.

    What is drawn comes from the key's, the candidate's and the feature's hash.
    """
    out = rows.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    at = [F.lit(seed), F.col(key), F.col("candidate")]
    ranks = F.array_sort(F.array(*[F.struct(uniform(*at, F.lit(f"order {c}")).alias("u"), F.lit(c).alias("c")) for c in features]))
    many = 1 + F.floor(uniform(*at, F.lit("how many")) * min(most, len(features)))
    out = out.withColumn("_chosen", F.when(F.col("candidate") > 0, F.transform(F.slice(ranks, F.lit(1), many.cast("int")), lambda s: s["c"])).otherwise(F.array().cast("array<string>")))
    new = {}
    for c in features:
        lo, hi = limits[c]
        kept = F.least(F.greatest(F.col(c).cast("double"), F.lit(float(lo))), F.lit(float(hi)))
        new[c] = F.when(F.array_contains("_chosen", F.lit(c)), F.lit(float(lo)) + uniform(*at, F.lit(f"value {c}")) * float(hi - lo)).otherwise(kept)
    return out.withColumns({f"_was_{c}": F.col(c).cast("double") for c in features} | new).drop("_chosen")


def counterfactuals(train: DataFrame, rows: DataFrame, key: str, features: list[str], model: Callable[[DataFrame], DataFrame], reached: Column, candidates: int = 256, most: int = 10, seed: int = 42) -> DataFrame:
    """(key, candidate, distance, changed, features ...): for each row of ``rows`` the nearest candidate that ``reached`` holds for after ``model``; rows without one are left out.

    Features stay between the least and largest values of ``train``. The distance
    is Euclidean over features divided by these ranges; the smaller candidate
    number wins a tie. The nearest one is kept by a minimum per key, which
    combines before the shuffle.
    """
    ends = train.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"_{i}") for i, c in enumerate(features)]).first()
    limits = {c: (ends[f"_{i}"].lo, ends[f"_{i}"].hi) for i, c in enumerate(features)}
    tried = model(counterfactual_candidates(rows, key, features, limits, candidates, most, seed)).where(reached)
    apart, changed = F.lit(0.0), F.lit(0)
    for c in features:
        step = (F.col(c) - F.col(f"_was_{c}")) / float((limits[c][1] - limits[c][0]) or 1.0)
        apart = apart + step * step
        changed = changed + (F.col(c) != F.col(f"_was_{c}")).cast("int")
    best = F.min(F.struct(F.sqrt(apart).alias("distance"), "candidate", changed.alias("changed"), *features)).alias("r")
    return tried.groupBy(key).agg(best).select(key, "r.candidate", "r.distance", "r.changed", *[f"r.{c}" for c in features])
