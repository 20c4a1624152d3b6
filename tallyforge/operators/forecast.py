"""Forecasts of many series at once: additive Holt-Winters by key, and a forest over lags stepped for all keys together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import applied, fit

#: Smoothing weights that are tried for level, trend and season.
GRID = (0.05, 0.2, 0.4, 0.6, 0.8)


def smoothed(y: np.ndarray, season: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared one-step errors, level, trend, seasons) of additive smoothing for many weights at once.

    The start is the first season's mean, the mean change to the second season
    by step, and the first season's distances from its mean.
    """
    first, second = y[:season].mean(), y[season : 2 * season].mean()
    level, trend = np.full(len(alpha), first), np.full(len(alpha), (second - first) / season)
    seasons = np.tile(y[:season] - first, (len(alpha), 1))
    errors = np.zeros(len(alpha))
    for i in range(season, len(y)):
        s = seasons[:, i % season]
        errors += (y[i] - level - trend - s) ** 2
        before = level
        level = alpha * (y[i] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        seasons[:, i % season] = gamma * (y[i] - level) + (1 - gamma) * s
    return errors, level, trend, seasons


def holt_winters(y: np.ndarray, steps: int, season: int = 12) -> np.ndarray:
    """The next ``steps`` values by the weights of ``GRID`` with the least squared one-step error (the first on a tie); empty for fewer than two seasons."""
    if len(y) < 2 * season:
        return np.zeros(0)
    a, b, g = (v.ravel() for v in np.meshgrid(GRID, GRID, GRID, indexing="ij"))
    errors, level, trend, seasons = smoothed(y, season, a, b, g)
    k = int(errors.argmin())
    return np.array([level[k] + h * trend[k] + seasons[k, (len(y) + h - 1) % season] for h in range(1, steps + 1)])


def holt_winters_forecast(series: DataFrame, key: str, ts: str, y: str, steps: int = 7, season: int = 12) -> DataFrame:
    """(key, step, forecast) of every series of at least two seasons; values are taken in order of ``ts``, missing ones are left out.

    A series is one task's group: a few numbers a row.
    """
    kind = series.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = holt_winters(part.sort_values("t")["y"].to_numpy(float), steps, season)
        return pd.DataFrame({"key": part["key"].iloc[:1].repeat(len(made)).to_numpy(), "step": np.arange(1, len(made) + 1, dtype=np.int32), "forecast": made})

    rows = series.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).select(F.col(key).alias("key"), F.col(ts).alias("t"), F.col(y).cast("double").alias("y"))
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, step int, forecast double").withColumnRenamed("key", key)


def lag_forest_forecast(series: DataFrame, key: str, ts: str, y: str, steps: int = 7, lags: int = 5, trees: int = 20, seed: int = 42) -> DataFrame:
    """(key, step, forecast) by a random forest over the last ``lags`` values, fitted on all series, its own forecasts fed back.

    Each key is one row of its last values; a step scores all keys and shifts
    their values, so the work per step does not depend on the series' length.
    Keys with fewer than ``lags`` values are left out; without a row to learn
    from there is no forecast.
    """
    rows = series.where(F.col(y).isNotNull()).select(key, F.col(ts).alias("_t"), F.col(y).cast("double").alias("label"))
    w = Window.partitionBy(key).orderBy("_t")
    names = [f"lag_{i}" for i in range(lags, 0, -1)]
    known = rows.withColumns({f"lag_{i}": F.lag("label", i).over(w) for i in range(1, lags + 1)}).where(F.col(f"lag_{lags}").isNotNull())
    form = f"{key} {series.schema[key].dataType.simpleString()}, step int, forecast double"
    if not known.limit(1).count():
        return series.sparkSession.createDataFrame([], form)
    model = fit(known, RandomForestRegressor(numTrees=trees, seed=seed), names)
    back = Window.partitionBy(key).orderBy(F.desc("_t"))
    last = rows.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= lags).groupBy(key).agg(*[F.max(F.when(F.col("_r") == i, F.col("label"))).alias(f"lag_{i}") for i in range(1, lags + 1)])
    state, made = last.where(F.col(f"lag_{lags}").isNotNull()), []
    for step in range(1, steps + 1):
        state = applied(model, state).withColumnRenamed("prediction", f"_f{step}")
        shifted = {f"lag_{i}": F.col(f"lag_{i - 1}") for i in range(2, lags + 1)} | {"lag_1": F.col(f"_f{step}")}
        state = state.withColumns(shifted)
        made.append(F.struct(F.lit(step).alias("step"), F.col(f"_f{step}").alias("forecast")))
    return state.select(key, F.explode(F.array(*made)).alias("r")).select(key, "r.*")
