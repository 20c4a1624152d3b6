"""Time series per key: differences, lags, weekly labels, gaps filled, naive forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differences(df: DataFrame, key: str, ts: str | list[str], y: str) -> DataFrame:
    """Adds ``diff`` to the row before of the same key; first rows go."""
    ts = [ts] if isinstance(ts, str) else ts
    w = Window.partitionBy(key).orderBy(*ts)
    return df.withColumn("diff", F.col(y) - F.lag(y).over(w)).where("diff IS NOT NULL")


def lag_matrix(df: DataFrame, key: str, ts: str, y: str, lags: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumns({f"lag_{i}": F.lag(y, i).over(w) for i in range(1, lags + 1)}).where(f"lag_{lags} IS NOT NULL")


def week_ending_monday(ts: Column) -> Column:
    return F.next_day(F.date_sub(F.to_date(ts), 1), "Mon")


def daily(df: DataFrame, key: str, ts: str, y: str) -> DataFrame:
    return df.where(f"{y} IS NOT NULL AND NOT isnan({y})").groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(y).alias("y"))


def regular_days(series: DataFrame, key: str) -> DataFrame:
    """Every day between a key's first and last, missing values interpolated linearly."""
    ends = series.groupBy(F.col(key).alias("_k")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("_k", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("_d"))
    full = days.join(series, (days._k == series[key]) & (days._d == series.day), "left").select(F.col("_k").alias(key), F.col("_d").alias("day"), "y")
    before, after = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("y").isNotNull(), F.struct("day", "y"))
    full = full.withColumn("p", F.last(at, True).over(before)).withColumn("n", F.first(at, True).over(after))
    weight = F.datediff("day", F.col("p.day")) / F.datediff(F.col("n.day"), F.col("p.day"))
    return full.select(key, "day", F.coalesce("y", F.col("p.y") + weight * (F.col("n.y") - F.col("p.y"))).alias("y"))


def naive_forecast(series: DataFrame, key: str, steps: int = 7) -> DataFrame:
    last = series.groupBy(key).agg(F.max("day").alias("last"), F.max_by("y", "day").alias("forecast"))
    return last.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.date_add(F.col("last"), i))).alias("day"), "forecast")


def autocorrelation(series: DataFrame, key: str, ts: str, y: str, lags: int = 20) -> DataFrame:
    """(key, lag, acf) of the differenced series, for lags up to a quarter of its length; null for a constant one."""
    d = differences(series, key, ts, y)
    every = Window.partitionBy(key)
    w = every.orderBy(ts)
    centred = d.withColumn("_c", F.col("diff") - F.avg("diff").over(every)).withColumn("_n", F.count("*").over(every))
    sums = centred.select(key, "_n", (F.col("_c") * F.col("_c")).alias("_0"), *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_{k}") for k in range(1, lags + 1)])
    one = sums.groupBy(key).agg(F.max("_n").alias("_n"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0.0)).alias(f"_{k}") for k in range(lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}"), F.col("_0")).alias("acf")) for k in range(1, lags + 1)])
    return one.select(key, "_n", F.explode(cells).alias("r")).where(F.col("r.lag") <= F.floor(F.col("_n") / 4)).select(key, "r.*")


# The longest gap in days of a frequency, its letter, and its season's length.
FREQUENCIES = [(0.5, "H", 24), (4, "D", 7), (15, "W", 52), (60, "M", 12), (200, "Q", 4)]


def frequency(series: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, gap_days, freq, season_length, seasonal): the commonest gap (the shorter on a tie) and whether three seasons fit."""
    w = Window.partitionBy(key).orderBy(ts)
    gaps = series.select(key, ((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp"))) / 86400).alias("gap"))
    counts = gaps.groupBy(key, "gap").agg(F.count("*").alias("n"))
    one = counts.groupBy(key).agg(F.min_by("gap", F.when(F.col("gap").isNotNull(), F.struct(-F.col("n"), F.col("gap")))).alias("gap_days"), F.sum("n").alias("n"))
    freq, season = F.when(F.col("gap_days").isNull(), None), F.when(F.col("gap_days").isNull(), 0)
    for most, letter, length in FREQUENCIES:
        freq, season = freq.when(F.col("gap_days") <= most, letter), season.when(F.col("gap_days") <= most, length)
    one = one.select(key, "gap_days", "n", freq.otherwise("Y").alias("freq"), season.otherwise(1).alias("season_length"))
    return one.select(key, "gap_days", F.when(F.col("gap_days").isNotNull(), F.col("freq")).alias("freq"), "season_length", ((F.col("season_length") > 0) & (F.col("n") >= 3 * F.col("season_length"))).alias("seasonal"))


def spikes_removed(series: DataFrame, key: str, limit: float = 12.0, tail: float = 0.001) -> DataFrame:
    """``series`` (key, day, y) without spikes: values whose 0.6745 * |y - median| / MAD is above ``limit`` are interpolated, then all are put between the ``tail`` quantiles of their key.

    A key whose MAD is 0 has no spikes. Medians and quantiles are exact, by key.
    """
    mid = series.groupBy(F.col(key).alias("_k")).agg(F.percentile("y", 0.5).alias("_m"))
    off = series.join(mid, F.col(key) == F.col("_k")).drop("_k").withColumn("_d", F.abs(F.col("y") - F.col("_m")))
    mad = off.groupBy(F.col(key).alias("_k")).agg(F.percentile("_d", 0.5).alias("_mad"))
    gone = off.join(mad, F.col(key) == F.col("_k")).drop("_k").withColumn("y", F.when(F.coalesce(0.6745 * F.col("_d") / F.nullif(F.col("_mad"), F.lit(0.0)) > limit, F.lit(False)), None).otherwise(F.col("y")))
    w = Window.partitionBy(key).orderBy("day")
    at = F.when(F.col("y").isNotNull(), F.struct("day", "y"))
    filled = gone.withColumn("p", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    weight = F.try_divide(F.datediff("day", F.col("p.day")).cast("double"), F.datediff(F.col("n.day"), F.col("p.day")))
    filled = filled.select(key, "day", F.coalesce("y", F.col("p.y") + weight * (F.col("n.y") - F.col("p.y")), F.col("p.y"), F.col("n.y")).alias("y"))
    ends = filled.groupBy(F.col(key).alias("_k")).agg(F.percentile("y", F.array(F.lit(tail), F.lit(1 - tail))).alias("_e"))
    return filled.join(ends, F.col(key) == F.col("_k")).select(key, "day", F.greatest(F.least("y", F.get("_e", F.lit(1))), F.get("_e", F.lit(0))).alias("y"))
