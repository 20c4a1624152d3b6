"""Calibration and coverage of scored rows by segment or by week, all segments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import week_ending_monday

BINS = 10


def scored_rows(df: DataFrame, y: str, probabilities: str, classes: list, threshold: float | dict, most: int = 2) -> DataFrame:
    """Adds _q (the largest probability), _right (whether that class is ``y``), _size, _covered and _abstained of the prediction set.

    A set holds the classes with 1 - p of at most the ``threshold``, or of the class's own one (a missing one is 1),
    most probable first, at most ``most``. Of equally probable classes the first leads.
    """
    own = [F.lit(float(threshold.get(c, 1.0) if isinstance(threshold, dict) else threshold)) for c in classes]
    place = F.array_position(F.array(*[F.lit(c).cast("string") for c in classes]), F.col(y).cast("string")) - 1
    cells = F.transform(probabilities, lambda p, i: F.struct((-p).alias("order"), i.cast("long").alias("i"), (1 - p <= F.get(F.array(*own), i)).alias("inside")))
    ranked = F.slice(F.array_sort(F.filter(cells, lambda c: c["inside"])), 1, most)
    top = F.array_min(cells)
    out = df.withColumn("_y", place).withColumn("_set", F.transform(ranked, lambda c: c["i"])).withColumn("_q", -top["order"]).withColumn("_right", (top["i"] == F.col("_y")).cast("double"))
    return out.withColumn("_size", F.size("_set")).withColumn("_covered", F.array_contains("_set", F.col("_y")).cast("double")).withColumn("_abstained", (F.size("_set") == 0).cast("double")).drop("_set", "_y")


def calibration_by(scored: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys ..., n, ece, coverage, avg_set_size, abstention_rate) of ``scored_rows`` by ``keys``.

    Bins are of equal frequency in each group, by exact quantiles of it; a value
    on an inner edge counts in both bins. Edges are joined back by key, so no
    group comes to the driver, and a large group's join can be split.
    """
    edges = scored.groupBy(*keys).agg(F.percentile("_q", F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_e"), F.count("*").alias("n"), F.avg("_covered").alias("coverage"), F.avg("_size").alias("avg_set_size"), F.avg("_abstained").alias("abstention_rate"))
    named = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_e")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = lambda i: (F.col("_q") >= F.get("_e", i)) & (F.when(i < bins - 1, F.col("_q") < F.get("_e", i + 1) + 1e-12).otherwise(F.col("_q") <= F.get("_e", i + 1) + 1e-12))
    placed = scored.join(named, same).withColumn("_b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), inside)))
    per = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.abs(F.avg("_right") - F.avg("_q")).alias("_gap"))
    ece = per.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg((F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"))
    return edges.join(ece, same, "left").select(*keys, "n", "ece", "coverage", "avg_set_size", "abstention_rate")


def segment_table(df: DataFrame, y: str, probabilities: str, classes: list, threshold: float | dict, columns: list[str], min_n: int = 200, most: int = 2, target: float = 0.90, ece_alarm: float = 0.08, tolerance: float = 0.02, max_values: int = 30) -> DataFrame:
    """(name, n, ece, coverage, avg_set_size, abstention_rate, alarm, low_n, rank) of each ``column=value``, alarms first, then the largest.

    Of each column the ``max_values`` most frequent values (by name on a tie);
    null is "NA". low_n: fewer than ``min_n`` rows. An alarm is an ECE above
    ``ece_alarm`` where n is not low, or a coverage below ``target`` less
    ``tolerance``.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("value")) for c in columns])
    long = scored_rows(df, y, probabilities, classes, threshold, most).withColumn("_s", F.explode(cells))
    long = long.select(F.col("_s.column").alias("column"), F.col("_s.value").alias("value"), "_q", "_right", "_size", "_covered", "_abstained")
    top = long.groupBy("column", "value").agg(F.count("*").alias("_n")).withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("_n"), "value"))).where(F.col("_r") <= max_values)
    kept = long.join(F.broadcast(top.select("column", "value")), ["column", "value"])  # max_values rows per column
    out = calibration_by(kept, ["column", "value"])
    low = F.col("n") < min_n
    alarm = (~low & (F.col("ece") > ece_alarm)) | (F.col("coverage") < target - tolerance)
    out = out.select(F.concat_ws("=", "column", "value").alias("name"), "n", "ece", "coverage", "avg_set_size", "abstention_rate", F.coalesce(alarm, F.lit(False)).alias("alarm"), low.alias("low_n"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("alarm"), F.desc("n"), "name")))  # a row per segment


def weekly_calibration(df: DataFrame, y: str, probabilities: str, classes: list, threshold: float | dict, ts: str, most: int = 2) -> DataFrame:
    """(week, n, ece, coverage): by weeks that end on Monday; rows without a time are left out."""
    scored = scored_rows(df.where(F.col(ts).isNotNull()), y, probabilities, classes, threshold, most).withColumn("week", week_ending_monday(F.col(ts)))
    return calibration_by(scored, ["week"]).select("week", "n", "ece", "coverage")
