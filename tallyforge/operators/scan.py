"""Sums and lookups along one global order, without a window over the whole table.

Values are cut into ranges at approximate quantiles. A first aggregate gives each
range's total, a number per range that comes to the driver; a window inside each
range adds what the ranges before it hold. So a sort never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def range_edges(df: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges`` - 1 distinct values that cut a column into ranges of about equal rows."""
    at = F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 100 * ranges)
    return sorted(set(df.agg(at).first()[0] or []))


def range_of(c: Column, edges: list[float]) -> Column:
    """The range a value is in: how many edges are below it, so equal values share a range."""
    out = F.lit(0)
    for e in edges:
        out = out + (c.cast("double") > F.lit(float(e))).cast("int")
    return out


def running_sums(df: DataFrame, order: str, columns: list[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds ``cum_<column>``: its sum over all rows up to this one by ``order``, rows of equal order included.

    ``order`` is a number without nulls. ``df`` is read three times; persist it where it is costly.
    """
    edges = range_edges(df, order, ranges)
    cut = df.withColumn("_range", range_of(F.col(order), edges))
    totals = {r._range: r for r in cut.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns]).collect()}  # a row per range
    numbers = sorted(range(len(edges) + 1), reverse=descending)
    before = {c: dict.fromkeys(numbers, 0.0) for c in columns}
    for c in columns:
        so_far = 0.0
        for i in numbers:
            before[c][i] = so_far
            so_far += float((totals[i][c] if i in totals else None) or 0.0)
    w = Window.partitionBy("_range").orderBy(F.col(order).desc() if descending else F.col(order))
    carried = {c: F.get(F.array(*[F.lit(before[c][i]) for i in range(len(edges) + 1)]), F.col("_range")) for c in columns}
    return cut.withColumns({f"cum_{c}": F.sum(c).over(w) + carried[c] for c in columns}).drop("_range")


def first_at_or_above(rows: DataFrame, value: str, curve: DataFrame, level: str, at: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: the smallest ``at`` of the ``curve`` points whose ``level`` is at least the row's ``value``; null where there is none.

    Rows with a null value get null.
    """
    points = curve.where(F.col(level).isNotNull()).select(F.col(level).cast("double").alias("_v"), F.col(at).alias("_at"))
    edges = range_edges(points, "_v", ranges)
    least = {r._range: r.least for r in points.groupBy(range_of(F.col("_v"), edges).alias("_range")).agg(F.min("_at").alias("least")).collect()}
    later, carry = None, {}
    for i in range(len(edges), -1, -1):
        carry[i] = later
        later = min((x for x in (later, least.get(i)) if x is not None), default=None)
    kind = curve.schema[at].dataType
    both = rows.withColumn("_v", F.col(value).cast("double")).withColumn("_point", F.lit(0)).unionByName(points.withColumn("_point", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_range", range_of(F.col("_v"), edges))
    w = Window.partitionBy("_range").orderBy(F.col("_v").desc(), F.col("_point").desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = F.get(F.array(*[F.lit(carry[i]).cast(kind) for i in range(len(edges) + 1)]), F.col("_range"))
    found = F.when(F.col("_v").isNotNull(), F.least(F.min("_at").over(w), beyond))
    return both.withColumn(name, found).where("_point = 0").drop("_v", "_at", "_point", "_range")
