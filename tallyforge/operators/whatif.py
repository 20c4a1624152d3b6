"""What-if changes of columns, and summaries of what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import group_medians, smallest


def change(c: Column, kind: str, amount: float) -> Column:
    """percentage, additive, multiplicative or set; nulls stay null."""
    made = {"percentage": c * (1 + amount / 100), "additive": c + amount, "multiplicative": c * amount, "set": F.lit(float(amount))}[kind]
    return F.when(c.isNotNull(), made)


def rescale(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """To [low, high]; a constant column to the middle."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    part = F.coalesce(F.try_divide(F.col(column) - F.col("_a"), F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))), F.lit(0.5))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.when(F.col(column).isNotNull(), low + part * (high - low))).drop("_a", "_b")


def replace_category(c: Column, new: str, old: str | None = None) -> Column:
    return F.when(c.isNotNull() if old is None else c == old, new).otherwise(c)


def boolean_force(c: Column, value: bool) -> Column:
    """``value`` for every row that has one."""
    return F.when(c.isNotNull(), F.lit(value))


def category_boost(df: DataFrame, column: str, category: str, percent: float, key: list[str], seed: int = 42) -> DataFrame:
    """``df`` with exactly floor(``percent`` % of the non-null rows) rows of other categories (or all of these, where there are fewer) turned into ``category``.

    Rows are those with the smallest hashes of ``key``, which tells rows apart, so the choice does not
    depend on partitioning. Nulls stay.
    """
    counts = df.agg(F.count(column).alias("n"), F.count_if(F.col(column) != category).alias("others")).first()
    k = min(int(percent / 100 * counts.n), counts.others)
    if k <= 0 or not category:
        return df
    other = F.coalesce(F.col(column) != category, F.lit(False))
    hashed = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52))
    chosen = smallest(df.where(other), hashed, [F.col(c) for c in key], k, "_chosen")
    turned = chosen.withColumn(column, F.when(F.col("_chosen"), category).otherwise(F.col(column))).drop("_chosen")
    return df.where(~other).unionByName(turned)


def change_summary(df: DataFrame, before: str, after: str, by: str) -> DataFrame:
    """(scope, ``by``, which, mean, median, std, mean_change, ci_low, ci_high) of a number before and after its change.

    For the whole table (scope "all", a null ``by``) and for each value of ``by``
    (scope "group"); std is a sample's, the interval of the mean change the
    normal one of 95 %. One aggregate, and the exact medians by brackets.
    """
    d = F.col(after) - F.col(before)
    scopes = F.array(F.struct(F.lit("all").alias("scope"), F.lit(None).cast(df.schema[by].dataType).alias("by")), F.struct(F.lit("group").alias("scope"), F.col(by).alias("by")))
    sides = F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).cast("double").alias("v")) for w, c in (("before", before), ("after", after))])
    rows = df.select(F.explode(scopes).alias("s"), sides.alias("sides"), d.alias("d")).select("s.*", F.explode("sides").alias("r"), "d").select("scope", "by", "r.*", "d")
    keys = ["scope", "by", "which"]
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("d"))
    made = rows.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.avg("d").alias("mean_change"), (F.avg("d") - half).alias("ci_low"), (F.avg("d") + half).alias("ci_high"))
    middle = group_medians(rows.select(*keys, "v"), keys, "v").select(F.col("scope").alias("_s"), F.col("by").alias("_b"), F.col("which").alias("_w"), "median")
    both = made.join(middle, (F.col("scope") == F.col("_s")) & F.col("by").eqNullSafe(F.col("_b")) & (F.col("which") == F.col("_w")))
    return both.select("scope", F.col("by").alias(by), "which", "mean", "median", "std", "mean_change", "ci_low", "ci_high")


def category_summary(df: DataFrame, before: str, after: str, most: int = 5) -> DataFrame:
    """(which, value, n, rank): the ``most`` commonest values before and after a change, by value on a tie; nulls don't count."""
    sides = F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).cast("string").alias("value")) for w, c in (("before", before), ("after", after))])
    counts = df.select(F.explode(sides).alias("r")).select("r.*").where("value is not null").groupBy("which", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("which").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most)
