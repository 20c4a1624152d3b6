"""Keys: keep-last, duplicates, top values, newest entries, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``; rows with a null key go first, so they are no hot group.

    ``max_by`` combines before the shuffle, so a hot key costs one row a task.
    """
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return last.select([F.col("_r")[c].alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; null counts as one key."""
    return df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value, count) of the ``n`` most frequent values of each column, all columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    best = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def newest(df: DataFrame, groups: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows per group; Spark trims each task's rows to ``n`` before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hashed_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: a key is always on the same side; a null key is in training."""
    return df.withColumn("split", F.when(draw(key, seed) % 10_000 < int(test_share * 10_000), "test").otherwise("train"))


def draw(key: str, seed: int) -> Column:
    """A number below 2^32 that the key and the seed fix, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def stratified_quota(df: DataFrame, stratum: str, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows with the strata's shares kept, those of the lowest draws; a sampling operator."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    quota = sizes.crossJoin(total).select(F.col(stratum).alias("_s"), "_n", F.round(F.col("_n") / F.col("_total") * rows).cast("long").alias("_quota"))
    # the draws of the rows that can be among the first are low, so few rows of a stratum meet to be ranked
    near = df.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_draw", draw(key, seed))
    near = near.where(F.col("_draw") <= F.lit(2.0**32) * (2 * F.col("_quota") + 100) / F.col("_n"))
    w = Window.partitionBy(stratum).orderBy("_draw", key)
    return near.withColumn("_rank", F.row_number().over(w)).where("_rank <= _quota").select(df.columns)


def nearest(df: DataFrame, time: str, at: list[float]) -> DataFrame:
    """For each of a few given times the row whose ``time`` is closest, the earlier on a tie."""
    picks = [F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(time) - F.lit(t)), F.col(time))).alias(f"r{i}") for i, t in enumerate(at)]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("at"), F.col(f"r{i}").alias("row")) for i, t in enumerate(at)])
    return df.agg(*picks).select(F.explode(rows).alias("p")).select("p.at", "p.row.*")


def canonical_join(customers: DataFrame, orders: DataFrame, marketing: DataFrame | None = None) -> DataFrame:
    """Customers with their orders and, if given, their marketing sends, by customer_id; customers without any stay.

    Columns of orders and sends that customers have too are prefixed.
    """
    out = customers
    for name, side in (("order", orders), ("marketing", marketing)):
        if side is not None:
            named = {c: f"{name}_{c}" for c in side.columns if c in out.columns and c != "customer_id"}
            side = side.withColumnsRenamed(named).withColumnRenamed("customer_id", "_c")
            out = out.join(side, F.col("customer_id") == F.col("_c"), "left").drop("_c")
    return out


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One of each group of rows that are equal in ``columns``, or in all."""
    return df.select(*(columns or df.columns)).dropDuplicates()


def stratified_split(df: DataFrame, stratum: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that each stratum gives its share to the test, rounded: its rows with the smallest draws of ``key``, by key on a tie.

    Only rows whose draw may be among a stratum's smallest are ranked, about
    ``test_share`` and a margin of them.
    """
    w = Window.partitionBy(stratum).orderBy("_draw", key)
    drawn = df.withColumn("_draw", draw(key, seed))
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.round(F.count("*") * test_share).cast("long").alias("_test"))
    ranked = drawn.withColumn("_rank", F.row_number().over(w)).join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_test"), "test").otherwise("train")).drop("_draw", "_rank", "_s", "_test")


def time_split(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Adds ``split``: rows from ``cutoff`` on are the test; a missing time is in training."""
    return df.withColumn("split", F.when(F.col(ts) >= F.lit(cutoff).cast("timestamp"), "test").otherwise("train"))


def group_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that all rows of a group are on one side."""
    return hashed_split(df, group, test_share, seed)


def sample_by_confidence(df: DataFrame, confidence: str, key: str, n: int, strategy: str = "lowest_confidence", seed: int = 42) -> DataFrame:
    """``n`` rows with the lowest or highest confidence, or drawn by ``key``'s hash; the smaller key leads on a tie. A feature with a limit."""
    order = {"lowest_confidence": F.asc_nulls_last(confidence), "highest_confidence": F.desc_nulls_last(confidence), "random": draw(key, seed)}[strategy]
    return df.orderBy(order, key).limit(n)


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, by column name; what one lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns that they share, in the first one's order."""
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*shared), b.select(*shared)


def with_target(df: DataFrame, target: str, drop: list[str] | None = None) -> DataFrame:
    """Rows that have a target, without the columns to ``drop``."""
    return df.na.drop(subset=[target]).drop(*(drop or []))
