"""Feature columns: date parts and flags, bins, rare values, capping, text hashes, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.clean import whole_days

from .select import exact_quantiles


def date_features(df: DataFrame, date: str) -> DataFrame:
    """Year, month, weekday (Monday 0), weekend, month start and end, and whole days before the table's last date."""
    d = F.col(date)
    last = df.agg(F.max(date).alias("_last"))
    out = df.crossJoin(F.broadcast(last))  # one row
    return out.select(
        *df.columns, F.year(d).alias("year"), F.month(d).alias("month"), F.weekday(d).alias("dow"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"), (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (F.last_day(d) == F.to_date(d)).cast("int").alias("is_month_end"), whole_days(F.col("_last"), d).alias("recency_days"),
    )


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Distinct exact quantile edges, at most ``bins`` + 1 numbers."""
    edges = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    return sorted({e for e in edges if e is not None})


def bin_by_edges(c: Column, edges: list[float]) -> Column:
    """The right-closed interval a value is in, from 0; the least value is in the first."""
    out = F.when(c.isNull(), None)
    for i, e in enumerate(edges[1:-1]):
        out = out.when(c <= e, i)
    return out.otherwise(max(len(edges) - 2, 0))


def rare_to_token(df: DataFrame, column: str, least: int = 10, share: float = 0.001, token: str = "__RARE__") -> DataFrame:
    """Values with a count of at most max(least, ceil(share of rows)) become ``token``."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    n = counts.agg(F.sum("_n").alias("_all"))
    rare = counts.crossJoin(F.broadcast(n)).where(F.col("_n") <= F.greatest(F.lit(least), F.ceil(F.col("_all") * share))).select("_v")
    return df.join(rare, df[column] == rare._v, "left").withColumn(column, F.when(F.col("_v").isNotNull(), token).otherwise(F.col(column))).drop("_v")


def capped(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, least: int = 50) -> DataFrame:
    """Adds ``<column>_capped``, between two quantiles when there are ``least`` values."""
    c = F.col(column)
    if df.agg(F.count(column)).first()[0] < least:
        return df.withColumn(f"{column}_capped", c)
    lo, hi = exact_quantiles(df, [column], [low, high])[column]
    return df.withColumn(f"{column}_capped", F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def text_hash_counts(df: DataFrame, key: str, text: str, buckets: int = 1024) -> DataFrame:
    """(key, bucket, n) of lower-cased tokens of two letters or digits and more, in long form."""
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("token"))
    return tokens.groupBy(key, F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by population mean and deviation, nulls as 0; a constant column becomes 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    s = filled.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = filled.crossJoin(F.broadcast(s))
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in columns}).select(df.columns)


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>__is_missing``, 1 for null."""
    return df.withColumns({f"{c}__is_missing": F.col(c).isNull().cast("int") for c in columns})


def binary_target(c: Column, positive: str | None = None) -> Column:
    """1 for the positive label, or for a number above 0; null counts as 0."""
    return F.coalesce((c.cast("string") == positive) if positive is not None else (c.try_cast("double") > 0), F.lit(False)).cast("int")


def label_codes(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Adds ``<column>_code``: labels numbered from 0 as they first appear by ``order``, which tells rows apart; null is a label of its own."""
    first = df.groupBy(F.col(column).alias("_v")).agg(F.min(F.struct(*order)).alias("_at"))
    codes = first.select("_v", (F.row_number().over(Window.orderBy("_at")) - 1).alias(f"{column}_code"))  # a row per label
    return df.join(codes, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def encoding_plan(df: DataFrame, columns: list[str], one_hot: int = 80) -> DataFrame:
    """(column, values, plan): one-hot up to ``one_hot`` values (null is one), hashing beyond, ignore for none; one aggregate."""
    made = [F.struct(F.lit(c).alias("column"), (F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))).alias("values")).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.agg(*made).select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select("r.*")
    return rows.withColumn("plan", F.when(F.col("values") == 0, "ignore").when(F.col("values") <= one_hot, "onehot").otherwise("hash"))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Adds ``__oh__<column>_<value>`` for each value of the fit; other values and null are 0 in all."""
    return df.withColumns({f"__oh__{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def fitted_values(df: DataFrame, column: str, most: int = 80) -> list[str]:
    """The values of a fit in order, refused beyond ``most``, so that what comes to the driver is bounded."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values: hash it")
    return sorted(found)


def safe_bundle(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Medians for missing numbers, "-1" for missing texts; one aggregate fits it."""
    mid = df.agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in numbers])
    out = df.crossJoin(F.broadcast(mid))  # one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in numbers} | {c: F.coalesce(F.col(c), F.lit("-1")) for c in texts}).select(df.columns)
