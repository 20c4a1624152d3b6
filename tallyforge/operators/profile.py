"""Profiles of a table: health, columns, outliers, nulls; one wide aggregate per pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import exact_quantiles


def column_report(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(column, kind, non_nulls, nulls, null_rate, distinct, min, max, mean, p05, p25, p50, p75, p95, min_len, max_len, avg_len) of columns.

    Numbers have values and quantiles, other columns lengths as text; the rest
    is null. One aggregate; quantiles are exact by brackets (``exact_quantiles``).
    Distinct values are counted by sketches, or exactly where ``exact`` is set.
    """
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    found = exact_quantiles(df, numbers, list(shares.values())) if numbers else {}
    made = []
    for i, c in enumerate(columns):
        v, text = F.col(c), F.char_length(F.col(c).cast("string"))
        number = v.cast("double") if c in numbers else F.lit(None).cast("double")
        length = text if c not in numbers else F.lit(None).cast("int")
        distinct = F.count_distinct(v) if exact else F.approx_count_distinct(v)
        quantiles = [F.lit(found[c][k] if c in found else None).cast("double").alias(q) for k, q in enumerate(shares)]
        values = [F.lit(c).alias("column"), F.lit("numeric" if c in numbers else "text").alias("kind"), F.count(v).alias("non_nulls"), F.count_if(v.isNull()).alias("nulls"), F.avg(v.isNull().cast("double")).alias("null_rate"), distinct.alias("distinct")]
        values += [F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), *quantiles, F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.avg(length).alias("avg_len")]
        made.append(F.struct(*values).alias(f"_{i}"))
    return df.agg(*made).select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select("r.*")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, outliers): values beyond 1.5 interquartile ranges, from exact quartiles by brackets and one aggregate."""
    q = exact_quantiles(df, columns, [0.25, 0.75])
    far = lambda c, a, b: F.lit(False) if a is None else (F.col(c) < 2.5 * F.lit(a) - 1.5 * F.lit(b)) | (F.col(c) > 2.5 * F.lit(b) - 1.5 * F.lit(a))
    out = df.agg(*[F.count_if(far(c, *q[c])).alias(c) for c in columns])
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in columns])).alias("r")).select("r.*")


def health(df: DataFrame, key: str, date: str, amount: str, as_of: str) -> DataFrame:
    """(severity, field, message, count) of what is wrong, checks without a finding are left out; rows come in no order."""
    at = F.lit(as_of).cast("timestamp")
    checks = [
        ("error", key, "missing", F.col(key).isNull()), ("error", date, "missing", F.col(date).isNull()),
        ("warn", date, "in the future", F.col(date) > at), ("warn", amount, "negative", F.col(amount) < 0), ("info", amount, "zero", F.col(amount) == 0),
    ]
    one = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (*_, test) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"), F.lit(m).alias("message"), F.col(f"c{i}").alias("count")) for i, (s, f, m, _) in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("count > 0")


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def dataset_health(df: DataFrame, key: str | None = None, required: list[str] | None = None, dates: list[str] | None = None, as_of: str | None = None, email: str = "email", amount: str = "amount") -> tuple[DataFrame, DataFrame]:
    """(one row of totals, issues) of a table.

    Totals: rows, duplicate_keys (rows beyond the first of a key, nulls are one
    key), missing_required (rows that lack any required field; a column that
    isn't there is missing in all), null_rate of all cells, first and last date
    of the first of ``dates`` that exists. Issues are (severity, field, message,
    count) for missing required values, dates after ``as_of``, invalid emails and negative
    amounts, merged and in order. Two aggregates.
    """
    required, have = required or [], set(df.columns)
    date = next((c for c in dates or [] if c in have), None)
    lacks = {c: F.col(c).isNull() if c in have else F.lit(True) for c in required}
    any_lack = F.lit(False)
    for test in lacks.values():
        any_lack = any_lack | test
    cells = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    span = [F.date_format(f(F.col(date).try_cast("timestamp")), "yyyy-MM-dd") if date else F.lit(None).cast("string") for f in (F.min, F.max)]
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(any_lack).alias("missing_required"), F.try_divide(cells, F.count(F.lit(1)) * len(df.columns)).alias("null_rate"), span[0].alias("first_date"), span[1].alias("last_date"))
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys")) if key in have else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_keys"))
    checks = [("error", c, "Missing required values", t) for c, t in lacks.items()]
    if date and as_of:
        checks.append(("warn", date, "Dates in the future detected", F.col(date).try_cast("timestamp") > F.lit(as_of).cast("timestamp")))
    if email in have:
        checks.append(("error", email, "Invalid email format", ~F.col(email).rlike(EMAIL)))
    if amount in have:
        checks.append(("error", amount, "Negative amounts found", F.col(amount).cast("string").try_cast("double") < 0))
    one = df.agg(*[F.count_if(t).alias(f"c{i}") for i, (*_, t) in enumerate(checks)] or [F.lit(0).alias("none")])
    form = "severity string, field string, message string, count long"
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"), F.lit(m).alias("message"), F.col(f"c{i}").alias("count")) for i, (s, f, m, _) in enumerate(checks)])
    issues = one.select(F.explode(rows).alias("r")).select("r.*") if checks else df.sparkSession.createDataFrame([], form)
    return totals.crossJoin(F.broadcast(repeated)), merge_issues(issues.where("count > 0"))  # one row each


def merge_issues(issues: DataFrame) -> DataFrame:
    """(severity, field, message, count, rank): counts summed over equal issues; errors first, then warnings, then the rest, the largest counts first."""
    merged = issues.groupBy("severity", "field", "message").agg(F.sum("count").alias("count"))
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).when(F.col("severity") == "info", 2).otherwise(3)
    return merged.withColumn("rank", F.row_number().over(Window.orderBy(order, F.desc("count"), "field", "message")))  # a row per kind of issue


def null_rate(df: DataFrame) -> DataFrame:
    cells = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
    return df.agg((cells / (F.count("*") * len(df.columns))).alias("null_rate"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of equal rows; only two hashes of each row are shuffled."""
    hashed = df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit(1), *df.columns).alias("b"))
    return hashed.groupBy("a", "b").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def pii_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, email, phone, ipv4): shares of non-null cells that are so as a whole, from one aggregate."""
    looks = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$", "phone": r"^\+?[\d\-\s().]{7,}$", "ipv4": r"^(?:\d{1,3}\.){3}\d{1,3}$"}  # fixed values
    one = df.agg(*[F.avg(F.col(c).rlike(p).cast("double")).alias(f"{c}_{k}") for c in columns for k, p in looks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{k}").alias(k) for k in looks]) for c in columns])).alias("r")).select("r.*")


# Labels that mean yes.
POSITIVE = ["1", "true", "yes", "y", "t", "purchase", "purchased", "won", "success", "churn", "fraud", "refund", "returned"]


def positive_label(df: DataFrame, column: str) -> DataFrame:
    """(label, rows): the label that counts as positive: 1, then true, then another positive word (the first by name), else the rarest, by text on a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("rows"))
    word = F.lower(F.trim("label"))
    rank = F.when(word == "1", 0).when(word == "true", 1).when(word.isin(POSITIVE), 2).otherwise(3)
    best = F.min_by(F.struct("label", "rows"), F.struct(rank, F.when(rank == 3, F.col("rows")).otherwise(F.lit(0)), "label"))
    return counts.agg(best.alias("r")).select("r.*").where("label is not null")


def task_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, labels, task): classification for 0/1 columns and for few labels (at most a tenth of the rows, 2 to 20), else regression; one aggregate."""
    made = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("labels"), F.count(c).alias("n"), F.min(F.col(c).cast("string").isin("0", "1", "0.0", "1.0", "true", "false")).alias("flag")).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.agg(*made).select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select("r.*")
    most = F.least(F.lit(20), F.greatest(F.lit(2), F.floor(F.col("n") * 0.1)))
    return rows.select("column", "labels", F.when(F.coalesce("flag", F.lit(True)) | (F.col("labels") <= most), "classification").otherwise("regression").alias("task"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of each ``rows`` value by the given ``values`` of ``columns``, 0 where there is none."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0, subset=[str(v) for v in values])


def segment_statistics(df: DataFrame, segment: str, features: list[str], digits: int = 2) -> DataFrame:
    """(segment, feature, mean, median, std, min, max), rounded, of each segment and feature; null is a segment."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    long = df.select(F.col(segment).alias("segment"), F.explode(cells).alias("r")).select("segment", "r.*")
    made = {"mean": F.avg("v"), "median": F.percentile("v", 0.5), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")}
    return long.groupBy("segment", "feature").agg(*[F.round(f, digits).alias(n) for n, f in made.items()])


def risk_metrics(df: DataFrame, p: Column, limit: float = 0.7) -> DataFrame:
    """mean, median, min, max, std (of the population) of a probability, and how many and what percent are above ``limit``."""
    return df.agg(F.avg(p).alias("mean"), F.percentile(p, 0.5).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"), F.stddev_pop(p).alias("std"), F.count_if(p > limit).alias("high_count"), (100 * F.try_divide(F.count_if(p > limit), F.count(p))).alias("high_pct"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal-width bins between the least and largest value, empty ones included; a constant column is in the first bin."""
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    place = F.least(F.coalesce(F.floor(F.try_divide(v - F.col("a"), F.col("b") - F.col("a")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.alias("_p")).agg(F.count("*").alias("_n"))  # one row
    edges = ends.where("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("b") - F.col("a")) / bins
    return edges.join(F.broadcast(counts), F.col("bin") == F.col("_p"), "left").select("bin", (F.col("a") + F.col("bin") * step).alias("low"), (F.col("a") + (F.col("bin") + 1) * step).alias("high"), F.coalesce("_n", F.lit(0)).alias("n"))
