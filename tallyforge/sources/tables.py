"""Reading and writing business tables."""

from __future__ import annotations

import re
import statistics

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.clean import formula_safe

DELIMITERS = [",", ";", "\t", "|", "^"]


def read_table(spark: SparkSession, path: str, kind: str = "parquet", sep: str = ",", header: bool = True) -> DataFrame:
    """csv, tsv, parquet, json or jsonl; text formats as strings, malformed rows dropped."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", kind == "json").option("mode", "DROPMALFORMED").json(path)
    return spark.read.option("header", header).option("sep", "\t" if kind == "tsv" else sep).option("mode", "DROPMALFORMED").csv(path)


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 200) -> str:
    """The delimiter with most columns for least variance over the head of a file."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value]

    def score(d: str) -> float:
        n = [line.count(d) + 1 for line in head]
        return statistics.fmean(n) / (1 + statistics.pvariance(n)) if n and max(n) > 1 else 0.0

    return max(DELIMITERS, key=score)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells a spreadsheet does not run."""
    df.withColumns({c: formula_safe(F.col(c)) for c, kind in df.dtypes if kind == "string"}).write.option("header", True).csv(path)


def write_training(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The training table as Parquet, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


HEADER_LIKE_DATA = r"^\s*[-+]?[0-9][0-9.,]*\s*$|^\s*\d{4}-\d{1,2}-\d{1,2}|^\s*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}"


def read_csv_checked(spark: SparkSession, path: str, sep: str = ",", share: float = 0.7) -> DataFrame:
    """CSV with a header, or where at least ``share`` of the header's cells are numbers or dates without one: columns are then col_1, col_2 and so on."""
    df = read_table(spark, path, "csv", sep)
    cells = [re.sub(r"_c\d+$", "", c) for c in df.columns]
    if cells and sum(bool(re.match(HEADER_LIKE_DATA, c)) for c in cells) >= share * len(cells):
        df = read_table(spark, path, "csv", sep, header=False)
        df = df.toDF(*[f"col_{i + 1}" for i in range(len(df.columns))])
    return df


def select_only(spark: SparkSession, df: DataFrame, name: str, query: str) -> DataFrame:
    """Ad-hoc SQL over one table; anything but a SELECT is refused."""
    if not query.lstrip().lower().startswith("select"):
        raise ValueError("only SELECT is allowed")
    df.createOrReplaceTempView(name)
    return spark.sql(query)


def preview(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first rows by key, timestamps in ISO form, NaN and infinities as null; a feature with a limit."""
    out = {}
    for c, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out[c] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind in ("double", "float"):
            out[c] = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return df.orderBy(*keys).limit(n).withColumns(out) if out else df.orderBy(*keys).limit(n)


# Parts of a name that mark a code, kept as text.
CODE_WORDS = ["ean", "upc", "gtin", "sku", "barcode", "code"]


def storage_types(df: DataFrame) -> DataFrame:
    """(column, storage_type): integers by their range, code-like names as text; one aggregate."""
    ints = [c for c, kind in df.dtypes if kind in ("int", "bigint", "smallint", "tinyint")]
    fixed = {"double": "Float", "float": "Float", "string": "Text"}
    wide = {c: F.when((F.min(c) >= -(2**31)) & (F.max(c) < 2**31), "Integer").otherwise("BigInteger") for c in ints}
    coded = [c for c in df.columns if any(w in c.lower() for w in CODE_WORDS)]
    one = df.agg(*[(F.first(F.lit("Text")) if c in coded else wide[c] if c in wide else F.first(F.lit(fixed.get(k, "Text")))).alias(c) for c, k in df.dtypes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("Text")).alias("storage_type")) for c in df.columns])).alias("r")).select("r.*")
