"""A preprocessor fitted once: sparse columns go, telling gaps are flagged, the rest is imputed and coded."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import exact_quantiles

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
MISSING = "MISSING"


@dataclass
class Preprocessor:
    """What ``fit`` learned: columns that go, columns that are flagged, medians, and a table of codes (value, code) for each text column."""

    dropped: list[str]
    flagged: list[str]
    medians: dict[str, float]
    codes: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``<column>_was_missing`` flag for each flagged column, numbers imputed by the fit's medians, and texts as codes, -1 for a value that the fit did not see.

        Columns that the fit dropped go, ones that it did not see stay as they
        are. Codes are joined by value; Spark broadcasts them where they are small.
        """
        out = df.drop(*[c for c in self.dropped if c in df.columns])
        out = out.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in self.flagged if c in out.columns})
        out = out.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) for c, m in self.medians.items() if c in out.columns})
        for c, table in self.codes.items():
            if c in df.columns:
                known = table.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
                out = out.join(known, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col("_v"), "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
        return out


def fit_preprocessor(df: DataFrame, keep: list[str] | None = None, high: float = 0.5, low: float = 0.1, shift: float = 0.1, peers: int = 3) -> Preprocessor:
    """Learns from all rows; columns in ``keep`` (ids, targets) are left alone.

    Columns with more than ``high`` missing go. A number with a share between
    ``low`` and ``high`` is flagged if the mean of one of the first ``peers``
    other numbers differs between its missing and its present rows by more than
    ``shift`` of that number's deviation. Texts are numbered in order of their
    values, null as "MISSING". Two aggregates, exact medians, and a table of
    distinct values for each text column.
    """
    columns = [(c, kind.split("(")[0]) for c, kind in df.dtypes if c not in (keep or [])]
    gap = lambda c: F.col(c).isNull() | (F.isnan(F.col(c)) if dict(columns)[c] in ("float", "double") else F.lit(False))
    share = df.agg(*[F.avg(gap(c).cast("double")).alias(f"g{i}") for i, (c, _) in enumerate(columns)]).first()
    missing = {c: share[f"g{i}"] or 0.0 for i, (c, _) in enumerate(columns)}
    dropped = [c for c, _ in columns if missing[c] > high]
    numbers = [c for c, kind in columns if kind in NUMBERS and c not in dropped]
    tests = [(c, p) for c in numbers if low <= missing[c] <= high for p in [n for n in numbers if n != c][:peers]]
    flagged = []
    if tests:
        value = lambda p: F.when(~gap(p), F.col(p).cast("double"))
        apart = [(F.abs(F.avg(F.when(gap(c), value(p))) - F.avg(F.when(~gap(c), value(p)))) > shift * F.stddev_samp(value(p))).alias(f"t{i}") for i, (c, p) in enumerate(tests)]
        one = df.agg(*apart).first()
        flagged = [c for c in numbers if any(one[f"t{i}"] for i, (d, _) in enumerate(tests) if d == c)]
    middle = exact_quantiles(df.select(*[F.when(~gap(c), F.col(c).cast("double")).alias(c) for c in numbers]), numbers, [0.5]) if numbers else {}
    codes = {}
    for c, kind in columns:
        if kind not in NUMBERS and c not in dropped:
            values = df.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")).distinct()
            codes[c] = values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)  # a row per distinct value
    return Preprocessor(dropped, flagged, {c: middle[c][0] if middle[c][0] is not None else 0.0 for c in numbers}, codes)
