"""What columns hold: semantic types, feature roles, values standardised by type, JSON cells expanded.

One pass over all rows gives each column's facts (rates of patterns, distinct
values, lengths) as one row of a table; types and roles are expressions over
that table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import clean

from .canonical import GENERIC_NAMES

# Patterns of whole cells, words, and hints in names.
EMAIL, URL, IPV4 = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"(?i)^(?:https?://|www\.)\S+$", r"^(?:\d{1,3}\.){3}\d{1,3}$"
BOOLEAN = ["true", "false", "yes", "no", "y", "n", "t", "f", "1", "0"]
PERCENT_HINTS = ["%", "_pct", "percent", "rate"]
DATE_HINTS = ["date", "time", "created", "updated", "timestamp", "ordered", "processed"]
KEEP_HINTS = ["age", "tenure", "amount", "price", "cost", "revenue", "qty", "quantity", "score", "margin", "days", "duration", "time", "rate"]
DATES = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"

RATES = ["email", "phone", "url", "ipv4", "boolean", "zero_one", "json", "timestamp", "symbol", "numeric", "digits", "short", "from_0_to_1", "from_0_to_100", "over_1", "uuid", "hyphen", "epoch", "point"]


def _tests(v: Column) -> dict[str, Column]:
    """Patterns of a non-null cell as text."""
    bare = F.trim(v)
    json = F.ltrim(v).rlike(r"^[{\[]")
    number = clean.locale_number(F.when(~json, F.regexp_replace(bare, "%+$", "")))
    return {
        "email": v.rlike(EMAIL), "phone": (F.length(F.regexp_replace(bare, r"\D", "")) >= 10) & ~v.rlike("[A-Za-z]") & ~bare.rlike(DATES), "url": v.rlike(URL), "ipv4": v.rlike(IPV4),
        "boolean": F.lower(bare).isin(BOOLEAN), "zero_one": bare.isin("0", "1"), "json": json & F.try_parse_json(v).isNotNull(), "timestamp": bare.rlike("[-/:]") & ~json & F.coalesce(bare.try_cast("timestamp"), clean.parse_timestamp(bare)).isNotNull(),
        "symbol": v.rlike("[$€£¥]"), "numeric": number.isNotNull(), "digits": v.rlike(r"^\d+$"), "short": F.char_length(v) <= 64, "from_0_to_1": number.between(0, 1), "from_0_to_100": number.between(0, 100), "over_1": number > 1,
        "uuid": v.rlike(r"^[0-9a-fA-F\-]{16,}$"), "hyphen": v.contains("-"), "epoch": number.between(1e9, 1e10) | number.between(1e12, 1e13), "point": v.contains("."),
    }


def column_facts(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, kind, rows, non_nulls, distinct, unique_ratio, avg_len, and a rate for each of ``RATES``) of each column.

    Rates are shares of the non-null cells (0 for a column without any), over
    all rows. Cells are counted by column and value first, combined before the
    shuffle, and each value is tested once. Where ``exact`` is false, values are
    not grouped and distinct ones are counted by sketches: no shuffle but a row
    per column and task, which suits large tables of mostly unique cells.
    """
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("r")).select("r.*")
    values = cells.groupBy("column", "kind", "v").agg(F.count("*").alias("n")) if exact else cells.withColumn("n", F.lit(1).cast("long"))
    v, known = F.col("v"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    rates = [F.coalesce(F.try_divide(F.sum(F.when(F.coalesce(t, F.lit(False)), F.col("n")).otherwise(0)), known), F.lit(0.0)).alias(name) for name, t in _tests(v).items()]
    distinct = F.count("v") if exact else F.approx_count_distinct("v")
    facts = values.groupBy("column", "kind").agg(F.sum("n").alias("rows"), known.alias("non_nulls"), distinct.alias("distinct"), F.coalesce(F.try_divide(F.sum(F.char_length("v") * F.col("n")), known), F.lit(0.0)).alias("avg_len"), *rates)
    return facts.select("column", "kind", "rows", "non_nulls", "distinct", F.coalesce(F.try_divide("distinct", "non_nulls"), F.lit(0.0)).alias("unique_ratio"), "avg_len", *RATES)


def _hinted(words: list[str]) -> Column:
    return F.lower("column").rlike("|".join(re.escape(w) for w in words))


def semantic_types(facts: DataFrame) -> DataFrame:
    """(column, semantic, valid_rate, unique_ratio, suspect): the first that holds of email, timestamp, phone, url, ip, boolean, json, id, money, percent, numeric, then categorical or text.

    ``suspect`` marks percent columns without a percent sign in their name most
    of whose values are above 1.
    """
    c = F.col
    id_like = (c("unique_ratio") > 0.9) & (c("email") < 0.2) & (c("phone") < 0.2) & (c("timestamp") < 0.2) & (c("short") > 0.7) & ((c("numeric") < 0.3) | (c("digits") > 0.9))
    amount = F.lower("column").isin(GENERIC_NAMES["amount"])
    percent = _hinted(PERCENT_HINTS) & (c("numeric") > 0.5)
    in_range = F.greatest("from_0_to_1", "from_0_to_100") / F.greatest("numeric", F.lit(1e-12)) > 0.7
    ladder = [
        (c("email") > 0.6, "email", c("email")), (c("timestamp") > 0.5, "timestamp", c("timestamp")), (c("phone") > 0.6, "phone", c("phone")), (c("url") > 0.6, "url", c("url")), (c("ipv4") > 0.6, "ip", c("ipv4")),
        ((c("boolean") > 0.8) | (c("zero_one") > 0.95), "boolean", F.greatest("boolean", "zero_one")), (c("json") > 0.6, "json", c("json")), (id_like, "id", c("unique_ratio")), (c("symbol") > 0.1, "money", c("symbol")),
        (amount & (c("numeric") > 0.85), "money", c("numeric")), (percent & in_range, "percent", c("numeric")), (percent, "numeric", c("numeric")), (c("numeric") > 0.85, "numeric", c("numeric")),
        ((c("unique_ratio") <= 0.05) & (c("distinct") <= 50), "categorical", 1 - c("unique_ratio")), (c("avg_len") > 40, "text", F.lit(0.6)),
    ]
    name, rate = F.lit("categorical"), F.lit(0.5)
    for test, said, value in reversed(ladder):
        name, rate = F.when(test, said).otherwise(name), F.when(test, value).otherwise(rate)
    out = facts.withColumn("semantic", name).withColumn("valid_rate", rate)
    suspect = (c("semantic") == "percent") & (c("over_1") / F.greatest("numeric", F.lit(1e-12)) > 0.5) & ~c("column").contains("%")
    return out.select("column", "semantic", "valid_rate", "unique_ratio", suspect.alias("suspect"))


def column_roles(facts: DataFrame, given: dict[str, str] | None = None, deny: list[str] | None = None, allow: list[str] | None = None) -> DataFrame:
    """(column, role): the ``given`` role, else Ignore, Date, ID, Numerical, Categorical or Text by the column's facts.

    Ignored are columns that a ``deny`` pattern names and no ``allow`` pattern
    does, and those of at most one value or 98 % nulls, unless their name or
    their values make them ids. Numbers with few values are categorical.
    """
    c = F.col
    named = lambda patterns: F.lower("column").rlike("|".join(f"^(?:{p.lower()})$" for p in patterns)) if patterns else F.lit(False)
    number = c("kind").rlike("^(?:tinyint|smallint|int|bigint|float|double|decimal.*)$")
    id_name = F.lower("column").rlike("(?:^id|_id)$")
    per_row = F.coalesce(F.try_divide("distinct", "rows"), F.lit(0.0))
    junk = ((c("non_nulls") <= 0.02 * c("rows")) | (c("distinct") <= 1)) & ~id_name & (c("unique_ratio") < 0.9)
    hint = F.when(_hinted(DATE_HINTS), 0.15).otherwise(0.0)
    date = c("kind").rlike("^(?:timestamp.*|date)$") | ((c("non_nulls") > 0) & (F.when(number, c("epoch") >= 0.6).otherwise(c("timestamp") >= F.greatest(F.lit(0.2), 0.6 - hint))))
    loose = (c("uuid") > 0.5) | (c("hyphen") > 0.3)
    floaty = c("kind").isin("float", "double") & (c("point") > 0.2)
    contact = (c("email") > 0.3) | (c("url") > 0.3) | (c("ipv4") > 0.3)
    id_like = (c("non_nulls") > 0) & ~contact & ~floaty & (c("unique_ratio") >= F.when(id_name | loose, 0.85).otherwise(0.95)) & (c("avg_len") <= F.when(loose, 80).otherwise(64))
    keep = (c("distinct") >= 30) | (per_row >= 0.05) | F.lit(False)
    for h in KEEP_HINTS:
        keep = keep | c("column").contains(h)
    text = ~((c("distinct") <= 30) | (per_row <= 0.05)) & (c("avg_len") >= 20)
    role = F.when(junk, "Ignore").when(date, "Date").when(id_like, "ID").when(number, F.when(keep, "Numerical").otherwise("Categorical")).when(text, "Text").otherwise("Categorical")
    role = F.when(named(deny or []) & ~named(allow or []), "Ignore").otherwise(role)
    for name, said in (given or {}).items():
        role = F.when(F.lower("column") == name.lower(), said).otherwise(role)
    return facts.select("column", role.alias("role"))


def _fields(kind: str) -> list[tuple[str, str]]:
    """(name, type) of an ``OBJECT<...>`` schema; names may be in back quotes."""
    body, out, at = kind[len("OBJECT<") : -1], [], 0
    while at < len(body):
        if body[at] == "`":
            end = at + 1
            while body[end] != "`" or body[end + 1 : end + 2] == "`":
                end += 2 if body[end] == "`" else 1
            name, at = body[at + 1 : end].replace("``", "`"), end + 1
        else:
            end = body.index(":", at)
            name, at = body[at:end], end
        at += 2  # ": "
        depth, quoted, end = 0, False, at
        while end < len(body) and (depth or quoted or body[end] != ","):
            quoted ^= body[end] == "`"
            depth += 0 if quoted else (body[end] in "<(") - (body[end] in ">)")
            end += 1
        out.append((name, body[at:end]))
        at = end + 2
    return out


def json_paths(kind: str, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(keys from the top, Spark type) of every leaf of a merged schema; lists, and keys of several types, are text."""
    out = []
    for name, inner in _fields(kind) if kind.startswith("OBJECT<") and kind != "OBJECT<>" else []:
        if inner.startswith("OBJECT<") and inner != "OBJECT<>":
            out += json_paths(inner, (*above, name))
        else:
            simple = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}.get(inner, "double" if inner.startswith("DECIMAL") else "string")
            out.append(((*above, name), simple))
    return out


def expand_json(df: DataFrame, columns: list[str] | None = None, least: float = 0.2) -> DataFrame:
    """``df`` with text columns of JSON objects replaced by a column for each leaf, ``column.key`` with deeper keys after further points.

    A column counts if at least ``least`` of its cells begin with a brace or
    bracket. Its keys and their types are merged over all rows by Spark's
    variant schema aggregate, so no schema is written by hand and none is
    sampled. Cells that are not objects give nulls. A name that exists gets _2,
    _3 and so on.
    """
    texts = [c for c, kind in df.dtypes if kind == "string" and (columns is None or c in columns)]
    if not texts:
        return df
    begins = lambda c: F.coalesce(F.col(f"`{c}`").rlike(r"^[{\[]"), F.lit(False))
    object_of = lambda c: F.try_parse_json(F.when(F.col(f"`{c}`").rlike(r"^\{"), F.col(f"`{c}`")))
    found = df.agg(*[f for i, c in enumerate(texts) for f in (F.avg(begins(c).cast("double")).alias(f"r{i}"), F.schema_of_variant_agg(object_of(c)).alias(f"s{i}"))]).first()
    out = df
    for i, c in enumerate(texts):
        if (found[f"r{i}"] or 0.0) < least:
            continue
        taken, made = [x for x in out.columns if x != c], []
        for keys, kind in json_paths(found[f"s{i}"]):
            base = name = ".".join((c, *keys))
            k = 2
            while name in out.columns or name in [m for m, _ in made]:
                name, k = f"{base}_{k}", k + 1
            path = "$" + "".join("[" + ("'" + x + "'" if "'" not in x else '"' + x + '"') + "]" for x in keys)
            made.append((name, F.try_variant_get(object_of(c), path, kind)))
        out = out.select(*[F.col(f"`{x}`") for x in taken], *[v.alias(name) for name, v in made])
    return out


def standardized(df: DataFrame, types: dict[str, str], decimal: str = ".", thousands: str = ",", country: str = "US") -> DataFrame:
    """``df`` with values by semantic type: emails and phones normalised, booleans and timestamps typed, and new columns ``_num`` (money, numeric), ``_rate`` (percent) and ``_slug`` (categorical).

    A percent column most of whose numbers are above 1 is divided by 100; one
    aggregate decides it for all.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    number = lambda c: clean.locale_number(F.regexp_replace(text(c), "%", ""), decimal, thousands)
    percents = [c for c, t in types.items() if t == "percent"]
    over = df.agg(*[F.avg((number(c) > 1).cast("double")).alias(f"o{i}") for i, c in enumerate(percents)]).first() if percents else []
    new: dict[str, Column] = {}
    for c, t in types.items():
        if t == "email":
            new[c] = F.trim(F.lower(text(c)))
        elif t == "phone":
            new[c] = clean.e164(text(c), country)
        elif t == "boolean":
            new[c] = clean.to_bool01(text(c)).cast("boolean")
        elif t == "timestamp":
            new[c] = F.coalesce(F.trim(text(c)).try_cast("timestamp"), clean.parse_timestamp(text(c)))
        elif t in ("money", "numeric"):
            new[f"{c}_num"] = number(c)
        elif t == "percent":
            new[f"{c}_rate"] = number(c) / (100.0 if (over[percents.index(c)] or 0.0) > 0.5 else 1.0)
        elif t == "categorical":
            new[f"{c}_slug"] = clean.slug(text(c))
    return df.withColumns(new)
