"""Canonical customers, orders, marketing sends and events from raw tables and a column mapping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import clean

from .keys import keep_last


def pick(df: DataFrame, names: list[str] | str | None, kind: str = "string") -> Column:
    """The first non-null of several source columns, left to right; null where none is mapped."""
    names = [names] if isinstance(names, str) else names or []
    have = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def amounts(df: DataFrame, names: list[str] | str | None) -> Column:
    """The first non-null of several money columns as a number; only text goes through money cleaning."""
    named = [names] if isinstance(names, str) else names or []
    kinds = [kind.split("(")[0] for c, kind in df.dtypes if c in named]
    if kinds and all(k in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for k in kinds):
        return pick(df, named, "double")
    return clean.money(pick(df, named))


def customers(df: DataFrame, m: dict, order: list[str]) -> DataFrame:
    out = df.select(
        clean.missing_to_null(pick(df, m["customer_id"])).alias("customer_id"), clean.clean_email(pick(df, m.get("email"))).alias("email"),
        clean.clean_phone(pick(df, m.get("phone"))).alias("phone"), pick(df, m.get("created_at"), "timestamp").alias("created_at"), *[F.col(o).alias(f"_{o}") for o in order],
    )
    return keep_last(out, ["customer_id"], [f"_{o}" for o in order]).select("customer_id", "email", "phone", "created_at")


def orders(df: DataFrame, m: dict, order: list[str]) -> DataFrame:
    """Null ids go, the last row per id stays, amounts of zero or less go."""
    out = df.select(
        clean.missing_to_null(pick(df, m["order_id"])).alias("order_id"), clean.missing_to_null(pick(df, m["customer_id"])).alias("customer_id"),
        pick(df, m["order_date"], "timestamp").alias("order_date"), amounts(df, m["amount"]).alias("amount"), *[F.col(o).alias(f"_{o}") for o in order],
    )
    last = keep_last(out, ["order_id"], [f"_{o}" for o in order])
    return last.where(F.coalesce("amount", F.lit(0.0)) > 0).select("order_id", "customer_id", "order_date", "amount")


def marketing(df: DataFrame, m: dict, order: list[str], keys: tuple[str, ...] = ("campaign_id",)) -> DataFrame:
    flags = [clean.to_bool01(pick(df, m.get(c))).alias(c) for c in ("opened", "clicked", "converted")]
    out = df.select(
        clean.missing_to_null(pick(df, m["campaign_id"])).alias("campaign_id"), pick(df, m["customer_id"]).alias("customer_id"), F.lower(F.trim(pick(df, m["channel"]))).alias("channel"),
        pick(df, m["sent_date"], "timestamp").alias("sent_date"), *flags, F.coalesce(amounts(df, m.get("cost")), F.lit(0.0)).alias("cost"), *[F.col(o).alias(f"_{o}") for o in order],
    )
    return keep_last(out, list(keys), [f"_{o}" for o in order]).drop(*[f"_{o}" for o in order])


def minimal_events(df: DataFrame, m: dict) -> DataFrame:
    """event_id, value, timestamp, entity_id (the event where there is none); a missing value is 0, and 1 per event where no value column is mapped."""
    named = m.get("value") in df.columns
    event = pick(df, m["event_id"])
    return df.select(event.alias("event_id"), F.coalesce(pick(df, m.get("value"), "double") if named else F.lit(1.0), F.lit(0.0)).alias("value"), pick(df, m["timestamp"], "timestamp").alias("timestamp"), F.coalesce(pick(df, m.get("entity_id")), event).alias("entity_id"))


# What counts as a positive or a negative target.
TRUTHY = ["1", "true", "t", "yes", "y", "success", "converted", "purchase", "purchased", "responded", "clicked", "open", "opened"]
FALSY = ["0", "false", "f", "no", "n", "fail", "failed", "did_not_convert", "did not convert", "not_clicked", "not opened", "churned=0"]

# Names that a canonical column goes by, the first one leads.
GENERIC_NAMES = {
    "id": ["id", "record_id", "uuid", "row_id", "user_id", "customer_id", "order_id", "lead_id", "account_id"],
    "timestamp": ["timestamp", "ts", "time", "event_time", "date", "datetime", "created_at", "updated_at", "order_date", "sent_at"],
    "amount": ["amount", "revenue", "price", "value", "total", "charge", "cost", "net", "gross", "amt", "order_amount"],
    "email": ["email", "email_address", "e-mail"],
    "phone": ["phone", "phone_number", "mobile", "cell", "tel"],
    "channel": ["channel", "utm_source", "source", "utm_medium", "medium", "campaign", "utm_campaign"],
    "target": ["target", "label", "converted", "purchase", "purchased", "response", "responded", "clicked", "opened", "churned", "y", "outcome"],
}


def generic_mapping(columns: list[str], given: dict | None = None) -> dict[str, str | None]:
    """The source of each canonical column: the given one, else the first name that a column has in any case, else with blanks and underscores left out."""
    bare = lambda c: c.lower().replace("_", "").replace(" ", "")
    exact, loose = {c.lower(): c for c in columns}, {bare(c): c for c in columns}
    out = {}
    for name, known in GENERIC_NAMES.items():
        found = next((exact[k] for k in known if k in exact), None) or next((loose[bare(k)] for k in known if bare(k) in loose), None)
        out[name] = (given or {}).get(name) or found
    return out


def generic(df: DataFrame, m: dict | None = None) -> DataFrame:
    """id, timestamp, amount, email, phone, channel, target of any table, by ``generic_mapping`` where ``m`` doesn't say.

    A target of a truthy or falsy word is 1 or 0, others stay as text. Where no
    column is mapped to id, or it holds nothing but nulls, rows are numbered
    (unique, not consecutive); that asks the table for one non-null id first.
    """
    m = generic_mapping(df.columns, m)
    target = pick(df, m["target"])
    word = F.lower(F.trim(target))
    number = m["id"] is None or df.where(F.col(m["id"]).isNotNull()).limit(1).count() == 0
    return df.select(
        (F.monotonically_increasing_id().cast("string") if number else clean.missing_to_null(pick(df, m["id"]))).alias("id"), pick(df, m["timestamp"], "timestamp").alias("timestamp"),
        F.regexp_replace(pick(df, m["amount"]), r"[^0-9.\-]", "").try_cast("double").alias("amount"), clean.clean_email(pick(df, m["email"])).alias("email"), clean.clean_phone(pick(df, m["phone"])).alias("phone"),
        F.lower(F.trim(pick(df, m["channel"]))).alias("channel"), F.when(word.isin(TRUTHY), "1").when(word.isin(FALSY), "0").otherwise(target).alias("target"),
    )


def file_health(df: DataFrame, required: list[str], key: str, date: str | None = None) -> DataFrame:
    """(column, present, null_rate) of required columns with the table's rows, duplicate keys and date range, from one aggregate."""
    have = [c for c in required if c in df.columns]
    one = df.agg(F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"), (F.min(date) if date else F.lit(None).cast("timestamp")).alias("first_date"), (F.max(date) if date else F.lit(None).cast("timestamp")).alias("last_date"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"_n_{c}") for c in have])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), (F.col(f"_n_{c}") if c in have else F.lit(None).cast("double")).alias("null_rate")) for c in required]
    return one.select("rows", "duplicate_keys", "first_date", "last_date", F.explode(F.array(*cells)).alias("c")).select("c.*", "rows", "duplicate_keys", "first_date", "last_date")


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The training columns in their order: a missing one is 0, others go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


# Names that tell the outcome.
LEAKING = ["label", "target", "outcome", "refund", "chargeback", "settled", ".*_next"]


def allowed_columns(columns: list[str], allow: list[str] | None = None, deny: list[str] | None = None) -> list[str]:
    """Columns that no deny pattern names in full, or that an allow pattern does; outcome names are always denied unless allowed."""
    match = lambda c, patterns: any(re.fullmatch(p, c, re.I) for p in patterns)
    return [c for c in columns if match(c, allow or []) or not match(c, [*(deny or []), *LEAKING])]
