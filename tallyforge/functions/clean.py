"""Column expressions that clean text, dates, money, phones and personal data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of a missing cell, tokens of true and false, PII patterns.
MISSING = ["", "na", "n/a", "none", "null", "nan", "nil", "-", "--"]
TRUE = ["1", "true", "yes", "y", "t"]
FALSE = ["0", "false", "no", "n", "f"]
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_IN_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_IN_TEXT = r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b"
CARD_IN_TEXT = r"\b(?:\d[ -]*?){13,19}\b"
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "dd/MM/yyyy"]


def missing_to_null(c: Column) -> Column:
    """Null for a marker of a missing cell in lower, upper or title case; others stay as they are, trimmed."""
    t = F.trim(c)
    spelled = [s for m in MISSING for s in {m, m.upper(), m.title()}]
    return F.when(~t.isin(spelled), t)


def clean_email(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.rlike(EMAIL), e)


def clean_phone(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) >= 10, d)


def to_bool01(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(TRUE), 1).when(t.isin(FALSE), 0)


def money(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,]", "").try_cast("double")


def locale_number(c: Column, decimal: str = ".", thousands: str = ",") -> Column:
    """Symbols, currency codes, percent, thousands marks, a decimal comma and (x) for -x."""
    t = F.regexp_replace(F.trim(c), "[\"'\\s\u00a0]", "")
    negative, percent = t.rlike(r"^\(.*\)$"), t.contains("%")
    t = F.regexp_replace(F.regexp_replace(t, r"[()%$€£¥₹]", ""), r"(?i)^(USD|EUR|GBP|JPY|INR|CAD|AUD)|(USD|EUR|GBP|JPY|INR|CAD|AUD)$", "")
    t = F.replace(t, F.lit(thousands), F.lit(""))
    v = (F.replace(t, F.lit(decimal), F.lit(".")) if decimal != "." else t).try_cast("double")
    v = F.when(negative, -v).otherwise(v)
    return F.when(percent, v / 100).otherwise(v)


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """The first format that fits, then epoch seconds."""
    epoch = F.timestamp_seconds(F.when(F.trim(c).rlike(r"^\d{9,10}$"), c.try_cast("long")))
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats or DATE_FORMATS], epoch)


def e164(c: Column, country: str = "US") -> Column:
    d = F.regexp_replace(c, r"\D", "")
    own = F.when((F.length(d) == 10) & F.lit(country in ("US", "CA")), F.concat(F.lit("+1"), d))
    return own.when(F.length(d) >= 8, F.concat(F.lit("+"), d))


def slug(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def mask_text(c: Column) -> Column:
    """Emails, then phones, then cards of free text become [email], [phone], [card]."""
    c = F.regexp_replace(c, EMAIL_IN_TEXT, "[email]")
    return F.regexp_replace(F.regexp_replace(c, PHONE_IN_TEXT, "[phone]"), CARD_IN_TEXT, "[card]")


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.{1,2})[^@]*(@.*)$", "$1***$2")


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("***-***-"), F.right(F.regexp_replace(c, r"\D", ""), F.lit(4)))


def mask_ipv4(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", "$1.*")


#: Header suffix, suffix of the base unit, factor.
UNITS = [("_oz", "_g", 28.3495), ("_lb", "_g", 453.592), ("_kg", "_g", 1000.0), ("_floz", "_l", 0.0295735), ("_ml", "_l", 0.001)]


def base_units(df: DataFrame) -> DataFrame:
    """Adds a column in grams or litres for each whose name ends in another unit; text that is no number becomes null."""
    for c in df.columns:
        for suffix, base, factor in UNITS:
            if c.lower().endswith(suffix):
                df = df.withColumn(c[: -len(suffix)] + base, F.col(c).try_cast("double") * factor)
                break
    return df


def stabilized(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_log``: log1p, sign-preserving for negative values; on the others both forms agree, so a series needs no look at its least value."""
    c = F.col(column)
    return df.withColumn(f"{column}_log", F.signum(c) * F.log1p(F.abs(c)))


def salted_hash(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(c.cast("string"), F.lit(salt)), 256)


def keyed_hash(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 by built-in functions; both pads are made on the driver."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.8, "Extreme").when(p >= 0.5, "High").when(p >= 0.2, "Medium").otherwise("Low")


def formula_safe(c: Column) -> Column:
    """A quote before text that a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)
