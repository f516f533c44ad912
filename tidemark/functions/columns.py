"""Column expressions that the operators share. All are built-in expressions; bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASTS = {"string": "string", "integer": "bigint", "float": "double", "date": "date", "timestamp": "timestamp"}


def blank_to_null(c: Column) -> Column:
    """Null for text that is empty after trimming."""
    return F.when(F.trim(c.cast("string")) != "", c)


def boolean(c: Column) -> Column:
    """true, 1, yes and false, 0, no in any case; null otherwise."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def typed(c: Column, kind: str) -> Column:
    """The value in a contract's type, null if it has none."""
    return boolean(c) if kind == "boolean" else c.try_cast(CASTS[kind])


def surrogate_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed upper-case parts, joined by |; null if one is blank."""
    clean = [F.upper(F.trim(p)) for p in parts]
    blank = F.lit(False)
    for p in clean:
        blank = blank | p.isNull() | (p == "")
    return F.when(~blank, F.substring(F.sha2(F.concat_ws("|", *clean), 256), 1, 16))


def iso_utc(ts: Column) -> Column:
    """A time of a session in UTC in ISO form, with its offset, and microseconds if it has any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def date_key(c: Column) -> Column:
    """yyyyMMdd as an integer."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def period_index(period: Column) -> Column:
    """YYYYQn -> year * 4 + quarter."""
    return F.substring(period, 1, 4).try_cast("int") * 4 + F.substring(period, 6, 1).try_cast("int")


def iso_weekday(c: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(c) + 1
