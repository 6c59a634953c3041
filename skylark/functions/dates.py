"""Date keys and tolerant time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO-8601, RFC-822 (with or without the weekday) or YYYY-MM-DD; anything else is null."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss zzz")))


def business_date(ts: Column, hours: int = 8) -> Column:
    return F.date_format(ts + F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM-dd")


def minute_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
