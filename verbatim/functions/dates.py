"""Date expressions that give null, never an error, for what isn't a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = r"(\d{4}-\d{2}-\d{2})"


def strict_date(text: Column) -> Column:
    """A date from a full year-month-day at the start; shorter forms, which Spark would accept, give null."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("y-M-d")).cast("date"))


def any_date(text: Column) -> Column:
    """ISO anywhere, else day/month/year, else eight digits."""
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(text, ISO, 1), F.lit("")), F.lit("yyyy-MM-dd"))
    slashed = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), F.lit("d/M/yyyy"))
    packed = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"^\s*(\d{8})\s*$", 1), F.lit("")), F.lit("yyyyMMdd"))
    return F.coalesce(iso, slashed, packed).cast("date")


def year_month(text: Column) -> Column:
    """struct(year, month) of the first ISO date; '0000' and '00' without one."""
    iso = F.regexp_extract(text, ISO, 1)
    return F.struct(F.when(iso != "", F.substring(iso, 1, 4)).otherwise("0000").alias("year"), F.when(iso != "", F.substring(iso, 6, 2)).otherwise("00").alias("month"))


def calendar_day(text: Column, zone: str = "America/Sao_Paulo") -> Column:
    """The day of a time stamp: in ``zone`` where the text has an offset, as written otherwise."""
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & text.rlike(r"\d{2}:\d{2}")
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()), zone)
    return F.when(aware, F.to_date(local)).otherwise(any_date(text))


def bigint_like(text: Column) -> Column:
    """Integers from decimals and exponents, rounded; null for what isn't a number."""
    return F.round(text.try_cast("decimal(38,6)")).cast("bigint")


def windows(spark, start: str, end: str, unit: str) -> DataFrame:
    """window_start, window_end of the months, quarters or years that meet [start, end], clipped to it."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    first, last = (F.lit(x).cast("date") for x in (start, end))
    begins = F.sequence(F.trunc(first, unit), last, F.expr(f"interval {months} month"))
    rows = spark.range(1).select(F.explode(begins).alias("b"))
    return rows.select(F.greatest("b", first).alias("window_start"), F.least(F.date_sub(F.add_months("b", months), 1), last).alias("window_end"))


def period(day: Column, unit: str) -> Column:
    return F.date_format(day, {"year": "yyyy", "month": "yyyy-MM"}[unit])
