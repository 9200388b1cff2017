"""Dates, dayparts and export flags."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: sales rung up from 16:00 on belong to dinner.
DINNER_FROM_HOUR = 16
PERIODS = ("dinner", "lunch")


def flag(value: Column) -> Column:
    """Exports carry booleans, "True" or "1"; null means not flagged."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def daypart(hour: Column) -> Column:
    return F.when(hour < DINNER_FROM_HOUR, "lunch").otherwise("dinner")


def log_hour(time_text: Column) -> Column:
    """Hour of an ``HH:MM[:SS]`` text."""
    return F.split(time_text, ":")[0].cast("int")


def to_business_date(value: Column) -> Column:
    """Date, timestamp or ISO text to a date; text that is no date fails the job."""
    return value.cast("date")


def calendar_columns(date: Column) -> dict[str, Column]:
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
    }
