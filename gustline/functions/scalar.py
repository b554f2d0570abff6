"""Coercion, scaling, calendar and text column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Columns whose feature form is log1p, the lags and rolling widths that go with them.
LOG_SKEWED = ("pm25", "upwind_pm25", "transport_potential", "no", "no2", "nox")
LAGS = (1, 2, 3, 6, 12)
ROLLS = (3, 6)

# Patterns that carry a PM2.5 value in a city page, in order of priority.
PM25_PAGE_PATTERNS = (
    r"(?i)PM2\.5[^0-9\-\n\r]*([0-9]+(?:\.[0-9]+)?)",
    r'(?i)data\-pm25\-value\="([0-9]+(?:\.[0-9]+)?)"',
    r'(?i)"pm25"\s*:\s*([0-9]+(?:\.[0-9]+)?)',
)


def number(c: Column) -> Column:
    """Double, or null if the text is not a number. NaN counts as missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def truthy_or(*cs: Column) -> Column:
    """First value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cs], F.lit(0.0))


def log_clip(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def exp_clip(c: Column) -> Column:
    """Back from log1p, never negative."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def cyclic(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week (Monday 0) on the unit circle."""
    day, week = F.hour(ts) * (2 * math.pi / 24), F.weekday(ts) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)}


def utc_hour(ts: Column) -> Column:
    """Start of the hour; a text timestamp that does not parse becomes null."""
    return F.date_trunc("hour", ts.try_cast("timestamp"))


def digits(c: Column) -> Column:
    """First run of digits as an integer, null if there is none."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int")


def timestamp_from_parts(year: Column, month: Column, day: Column, hour: Column | None = None) -> Column:
    """Missing parts default to 2026-01-01 00h; impossible dates become null."""
    hh = F.lit(0) if hour is None else F.coalesce(digits(hour), F.lit(0))
    part = lambda c, default: F.coalesce(c.try_cast("double").cast("int"), F.lit(default))
    return F.try_make_timestamp(part(year, 2026), part(month, 1), part(day, 1), hh, F.lit(0), F.lit(0))


def partition_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def dedup_key(station: Column, source: Column, ts: Column) -> Column:
    return F.concat_ws("|", station, source, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx"))


def city_slug(city: Column) -> Column:
    kept = F.regexp_replace(F.lower(city), "[^a-z0-9 ]+", "")
    return F.regexp_replace(F.replace(F.trim(kept), F.lit(" "), F.lit("-")), "-+", "-")


def pm25_from_page(html: Column) -> Column:
    return F.coalesce(*[
        F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in PM25_PAGE_PATTERNS
    ]).cast("double")


def text_seed_order(seed: int, *keys: Column) -> Column:
    """Reproducible pseudo-random order of rows: the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
