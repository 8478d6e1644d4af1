"""Dates, durations and clocks as Columns. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column) -> Column:
    """ISO date of compact, ISO or RFC 822 times; else the empty string."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\w{3},\s*", "")
    forms = ["yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy"]
    return F.coalesce(*(F.date_format(F.try_to_timestamp(v, F.lit(f)), "yyyy-MM-dd") for f in forms), F.lit(""))


def year_of(date: Column) -> Column:
    return F.regexp_extract(F.coalesce(date, F.lit("")), r"^(\d{4})", 1).try_cast("int")


def recency_bonus(date: Column, this_year: int) -> Column:
    y = year_of(date)
    return F.when(y.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(0.1) - F.lit(0.01) * F.greatest(F.lit(0), F.lit(this_year) - y)))


def _clock(text: Column) -> Column:
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda t, p: t * 60 + F.coalesce(p.try_cast("long"), F.lit(0)))


def parse_duration(value: Column) -> Column:
    """Seconds of ISO 8601 durations, clocks and plain numbers; else 0."""
    t = F.trim(F.coalesce(value, F.lit("")))
    iso = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?\z"
    part = lambda i: F.coalesce(F.regexp_extract(t, iso, i).try_cast("long"), F.lit(0))
    return F.when(t.rlike(iso), part(1) * 3600 + part(2) * 60 + part(3)).when(t.rlike(r"^\d+(:\d{1,2}){1,2}\z"), _clock(t)).when(t.rlike(r"^\d+\z"), t.try_cast("long")).otherwise(0).cast("long")


def parse_timestamp(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^(?:\d+:)?\d{1,2}:\d{2}\z"), _clock(t))


def fmt_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(~(F.coalesce(seconds, F.lit(0)) > 0), "length unknown").when(h > 0, F.concat_ws(":", h, two(m), two(r))).otherwise(F.concat_ws(":", m, two(r)))


def fmt_timestamp(seconds: Column) -> Column:
    return F.when(seconds >= 1, fmt_duration(seconds)).otherwise("0:00")


def video_url(video_id: Column, seconds: Column | None = None) -> Column:
    base = F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)
    return base if seconds is None else F.when(F.coalesce(seconds, F.lit(0)) > 0, F.concat(base, F.lit("&t="), F.floor(seconds).cast("string"), F.lit("s"))).otherwise(base)


def next_run(now: Column, clock: str = "08:00") -> Column:
    """The next time that the clock shows this, today or tomorrow."""
    today = F.to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit(f" {clock}:00")))
    return F.when(today > now, today).otherwise(today + F.expr("INTERVAL 1 DAY"))
