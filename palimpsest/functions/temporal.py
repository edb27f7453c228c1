"""Day ranges (closed) and phrases about them, as Columns over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the units in which durations are told.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def days_in(lo: Column, hi: Column) -> Column:
    return F.datediff(hi, lo) + 1


def overlap_days(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.least(hi1, hi2), F.greatest(lo1, lo2)) + 1)


def temporal_score(answer_lo: Column, answer_hi: Column, gold_lo: Column, gold_hi: Column) -> Column:
    """Share of the answer's days that the gold range holds; 0 without an answer."""
    return F.coalesce(overlap_days(answer_lo, answer_hi, gold_lo, gold_hi) / days_in(answer_lo, answer_hi), F.lit(0.0))


def week_of(day: Column) -> Column:
    """Monday of the week; weeks start on Monday."""
    return F.date_sub(day, F.weekday(day))


def last_week(anchor: Column) -> tuple[Column, Column]:
    return F.date_sub(anchor, 7), F.date_sub(anchor, 1)


def next_week(anchor: Column) -> tuple[Column, Column]:
    return F.date_add(anchor, 1), F.date_add(anchor, 7)


def last_weekend(anchor: Column) -> tuple[Column, Column]:
    """The latest Saturday strictly before the anchor, and the Sunday after it."""
    saturday = F.date_sub(anchor, F.pmod(F.weekday(anchor) - 6, F.lit(7)) + 1)
    return saturday, F.date_add(saturday, 1)


def whole_month(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def month_part(day: Column, part: str) -> tuple[Column, Column]:
    """Early, mid or late in a month: 1-10, 11-20, 21 to the end."""
    first = F.trunc(day, "month")
    lo = {"early": 0, "mid": 10, "late": 20}[part]
    return F.date_add(first, lo), F.last_day(day) if part == "late" else F.date_add(first, lo + 9)


def season(year: Column, name: str) -> tuple[Column, Column]:
    """Three months; winter starts in December of its year."""
    month = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}[name]
    lo = F.make_date(year, F.lit(month), F.lit(1))
    return lo, F.last_day(F.add_months(lo, 2))


def whole_months_between(start: Column, end: Column) -> Column:
    """Whole calendar months: one less if the day of the month is not reached."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def ago_phrase(day: Column, today: Column) -> Column:
    """How far a day lies back, in each unit a question may ask for; or how far ahead."""
    days = F.datediff(today, day)
    months = whole_months_between(day, today)
    weeks = F.when(days >= 7, F.concat(F.lit("; "), counted(F.floor(days / 7), "week"))).otherwise(F.lit(""))
    told = F.concat(counted(days, "day"), F.lit(" ago"), weeks, F.when(months >= 1, F.concat(F.lit("; "), counted(months, "month"))).otherwise(F.lit("")))
    return F.when(days == 0, F.lit("today")).when(days < 0, F.concat(F.lit("in "), counted(-days, "day"))).otherwise(told)


def range_in_words(lo: Column, hi: Column) -> Column:
    """The shortest plain wording of a day range."""
    text = lambda d, pattern: F.date_format(d, pattern)
    full = "d MMMM yyyy"
    same_year, same_month = F.year(lo) == F.year(hi), F.trunc(lo, "month") == F.trunc(hi, "month")
    return (
        F.when(lo == hi, text(lo, full))
        .when(same_year & (text(lo, "MM-dd") == "01-01") & (text(hi, "MM-dd") == "12-31"), F.year(lo).cast("string"))
        .when(same_month & (F.dayofmonth(lo) == 1) & (hi == F.last_day(hi)), text(lo, "MMMM yyyy"))
        .when(same_month, F.concat(text(lo, "d"), F.lit("–"), text(hi, full)))
        .when(same_year, F.concat(text(lo, "d MMMM"), F.lit(" – "), text(hi, full)))
        .otherwise(F.concat(text(lo, full), F.lit(" – "), text(hi, full)))
    )


def session_time(text: Column) -> Column:
    """The time of a session heading in any of the known layouts, else null."""
    clean = F.regexp_replace(F.trim(text), r"\s*\([A-Za-z]{3}\)", "")
    spoken = F.regexp_extract(clean, r"(?i)^(\d{1,2}:\d{2}) ?([ap]m) on (\d{1,2} \w+),? (\d{4})$", 0)
    upper = F.regexp_replace(F.upper(F.regexp_extract(spoken, r"(?i)^\d{1,2}:\d{2} ?[ap]m", 0)), " ", "")
    day = F.regexp_replace(F.regexp_extract(spoken, r"(?i) on (.*)$", 1), ",", "")
    return F.coalesce(
        F.try_to_timestamp(clean, F.lit("yyyy/MM/dd HH:mm")),
        F.try_to_timestamp(F.concat_ws(" ", F.initcap(day), upper), F.lit("d MMMM yyyy h:mma")),
        F.try_to_timestamp(F.initcap(clean), F.lit("d MMMM yyyy")),
    )
