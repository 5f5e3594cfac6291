"""Dates as pages write them: epochs, ISO, words, "so long ago", days with a month's name; and how exact they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNITS = {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
NESTED = ("$.date", "$.value", "$.text", "$[0]")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; null if it is no month."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)), F.lit(0)).cast("int")


def day(year: Column, month: Column, of_month: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, of_month).try_cast("date")


def ago(low: Column, now: Column) -> tuple[Column, Column]:
    """(day, days in the unit) of "3 weeks ago"; minutes and hours count as now's day."""
    pattern = r"([0-9]{1,4})\s+(minute|hour|day|week|month|year)s?\s+ago"
    size = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.regexp_extract(low, pattern, 2)]
    return F.date_sub(F.to_date(now), (_number(low, pattern, 1) * size).cast("int")), size


WORDS = (("day before yesterday", 2), ("yesterday", 1), ("today", 0), ("just now", 0))


def published(raw: Column, now: Column) -> Column:
    """An ISO day, or an ISO moment where there was a time; null if it can't be read.

    A day and month without a year that would be in the future is last year's.
    """
    text = F.trim(F.coalesce(*(F.get_json_object(F.when(raw.rlike(r"^\s*[\[{]"), raw), p) for p in NESTED), raw))
    low = F.lower(text)
    epoch = F.when(text.rlike(r"^-?[0-9]{9,}$"), text.try_cast("double"))
    moment = F.date_format(F.timestamp_seconds(F.when(F.abs(epoch) > 1e11, epoch / 1000).otherwise(epoch)), "yyyy-MM-dd'T'HH:mm:ss")
    iso = r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2})?)?"
    date, clock, seconds = (F.regexp_extract(text, iso, k) for k in (1, 2, 3))
    stamp = F.when(date != "", F.when(clock == "", date).otherwise(F.concat(date, F.lit("T"), clock, F.when(seconds == "", ":00").otherwise(seconds))))
    word = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.date_sub(F.to_date(now), n)) for w, n in WORDS))
    named = r"([0-9]{1,2})\s+([a-z]{3,})\.?\s*([0-9]{4})?"
    month, year = month_number(F.regexp_extract(low, named, 2)), _number(low, named, 3)
    this = day(F.coalesce(year, F.year(now)), month, _number(low, named, 1))
    rolled = F.when(year.isNull() & (this > F.date_add(F.to_date(now), 1)), F.add_months(this, -12)).otherwise(this)
    return F.coalesce(moment, stamp, F.coalesce(word, ago(low, now)[0], rolled).cast("string"))


def reviewed(text: Column, now: Column) -> tuple[Column, Column]:
    """(day, precision) of a review: exact, approx or month; none without a date. The first form that is there wins."""
    low = F.lower(text)
    dmy = r"\b([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\b"
    numbers = day(*(_number(low, dmy, k) for k in (3, 2, 1)))
    named = r"\b([0-9]{1,2}) ([a-z]{3,9}) ([0-9]{4})\b"
    written = day(_number(low, named, 3), month_number(F.regexp_extract(low, named, 2)), _number(low, named, 1))
    before, unit = ago(low, now)
    word = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.date_sub(F.to_date(now), n)) for w, n in WORDS))
    only = r"\b([a-z]{3,9}) ([0-9]{4})\b"
    month = day(_number(low, only, 2), month_number(F.regexp_extract(low, only, 1)), F.lit(1))
    forms = [(numbers, F.lit("exact")), (written, F.lit("exact")), (before, F.when(unit <= 7, "approx").otherwise("month")), (word, F.lit("approx")), (month, F.lit("month"))]
    precision = F.lit("none")
    for d, p in reversed(forms):
        precision = F.when(d.isNotNull(), p).otherwise(precision)
    return F.coalesce(*(d for d, _ in forms)), precision
