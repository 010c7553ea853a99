"""Date functions. A batch is a Friday; its number is the year and which Friday of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column, *formats: tuple[str, int | None]) -> Column:
    """The first of (format, length) that reads the trimmed text, cut to the length if there is one; else null."""
    plain = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(F.substring(plain, 1, n) if n else plain, F.lit(f)).cast("date") for f, n in formats])


def last_friday(d: Column) -> Column:
    """The most recent Friday, the date itself if it is one."""
    return F.date_sub(d, (F.weekday(d) + 3) % 7)


def next_friday(d: Column) -> Column:
    """The next Friday after the date."""
    return F.next_day(d, "FRI")


def friday_number(friday: Column) -> Column:
    return F.ceil(F.dayofyear(friday) / 7).cast("int")


def batch_number(d: Column) -> Column:
    """YYYY-NNN of the date's batch."""
    friday = last_friday(d)
    return F.when(d.isNotNull(), F.format_string("%04d-%03d", F.year(friday), friday_number(friday)))


def batch_date(number: Column) -> Column:
    """The Friday of YYYY-NNN."""
    first = F.make_date(F.substring(number, 1, 4).cast("int"), F.lit(1), F.lit(1))
    first = F.date_add(first, (11 - F.weekday(first)) % 7)
    return F.date_add(first, 7 * (F.substring(number, 6, 3).cast("int") - 1))


def batches_between(start: Column, end: Column) -> Column:
    """All Fridays of the span."""
    first = F.date_add(start, (11 - F.weekday(start)) % 7)
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


def age_years(since: Column, at: Column) -> Column:
    """Days over 365.25, two places, half to even."""
    return F.bround(F.datediff(at, since) / 365.25, 2)


def clamped_age(age: Column) -> Column:
    """Negative ages as zero; null stays null."""
    return F.when(age < 0, F.lit(0.0)).otherwise(age)


def age_phrase(age: Column) -> Column:
    months = F.bround(age * 12, 0).cast("int")
    return F.when(age.isNull(), F.lit(None)).when(months <= 0, "under a month").when(months == 1, "1 month").when(months < 24, F.concat(months.cast("string"), F.lit(" months"))).otherwise(F.concat(F.floor(age).cast("string"), F.lit(" years")))


def filing_phrase(age: Column) -> Column:
    """How long before its filing a company was incorporated."""
    months = F.bround(age * 12, 0).cast("int")
    return F.when(age.isNull(), F.lit(None)).when(months <= 0, "in the same month as its").when(months == 1, "a month before its").otherwise(F.concat(months.cast("string"), F.lit(" months before its")))


def calendar_months(since: Column, at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at)) - (F.year(since) * 12 + F.month(since))


def is_due(last: Column, today: Column, days: int = 7) -> Column:
    return F.datediff(today, last) >= days


def is_stale(reference: Column, today: Column, days: int = 21) -> Column:
    return F.when(F.datediff(today, reference) > 0, F.datediff(today, reference)).otherwise(0) > days
