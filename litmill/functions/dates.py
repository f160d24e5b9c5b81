"""Years, eras and publication dates, which the tables keep as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def era_of_sample(year: Column) -> Column:
    """Eras of the sampling cells; a missing year falls into the last."""
    return F.when(year < 2000, "pre2000").when(year.between(2000, 2009), "2000-2009").when(year.between(2010, 2019), "2010-2019").otherwise("2020+")


def era_of_report(year: Column) -> Column:
    """Eras of the reports; a missing year is unknown."""
    return (
        F.when(year < 2000, "pre-2000").when(year.between(2000, 2009), "2000-2009").when(year.between(2010, 2019), "2010-2019")
        .when(year >= 2020, "2020+").otherwise("unknown")
    )


ERAS_OF_REPORT = ["pre-2000", "2000-2009", "2010-2019", "2020+"]


def month_number(month: Column) -> Column:
    """Digits, or the first three letters of a month's name; null if neither."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    text = F.trim(month)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(F.try_element_at(names, F.lower(F.substring(text, 1, 3))))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """Year, month and day as text; the first of the month without a day; empty without a month. The calendar is not
    consulted."""
    m = month_number(month)
    d = F.when(F.trim(day).rlike("^[0-9]+$"), F.trim(day).try_cast("int"))
    full = F.format_string("%04d-%02d-%02d", year, m, F.coalesce(d, F.lit(1)))
    return F.when(year.isNull() | m.isNull(), "").otherwise(full)


def year_within(text: Column) -> Column:
    """The first word of four digits."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{4})\b", 1).try_cast("int")
