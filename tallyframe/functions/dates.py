"""Twelve declared date formats, read strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

#: Format name to (strict pattern, positions of year, month and day in it).
_D, _M, _Y, _Y2, _MON = r"(\d{1,2})", r"(\d{1,2})", r"(\d{4})", r"(\d{2})", r"([A-Za-z]{3})"
FORMATS = {
    "YYYY-MM-DD": (f"{_Y}-{_M}-{_D}", (1, 2, 3)),
    "YYYY/MM/DD": (f"{_Y}/{_M}/{_D}", (1, 2, 3)),
    "DD/MM/YYYY": (f"{_D}/{_M}/{_Y}", (3, 2, 1)),
    "DD-MM-YYYY": (f"{_D}-{_M}-{_Y}", (3, 2, 1)),
    "DD.MM.YYYY": (rf"{_D}\.{_M}\.{_Y}", (3, 2, 1)),
    "DD/MM/YY": (f"{_D}/{_M}/{_Y2}", (3, 2, 1)),
    "DD-MM-YY": (f"{_D}-{_M}-{_Y2}", (3, 2, 1)),
    "DD-Mon-YYYY": (f"{_D}-{_MON}-{_Y}", (3, 2, 1)),
    "DD Mon YYYY": (f"{_D} {_MON} {_Y}", (3, 2, 1)),
    "DD-Mon-YY": (f"{_D}-{_MON}-{_Y2}", (3, 2, 1)),
    "MM/DD/YYYY": (f"{_M}/{_D}/{_Y}", (3, 1, 2)),
    "MM-DD-YYYY": (f"{_M}-{_D}-{_Y}", (3, 1, 2)),
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"  # fixed values


def fits(trimmed: Column, form: str) -> Column:
    return trimmed.rlike(rf"^{FORMATS[form][0]}\z")


def read(trimmed: Column, form: str) -> Column:
    """The date of trimmed text that fits the format, or null if there is no such date. (Other text: undefined.)"""
    pattern, (y, m, d) = FORMATS[form]
    full, century = rf"^{pattern}\z", "20" if "YYYY" not in form else ""
    if "Mon" not in form:
        return F.regexp_replace(trimmed, full, f"{century}${y}-${m}-${d}").try_cast("date")
    part = lambda k: F.regexp_extract(trimmed, full, k)
    at = F.instr(F.lit(MONTHS), F.lower(part(m)))
    month = F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
    return F.when(month.isNotNull(), F.concat_ws("-", F.concat(F.lit(century), part(y)), month, part(d))).try_cast("date")


def parse_date(c: Column, form: str) -> Column:
    """The date, or null for a misfit, an impossible date or a blank. White space around is dropped."""
    c = trim(c)
    return F.when(fits(c, form), read(c, form))


def problem(trimmed: Column, fitting: Column, day: Column, form: str) -> Column:
    """Why a date cannot be read, or null if it can, from what `fits` and `read` gave."""
    short = form.replace("YYYY", "YY")
    two = fits(trimmed, short) if short != form and short in FORMATS else F.lit(False)
    misfit = F.when(trimmed == "", F.lit("no date")).when(two, F.lit("two-digit year")).otherwise(F.concat(F.lit("does not fit "), F.lit(form)))
    return F.when(~fitting, misfit).when(day.isNull(), F.lit("no such date"))


def date_problem(c: Column, form: str) -> Column:
    t = trim(F.coalesce(c, F.lit("")))
    return problem(t, fits(t, form), read(t, form), form)


def fitting_formats(df: DataFrame, column: str) -> DataFrame:
    """One row per format that every non-blank value fits, day-first before month-first; one pass over df."""
    c = F.col(column)
    filled = trim(F.coalesce(c, F.lit(""))) != ""
    one = df.agg(F.count_if(filled).alias("n"), *[F.count_if(filled & parse_date(c, f).isNull()).alias(f"bad{i}") for i, f in enumerate(FORMATS)])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("format"), F.col(f"bad{i}").alias("bad"), F.col("n").alias("n")) for i, f in enumerate(FORMATS)])
    return one.select(F.explode(rows).alias("r")).filter("r.bad = 0 and r.n > 0").select("r.place", "r.format")


def books_window(bank_day: Column, days_before: int, days_after: int) -> tuple[Column, Column]:
    return F.date_sub(bank_day, days_after), F.date_add(bank_day, days_before)
