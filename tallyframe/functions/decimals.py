"""Strict parsing of decimal text and exact arithmetic on it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"\d+"
#: Comma groups of three, or the last of three and the others of two.
GROUPED = r"(?:\d+|\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})*,\d{3})"


def pattern(grouped: bool = False, trailing_minus: bool = False, parentheses: bool = False) -> str:
    whole = GROUPED if grouped else PLAIN
    body = rf"(?:{whole}(?:\.\d*)?|\.\d+)"
    forms = [rf"[+-]?{body}"]
    if trailing_minus:
        forms.append(rf"{body}-")
    if parentheses:
        forms.append(rf"\({body}\)")
    return r"^(?:" + "|".join(forms) + r")\z"


def clean(c: Column, grouped: bool = False, trailing_minus: bool = False, parentheses: bool = False) -> Column:
    """Plain signed text of a number that fits, else null."""
    digits = F.translate(c, ",()+-", "")
    negative = c.startswith("-") | c.startswith("(") | c.endswith("-")
    return F.when(c.rlike(pattern(grouped, trailing_minus, parentheses)), F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits))


def parse(c: Column, kind: str = "decimal(38,10)", **forms: bool) -> Column:
    """Null for blanks, exponents, spaces, currency signs and anything else that is not a plain number."""
    return clean(c, **forms).try_cast(kind)


def fraction_digits(plain: Column) -> Column:
    """Digits behind the point up to the last that is not 0."""
    point = F.instr(plain, ".")
    return F.when(point == 0, 0).otherwise(F.length(F.rtrim(F.substr(plain, point + 1), F.lit("0"))))


def rescaled(plain: Column, minor_units: int) -> Column:
    """decimal(28, minor_units), or null if digits other than 0 would be lost or it is too large."""
    return F.when(fraction_digits(plain) <= minor_units, plain.try_cast(f"decimal(28,{minor_units})"))


def within(a: Column, b: Column, tolerance) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def within_exactly(a: Column, b: Column, tolerance: Decimal) -> Column:
    """Whether two plain texts (see `clean`) differ by the tolerance at most, for any number of digits.

    Numbers of up to 27 digits before the point and 10 behind it are compared as decimals; the longer of others is
    compared digit by digit. Nothing is rounded.
    """
    short = lambda c: (F.length(F.substring_index(c, ".", 1)) <= 27) & (fraction_digits(c) <= 10)
    tolerance = Decimal(tolerance)
    few = -tolerance.as_tuple().exponent <= 10 and tolerance < 10**27
    slow = _within_by_digits(a, b, tolerance)
    if not few:
        return slow
    fast = F.abs(a.try_cast("decimal(37,10)") - b.try_cast("decimal(37,10)")) <= F.lit(tolerance)
    return F.when(short(a) & short(b), fast).otherwise(slow)


def _within_by_digits(a: Column, b: Column, tolerance: Decimal) -> Column:
    """t - d and t + d are both at least 0, where d is the difference and t the tolerance, each a row of signed digits.

    Of such a row the sign is that of a running value, highest digit first; once this is far from 0, no digits that
    follow turn it, so it is kept within bounds.
    """
    t = format(tolerance, "f")
    parts = [(F.substring_index(F.ltrim(c, F.lit("-")), ".", 1), F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", -1)).otherwise("")) for c in (a, b, F.lit(t))]
    whole, fraction = (F.greatest(*[F.length(p[k]) for p in parts]) for k in (0, 1))

    def digits(part, sign):
        text = F.concat(F.lpad(part[0], whole, F.lit("0")), F.rpad(part[1], fraction, F.lit("0")))
        return F.transform(F.split(text, ""), lambda x: x.cast("int") * sign)

    sign = lambda c: F.when(c.startswith("-"), -1).otherwise(1)
    d = F.zip_with(digits(parts[0], sign(a)), digits(parts[1], sign(b)), lambda x, y: x - y)
    limit = digits(parts[2], F.lit(1))

    def not_negative(row):
        return F.aggregate(row, F.lit(0), lambda held, x: F.greatest(F.lit(-1000), F.least(F.lit(1000), held * 10 + x))) >= 0

    return not_negative(F.zip_with(limit, d, lambda x, y: x - y)) & not_negative(F.zip_with(limit, d, lambda x, y: x + y))


def balance(c: Column, minor_units: int, marks: str | None = None, grouped: bool = True) -> Column:
    """A stated balance. marks: which of "cr" and "dr" is positive; None: no mark may stand. A marked balance must not
    be signed; an unmarked one is a plain number."""
    c = F.trim(c)
    mark = F.lower(F.right(c, F.lit(2)))
    plain = clean(c, grouped=grouped)
    out = rescaled(plain, minor_units)
    if marks is None:
        return out
    body = F.trim(F.substring(c, F.lit(1), F.length(c) - 2))
    value = rescaled(F.when(~body.rlike(r"^[+-]"), clean(body, grouped=grouped)), minor_units)
    return F.when(mark.isin("cr", "dr"), F.when(mark == marks, value).otherwise(-value)).otherwise(out)


def cash_balance(stated: Column, basis: Column) -> Column:
    return F.when(basis == "liability", -stated).otherwise(stated)
