"""Scalar functions against tables of accepted and rejected text."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, decimals, text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_parse_decimal(spark):
    good = {"1": 1, "-1": -1, "+2.50": 2.5, ".5": 0.5, "3.": 3, "007": 7, "1,234.5": 1234.5, "12,34,567": 1234567, "5-": -5, "(7)": -7}
    bad = ["", " 1", "1 ", "1e5", "--1", "-5-", "1,23", "1,2345", ",123", "(-1)", "(1", "( 1)", "$1", "5%", "1.2.3", ".", "5\n", None]
    parse = lambda c: decimals.parse(c, "decimal(20,4)", grouped=True, trailing_minus=True, parentheses=True)
    assert values(spark, list(good), parse) == [Decimal(str(v)).quantize(Decimal("0.0001")) for v in good.values()]
    assert values(spark, bad, parse) == [None] * len(bad)
    assert values(spark, ["1,234", "5-", "(7)"], decimals.parse) == [None] * 3


def test_rescale_and_balance(spark):
    assert values(spark, ["1.500", "1.505", "2", "x"], lambda c: decimals.rescaled(decimals.clean(c), 2)) == [Decimal("1.50"), None, Decimal("2.00"), None]
    got = values(spark, ["5.00 Cr", "5.00DR", "-5.00", "-5.00 Cr", "1,000.00 cr", "x"], lambda c: decimals.balance(c, 2, "cr"))
    assert got == [Decimal("5.00"), Decimal("-5.00"), Decimal("-5.00"), None, Decimal("1000.00"), None]
    assert values(spark, ["5.00 Cr"], lambda c: decimals.balance(c, 2)) == [None]


@pytest.mark.parametrize(
    "form,raw,want",
    [
        ("DD/MM/YYYY", " 5/3/2024 ", "2024-03-05"),
        ("DD/MM/YYYY", "31/02/2024", None),
        ("DD/MM/YYYY", "001/02/2024", None),
        ("DD/MM/YYYY", "1/2/24", None),
        ("DD/MM/YY", "1/2/24", "2024-02-01"),
        ("DD-Mon-YYYY", "05-SEP-2026", "2026-09-05"),
        ("DD Mon YYYY", "5 xyz 2026", None),
        ("DD Mon YYYY", "5 anf 2026", None),
        ("MM/DD/YYYY", "02/29/2024", "2024-02-29"),
        ("MM/DD/YYYY", "02/29/2023", None),
        ("YYYY-MM-DD", "2024-1-2", "2024-01-02"),
        ("DD.MM.YYYY", "1.2.2024", "2024-02-01"),
        ("DD/MM/YYYY", None, None),
    ],
)
def test_dates(spark, form, raw, want):
    (got,) = values(spark, [raw], lambda c: dates.parse_date(c, form))
    assert (str(got) if got else None) == want
    (why,) = values(spark, [raw], lambda c: dates.date_problem(c, form))
    assert (why is None) == (want is not None)


def test_text(spark):
    assert values(spark, [" ﻿ a b \t ", ""], text.trim) == ["a b", ""]
    assert values(spark, ["=1+1", "-5", "-x", "@a", "+1.5", "ok", "\tq"], text.escape_formula) == ["'=1+1", "-5", "'-x", "'@a", "+1.5", "ok", "'\tq"]
    assert values(spark, ["bank|" + "0" * 64 + "|1", "bank|" + "0" * 63 + "|1", "x|" + "0" * 64 + "|1", "bank|" + "0" * 64 + "|01"], text.is_txn_key) == [True, False, False, False]
    assert values(spark, ["a", "b"], lambda c: text.found("AB", c, F.lit("b"))) == [False, False]


def test_fitting_formats(spark):
    df = spark.createDataFrame([("13/01/2024",), ("",), (None,), ("2/3/2024",)], "v string")
    assert [r["format"] for r in dates.fitting_formats(df, "v").collect()] == ["DD/MM/YYYY"]
