"""Known-answer pairs for tests and benchmarks (A20, A21), made in parallel from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_pair(spark: SparkSession, rows: int, columns: int = 10, width: int = 12, changed: float = 0.05, added: float = 0.02, removed: float = 0.02, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(old, new): shares of rows removed, added and changed in one column each."""
    part = lambda k: F.pmod(F.xxhash64("n", F.lit(seed + k)), F.lit(1_000_000)) / 1e6
    cell = lambda c, salt: F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.lit(c).cast("string"), salt), 256), 1, width)
    gone, altered = part(0) < removed, part(1) < changed
    base = spark.range(rows).withColumnRenamed("id", "n")
    at = F.pmod(F.xxhash64("n", F.lit(seed + 2)), F.lit(columns))
    key = F.concat(F.lit("K"), F.lpad(F.col("n").cast("string"), 10, "0")).alias("id")
    old = base.select(key, *[cell(c, F.lit("a")).alias(f"col{c + 1}") for c in range(columns)], (F.col("n") + 1).alias("record_number"))
    kept = base.filter(~gone).select(key, *[cell(c, F.when(altered & (at == c), F.lit("b")).otherwise(F.lit("a"))).alias(f"col{c + 1}") for c in range(columns)], (F.col("n") + 1).alias("record_number"))
    new = spark.range(rows, rows + round(rows * added)).withColumnRenamed("id", "n").select(key, *[cell(c, F.lit("a")).alias(f"col{c + 1}") for c in range(columns)], (F.col("n") + 1).alias("record_number"))
    return old, kept.unionByName(new)


def ledger_pair(spark: SparkSession, rows: int, amounts: int | None = None, days: int = 28, account: str = "A") -> tuple[DataFrame, DataFrame]:
    """(bank, books): distinct amounts, or `amounts` different ones, over `days` days."""
    amount = (F.col("id") if amounts is None else F.pmod("id", F.lit(amounts))) + 1

    def one(shift: int) -> DataFrame:
        return spark.range(rows).select(F.lit(account).alias("account"), (F.col("id") + 1).alias("record_number"), F.date_add(F.lit("2026-09-01").cast("date"), (F.pmod("id", F.lit(days)) + shift).cast("int")).alias("day"), amount.cast("long").alias("amount"), F.lit(None).cast("string").alias("reference"))

    return one(0), one(1 if days > 1 else 0)


def running_balances(spark: SparkSession, rows: int, opening: int = 50_000, breaks: int = 0, account: str = "A") -> tuple[DataFrame, int]:
    """(rows, opening) of an account whose stated balances run on from row to row; each `breaks`-th one is off by 1.

    The balance is in closed form, so that any number of rows is made in parallel: amounts go 1, -2, 3, -4, ...
    """
    n = F.col("id") + 1
    amount = F.when(n % 2 == 1, n).otherwise(-n)
    balance = F.lit(opening) + F.when(n % 2 == 1, (n + 1) / 2).otherwise(-n / 2).cast("long")
    off = F.when(n % breaks == 0, 1).otherwise(0) if breaks else F.lit(0)
    return spark.range(rows).select(F.lit(account).alias("account"), n.alias("record_number"), amount.alias("amount"), (balance + off).alias("balance")), opening
