"""Row numbers within groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, reading

_PART = 33  # fixed value: bits of a row's place in its partition in monotonically_increasing_id()


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str, weight: str | None = None, before: str = "before") -> DataFrame:
    """df with a column `name`: 1, 2, ... in `order` (columns by name, or expressions) within rows of equal `by`; with a
    `weight` column also `before`, the sum of the weights of the rows before.

    Rows are dealt by ranges of (by, order), sorted in their parts and written with their places there. A row's number
    is its place from the group's first row in the part, plus what earlier parts hold of the group, of which there are
    few whatever the table. So a group of any size is spread over tasks. The order should tell all rows of a group
    apart; rows that it ties get their numbers in any order. The result reads a table of the shared folder, which
    `discard` of it deletes.
    """
    keys = [o if isinstance(o, str) else f"__order{i}" for i, o in enumerate(order)]
    wide = df.select("*", *[o.alias(k) for o, k in zip(order, keys) if not isinstance(o, str)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wide.repartitionByRange(parts, *by, *keys).sortWithinPartitions(*by, *keys).select(*df.columns, F.monotonically_increasing_id().alias("__at"))
    written = materialize(dealt, "numbered")
    dealt = written.withColumn("__part", F.shiftright("__at", _PART))
    weights = [F.sum(weight).alias("__weight")] if weight else []
    held = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"), *weights)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, alias: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(alias)
    own = [f"__by{i}" for i in range(len(by))]
    held = held.select(*[F.col(c).alias(o) for c, o in zip(by, own)], F.col("__part").alias("__of"), "__first", sums("__rows", "__before"), *([sums("__weight", "__lighter")] if weight else []))
    same = F.col("__part") == F.col("__of")
    for c, o in zip(by, own):
        same = same & F.col(c).eqNullSafe(F.col(o))
    more = []
    if weight:  # sums within a part, which is as long as a task's rows
        inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        more = [(F.col("__lighter") + F.col("__inside")).alias(before)]
    return reading(dealt.join(held, same).select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name), *more), written)
