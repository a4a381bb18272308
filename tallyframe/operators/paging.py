"""Results kept for paging (C20-C22): a table in order, in parts of known length, of which a page reads one or two."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, new_path, reading

MOST = 500  # fixed value: rows of a page
_PART = 33  # fixed value: bits of a row's place in its partition in monotonically_increasing_id()


class Pages:
    """Pages of a kept table, or of those of its rows for which a condition holds. counts: rows by part, a number for each
    part of the table, so what a page needs of the rows before it is a sum."""

    def __init__(self, table: DataFrame, columns: list[str], counts: dict[int, int], condition: Column | None = None):
        self.table, self.columns, self.condition = table, columns, condition
        self.parts = sorted(counts)
        self.ends = list(accumulate(counts[p] for p in self.parts))
        self.total = self.ends[-1] if self.ends else 0

    def page(self, offset: int, limit: int = MOST) -> DataFrame:
        """Rows offset to offset + limit of the order, MOST at most; reads the parts that hold them and no others."""
        offset, limit = max(0, int(offset)), min(MOST, max(0, int(limit)))
        last = min(offset + limit, self.total)
        if offset >= last:
            return self.table.select(*self.columns).limit(0)
        a, b = bisect_right(self.ends, offset), bisect_right(self.ends, last - 1)
        before = self.ends[a - 1] if a else 0
        rows = self.table.filter(F.col("__part").isin(self.parts[a : b + 1]))
        if self.condition is None:  # places are known: the scan skips row groups by them
            first = (F.col("__part") > self.parts[a]) | (F.col("__place") >= offset - before)
            end = (F.col("__part") < self.parts[b]) | (F.col("__place") < last - (self.ends[b - 1] if b else 0))
            return rows.filter(first & end).orderBy("__part", "__place").select(*self.columns)
        return rows.filter(self.condition).orderBy("__part", "__place").offset(offset - before).limit(last - offset).select(*self.columns)

    def where(self, condition: Column) -> Pages:
        """Pages of the rows for which a condition holds (a search): one pass counts them by part, for all its pages."""
        held = condition if self.condition is None else self.condition & condition
        counts = {r[0]: r[1] for r in self.table.filter(held).groupBy("__part").count().collect()}
        return Pages(self.table, self.columns, counts, held)

    def close(self) -> None:
        """Deletes the table, which other pages of it need too."""
        discard(self.table)


def paged(df: DataFrame, order: list[str], parts: int | None = None) -> Pages:
    """df kept in the shared folder for paging: dealt by ranges of `order` and sorted in its parts (the session's shuffle
    partitions by default). `order` should tell all rows apart; rows that it ties keep one order from page to page."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", at.alias("__at"))
    dealt = dealt.select(*df.columns, F.shiftright("__at", _PART).alias("__part"), F.col("__at").bitwiseAND((1 << _PART) - 1).alias("__place"))
    path = new_path(spark, "pages")
    dealt.write.partitionBy("__part").parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path)
    table.scratch_path = path
    counts = {r[0]: r[1] for r in table.groupBy("__part").count().collect()}  # a row for each part
    return Pages(reading(table), df.columns, counts)
