"""JSON documents of any length (A12, A14, A17): written as ordered pieces of text, so that no task holds a document.

A document is an object with some fields and then lists. Its head, each item of its lists, and what stands between them
are lines of text, which are dealt to tasks by ranges of (document, list, place). Each document is a folder whose parts,
joined in the order of their names, are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..scratch import reading

_NULLS = {"ignoreNullFields": "false"}


def lines(heads: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], by: str = "account") -> DataFrame:
    """(document, section, nth, value): the lines of every document, a row of `heads` with `by` (its name, not null) and its
    fields. lists: for each list in its order a table (by, item) with the columns that put a document's items in order.

    Items of documents that heads does not have are left out; a document without items has empty lists.
    """
    named = list(lists)
    fields = [c for c in heads.columns if c != by]
    text = lambda c: F.to_json(c, _NULLS)
    between = [f'"{name}":[' for name in named]

    def row(section: int, value: Column, rows: DataFrame = heads) -> DataFrame:
        return rows.select(F.col(by).alias("document"), F.lit(section).alias("section"), F.lit(0).cast("long").alias("nth"), value.alias("value"))

    head = F.regexp_replace(text(F.struct(*fields)), r"\}\z", "")
    comma = F.when(head == "{", F.lit("")).otherwise(F.lit(","))
    out = row(0, F.concat(head, comma, F.lit(between[0])) if named else F.concat(head, F.lit("}")))
    for i, name in enumerate(named):
        df, order = lists[name]
        item = df.schema["item"].dataType.typeName()
        value = text("item") if item in ("struct", "array", "map", "variant") else F.regexp_extract(text(F.struct("item")), r"(?s)\A\{\"item\":(.*)\}\z", 1)
        held = df.join(heads.select(by), by, "left_semi").select(by, value.alias("value"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
        placed = numbered(held, [by], [*[f"o{k}" for k in range(len(order))], "value"], "nth")
        items = placed.select(F.col(by).alias("document"), F.lit(2 * i + 1).alias("section"), "nth", F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), "value").alias("value"))
        end = F.lit("]," + between[i + 1] if i + 1 < len(named) else "]}")
        out = reading(out.unionByName(items).unionByName(row(2 * i + 2, end)), *getattr(out, "scratch_tables", ()), placed)
    return out


def write(pieces: DataFrame, folder: str, parts: int | None = None) -> None:
    """Each document's lines to a folder of its own (document=...). Adaptive execution chooses how many ranges the lines are
    dealt to, by their size, unless `parts` says it."""
    order = ["document", "section", "nth"]
    pieces.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select("document", "value").write.mode("overwrite").partitionBy("document").text(folder)


def joined(spark, folder: str) -> DataFrame:
    """(document, value): whole documents of a folder as texts, for those short enough to be rows."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    parts = spark.read.text(folder).select(F.col("document").cast("string").alias("document"), at.alias("line"))
    return parts.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "").alias("value"))
