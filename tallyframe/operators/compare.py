"""Keyed snapshot comparison.

Both snapshots are united and grouped once by the normalised key. The aggregate holds one struct per side, so a key
with any number of duplicates costs one row per task before the shuffle, and a full outer join is not needed.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CompareRules
from ..functions import decimals, text

ROW = "record_number"


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, kind, place): shared and removed columns in old order, added ones in new order."""
    a, b = ([c for c in df.columns if c != ROW] for df in (old, new))
    rows = [(c, "shared" if c in b else "removed", i) for i, c in enumerate(a)] + [(c, "added", i) for i, c in enumerate(b) if c not in a]
    return old.sparkSession.createDataFrame(rows, "name string, kind string, place int")


def keyed(old: DataFrame, new: DataFrame, rules: CompareRules) -> DataFrame:
    """(side, record_number, key, parts, row) of both sides; row has every column of the side as text."""
    rules.check(old.columns, new.columns)

    def one(df: DataFrame, side: str) -> DataFrame:
        cols = [c for c in df.columns if c != ROW]
        cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        names = sorted({*old.columns, *new.columns} - {ROW})
        row = F.struct(*[(cell(c) if c in cols else F.lit(None).cast("string")).alias(c) for c in names])
        return df.select(
            F.lit(side).alias("side"),
            F.col(ROW).cast("long").alias(ROW),
            F.array(*[text.key_part(F.col(f"`{c}`"), rules.trim_keys, rules.fold_keys) for c in rules.key]).alias("key"),
            F.array(*[cell(c) for c in rules.key]).alias("parts"),
            row.alias("row"),
        )

    return one(old, "old").unionByName(one(new, "new"))


def empty_keys(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("key", lambda p: p == "")).select("side", ROW, "parts")


def classify(rows: DataFrame) -> DataFrame:
    """One row per complete key: key, n_old, n_new, old, new (record_number, parts, row), kind."""
    of = lambda s: F.any_value(F.when(F.col("side") == s, F.struct(ROW, "parts", "row")), ignoreNulls=True)
    out = (
        rows.filter(~F.exists("key", lambda p: p == ""))
        .groupBy("key")
        .agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"), of("old").alias("old"), of("new").alias("new"))
    )
    kind = F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "ambiguous").when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").otherwise("matched")
    return out.withColumn("kind", kind)


def _numbers(c: Column, rule) -> Column:
    """Plain text of a number, else null; of any number of digits."""
    return decimals.clean(c, grouped=rule.grouped, trailing_minus=True)


def _differs(a: Column, b: Column, c: str, rules: CompareRules) -> Column:
    x, y = (text.trim(a), text.trim(b)) if rules.trim_values else (a, b)
    if c in rules.numeric:
        p, q = _numbers(x, rules.numeric[c]), _numbers(y, rules.numeric[c])
        return F.when(p.isNotNull() & q.isNotNull(), ~decimals.within_exactly(p, q, rules.numeric[c].tolerance)).otherwise(~x.eqNullSafe(y))
    if c in rules.case_insensitive:
        return ~F.lower(x).eqNullSafe(F.lower(y))
    return ~x.eqNullSafe(y)


def compared_columns(old: DataFrame, new: DataFrame, rules: CompareRules) -> list[str]:
    return [c for c in old.columns if c in new.columns and c != ROW and c not in rules.ignored]


def compare_values(classes: DataFrame, columns: list[str], rules: CompareRules) -> DataFrame:
    """Matched keys with changes (in the order of columns) and warnings (one per side that is not a number)."""
    a, b = (lambda c: F.col("old.row")[c]), (lambda c: F.col("new.row")[c])
    changes = F.array(*[F.when(_differs(a(c), b(c), c, rules), F.struct(F.lit(c).alias("column"), a(c).alias("before"), b(c).alias("after"))) for c in columns])
    kind = "array<struct<column:string,side:string,record_number:long,message:string>>"
    said = []
    for c in (c for c in columns if c in rules.numeric):
        for side, v in (("old", a(c)), ("new", b(c))):
            x = text.trim(v) if rules.trim_values else v
            message = F.concat(F.lit('"'), v, F.lit('" is not a number; compared as text'))
            said.append(F.when(_numbers(x, rules.numeric[c]).isNull(), F.struct(F.lit(c).alias("column"), F.lit(side).alias("side"), F.col(f"{side}.{ROW}").alias(ROW), message.alias("message"))))
    warnings = F.array_compact(F.array(*said)).cast(kind) if said else F.array().cast(kind)
    return classes.filter("kind = 'matched'").select("key", "old", "new", F.array_compact(changes).alias("changes") if columns else F.array().cast("array<struct<column:string,before:string,after:string>>").alias("changes"), warnings.alias("warnings"))


def changed(compared: DataFrame) -> DataFrame:
    return compared.filter(F.size("changes") > 0)


def change_rows(compared: DataFrame) -> DataFrame:
    return changed(compared).select("key", F.col(f"old.{ROW}").alias("old_record"), F.col(f"new.{ROW}").alias("new_record"), F.inline("changes"))


def warning_rows(compared: DataFrame) -> DataFrame:
    return compared.select("key", F.inline("warnings"))


def changes_by_column(compared: DataFrame) -> DataFrame:
    return change_rows(compared).groupBy("column").agg(F.count("*").alias("records"))


def summary(rows: DataFrame, classes: DataFrame, compared: DataFrame) -> DataFrame:
    """One row of counts: ambiguous counts keys, empty_key counts records."""
    kinds = classes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "ambiguous")])
    values = compared.agg(F.count_if(F.size("changes") > 0).alias("changed"), F.count_if(F.size("changes") == 0).alias("unchanged"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"))
    empty = empty_keys(rows).agg(F.count("*").alias("empty_key"))
    return kinds.crossJoin(values).crossJoin(empty).select("added", "removed", "changed", "unchanged", "ambiguous", "empty_key", "warnings")


def rules_json(rules: CompareRules) -> str:
    """The rules that a report says it used."""
    return json.dumps(asdict(rules), default=str)


def summary_text(summed: DataFrame, by_column: DataFrame) -> DataFrame:
    """One sentence; columns by falling count, then name."""
    named = by_column.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("records")).alias("n"), "column"))), lambda x: F.concat(x["column"], F.lit(": "), (-x["n"]).cast("string"))), ", ").alias("by"))
    tail = F.when(F.col("by") != "", F.concat(F.lit(" ("), F.col("by"), F.lit(")"))).otherwise(F.lit(""))
    return summed.crossJoin(named).select(F.concat(F.col("added").cast("string"), F.lit(" added, "), F.col("removed").cast("string"), F.lit(" removed, "), F.col("changed").cast("string"), F.lit(" changed"), tail, F.lit(".")).alias("sentence"))


def ambiguous_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Every record of an ambiguous key, with the key's counts."""
    keys = classes.filter("kind = 'ambiguous'").select("key", "n_old", "n_new")
    return rows.join(keys, "key").select("key", "side", ROW, "parts", "n_old", "n_new")


def capped_members(members: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` records of each key and side: a preview."""
    nth = F.row_number().over(Window.partitionBy("key", "side").orderBy(ROW))
    return members.withColumn("nth", nth).filter(F.col("nth") <= most)


def changed_in(compared: DataFrame, column: str) -> DataFrame:
    return compared.filter(F.exists("changes", lambda x: x["column"] == column))


def _holding(shown: Column, needle: str) -> Column:
    """Whether any of an array of texts holds the needle; never across two of them. A blank needle is in all."""
    needle = needle.strip().lower()
    return F.exists(shown, lambda v: F.contains(F.lower(v), F.lit(needle))) if needle else F.lit(True)


def search_changes(compared: DataFrame, needle: str) -> DataFrame:
    cells = F.flatten(F.transform("changes", lambda x: F.array(x["column"], x["before"], x["after"])))
    return changed(compared).filter(_holding(F.concat(F.col("new.parts"), F.col("old.parts"), cells), needle))


def search(section: str, rows: DataFrame, needle: str) -> DataFrame:
    """Rows of a section of the report (see sinks.compare_sections, or compare_values() for Changed) with the needle in any
    text shown: the key as typed in every section, all values of added and removed records, columns with values of
    changed ones, columns and messages of warnings. Filter first, then page."""
    if section == "Changed":
        return search_changes(rows, needle)
    if section in ("Added", "Removed"):
        shown = F.array(*[F.coalesce(F.col("row")[c], F.lit("")) for c in rows.schema["row"].dataType.names])
    elif section in ("Ambiguous keys", "Empty keys"):
        shown = F.col("parts")
    elif section == "Numeric warnings":
        shown = F.array("column", "message")
    else:
        raise ValueError(f"no such section: {section}")
    return rows.filter(_holding(shown, needle))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page in a stable order; at most 500 rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 500))


def preview(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first `size` rows with the total of all."""
    return df.orderBy(*order).limit(size).crossJoin(df.agg(F.count("*").alias("total")))


def export_rows(classes: DataFrame, compared: DataFrame, old_columns: list[str], new_columns: list[str]) -> DataFrame:
    """The long changes report: (change_type, key, column, before, after) with the order of its lines."""

    def every(side: str, kind: str, place: int, columns: list[str]) -> DataFrame:
        empty = F.lit("")
        cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), (F.col(f"{side}.row")[c] if side == "old" else empty).alias("before"), (F.col(f"{side}.row")[c] if side == "new" else empty).alias("after")) for i, c in enumerate(columns)])
        return classes.filter(F.col("kind") == kind).select(F.lit(kind).alias("change_type"), F.lit(place).alias("section"), F.col(f"{side}.{ROW}").alias(ROW), text.key_cell(F.col(f"{side}.parts")).alias("key"), F.inline(cells))

    order = F.create_map(*[y for i, c in enumerate(old_columns) for y in (F.lit(c), F.lit(i))])
    changes = changed(compared).select(F.lit("changed").alias("change_type"), F.lit(2).alias("section"), F.col(f"new.{ROW}").alias(ROW), text.key_cell(F.col("new.parts")).alias("key"), F.inline("changes")).withColumn("position", F.element_at(order, F.col("column")))
    return every("new", "added", 0, new_columns).unionByName(every("old", "removed", 1, old_columns)).unionByName(changes)
