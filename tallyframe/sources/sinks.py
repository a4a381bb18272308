"""Reports as tables and files (A11-A15). Every writer is partitioned; one-file forms are for the reader to make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CompareRules
from ..functions.text import escape_formula
from ..operators import compare as C
from . import pieces

REPORT = "csv-diff-report"  # fixed value: what the document calls itself


def compare_sections(rows: DataFrame, classes: DataFrame, compared: DataFrame) -> dict[str, DataFrame]:
    """The sections of a comparison report, each there even if empty."""
    side = lambda kind, s: classes.filter(F.col("kind") == kind).select(F.col(f"{s}.record_number").alias("record_number"), F.col(f"{s}.parts").alias("key"), F.col(f"{s}.row").alias("row"))
    return {
        "Summary": C.summary(rows, classes, compared),
        "Added": side("added", "new"),
        "Removed": side("removed", "old"),
        "Changed": C.change_rows(compared),
        "Ambiguous keys": C.ambiguous_members(rows, classes),
        "Empty keys": C.empty_keys(rows),
        "Numeric warnings": C.warning_rows(compared),
    }


def manifest(summary: DataFrame, rules: CompareRules, old_name: str, new_name: str, generated_at: str) -> DataFrame:
    """The head of a comparison report: one row with what it is, the rules, the files, the time and the counts."""
    head = [F.lit(REPORT).alias("format"), F.lit(1).alias("version"), F.lit(C.rules_json(rules)).alias("rulesUsed"), F.struct(F.lit(old_name).alias("old"), F.lit(new_name).alias("new")).alias("files"), F.lit(generated_at).alias("generatedAt")]
    return summary.select(*head, F.struct(*summary.columns).alias("summary"))


def write_json_sections(sections: dict[str, DataFrame], folder: str, head: DataFrame | None = None) -> None:
    """A folder of JSON lines for each section, and the manifest."""
    for name, df in [*sections.items(), *([("manifest", head)] if head is not None else [])]:
        df.write.mode("overwrite").json(f"{folder}/{name.lower().replace(' ', '_')}")


def write_changes(export: DataFrame, folder: str, escape: bool = False) -> None:
    """The long report as CSV parts in report order; `escape` guards cells that a spreadsheet would run."""
    out = export.repartitionByRange("section", "record_number", "position").sortWithinPartitions("section", "record_number", "position")
    cols = ["change_type", "key", "column", "before", "after"]
    out.select(*[(escape_formula(F.col(c)) if escape else F.col(c)).alias(c) for c in cols]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(folder)


def write_changes_text(export: DataFrame, folder: str, escape: bool = True) -> None:
    """The long report as text parts whose bytes, joined in the order of their names, are one CSV file for spreadsheets:
    a byte order mark, CRLF line ends and quotes where a cell needs them. No task holds more than its range of lines."""
    cols = ["change_type", "key", "column", "before", "after"]
    cell = lambda c: escape_formula(F.coalesce(F.col(c), F.lit(""))) if escape else F.coalesce(F.col(c), F.lit(""))
    quoted = lambda c: F.when(c.rlike('[",\r\n\uFEFF]|^ | \\z'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    lines = export.select("section", "record_number", "position", F.concat(F.concat_ws(",", *[quoted(cell(c)) for c in cols]), F.lit("\r")).alias("value"))
    head = export.sparkSession.createDataFrame([(-1, 0, 0, "\ufeff" + ",".join(cols) + "\r")], "section int, record_number long, position int, value string")
    order = ["section", "record_number", "position"]
    lines.unionByName(head).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(folder)


def reconcile_sections(summary: DataFrame, matches: DataFrame, outstanding: DataFrame, members: DataFrame, problems: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    return {"Summary": summary, "Matches": matches, "Outstanding": outstanding, "Group members": members, "Problems": problems, "Decisions": decisions}


def section_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """(account, section, line): every section as lines of text, its columns joined by `|` (null: empty)."""
    out = []
    for name, df in sections.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != "account"]
        out.append(df.select("account", F.lit(name).alias("section"), F.concat_ws("|", *cells).alias("line")))
    return reduce(DataFrame.unionByName, out)


def reconcile_report(bridge: DataFrame, statuses: DataFrame, **lists: DataFrame) -> DataFrame:
    """One nested row per account: its bridge, its statuses and a list for each table given by name (sources, matches,
    outstanding, problems, decisions, lapsed, ...). Lists are per account, as the document has them; the tables
    themselves are the form for lists of any length."""
    out = bridge.join(statuses.drop("bridge_complete"), "account", "left")
    for name, df in lists.items():
        cols = [c for c in df.columns if c != "account"]
        listed = df.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(listed, "account", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out


def reconcile_report_pieces(bridge: DataFrame, statuses: DataFrame, **lists: DataFrame) -> DataFrame:
    """The same reports as lines for pieces.write(), a document per account with lists of any length; a list's items are in
    the order of their columns."""
    heads = bridge.join(statuses.drop("bridge_complete"), "account", "left")
    own = {}
    for name, df in lists.items():
        cols = [c for c in df.columns if c != "account"]
        own[name] = (df.select("account", F.struct(*cols).alias("item"), *cols), cols)
    return pieces.lines(heads, own)
