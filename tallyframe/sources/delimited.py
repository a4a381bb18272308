"""Delimited files as all-text tables (A1-A10): layouts, diagnostics, whole-file rejection, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t")


@dataclass(frozen=True)
class Layout:
    """The header is the header_record-th non-blank record; then skip_leading and, at the end, skip_trailing are not data."""

    header_record: int = 1
    skip_leading: int = 0
    skip_trailing: int = 0


#: Lines from the header on that a delimiter is told by.
LOOKED_AT = 10


def detect_delimiter(spark: SparkSession, paths: list[str], header_record: int = 1, parts: bool = False) -> DataFrame:
    """(file, delimiter): candidates are tried in order, and one takes the place of the one before if its number of fields
    changes no more from line to line and is larger on average. A single column counts as commas.

    Delimiters inside quotes are no delimiters. Up to LOOKED_AT non-blank lines from the header on are looked at.
    parts: a folder is one file, as in `ranges`.
    """
    path = F.col("_metadata.file_path")
    at = F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).select((F.regexp_replace(path, r"[^/]*\z", "") if parts else path).alias("file"), "value", at.alias("at")).filter(F.trim(F.regexp_replace("value", "﻿", "")) != "")
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.col("nth") < header_record + LOOKED_AT)
    bare = F.regexp_replace("value", '"[^"]*("|$)', "")
    fields = first.filter(F.col("nth") >= header_record).select("file", "nth", *[F.size(F.split(bare, f"[{d}]")).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    seen = fields.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("nth", *[f"n{i}" for i in range(len(DELIMITERS))]))).alias("lines"))

    def judged(i: int, d: str):
        n = F.transform("lines", lambda x: x[f"n{i}"])
        change = F.aggregate(F.sequence(F.lit(1), F.size(n)), F.lit(0), lambda c, k: c + F.abs(F.get(n, k - 1) - F.get(n, F.greatest(k - 2, F.lit(0)))))
        return F.struct(change.alias("change"), (F.aggregate(n, F.lit(0), lambda c, x: c + x) / F.size(n)).alias("mean"), F.lit(d).alias("d"))

    start = F.struct(F.lit(2**31 - 1).alias("change"), F.lit(1.99).cast("double").alias("mean"), F.lit(",").alias("d"))
    best = F.aggregate(F.array(*[judged(i, d) for i, d in enumerate(DELIMITERS)]), start, lambda a, x: F.when((x["change"] <= a["change"]) & (x["mean"] > a["mean"]), x).otherwise(a))
    return seen.select("file", best["d"].alias("delimiter"))


def records(spark: SparkSession, paths: list[str], width: int, delimiter: str = ",") -> DataFrame:
    """(file, record, c0.., _bad) of every non-blank record, text as typed ('' for empty)."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("sep", delimiter).option("quote", '"').option("escape", '"').csv(paths)
    some = F.length(F.concat_ws("", *[f"c{i}" for i in range(width)])) >= 0  # always; the reader refuses a scan of _bad alone
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), *[F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(width)], F.when(some, F.col("_bad")).alias("_bad"))
    # under multiLine one file is one task, so the order of ids is the order in the file
    return raw.withColumn("record", F.row_number().over(Window.partitionBy("file").orderBy("at"))).drop("at")


def zoned(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows with zone (before, header, after, data, end) and record_number (1-based, data only)."""
    n = F.count("*").over(Window.partitionBy("file"))
    h, first = layout.header_record, layout.header_record + layout.skip_leading
    zone = F.when(F.col("record") < h, "before").when(F.col("record") == h, "header").when(F.col("record") <= first, "after").when(F.col("record") > n - layout.skip_trailing, "end").otherwise("data")
    out = rows.withColumn("zone", zone)
    return out.withColumn("record_number", F.when(F.col("zone") == "data", (F.col("record") - first).cast("long")))


def skipped(zones: DataFrame) -> DataFrame:
    return zones.filter(F.col("zone").isin("before", "after", "end"))


def header_issues(names: DataFrame) -> DataFrame:
    """names (file, place, name): (file, message) for empty and repeated header names."""
    trimmed = names.withColumn("name", F.trim("name"))
    empty = trimmed.filter("name = ''").select("file", F.concat(F.lit("column "), (F.col("place") + 1).cast("string"), F.lit(" has no name")).alias("message"))
    twice = trimmed.filter("name != ''").groupBy("file", "name").agg(F.count("*").alias("n")).filter("n > 1").select("file", F.concat(F.lit("column name used twice: "), F.col("name")).alias("message"))
    return empty.unionByName(twice)


def record_issues(zones: DataFrame) -> DataFrame:
    """Records of a wrong width or structure: only data records count, and each of them keeps its text."""
    return zones.filter("zone = 'data' and _bad is not null").select("file", "record_number", F.lit("wrong number of fields").alias("message"), F.col("_bad").alias("raw"))


def accepted(zones: DataFrame, *issues: DataFrame) -> DataFrame:
    """Data records of files without any issue: one issue rejects its whole file."""
    out = zones.filter("zone = 'data'")
    for i in issues:
        out = out.join(i.select("file").distinct(), "file", "left_anti")
    return out


def read_table(spark: SparkSession, path: str, layout: Layout = Layout(), delimiter: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the file's own columns and record_number, skipped records, issues) of one file.

    The header is a single small record and is read first, to name the columns.
    """
    if delimiter is None:
        found = detect_delimiter(spark, [path], layout.header_record).first()
        delimiter = found["delimiter"] if found else ","
    one = records(spark, [path], 1, delimiter)  # a header of several columns is a bad record of one, with its text
    head = one.filter(F.col("record") == layout.header_record).first()
    if head is None:
        raise ValueError(f"{path}: no header record")
    text = head["_bad"]
    names = next(iter(__import__("csv").reader([text], delimiter=delimiter))) if text else [head["c0"]]
    names = [n.strip().lstrip("﻿").strip() for n in names]
    zones = zoned(records(spark, [path], len(names), delimiter), layout)
    heads = spark.createDataFrame([(path, i, n) for i, n in enumerate(names)], "file string, place int, name string")
    broken = encoding_issues(fingerprints(spark, [path])).select(F.lit(None).cast("long").alias("record_number"), "message", F.lit(None).cast("string").alias("raw"))
    issues = record_issues(zones).select("record_number", "message", "raw").unionByName(broken).unionByName(header_issues(heads).select(F.lit(None).cast("long").alias("record_number"), "message", F.lit(None).cast("string").alias("raw")))
    rows = zones.filter("zone = 'data'")
    if len(set(names)) == len(names) and all(names):
        rows = rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "record_number", "file")
    return rows, skipped(zones), issues


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, fingerprint, is_utf8) of whole files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("fingerprint"), F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"))


def manifest(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(file, fingerprint, records)."""
    return rows.groupBy("file").agg(F.count("*").alias("records")).join(prints, "file", "left").select("file", "fingerprint", "records")


def encoding_issues(prints: DataFrame) -> DataFrame:
    """(file, message) of files that are not UTF-8: such an issue rejects the file whole (see accepted)."""
    return prints.filter(~F.col("is_utf8")).select("file", F.lit("not valid UTF-8").alias("message"))


def table_fingerprints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, records, fingerprint) of sources without bytes of their own: order-free sums of row hashes, so a source of
    any size is one row per task before the shuffle. Nulls and empty texts differ."""
    cells = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    h = F.conv(F.substring(F.md5(cells), 1, 15), 16, 10).cast("long")
    sums = df.withColumn("h", h).groupBy(*by).agg(F.count("*").alias("records"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("h").cast("string").alias("mixed"))
    return sums.select(*by, "records", F.sha2(F.concat_ws("|", "total", "mixed", F.col("records").cast("string")), 256).alias("fingerprint"))
