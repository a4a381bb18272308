"""Queries of layouts, diagnostics and manifests (A2-A10) over records that the given tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import delimited, ranges
from .adapters import sql

QUERIES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql(oracle) if oracle else None)
        return f

    return add


_LINES = """li AS (SELECT 'S' || CAST(o_custkey % 40 AS STRING) AS file, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS record, count(*) OVER (PARTITION BY o_custkey % 40) AS n, o_orderpriority AS c0, o_orderkey % 701 = 0 AS bad FROM orders),
  zo AS (SELECT *, CASE WHEN record < 3 THEN 'before' WHEN record = 3 THEN 'header' WHEN record <= 4 THEN 'after' WHEN record > n - 2 THEN 'end' ELSE 'data' END AS zone FROM li)"""


def _zones(spark, sf):
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_custkey") % 40
    rows = orders.select(F.concat(F.lit("S"), k.cast("string")).alias("file"), F.row_number().over(Window.partitionBy(k).orderBy("o_orderkey")).alias("record"), F.col("o_orderpriority").alias("c0"), F.when(F.col("o_orderkey") % 701 == 0, F.col("o_orderpriority")).alias("_bad"))
    return delimited.zoned(rows, delimited.Layout(3, 1, 2))


@query(f"WITH {_LINES} SELECT file, record, zone, CASE WHEN zone = 'data' THEN record - 4 END AS record_number FROM zo")
def a02_layout_zones(spark, sf):
    """A2, A5: layout zones and record numbers."""
    return _zones(spark, sf).select("file", F.col("record").cast("long").alias("record"), "zone", "record_number")


_HEADS = "he AS (SELECT 'S' || CAST(o_custkey AS STRING) AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderpriority END AS name FROM orders)"


@query(f"WITH {_HEADS} SELECT file, 'column ' || CAST(place AS STRING) || ' has no name' AS message FROM he WHERE name = '' UNION ALL SELECT file, 'column name used twice: ' || name FROM he WHERE name <> '' GROUP BY file, name HAVING count(*) > 1")
def a03_header_issues(spark, sf):
    """A3: a header for each customer, its names the priorities of all their orders."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return delimited.header_issues(orders.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("file"), place.alias("place"), F.when(F.col("o_orderkey") % 29 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("name")))


@query(f"WITH {_LINES} SELECT file, record - 4 AS record_number, c0 AS raw FROM zo WHERE zone = 'data' AND bad")
def a04_record_issues(spark, sf):
    return delimited.record_issues(_zones(spark, sf)).select("file", "record_number", "raw")


@query(f"WITH {_LINES} SELECT file, count(*) AS records FROM zo WHERE zone = 'data' AND file NOT IN (SELECT file FROM zo WHERE zone = 'data' AND bad) GROUP BY file")
def a04_accepted(spark, sf):
    """A4, A10: whole files with an issue are rejected; records of the others."""
    zones = _zones(spark, sf)
    good = delimited.accepted(zones, delimited.record_issues(zones))
    return delimited.manifest(good, good.select("file", F.lit("-").alias("fingerprint")).distinct()).select("file", "records")


@query(f"WITH {_LINES} SELECT file, zone, record FROM zo WHERE zone IN ('before', 'after', 'end')")
def a06_skipped(spark, sf):
    return delimited.skipped(_zones(spark, sf)).select("file", "zone", F.col("record").cast("long").alias("record"))


_PRINT = """fp AS (SELECT 'S' || CAST(o_custkey % 40 AS STRING) AS file, CAST('0x' || substr(md5('=' || CAST(o_orderkey AS STRING) || '|=' || o_orderstatus || '|=' || o_orderpriority), 1, 15) AS BIGINT) AS h FROM orders)"""


@query(f"WITH {_PRINT} SELECT file, count(*) AS records, sha256(CAST(sum(CAST(h AS HUGEINT)) AS STRING) || '|' || CAST(bit_xor(h) AS STRING) || '|' || CAST(count(*) AS STRING)) AS fingerprint FROM fp GROUP BY file")
def a09_fingerprints(spark, sf):
    """Fingerprints of sources that are tables, whatever the order of their rows."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("file", F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")))
    return delimited.table_fingerprints(orders, ["file"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


_DOCS = "dx AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS body, coalesce(lang, '') AS lang FROM documents)"


#: Bytes of texts in a part of a written file, on average.
PART = 1 << 25


def _in_parts(docs, rows, *order):
    """rows dealt by ranges of their order, to as many parts as the texts of docs need."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.repartitionByRange(size // PART + 1, *order).sortWithinPartitions(*order)


def _written(spark, sf):
    """documents as quoted CSV, a file of ordered parts (a folder) for each language, texts with their quotes and line ends."""
    from ..scratch import new_path

    path = new_path(spark, "delimited")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = F.lit("")
    rows = docs.select(F.coalesce("lang", none).alias("lang"), F.concat(F.lit("K"), F.coalesce("lang", none)).alias("folder"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", none).alias("source"), F.coalesce("text", none).alias("body"))
    _in_parts(docs, rows, "folder", "doc_id").write.partitionBy("folder").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("lineSep", "\n").csv(path)
    return path


@query(f"WITH {_DOCS} SELECT doc_id, source, lang, md5(body) AS body, CAST(row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS STRING)) AS BIGINT) AS record FROM dx")
def a01_ranged_scan(spark, sf):
    """A1, A5: a quoted file for each language, read by ranges: every field as it was, every record with its number."""
    found = ranges.records(spark, [_written(spark, sf)], 4, parts=True)
    return found.select(F.col("c1").cast("long").alias("doc_id"), F.col("c2").alias("source"), F.col("c0").alias("lang"), F.md5("c3").alias("body"), F.col("record").cast("long").alias("record"))


@query(f"""WITH {_DOCS}, n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY lang) AS n FROM dx WINDOW w AS (PARTITION BY lang ORDER BY CAST(doc_id AS STRING))), q AS (SELECT *, '"' || lang || '","' || doc_id || '","' || source || '","' || replace(body, '"', '""') || '"' AS raw FROM n)
  SELECT lang, CASE WHEN r < 3 THEN 'before' WHEN r <= 6 THEN 'after' ELSE 'end' END AS zone, CAST(r AS BIGINT) AS record, md5(raw) AS raw FROM q WHERE r <= 6 AND r <> 3 OR r > 6 AND r > n - 4""")
def a06_ranged_skipped(spark, sf):
    """Records around the data keep the text that they were typed as."""
    texts, files = ranges.record_texts(spark, [_written(spark, sf)], parts=True)
    zones = ranges.zoned(texts, files, delimited.Layout(3, 3, 4))
    lang = F.regexp_extract("file", "folder=K([^/]*)/", 1)
    return delimited.skipped(zones).select(lang.alias("lang"), "zone", F.col("record").cast("long").alias("record"), F.md5("text").alias("raw"))


@query(f"""WITH {_DOCS} SELECT lang, sha256(string_agg('"' || lang || '","' || doc_id || '","' || source || '","' || replace(body, '"', '""') || '"' || chr(10), '' ORDER BY CAST(doc_id AS STRING))) AS fingerprint, true AS is_utf8 FROM dx GROUP BY lang""")
def a07_ranged_fingerprints(spark, sf):
    """Hash and encoding of whole files, hashed piece by piece in constant memory."""
    found = ranges.fingerprints(spark, [_written(spark, sf)], parts=True)
    return found.select(F.regexp_extract("file", "folder=K([^/]*)/", 1).alias("lang"), "fingerprint", "is_utf8")


@query("""SELECT lang, CASE ascii(lang || 'x') % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter FROM (SELECT DISTINCT coalesce(lang, '') AS lang FROM documents)""")
def a08_delimiters(spark, sf):
    """A file for each language, its fields parted as the language's first letter has it; every delimiter also stands
    inside quotes, in the header and in texts."""
    from ..scratch import new_path

    path = new_path(spark, "delimiters")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.coalesce("lang", F.lit("")))
    mark = F.element_at(F.array(*[F.lit(d) for d in delimited.DELIMITERS]), F.ascii(F.concat("lang", F.lit("x"))) % 3 + 1)
    body = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", ";"), '"', '""'), F.lit('"'))
    folder = F.concat(F.lit("K"), F.col("lang")).alias("folder")
    rows = docs.select(folder, F.lit(1).alias("nth"), "lang", "doc_id", "source", "text")
    heads = docs.select("lang").distinct().select(folder, F.lit(0).alias("nth"), "lang")
    dealt = _in_parts(docs, heads.unionByName(rows, allowMissingColumns=True), "folder", "nth", "doc_id")  # lines are made behind it, once
    head = F.concat(F.lit('"a,b;c;d\t,;\t"'), mark, F.lit("source"), mark, F.lit("text"))
    line = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), mark, F.coalesce("source", F.lit("")), mark, body)
    written = dealt.withColumn("value", F.when(F.col("nth") == 0, head).otherwise(line))
    written.select("folder", "value").write.partitionBy("folder").text(path)
    return delimited.detect_delimiter(spark, [path], parts=True).select(F.regexp_extract("file", "folder=K([^/]*)/", 1).alias("lang"), "delimiter")
