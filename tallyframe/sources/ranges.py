"""Delimited files read by byte ranges (A1, A4-A7, A9): a large quoted file takes as many tasks as it has ranges.

Spark's text reader cuts a file into ranges of whole lines. Whether a line stands inside a quoted field depends on all lines
before it, but only in one bit: each range is summed up for both cases (how it ends, how many records begin in it), the
sums of a file's ranges are walked once, and then every range is read from its true start and with its true record number.
Only the pieces of records that cross from one range into another are shuffled.

Lines end with a line feed or carriage return and line feed. A quote opens a field only at the field's start, and stands
for itself inside other text, as RFC 4180 readers have it.

With `parts` a folder is one file: the files in it, each of which ends with a line feed, are its text in the order of their
names, as Spark writes a table in order. Records may cross parts. Its name is the folder's, with a slash at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sha256
from ..scratch import discard, materialize, new_path, reading
from . import delimited

#: Ranges that the second reading may know of, a few tens of bytes each.
MOST_RANGES = 2_000_000
BOM = "﻿"


def _name(path: Column, parts: bool) -> Column:
    return F.regexp_replace(path, r"[^/]*\z", "") if parts else path


def _lines(spark: SparkSession, paths: list[str], *more, parts: bool = False) -> DataFrame:
    """(file, block, value, ...) of every line, in order within a block (the place in its file where a range begins)."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if not parts:
        return raw.select(F.xxhash64(path).alias("file"), block.alias("block"), "value", *more)
    held = raw.select(F.xxhash64(path).alias("part"), block.alias("at_part"), "value", *more)
    whole = _parts(spark, paths, True).select(F.xxhash64("path").alias("part"), F.xxhash64("file").alias("file"), "start")
    return held.join(F.broadcast(whole), "part").select("file", (F.col("at_part") + F.col("start")).alias("block"), *[c for c in held.columns if c not in ("part", "at_part")])


def _parts(spark: SparkSession, paths: list[str], parts: bool) -> DataFrame:
    """(path, file, length, start) of every file that is there, without reading any, and where it begins in its whole."""
    one = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "length")
    one = one.withColumn("file", _name(F.col("path"), parts))
    earlier = Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("start", F.coalesce(F.sum("length").over(earlier), F.lit(0)))


def _files(spark: SparkSession, paths: list[str], parts: bool = False) -> DataFrame:
    """(id, file, length) of every file, without reading any. Spark's readers leave out files of no bytes."""
    return _parts(spark, paths, parts).groupBy("file").agg(F.sum("length").alias("length")).select(F.xxhash64("file").alias("id"), "file", "length")


def inside_after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is still open after a line that begins inside one, or not."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):  # a field without quotes: on to the next
                at = line.find(delimiter, at) + 1
                if at == 0:
                    return False
                continue
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            break
        inside, at = False, line.find(delimiter, at + 1) + 1
        if at == 0 or at > n:
            return False


def _blocks(batches):
    """(file, block, lines) in pieces of a batch, in order."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(i).to_numpy() for i in range(2))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            lines = batch.column(2).slice(a, b - a).to_pylist()
            if block[a] == 0 and lines and lines[0].startswith(BOM):
                lines[0] = lines[0][1:]
            yield int(file[a]), int(block[a]), lines


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _summed(delimiter: str):
    """For each range, for a start outside and inside a quoted field: whether its end is inside, and records that begin."""

    def work(batches):
        import pyarrow as pa

        out, at = [], None
        for file, block, lines in _blocks(batches):
            if at != (file, block):
                out.append([file, block, False, 0, True, 0])
                at = (file, block)
            row = out[-1]
            for line in lines:
                for k in (2, 4):
                    if not row[k] and not _blank(line):
                        row[k + 1] += 1
                    row[k] = inside_after(line, row[k], delimiter)
        names = ["file", "block", "out_open", "out_records", "in_open", "in_records"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return work


def _walked(rows):
    """One file's ranges in order: how each begins, and how many records begin before it."""
    rows = rows.sort_values("block", ignore_index=True)
    inside, before, starts, counts = False, 0, [], []
    for r in rows.itertuples():
        starts.append(inside)
        counts.append(before)
        before += r.in_records if inside else r.out_records
        inside = r.in_open if inside else r.out_open
    rows["inside"], rows["before"], rows["total"], rows["open"] = starts, counts, before, inside
    return rows[["file", "block", "inside", "before", "total", "open"]]


def _cut(delimiter: str, starts):
    """(file, record, block, text, piece) of records: whole ones, and pieces of those that cross ranges."""

    def work(batches):
        import pyarrow as pa

        known = starts.value
        names = ["file", "record", "block", "text", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        out, at = [], None

        def flush():
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        held, inside, number, first = [], False, 0, False
        for file, block, lines in _blocks(batches):
            if at != (file, block):
                if held:
                    out.append((*at[:1], number, at[1], "\n".join(held), True))
                at, held = (file, block), []
                inside, number = known[file, block]
                first = inside  # the range begins in the middle of a record
            for line in lines:
                if not inside and not held:
                    if _blank(line):
                        continue
                    number += 1
                held.append(line)
                inside = inside_after(line, inside, delimiter)
                if not inside:
                    out.append((file, number, block, "\n".join(held), first))
                    held, first = [], False
            if len(out) >= 5_000:
                yield flush()
        if held:
            out.append((at[0], number, at[1], "\n".join(held), True))
        yield flush()

    return work


def record_texts(spark: SparkSession, paths: list[str], delimiter: str = ",", parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, files): (file, record, text) of every non-blank record, numbered from 1, and (file, records, open) of every
    file; open tells that its last record has a quote that is never closed."""
    lines, files = _lines(spark, paths, parts=parts), _files(spark, paths, parts)
    sums = lines.mapInArrow(_summed(delimiter), "file long, block long, out_open boolean, out_records long, in_open boolean, in_records long")
    walked = materialize(sums.groupBy("file").applyInPandas(_walked, "file long, block long, inside boolean, before long, total long, open boolean"), "ranges")
    starts = walked.limit(MOST_RANGES + 1).select("file", "block", "inside", "before").collect()
    if len(starts) > MOST_RANGES:
        raise ValueError("too many ranges: raise spark.sql.files.maxPartitionBytes")
    shared = spark.sparkContext.broadcast({(r[0], r[1]): (r[2], r[3]) for r in starts})
    cut = lines.mapInArrow(_cut(delimiter, shared), "file long, record long, block long, text string, piece boolean")
    crossing = cut.filter("piece").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    texts = cut.filter("not piece").select("file", "record", "text").unionByName(crossing)
    counted = walked.groupBy("file").agg(F.max("total").alias("records"), F.bool_or("open").alias("open")).withColumnRenamed("file", "id")
    named = files.join(counted, "id", "left").select("id", "file", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("open", F.lit(False)).alias("open"))
    # of files there are fewer than ranges; joined by shuffle, a file's texts would be one task's
    texts = texts.withColumnRenamed("file", "id").join(F.broadcast(named.select("id", "file")), "id").select("file", "record", F.regexp_replace("text", r"\r\z", "").alias("text"))
    return reading(texts, walked), reading(named.drop("id"), walked)


def records(spark: SparkSession, paths: list[str], width: int, delimiter: str = ",", parts: bool = False) -> DataFrame:
    """(file, record, c0.., _bad) as delimited.records() gives them, by ranges; a quote that is never closed is bad too."""
    texts, files = record_texts(spark, paths, delimiter, parts)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField("_bad", T.StringType())])
    parsed = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1", "maxColumns": str(max(width + 1, 20480))})
    unclosed = files.filter("open").select("file", F.col("records").alias("record"), F.lit(True).alias("unclosed"))
    rows = texts.join(F.broadcast(unclosed), ["file", "record"], "left").withColumn("r", parsed)
    bad = F.when(F.col("unclosed"), F.col("text")).otherwise(F.col("r._bad"))
    out = rows.select("file", "record", *[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(f"c{i}") for i in range(width)], bad.alias("_bad"))
    return reading(out, texts)


def zoned(rows: DataFrame, files: DataFrame, layout: delimited.Layout) -> DataFrame:
    """rows with zone and record_number as delimited.zoned() gives them; files (file, records) says how long each is."""
    h, first = layout.header_record, layout.header_record + layout.skip_leading
    out = rows.join(F.broadcast(files.select("file", "records")), "file")
    zone = F.when(F.col("record") < h, "before").when(F.col("record") == h, "header").when(F.col("record") <= first, "after").when(F.col("record") > F.col("records") - layout.skip_trailing, "end").otherwise("data")
    out = out.withColumn("zone", zone).drop("records")
    return out.withColumn("record_number", F.when(F.col("zone") == "data", (F.col("record") - first).cast("long")))


def header(spark: SparkSession, texts: DataFrame, record: int, delimiter: str) -> DataFrame:
    """(file, place, name) of each file's header record, of any number of columns."""

    def names(frames):
        import csv
        import sys

        csv.field_size_limit(sys.maxsize)
        for frame in frames:
            frame["names"] = [[n.strip() for n in next(csv.reader([t], delimiter=delimiter))] for t in frame["text"]]
            yield frame[["file", "names"]]

    heads = texts.filter(F.col("record") == record).select("file", "text").mapInPandas(names, "file string, names array<string>")
    return heads.select("file", F.posexplode("names").alias("place", "name"))


def encoding(spark: SparkSession, paths: list[str], parts: bool = False) -> DataFrame:
    """(file, is_utf8): a line feed is never part of a longer character, so a file is valid if each of its lines is."""
    valid = _lines(spark, paths, parts=parts).groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).withColumnRenamed("file", "id")
    return _files(spark, paths, parts).join(valid, "id", "left").select("file", F.coalesce("ok", F.lit(True)).alias("is_utf8"))


#: A file is hashed by pieces of so many bytes (and what a range has more), each by a task of its own.
PIECE = 1 << 27


def _hashed(begun: dict | None):
    """(id, fingerprint, state, size) of each file's lines in order: the hash if its end is reached, else where the chain has
    come to. begun: where it had come to before these lines; None if they are whole files."""

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        at, chain, size, out = None, None, 0, []
        for batch in batches:
            file = batch.column(0).to_numpy()
            cuts = np.flatnonzero(file[1:] != file[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                if file[a] != at:
                    if at is not None:
                        out.append((at, None, chain.state, size))
                    at = int(file[a])
                    state, size = (begun or {}).get(at, (None, 0))
                    chain = hashlib.sha256() if begun is None else sha256.Chain(state)
                values = batch.column(2).slice(a, b - a).to_pylist()
                ended = values[-1] is None
                values = values[:-1] if ended else values
                if values:
                    chain.update(b"\n".join([b"", *values] if size else values))
                    size += sum(map(len, values)) + len(values)
                if ended:  # its length tells whether the last line had a line feed
                    if size and size != batch.column(3)[b - 1].as_py() + 1:
                        chain.update(b"\n")
                    out.append((at, chain.hexdigest(), None, size))
                    at = None
        if at is not None:
            out.append((at, None, chain.state, size))
        kinds = {"id": pa.int64(), "fingerprint": pa.string(), "state": pa.binary(), "size": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())], names=[*kinds])

    return work


def fingerprints(spark: SparkSession, paths: list[str], parts: bool = False, piece: int = PIECE) -> DataFrame:
    """(file, fingerprint, is_utf8) of files of any length, as delimited.fingerprints() gives them.

    SHA-256 is a chain: the pieces of a file are hashed one after the other, each by a task that begins where the one before
    has come to, those of one place of all files side by side. The states of files longer than a piece, of 112 bytes each,
    go through the driver. Where the C library keeps its states to itself, a file is one piece.
    """
    piece, resumed = (piece, True) if sha256.resumes() else (1 << 62, False)
    files, folder = materialize(_files(spark, paths, parts), "files"), new_path(spark, "pieces")
    place = lambda c: F.floor(c / F.lit(piece)).cast("long").alias("place")
    lines = _lines(spark, paths, F.monotonically_increasing_id().alias("at"), parts=parts)
    lines.select("file", "block", F.col("value").cast("binary").alias("value"), "at", place(F.col("block"))).write.partitionBy("place").parquet(folder)
    written = spark.read.schema("file long, block long, value binary, at long, place long").parquet(folder)
    written.scratch_path = folder
    ends = files.select(F.col("id").alias("file"), F.lit(1 << 62).alias("block"), F.lit(None).cast("binary").alias("value"), F.col("length").alias("at"), place(F.greatest(F.col("length") - 1, F.lit(0))))
    tasks, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), "id long, fingerprint string, state binary, size long"

    def hashed(k: int, begun: dict | None) -> DataFrame:
        held = written.unionByName(ends).filter(F.col("place") == k).repartition(tasks, "file").sortWithinPartitions("file", "block", "at")
        return held.select("file", "block", "value", "at").mapInArrow(_hashed(begun), kind)

    first = materialize(hashed(0, {} if resumed else None), "hashed")
    told, states = [], {r["id"]: (bytes(r["state"]), r["size"]) for r in first.filter("state IS NOT NULL").collect()}
    longest = files.agg(F.max("length")).first()[0] or 0
    for k in range(1, (longest - 1) // piece + 1):
        for r in hashed(k, states).collect():
            if r["state"] is None:
                told.append((r["id"], r["fingerprint"]))
                del states[r["id"]]
            else:
                states[r["id"]] = (bytes(r["state"]), r["size"])
    discard(written)
    found = first.filter("state IS NULL").select("id", "fingerprint").unionByName(spark.createDataFrame(told, "id long, fingerprint string"))
    out = files.join(found, "id").join(encoding(spark, paths, parts), "file").select("file", "fingerprint", "is_utf8")
    return reading(out, files, first)


def read_table(spark: SparkSession, path: str, layout: delimited.Layout = delimited.Layout(), delimiter: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the file's own columns and record_number, skipped records with their raw text, issues) of one file, as
    delimited.read_table() gives them, but by ranges and for any number of columns."""
    if delimiter is None:
        found = delimited.detect_delimiter(spark, [path], layout.header_record).first()
        delimiter = found["delimiter"] if found else ","
    texts, files = record_texts(spark, [path], delimiter)
    heads = header(spark, texts, layout.header_record, delimiter)
    names = [r["name"] for r in heads.orderBy("place").collect()]
    if not names:
        raise ValueError(f"{path}: no header record")
    rows = zoned(records(spark, [path], len(names), delimiter), files, layout)
    said = lambda df: df.select(F.lit(None).cast("long").alias("record_number"), "message", F.lit(None).cast("string").alias("raw"))
    broken = encoding(spark, [path]).filter("not is_utf8").select(F.lit("not valid UTF-8").alias("message"))
    issues = delimited.record_issues(rows).select("record_number", "message", "raw").unionByName(said(broken)).unionByName(said(delimited.header_issues(heads)))
    raw = delimited.skipped(zoned(texts, files, layout)).select("file", "record", "zone", F.col("text").alias("raw"))
    data = rows.filter("zone = 'data'")
    if len(set(names)) == len(names) and all(names):
        data = data.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "record_number", "file")
    return data, raw, issues
