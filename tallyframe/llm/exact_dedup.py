"""Operator 11 (native): exact duplicates by a tree-merge of sorted digest runs. DataFrame functions only.

A run is a sorted list of digests, one row for each different text, with its count and its best row. There are 2^m runs,
one in each partition. Runs merge in binomial rounds: in a round, the partitions whose numbers differ in the same few
bits (four: 16 runs) exchange what they have. Each keeps one range of digests and merges 16 sorted pieces of it, so after
the last round a partition has one range of all digests and no run is ever whole in one task. Two rows merge only if their
texts are verified to be equal, by SHA-256 and by length behind the 64-bit digest that orders a run, and the better one's
identifier stays: at most 16 rows of one text meet in any merge, however many copies it has.

What a text's group has come to is told to the runs that hold it and by these to their own rows, never to all copies of a
text in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

WHITE = r"[\x20\x09-\x0D]+"
BITS = 4  # of a partition's number that one round exchanges: 16 runs meet
_TEXT = ["digest", "sha", "letters"]  # a text: place in a run, and what verifies it


def _leaves(docs: DataFrame, key: str, text: str, columns: list[str], width: int) -> DataFrame:
    """One row per document without its text, in the run of its input partition; written once, so that runs and rows keep
    their numbers whatever is recomputed."""
    kept = [F.col(c).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *kept)
    rows = rows.select("*", F.regexp_replace("text", WHITE, "").alias("norm"))
    rows = rows.select(
        (F.spark_partition_id() % (1 << width)).alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("norm").alias("digest"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").alias("letters"),
        F.length("text").alias("chars"),
        "doc_id",
        *[f"x{i}" for i in range(len(columns))],
    )
    return materialize(rows, "digests")


def _merged(rows: DataFrame, at, width: int) -> DataFrame:
    """Rows (texts with best and n) sent to the partitions `at` names; each merges its sorted pieces."""
    sent = rows.withColumn("at", at).repartitionById(1 << width, "at")
    return sent.groupBy("at", *_TEXT).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, runs: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, then `columns` of docs.

    Texts are equal when identical without ASCII white space; a null text counts as empty, so null, empty and blank texts
    are one group. The row with the most code points in its own text stays, then the one with the least key (null last),
    then, of repeated rows, one: each group has exactly one row with kept. `runs` is rounded up to a power of two; the
    session's shuffle partitions by default.
    """
    columns, width = columns or [], max((runs or spread(docs)) - 1, 0).bit_length()
    leaves = _leaves(docs, key, text, columns, width)
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = _merged(leaves.select("run", *_TEXT, best.alias("best"), F.lit(1).cast("long").alias("n")), F.col("run"), width)
    own = materialize(own, "runs")
    rows, done = own, 0
    while done < width:
        done = min(done + BITS, width)
        # partitions that agree in the bits above exchange; the leading bits of the digest say which of them keeps a row
        at = F.shiftleft(F.shiftright("at", done), done) + F.shiftrightunsigned("digest", 64 - done).cast("int")
        rows = _merged(rows, at, width)
    several = rows.filter("n > 1").select(*_TEXT, "best", "n")
    told = own.select(F.col("at").alias("run"), *_TEXT).join(several, _TEXT)
    out = leaves.join(told, ["run", *_TEXT], "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best")["doc_id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best")["row"], F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)],
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that `duplicates` does not keep."""
    got = duplicates(docs, key, text, docs.columns)
    own = len(got.columns) - len(docs.columns)
    got = got.toDF(*[f"y{i}" for i in range(len(got.columns))])  # a column of docs may have the name of a new one
    return got.filter("y3").select(*[F.col(f"y{own + i}").alias(c) for i, c in enumerate(docs.columns)])
