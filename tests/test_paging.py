"""Pages of kept results, and texts of keys."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import paging
from tallyframe.sources import delimited


def test_pages_are_those_of_the_whole_order(spark):
    rows = [((k * 7919) % 1009, f"t{k % 13}") for k in range(1009)]
    kept = paging.paged(spark.createDataFrame(rows, "n long, t string").repartition(5), ["n"], parts=7)
    want = sorted(rows)
    assert kept.total == 1009
    for offset, limit in ((0, 10), (140, 30), (0, 5000), (600, 500), (1000, 50), (1009, 5), (5000, 5), (-3, 2), (7, 0)):
        at = max(0, offset)
        assert [tuple(r) for r in kept.page(offset, limit).collect()] == want[at : at + min(limit, 500)]
    hits, found = kept.where(F.col("t") == "t5"), [r for r in want if r[1] == "t5"]
    assert hits.total == len(found) and [tuple(r) for r in hits.page(11, 40).collect()] == found[11:51]
    assert hits.where(F.col("n") < 0).total == 0 and hits.where(F.col("n") < 0).page(0, 5).count() == 0


def test_a_page_reads_one_or_two_parts(spark):
    kept = paging.paged(spark.range(40_000).select("id", F.repeat(F.lit("x"), 50).alias("t")), ["id"], parts=20)
    for offset in (0, 19_900):
        got = kept.page(offset, 500)
        rows = got.collect()
        assert [r["id"] for r in rows] == list(range(offset, offset + 500))
        scan = got._jdf.queryExecution().executedPlan().toString()
        kept_parts = re.search(r"PartitionFilters: \[[^\]]*__part#\d+L? (?:= \d+|IN \(([\d,]+)\))", scan)
        assert kept_parts and (kept_parts[1] or "").count(",") < 2


@pytest.mark.parametrize("value", ["plain", "\x1f", "\x0b\x0c\x1a", "a\\u001F", "\\\x1f", "\\\\\x0e", "é \x7f", '"\n\t\r\b\x0f'])
def test_keys_are_written_as_json(spark, value):
    df = spark.createDataFrame([(value, "x\x1c")], "a string, b string")
    got = df.select(text.encode_key(F.array("a", "b"))).first()[0]
    assert got == json.dumps([value, "x\x1c"], ensure_ascii=False, separators=(",", ":"))


@pytest.mark.parametrize("width", [1, 511, 512, 513])
def test_headers_of_any_width(spark, tmp_path, width):
    p = tmp_path / "w.csv"
    p.write_text(",".join(f"n{i}" for i in range(width)) + "\n" + ",".join(str(i) for i in range(width)) + "\n")
    rows, _, issues = delimited.read_table(spark, str(p), delimiter=",")
    assert rows.columns[:width] == [f"n{i}" for i in range(width)] and issues.count() == 0 and rows.count() == 1


def test_scratch_tables_go_with_what_reads_them(spark, tmp_path, monkeypatch):
    from tallyframe import scratch
    from tallyframe.operators.numbering import numbered

    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = numbered(spark.range(50).withColumn("w", F.col("id") % 5), [], [-F.col("id")], "n", "w")
    rows = {r["id"]: (r["n"], r["before"]) for r in got.collect()}
    assert rows == {49 - k: (k + 1, sum((49 - j) % 5 for j in range(k))) for k in range(50)}
    scratch.discard(got)
    assert not list(tmp_path.iterdir())
