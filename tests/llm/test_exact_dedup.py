"""Operator 11 against a plain grouping."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyframe.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, digest int, run int"


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, members in groups.items():
        first, *rest = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(str(first[0]), str(first[0]), len(members), True, sha)] + [(str(r[0]), str(first[0]), len(members), False, sha) for r in rest]
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def made():
    r = np.random.default_rng(4)
    texts = [None, "", " \t\n\x0b\x0c\r", "\xa0", "\x85", "a b", "ab", "a  b", "é", "é", "😀 x", "😀x", "x" * 200_000, "x" * 200_000 + " "]
    rows = [(i, texts[int(r.integers(len(texts)))]) for i in range(400)] + [(1000 + i, "hot" + " " * (i % 3)) for i in range(300)]
    rows += [(5, "a b"), (5, "a b"), (None, "a b"), (None, None), (None, "only"), (None, "only")] + [(2000 + i, f"own {i}") for i in range(300)]
    return [(*rows[i], "x", 1, 2) for i in r.permutation(len(rows))]


@pytest.mark.parametrize("runs,bits", [(1, 4), (8, 1), (32, 4)])
def test_against_a_plain_grouping(spark, monkeypatch, runs, bits):
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(11)
    assert got(exact_dedup.duplicates(df, runs=runs)) == plain(rows)


def test_equal_digests_of_unlike_texts_stay_apart(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.lit(-7).cast("long"))
    assert got(exact_dedup.duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), runs=4)) == plain(rows)


def test_copies_go_and_columns_stay(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted((str(r["doc_id"]), r["kept"], r["run"]) for r in kept.collect()) == sorted((r[0], "x", 2) for r in plain(made()) if r[3])
    assert exact_dedup.duplicates(df.filter("doc_id < 0")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    exact_dedup.duplicates(spark.createDataFrame(made(), SCHEMA).select("doc_id", "text")).explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")
