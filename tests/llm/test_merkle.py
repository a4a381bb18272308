"""Operator 13 against a plain tree that is built whole."""

import hashlib
import zlib

import numpy as np
import pytest

from tallyframe.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def climb(nodes):
    """The root over nodes, and each node's siblings by level as (before, after)."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 8
            sides[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 8])))
        nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], sides


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for lang in langs]
    climbed = [climb([leaf_of(r) for r in g]) for g in groups]
    root, upper = climb([c[0] for c in climbed])
    out = []
    for group, (subroot, sides), above in zip(groups, climbed, upper):
        for r, own in zip(group, sides):
            path, now = own + above, dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                now["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            folded = leaf_of(now)
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((str(r["doc_id"]), leaf_of(r), subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def made(sizes):
    r, rows = np.random.default_rng(3), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = [None, "", "ÀB c", "plain", "UPPER"][int(r.integers(5))]
            rows.append((int(r.integers(1, 10**6)), None if r.random() < 0.2 else "s", lang, int(r.integers(9)), text, "clash", 1))
    return [rows[i] for i in r.permutation(len(rows))]


SEVERAL = {None: 1, "": 8, "de": 64, "en": 700, "fr": 65, "é": 2, "z": 73, "a": 1, "b": 1, "c": 1}


@pytest.mark.parametrize("levels,sizes", [(0, {"en": 9, "fr": 1}), (1, SEVERAL), (3, SEVERAL), (1, {"en": 577}), (3, {"en": 577}), (3, {"en": 1})])
def test_against_a_plain_tree(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = made(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(merkle.tampered_manifest(df, FIELDS)) == plain([dict(zip(FIELDS, r)) for r in rows])


def test_repeated_rows_null_keys_long_texts_and_no_rows(spark):
    rows = [(None, None, None, None, None, None, None)] * 2 + [(7, "s", "en", 1, "A" * 300_000, "x", 1)] * 3 + [(8, "s", "en", 1, "same", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle.tampered_manifest(df, FIELDS)) == plain([dict(zip(FIELDS, r)) for r in rows])
    assert merkle.tampered_manifest(df.filter("doc_id < 0"), FIELDS).count() == 0


def test_proofs_can_be_kept(spark):
    df = spark.createDataFrame(made({"en": 20, "fr": 3}), SCHEMA)
    for r in merkle.manifest(df, FIELDS, proofs=True).collect():
        assert r["verified"] and sha(r["proof"]) == r["proof_sha256"]
