"""Operator 12 against a plain version over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    beside = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, str(form[w]), root, n, len(beside[w]), str(words.get(form[w]))))
    return sorted(out)


def got(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in df.collect())


def made():
    r = np.random.default_rng(8)
    letters = [*"abcxyz", "é", "ÿ", "×", "À"]
    base = ["".join(r.choice(letters, int(r.integers(7, 12)))) for _ in range(30)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab", "bababab"]
    texts = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = base[min(int(r.exponential(6)), len(base) - 1)]
            if r.random() < 0.4:
                k, c = int(r.integers(len(w) + 1)), str(r.choice(letters))
                w = [w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]][int(r.integers(3))]
            words.append(w.upper() if w.isascii() and r.random() < 0.2 else w)
        texts.append((i, " ".join(words)))
    long = "abcde" * 30
    texts += [(500, f"{long} {long} {long}x {long}x"), (501, "x" * 5000 + " " + "x" * 5000), (502, None), (503, ""), (504, "short ones"), (None, texts[0][1]), (505, "manifest̀ manifest's"), (0, texts[0][1])]
    # a chain of forms
    texts += [(600 + i, " ".join(["chainone"] * 400 + ["chainonx"] * 40 + ["chainoyx"] * 4)) for i in range(3)]
    return texts


@pytest.mark.parametrize("filter_bytes,words", [(32 << 20, 20_000), (200, 7)])
def test_against_all_pairs(spark, monkeypatch, filter_bytes, words):
    for name, value in {"FILTER_BYTES": filter_bytes, "WORDS": words, "PROBES": words * 50}.items():
        monkeypatch.setattr(spelling, name, value)
    if filter_bytes == 200:
        monkeypatch.setattr(spelling, "COUNTS", 20)
    rows = made()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = plain(rows)
    assert got(spelling.spelling_forms(df)) == want
    assert sum(w[1] != "None" for w in want) > 20 and any(w[2] != w[1] != "None" for w in want)


def test_edits_are_those_of_near_words():
    words = ["ÿbcdefg", "aabbccd"]
    found = {(words[i], e) for i, e in spelling.edits(words, lambda length, h: np.arange(len(h)))}
    assert found == {(w, e) for w, e in found if near(w, e)} and len(found) == sum(len(set(w[:k] + w[k + 1 :] for k in range(7))) for w in words) + sum(sum(int(a) < ord(c) for a in spelling.ALPHABET) for w in words for c in w)


def test_an_edit_has_the_hash_of_its_word():
    words, asked = ["abcdefgh", "éézzyyxx"], []
    found = spelling.edits(words, lambda length, h: asked.append((length, h)) or np.arange(len(h)))
    by_length = {n: np.concatenate([h for k, h in asked if k == n]) for n in (7, 8)}
    for n, h in by_length.items():
        assert h.tolist() == spelling.hashes([e for _, e in found if len(e) == n]).tolist()


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert spelling.spelling_forms(df).count() == 0
    assert spelling.spelling_forms(df.filter("doc_id > 5")).count() == 0
