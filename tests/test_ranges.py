"""Delimited files by ranges: against Python's reader and the reader of whole files, with cuts in every place."""

import csv
import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.sources import delimited, ranges


@pytest.fixture
def cut(spark):
    """Sets how long ranges are."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


def made(seed, n, ends="\n"):
    """A file's text: quoted fields with delimiters, quotes and line ends, blank lines, and quotes inside plain fields."""
    r = np.random.default_rng(seed)
    bits = ["a", "é", ",", '""', "\n", "\n\n", ends, "long " * 9, ";", "x"]
    lines = []
    for k in range(n):
        if r.random() < 0.1:
            lines.append("")
        quoted = ['"' + "".join(str(r.choice(bits)) for _ in range(int(r.integers(0, 8)))) + '"' for _ in range(2)]
        plain = [str(k), 'in"side', ""]
        row = [str(r.choice(plain)), *quoted, str(k)]
        lines.append(",".join(row[int(i)] for i in r.permutation(3)) + "," + row[3])
    return ends.join(lines) + (ends if r.random() < 0.5 else "")


@pytest.mark.parametrize("size,ends", [(40, "\n"), (150, "\r\n"), (10**6, "\n")])
def test_records_at_any_cut(spark, cut, tmp_path, size, ends):
    text = made(3, 16, ends)
    p = tmp_path / "t.csv"
    p.write_bytes(("﻿" + text).encode())
    cut(size)
    want = [tuple(row) for row in csv.reader(io.StringIO(text, newline="")) if row]
    found = ranges.records(spark, [str(p)], 4).collect()
    assert [tuple(r[f"c{i}"] for i in range(4)) for r in sorted(found, key=lambda r: r["record"])] == want
    assert sorted(r["record"] for r in found) == list(range(1, len(want) + 1))
    if size == 40:
        assert ranges._lines(spark, [str(p)]).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("seed", range(30))
def test_pieces_at_every_line(seed):
    """The two readings alone, with a range for each few lines."""
    text = made(seed, 25)
    lines = text.split("\n")[: -1 if text.endswith("\n") else None]
    r = np.random.default_rng(seed)
    block = np.cumsum(r.random(len(lines)) < [1.0, 0.5, 0.1][seed % 3])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(b - a, 9)), pa.array(block[a:b] + 1), pa.array(lines[a:b])], names=["file", "block", "value"]) for a, b in ((k, min(k + 7, len(lines))) for k in range(0, len(lines), 7))]
    sums = pa.Table.from_batches(ranges._summed(",")(batches)).to_pandas()
    walked = ranges._walked(sums)
    starts = type("Shared", (), {"value": {(9, x.block): (x.inside, x.before) for x in walked.itertuples()}})
    rows = pa.Table.from_batches(ranges._cut(",", starts)(batches)).to_pylist()
    found = {}
    for row in sorted(rows, key=lambda x: x["block"]):
        assert row["piece"] or row["record"] not in found
        found.setdefault(row["record"], []).append(row["text"])
    want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    assert [next(csv.reader(io.StringIO("\n".join(found[k]), newline=""))) for k in sorted(found)] == want
    assert sorted(found) == list(range(1, len(want) + 1)) and not walked["open"].any() and set(walked["total"]) == {len(want)}


def test_same_as_the_reader_of_whole_files(spark, cut, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text(made(10 + k, 15) + '\n1,2\n1,2,3,4,5\n"a",b,c,d\n')
    cut(150)
    rows = lambda df: sorted((r["file"].split("/")[-1], r["record"], *(r[f"c{i}"] for i in range(4)), r["_bad"]) for r in df.collect() if r["_bad"] is None)
    bad = lambda df: sorted((r["file"].split("/")[-1], r["record"], r["_bad"]) for r in df.collect() if r["_bad"] is not None)
    paths = [str(tmp_path / f"{k}.csv") for k in range(2)]
    a, b = ranges.records(spark, paths, 4), delimited.records(spark, paths, 4)
    assert rows(a) == rows(b) and bad(a) == bad(b) and len(bad(a)) == 4


@pytest.mark.parametrize("line,delimiter", [("", ","), ('"', ","), ('a"b', ","), ('a,"b', ","), ('a","b', ","), ('"a""b', ","), ('"a"";"b', ";"), ('"a"x,"b', ","), ('""', ","), ('"""', ","), ("a;b", ";"), ('x,"y",', ",")])
def test_open_fields_against_a_walk_by_characters(line, delimiter):
    def walk(inside):
        start, closed, k = not inside, False, 0
        while k < len(line):
            c = line[k]
            if inside:
                if c == '"' and line[k + 1 : k + 2] == '"':
                    k += 1
                elif c == '"':
                    inside, closed = False, True
            elif c == delimiter:
                start = True
                k += 1
                continue
            elif c == '"' and start and not closed:
                inside = True
            start = closed = False
            k += 1
        return inside

    for inside in (False, True):
        assert ranges.inside_after(line, inside, delimiter) == walk(inside)


def test_layout_wide_headers_unclosed_quotes_and_bad_bytes(spark, cut, tmp_path):
    cut(3000)
    p = tmp_path / "wide.csv"
    p.write_text("Bank,x\n" + ",".join(f"n{i}" for i in range(512)) + "\nskip\n" + "\n".join(",".join(f"{k}-{i}" for i in range(512)) for k in range(5)) + "\ntotal\n")
    rows, skipped, issues = ranges.read_table(spark, str(p), delimited.Layout(2, 1, 1), ",")
    assert rows.columns[:512] == [f"n{i}" for i in range(512)] and issues.count() == 0
    assert sorted((r["record_number"], r["n511"]) for r in rows.collect()) == [(k + 1, f"{k}-511") for k in range(5)]
    assert sorted((r["zone"], r["raw"]) for r in skipped.collect()) == [("after", "skip"), ("before", "Bank,x"), ("end", "total")]
    q = tmp_path / "open.csv"
    q.write_text('a,b\n1,2\n3,"never\nclosed\n')
    _, _, issues = ranges.read_table(spark, str(q), delimiter=",")
    assert [(r["record_number"], r["raw"]) for r in issues.collect()] == [(2, '3,"never\nclosed')]
    for k in range(5):  # a broken byte at and around every cut
        z = tmp_path / f"z{k}.csv"
        z.write_bytes(b"a,b\n" + b"x" * k + "é\n".encode() + b"y" * (5 - k) + b"\xc3\n")
    cut(4)
    assert ranges.encoding(spark, [str(tmp_path / f"z{k}.csv") for k in range(5)]).filter("is_utf8").count() == 0


def test_fingerprints_are_those_of_the_bytes(spark, cut, tmp_path):
    files = {"b": b"\n", "c": b"x", "d": b"x\n", "e": b"\n\n", "f": b"a\r\n\xff\n" * 90 + b"tail", "g": "é\n".encode() * 99}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    cut(100)
    found = {r["file"].split("/")[-1]: (r["fingerprint"], r["is_utf8"]) for r in ranges.fingerprints(spark, [str(tmp_path / n) for n in files]).collect()}
    assert found == {n: (hashlib.sha256(data).hexdigest(), n != "f") for n, data in files.items()}


@pytest.mark.parametrize("resumed", [True, False])
def test_fingerprints_of_files_hashed_in_pieces(spark, cut, tmp_path, monkeypatch, resumed):
    from tallyframe.functions import sha256

    files = {"b": b"\n", "c": b"x" * 700 + b"\n\n", "d": b"a\r\n\xff\n" * 190 + b"tail", "e": "é,\n".encode() * 299, "f": b"y\n" * 50 + b"z" * 1500 + b"\n", "g": b"\n" * 400}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    cut(100)
    held, seen = ranges._hashed, []
    monkeypatch.setattr(ranges, "_hashed", lambda begun: seen.append(begun) or held(begun))
    if resumed:
        assert sha256.resumes()
    else:
        monkeypatch.setattr(sha256, "resumes", lambda: False)
    found = {r["file"].split("/")[-1]: r["fingerprint"] for r in ranges.fingerprints(spark, [str(tmp_path / n) for n in files], piece=256).collect()}
    assert found == {n: hashlib.sha256(data).hexdigest() for n, data in files.items()}
    assert len(seen) == (7 if resumed else 1)


def in_parts(tmp_path, text, lines):
    """A folder for each file, its text dealt to parts of some lines."""
    rows = text.splitlines(keepends=True)
    for k in range(0, len(rows), lines):
        for name in ("b", "a"):
            (tmp_path / f"n={name}").mkdir(exist_ok=True)
            (tmp_path / f"n={name}" / f"part-{k:05d}").write_text("".join(rows[k : k + lines] if name == "a" else rows[: k + lines][-lines:]), newline="")


@pytest.mark.parametrize("lines,size", [(1, 30), (4, 10**6), (9, 60)])
def test_a_folder_of_parts_is_one_file(spark, cut, tmp_path, lines, size):
    text = made(5, 40)
    text += "" if text.endswith("\n") else "\n"
    in_parts(tmp_path, text, lines)
    cut(size)
    want = [tuple(row) for row in csv.reader(io.StringIO(text, newline="")) if row]
    found = ranges.records(spark, [str(tmp_path)], 4, parts=True).filter("file like '%/n=a/'").collect()
    assert [tuple(r[f"c{i}"] for i in range(4)) for r in sorted(found, key=lambda r: r["record"])] == want
    assert sorted(r["record"] for r in found) == list(range(1, len(want) + 1))
    whole = {f"n={n}": hashlib.sha256(b"".join(p.read_bytes() for p in sorted((tmp_path / f"n={n}").iterdir()))).hexdigest() for n in "ab"}
    assert {r["file"].split("/")[-2]: r["fingerprint"] for r in ranges.fingerprints(spark, [str(tmp_path)], parts=True, piece=500).collect()} == whole


def test_delimiter_of_a_folder_of_parts(spark, tmp_path):
    for k, text in enumerate(["h\n" * 3, "a;b,c\n" * 12, "a,b,c,d;e\n" * 40]):  # the longest part comes last
        (tmp_path / f"part-{k}").write_text(text)
    assert [tuple(r) for r in delimited.detect_delimiter(spark, [str(tmp_path)], 4, parts=True).select("delimiter").collect()] == [(",",)]
    assert delimited.detect_delimiter(spark, [str(tmp_path)], 4, parts=True).count() == 1


@pytest.mark.parametrize("part", [1 << 25, 20_000])
def test_written_files_are_dealt_to_parts(spark, tmp_path, monkeypatch, part):
    from tallyframe.plans import source_queries

    monkeypatch.setattr(source_queries, "PART", part)
    path = source_queries._written(spark, "/root/testdata/sf0.001")
    parts = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(parts) > 20 if part == 20_000 else len(parts) < 8
    assert part > 20_000 or max(r[0] for r in parts) < 12 * part
    found = source_queries.a01_ranged_scan(spark, "/root/testdata/sf0.001").select("lang", "record").collect()
    n = {}
    for r in found:
        n.setdefault(r["lang"], []).append(r["record"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in n.values())


@pytest.mark.parametrize(
    "text, header, want",
    [
        ("a;b\n1,5;2,5\n3,5;4,5\n", 1, ","),  # commas change more but are tried first, and semicolons make no more fields
        ("a;b;c\n1,5;2;3\n3;4,5;6\n", 1, ";"),
        ('"a,b,c";d\n1;2\n', 1, ";"),
        ('"a ""x"", y";b\n"1,2,3";4\n', 1, ";"),
        ("one column\n1\n", 1, ","),
        ("\ufeffa\tb\tc\n1\t2\t3\n", 1, "\t"),
        ("Account, of; the\n\na;b;c\n1;2;3\n", 2, ";"),
        ("a,b\n1,2\n", 1, ","),
    ],
)
def test_delimiters(spark, tmp_path, text, header, want):
    path = tmp_path / "x.csv"
    path.write_text(text, encoding="utf-8")
    assert [r["delimiter"] for r in delimited.detect_delimiter(spark, [str(path)], header).collect()] == [want]
