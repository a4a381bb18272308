"""Operators: known answers, order independence, and iterative ones against plain versions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import CompareRules, MatchingRules, NumericRule, SideMapping
from tallyframe.operators import compare as C
from tallyframe.operators import decisions as D
from tallyframe.operators import match as E
from tallyframe.operators import normalize as N
from tallyframe.operators.components import components
from tallyframe.sources import delimited, generate, sinks


def table(spark, cols, rows):
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in cols) + ", record_number long")


def counts(old, new, rules):
    rows = C.keyed(old, new, rules)
    classes = C.classify(rows)
    return C.summary(rows, classes, C.compare_values(classes, C.compared_columns(old, new, rules), rules)).first().asDict()


def test_numbers_groups_and_warnings(spark):
    old = table(spark, ["id", "price", "stock"], [("1", "1.0", "1,000"), ("2", "2", "N/A"), ("3", "3", "5")])
    new = table(spark, ["id", "price", "stock"], [("1", "1.00", "1000"), ("2", "2", "n/a"), ("3", "3", "6")])
    rules = CompareRules(key=("id",), numeric={"price": NumericRule(), "stock": NumericRule(grouped=True)}, case_insensitive=("stock",))
    got = counts(old, new, rules)
    assert (got["changed"], got["warnings"], got["unchanged"]) == (2, 2, 1)
    ignored = CompareRules(key=("id",), numeric={"stock": NumericRule()}, ignored=("price", "stock"))
    assert counts(old, new, ignored)["changed"] == 0 and counts(old, new, ignored)["warnings"] == 0


def test_composite_empty_and_ambiguous_keys(spark):
    old = table(spark, ["w", "sku"], [("A", "1"), ("A", ""), ("B", "2")])
    new = table(spark, ["w", "sku"], [("A", "1"), (" ", "9"), ("B", "2"), ("b", "2 ")])
    got = counts(old, new, CompareRules(key=("w", "sku"), fold_keys=True))
    assert (got["ambiguous"], got["empty_key"], got["added"], got["removed"], got["unchanged"]) == (1, 2, 0, 0, 1)
    assert counts(old, new, CompareRules(key=("w", "sku")))["added"] == 1
    with pytest.raises(ValueError):
        counts(old, new, CompareRules(key=("none",)))


def test_generated_pair_counts_and_partitions(spark):
    old, new = generate.snapshot_pair(spark, 5000, columns=4)
    rules = CompareRules(key=("id",))
    a, b = counts(old, new, rules), counts(old.repartition(7), new.orderBy(F.rand(1)), rules)
    assert a == b and a["added"] == 100 and a["changed"] + a["unchanged"] + a["removed"] == 5000


def test_split_amounts(spark):
    df = spark.createDataFrame([("A", i + 1, "1/2/2024", a, b) for i, (a, b) in enumerate([("5", ""), ("", "7.50"), ("-1", ""), ("1", "1"), ("", ""), ("0", ""), ("x", "y"), ("1.005", "")])], "account string, record_number long, d string, i string, o string")
    got = N.normalize_side(df, "bank", SideMapping(date="d", date_format="DD/MM/YYYY", money_in="i", money_out="o")).orderBy("record_number").collect()
    assert [r["amount"] for r in got[:2]] == [Decimal("5.00"), Decimal("-7.50")]
    assert [r["status"] for r in got] == ["valid", "valid", "problem", "problem", "problem", "zero", "problem", "problem"]


def sides(spark, seed, n=60):
    r = random.Random(seed)
    one = lambda: [("A", i, r.randrange(12), r.choice([100, 200, -100]), r.choice([None, "x", "y"])) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "account string, record_number long, d int, amount long, reference string").select("account", "record_number", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("day"), "amount", "reference")
    a, b = one(), one()
    return a, b, frame(a), frame(b)


def test_candidates_and_groups(spark):
    for seed, shared in ((1, False), (2, True)):
        a, b, bank, books = sides(spark, seed)
        rules = MatchingRules(2, 1, share_references=shared)
        want = {(x[1], y[1]) for x in a for y in b if x[3] == y[3] and x[2] - 1 <= y[2] <= x[2] + 2 and not (shared and x[4] and y[4] and x[4] != y[4])}
        pairs = E.candidates(bank, books, rules)
        assert {(r["bank"], r["books"]) for r in pairs.collect()} == want
        assert {(r["bank"], r["books"]) for r in E.candidates(bank.orderBy(F.rand(3)), books, rules, binned=True).collect()} == want
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for p, q in want:
            parent[find(("b", p))] = find(("l", q))
        got = {}
        for r in E.groups(pairs).collect():
            got.setdefault(r["group"], set()).add(find(("b", r["bank"])))
        assert all(len(v) == 1 for v in got.values()) and len(got) == len({find(("b", p)) for p, _ in want})
        if not shared:
            key = lambda df: sorted((r["group"], r["bank"], r["books"]) for r in df.collect())
            assert key(E.groups(pairs)) == key(E.groups_by_island(pairs))


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (5, 5), (None, 3), (7, 6)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, **{i: 200 for i in range(200, 500)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


LOG = "account string, seq long, action string, bank long, books long, side string, record_number long, classification string, exceptions array<string>, reason string"


def test_replay(spark):
    e = lambda seq, action, b=None, l=None, r=None: ("A", seq, action, b, l, "bank" if r else None, r, None, None, None)
    events = [e(1, "confirm", 1, 1), e(2, "confirm", 1, 2), e(3, "unmatch", 1, 2), e(4, "reject", 2, 2), e(5, "confirm", 2, 2), e(6, "restore", 2, 2), e(7, "confirm", 2, 2), e(8, "classify", r=1), e(9, "unmatch", 1, 1), e(10, "classify", r=1), e(11, "confirm", 3, 3)]
    log = spark.createDataFrame(events, LOG)
    verdicts = spark.createDataFrame([("A", 1, 1, True), ("A", 1, 2, True), ("A", 2, 2, True), ("A", 3, 3, False)], "account string, bank long, books long, allowed boolean")
    got = [r["outcome"] for r in D.replay(log, verdicts).orderBy("seq").collect()]
    assert got == ["applied", "lapsed", "skipped", "applied", "lapsed", "applied", "applied", "lapsed", "applied", "applied", "lapsed"]
    ok, refused = D.append(log, spark.createDataFrame([e(12, "reject", 3, 3)], LOG), verdicts)
    assert ok.count() == 1 and refused.count() == 0
    assert D.append(log, spark.createDataFrame([e(13, "reject", 3, 3)], LOG), verdicts)[0].count() == 0


def test_delimited_layout(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Bank;x\n\nperiod;2024\nid; name ;qty\nopening;;\n001;"a; b";1\n\n002;"two\nlines";2\nclosing;;\n', encoding="utf-8")
    rows, skipped, issues = delimited.read_table(spark, str(p), delimited.Layout(3, 1, 1))
    assert [(r["id"], r["name"], r["record_number"]) for r in rows.orderBy("record_number").collect()] == [("001", "a; b", 1), ("002", "two\nlines", 2)]
    assert issues.count() == 0 and skipped.count() == 4
    p.write_text("id,name\n1,a\n2,b,c\n3\n")
    _, _, issues = delimited.read_table(spark, str(p))
    assert [r["record_number"] for r in issues.orderBy("record_number").collect()] == [2, 3]
    assert delimited.fingerprints(spark, [str(p)]).first()["is_utf8"]


def test_changes_report(spark, tmp_path):
    old, new = table(spark, ["id", "v"], [("1", "=a"), ("2", "b")]), table(spark, ["id", "v"], [("1", "c"), ("3", "d")])
    rules = CompareRules(key=("id",))
    classes = C.classify(C.keyed(old, new, rules))
    out = C.export_rows(classes, C.compare_values(classes, ["id", "v"], rules), ["id", "v"], ["id", "v"])
    sinks.write_changes(out, str(tmp_path / "r"), escape=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert {(r["change_type"], r["key"], r["column"]) for r in back.collect()} == {("added", "3", "id"), ("added", "3", "v"), ("removed", "2", "id"), ("removed", "2", "v"), ("changed", "1", "v")}
    assert back.filter("change_type = 'changed'").first()["before"] == "'=a"


def test_side_summary_by_batch_is_that_of_blocked_records(spark):
    from tallyframe.operators import normalize

    rows = [("A" if k % 5 else "B", "bank", k, None if k % 7 == 3 else str(k // 4), [], "problem" if k % 11 == 2 else "zero" if k % 6 == 0 else "valid", (-1) ** k * k) for k in range(90)]
    side = spark.createDataFrame(rows, "account string, side string, record_number long, batch string, problems array<string>, status string, amount long")
    broken = side.filter("status = 'problem' AND batch IS NOT NULL").select("account", "batch").distinct()
    blocked = side.join(broken, ["account", "batch"], "left_semi").select("account", "record_number")
    want = normalize.side_summary(side, batch_problems=blocked)
    found = normalize.side_summary(side, by_batch=True)
    assert found.columns == want.columns and [t for _, t in found.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
