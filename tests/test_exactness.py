"""Exact decimals of any length, the order of problems, replay against the reference's sequences, and numbering."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import CompareRules, MatchingRules, NumericRule, SideMapping
from tallyframe.functions import decimals, text
from tallyframe.operators import accounting as G
from tallyframe.operators import compare as C
from tallyframe.operators import decisions as D
from tallyframe.operators import match as E
from tallyframe.operators import normalize as N
from tallyframe.operators.numbering import numbered
from tallyframe.sources import generate


@pytest.mark.parametrize(
    "old, new, tolerance, changed",
    [
        ("1.00000000001", "1.00000000002", "0", True),
        ("10000000000000000000000000000", "10000000000000000000000000000.0", "0", False),
        ("1" + "0" * 60, "0" + "9" * 60, "1", False),
        ("1" + "0" * 60, "0" + "9" * 59 + "8", "1", True),
        ("-0." + "0" * 50 + "1", "0." + "0" * 50 + "1", "0", True),
        ("-0." + "0" * 50 + "1", "0." + "0" * 50 + "1", "0." + "0" * 50 + "2", False),
        ("-0", "0.000", "0", False),
        ("007", "7.", "0", False),
        ("5-", "-5", "0", False),
        (".5", "0.50", "0", False),
        ("1.1", "1.2", "0.1", False),
        ("1.1", "1.2000000000000000000000001", "0.1", True),
    ],
)
def test_numbers_are_compared_exactly(spark, old, new, tolerance, changed):
    one = lambda v: spark.createDataFrame([("k", v, 1)], "id string, v string, record_number long")
    rules = CompareRules(key=("id",), numeric={"v": NumericRule(Decimal(tolerance))})
    got = C.compare_values(C.classify(C.keyed(one(old), one(new), rules)), ["v"], rules).first()
    assert (len(got["changes"]) == 1) == changed and got["warnings"] == []


def test_exact_tolerance_against_python(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        n = r.choice([3, 20, 45])
        a = Decimal(r.choice(["", "-"]) + "".join(r.choice("0123456789") for _ in range(n)) + "." + "".join(r.choice("09") for _ in range(r.choice([1, 12, 40]))))
        b = a + Decimal(r.choice(["0", "0.1", "-0.1", "0.10000000000000000000001", "-1", "99"])) if r.random() < 0.8 else -a
        rows.append((format(a, "f"), format(b, "f")))
    import decimal

    decimal.getcontext().prec = 200
    df = spark.createDataFrame(rows, "a string, b string")
    for t in ("0", "0.1", "1", "100"):
        got = df.select(decimals.within_exactly(F.col("a"), F.col("b"), Decimal(t)).alias("x"), decimals._within_by_digits(F.col("a"), F.col("b"), Decimal(t)).alias("y")).collect()
        want = [abs(Decimal(a) - Decimal(b)) <= Decimal(t) for a, b in rows]
        assert [g["x"] for g in got] == want == [g["y"] for g in got]


@pytest.mark.parametrize("money_in, money_out, want", [("-1", "x", "money in is negative"), ("x", "-1", "money in: x is not a number"), ("1", "x", "money out: x is not a number"), ("1", "-2", "money out is negative"), ("1", "2", "money in and money out are both used"), ("", "", "no amount"), ("1.005", "-2", "money in: 1.005 has more than 2 decimals"), (" 1 ", "﻿", None)])
def test_money_in_is_read_to_its_end_first(spark, money_in, money_out, want):
    rows = spark.createDataFrame([("A", 1, "1/2/2024", money_in, money_out)], "account string, record_number long, d string, i string, o string")
    got = N.normalize_side(rows, "bank", SideMapping(date="d", date_format="DD/MM/YYYY", money_in="i", money_out="o")).first()
    assert [p["message"] for p in got["problems"]] == ([want] if want else [])


LOG = "account string, seq long, action string, bank long, books long, side string, record_number long, classification string, exceptions array<string>, reason string"


def log(spark, *events):
    rows = []
    for seq, (action, *at) in enumerate(events, 1):
        unit = action in ("classify", "clear")
        rows.append(("A", seq, action, None if unit or not at else at[0], None if unit or not at else at[1], "bank" if unit else None, at[0] if unit else None, "investigate" if action == "classify" else None, None, None))
    return spark.createDataFrame(rows, LOG)


def outcomes(df):
    return [r["outcome"] for r in df.orderBy("seq").collect()]


def test_replay_sequences(spark):
    c, u, r, s = ("confirm", 1, 1), ("unmatch", 1, 1), ("reject", 1, 1), ("restore", 1, 1)
    # the second confirm lapses, so the unmatch after it is skipped and the pair stays active
    assert outcomes(D.replay(log(spark, c, c, u, u))) == ["applied", "lapsed", "skipped", "applied"]
    # a later confirm does not clear the mark of the one that lapsed
    assert outcomes(D.replay(log(spark, r, c, s, c, u))) == ["applied", "lapsed", "applied", "applied", "skipped"]
    # a confirm may take a classified unit; a matched unit is not classified, and only what is classified is cleared
    assert outcomes(D.replay(log(spark, ("classify", 1), c, ("classify", 1), ("clear", 1), u, ("clear", 1), ("clear", 1)))) == ["applied", "applied", "lapsed", "lapsed", "applied", "applied", "lapsed"]
    # another pair's unmatch does not free a unit
    assert outcomes(D.replay(log(spark, c, ("unmatch", 1, 2), ("confirm", 1, 2), ("complete",)))) == ["applied", "lapsed", "lapsed", "applied"]
    # a missing source lapses what it touches, and an unmatch of such a confirm too, as its source is missing as well
    gone = spark.createDataFrame([("A", 1, True, False), ("A", 2, True, False), ("A", 3, True, True), ("A", 4, True, True)], "account string, seq long, allowed boolean, present boolean")
    assert outcomes(D.replay(log(spark, c, u, u, c), gone)) == ["lapsed", "lapsed", "skipped", "applied"]


def test_replay_against_a_plain_walk_in_any_partitioning(spark):
    r = random.Random(9)
    events = [(r.choice(["confirm", "confirm", "unmatch", "reject", "restore", "classify", "clear"]), r.randrange(6), r.randrange(6)) for _ in range(400)]
    got = outcomes(D.replay(log(spark, *events).repartition(7)))
    used, refused, lapsed, named, want = {}, set(), set(), set(), []
    for action, b, l in events:
        edge, ok = (b, l), False
        if action == "unmatch" and edge in lapsed:
            lapsed.discard(edge)
            want.append("skipped")
            continue
        if action == "confirm":
            ok = edge not in refused and ("b", b) not in used and ("l", l) not in used
            used |= {("b", b): edge, ("l", l): edge} if ok else {}
            lapsed |= set() if ok else {edge}
        elif action == "unmatch":
            ok = used.get(("b", b)) == edge
            if ok:
                del used["b", b], used["l", l]
        elif action == "reject":
            ok = used.get(("b", b)) != edge and edge not in refused
            refused |= {edge} if ok else set()
        elif action == "restore":
            ok = edge in refused
            refused.discard(edge)
        else:
            ok = ("b", b) not in used and (action == "classify" or b in named)
            if ok:
                (named.add if action == "classify" else named.discard)(b)
        want.append("applied" if ok else "lapsed")
    assert got == want


def test_a_history_is_loaded_whole_or_not_at_all(spark):
    good = log(spark, ("confirm", 1, 1), ("unmatch", 1, 1))
    twice = log(spark, ("confirm", 1, 1), ("confirm", 1, 2)).withColumn("account", F.lit("B"))
    gap = good.withColumns({"account": F.lit("C"), "seq": F.col("seq") + 1})
    events, problems = D.load(good.unionByName(twice).unionByName(gap))
    assert {r["account"] for r in events.collect()} == {"A"} and events.count() == 2
    assert {(r["account"], r["message"]) for r in problems.collect()} == {("B", "contradicts the history before it"), ("C", "sequence is not contiguous")}


def test_decisions_are_judged_by_the_data(spark):
    units = lambda rows: spark.createDataFrame(rows, "account string, record_number long, day date, amount long, reference string, is_carried boolean")
    from datetime import date

    bank, books = units([("A", 1, date(2024, 1, 1), 5, None, False), ("A", 2, date(2024, 1, 9), 5, None, False)]), units([("A", 1, date(2024, 1, 1), 5, None, False), ("A", 2, date(2024, 1, 1), -5, None, False)])
    e = lambda seq, b, l, origin, ex=None, why=None: ("A", seq, "confirm", b, l, None, None, None, ex, why, origin)
    rows = [e(1, 1, 1, "suggested"), e(2, 2, 1, "suggested"), e(3, 2, 1, "manual"), e(4, 2, 1, "manual", ["date"]), e(5, 2, 1, "manual", ["date"], " "), e(6, 2, 1, "manual", ["date"], "told"), e(7, 1, 2, "manual"), e(8, 9, 1, "manual"), e(9, 1, 1, "manual")]
    rows += [("A", 10, "classify", None, None, "books", 1, "deposit-in-transit", None, None, None), ("A", 11, "classify", None, None, "books", 2, "deposit-in-transit", None, None, None), ("A", 12, "classify", None, None, "books", 7, "investigate", None, None, None)]
    events = spark.createDataFrame(rows, LOG + ", origin string")
    checked = E.check_pairs(events.filter("bank is not null").select("account", "bank", "books").distinct(), bank, books, MatchingRules())
    own = books.select("account", F.lit("books").alias("side"), "record_number", "amount")
    missing = spark.createDataFrame([("A", 9)], "account string, seq long")
    got = {r["seq"]: r["why"] for r in D.judge(events, checked, E.candidates(bank, books), own, missing).collect()}
    assert got == {1: None, 2: "no longer suggested", 3: "a broken rule is not named", 4: "no reason", 5: "no reason", 6: None, 7: "opposite directions", 8: "not in the data", 9: "its source is not loaded", 10: None, 11: "does not fit", 12: "not in the data"}


def test_rows_are_numbered_within_groups_of_any_size(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 950, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("x"), "id")
    got = numbered(df, ["g"], [F.col("x"), F.col("id")], "n").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["g"], r["x"], r["id"])):
        by[r["g"]] = by.get(r["g"], 0) + 1
        assert r["n"] == by[r["g"]]
    assert sum(by.values()) == 1000


def test_running_balances_of_the_generator(spark):
    rows, opening = generate.running_balances(spark, 500)
    openings = spark.createDataFrame([("A", opening)], "account string, opening long")
    assert G.running_balance(rows, openings).first()["state"] == "consistent"
    broken, _ = generate.running_balances(spark, 500, breaks=37)
    got = G.running_balance(broken.repartition(5), openings).first()
    assert (got["state"], got["record_number"], got["found"] - got["expected"]) == ("break", 37, 1)


def test_completion_is_gated(spark):
    status = spark.createDataFrame([("A", True, []), ("B", False, ["open items are not classified"]), ("C", True, [])], "account string, can_complete boolean, reasons array<string>")
    before = spark.createDataFrame([("A", 4), ("C", 4)], "account string, seq long")
    events = spark.createDataFrame([("A", 5, "b"), ("B", 1, "b"), ("C", 4, "b")], "account string, seq long, basis string")
    taken, refused = G.mark_complete(events, before, status)
    assert [r["account"] for r in taken.collect()] == ["A"]
    assert {r["account"]: r["reasons"] for r in refused.collect()} == {"B": ["open items are not classified"], "C": ["not the next event"]}


def test_unit_keys(spark):
    fp, other = "a" * 64, "b" * 64
    cases = {f"bank|{fp}|1": 1, f"bank|{fp}|1+12&bank|{other}|3": 3, f"bank|{fp}|12+1": None, f"bank|{other}|1&bank|{fp}|1": None, f"bank|{fp}|1+1": None, f"bank|{fp}|1&books|{other}|1": None, f"bank|{fp}|01": None, f"cash|{fp}|1": None, f"bank|{fp[:-1]}|1": None, "": None, f"bank|{fp}|1&bank|{fp}|2": None}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    got = {r["k"]: None if r["m"] is None else len(r["m"]) for r in df.select("k", text.unit_members(F.col("k")).alias("m")).collect()}
    assert got == cases
