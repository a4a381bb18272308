"""Documents, carry-forward over periods, mapping inference and reports: known answers."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyframe.config import CompareRules, MatchingRules
from tallyframe.operators import carry as H
from tallyframe.operators import compare as C
from tallyframe.operators.infer import propose
from tallyframe.sources import delimited, documents, sinks

FP = "a" * 64


def outstanding(**more):
    item = {"lineage": "bank|fp|1", "side": "bank", "date": "2026-9-30", "amount": "-50.00", "direction": "out", "reference": None, "description": "x", "origin": {"sessionId": "s", "period": {"start": "2026-09-01", "end": "2026-09-30"}, "fileName": "f", "fingerprint": "fp", "recordNumber": 1}}
    doc = {"format": "outstanding-items", "version": 1, "exportedAt": "t", "sessionId": "s", "account": "A", "currency": "INR", "minorUnits": 2, "period": {"start": "2026-09-01", "end": "2026-09-30"}, "items": [item], "cleared": ["z"]}
    for path, v in more.items():
        at = doc
        *way, last = path.split("__")
        for k in way:
            at = at[int(k) if k.isdigit() else k]
        at[last] = v
    return doc


BAD = {
    "format": "other",
    "version": 2,
    "minorUnits": 5,
    "account": 7,
    "items": 3,
    "cleared": [1],
    "period": {"start": "2026-10-01", "end": "2026-09-01"},
    "items__0__amount": "1.505",
    "items__0__direction": "in",
    "items__0__side": "cash",
    "items__0__date": "2026-02-30",
    "items__0__lineage": None,
    "items__0__reference": 5,
    "items__0__origin__recordNumber": 0,
    "items__0__origin__period": None,
}


def test_outstanding_documents_are_taken_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(outstanding(), indent=1))
    (tmp_path / "wide.json").write_text(json.dumps(outstanding(items__0__amount="-50.000", minorUnits=2)))
    (tmp_path / "zero.json").write_text(json.dumps(outstanding(items__0__amount="0")))
    (tmp_path / "number.json").write_text(json.dumps(outstanding(items__0__amount=-50)))
    (tmp_path / "nothing.json").write_text("{")
    for i, (k, v) in enumerate(BAD.items()):
        (tmp_path / f"bad{i}.json").write_text(json.dumps(outstanding(**{k: v})))
    got = documents.read_outstanding(spark, [str(tmp_path)])
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    assert sorted(r["name"] for r in got["files"].select(name).collect()) == ["good.json", "wide.json"]
    assert {(r["side"], r["day"], r["amount"], r["record_number"]) for r in got["items"].collect()} == {("bank", date(2026, 9, 30), "-50.00", 1), ("bank", date(2026, 9, 30), "-50.000", 1)}
    assert [r["lineage"] for r in got["cleared"].collect()] == ["z", "z"]
    told = {r["name"] for r in got["problems"].select(name).collect()}
    assert told == {"zero.json", "number.json", "nothing.json", *(f"bad{i}.json" for i in range(len(BAD)))}


def session(events):
    return {
        "format": "reconciliation-session", "version": 1, "id": "s1", "savedAt": "2026-10-01T00:00:00Z", "revision": 3, "context": {"account": "A", "currency": "INR", "minorUnits": 2}, "mappings": {"bank": {"a": 1}}, "accounting": {}, "opening": [],
        "rules": {"bankDaysBefore": 3, "bankDaysAfter": 3, "referencesShared": False, "referenceCaseInsensitive": False}, "sources": {s: {"fileName": "f", "fingerprint": FP, "sheet": None, "recordCount": 2} for s in ("bank", "books")},
        "events": events, "snapshots": [{"key": f"bank|{FP}|1", "date": "2026-09-01", "amount": "5", "direction": "in", "reference": None, "description": None}],
    }


def event(seq, action, **more):
    pair = {} if action in ("classify", "complete") else {"bank": f"bank|{FP}|1", "books": f"books|{FP}|1+2"}
    return {"seq": seq, "at": "2026-10-01T00:00:00Z", "action": action, **pair, **({"origin": "manual"} if action == "confirm" else {}), **more}


def test_sessions_round_trip_and_refusals(spark, tmp_path):
    good = [event(1, "confirm", exceptions=["date"], reason="told"), event(2, "unmatch"), event(3, "classify", key=f"bank|{FP}|1", classification="investigate"), event(4, "classify", key=f"bank|{FP}|1", classification=None), event(5, "complete", basis="b")]
    bad = [
        [event(2, "confirm")],
        [event(1, "confirm", origin="guess")],
        [event(1, "confirm", exceptions=["date"])],
        [event(1, "confirm", exceptions=["colour"], reason="x")],
        [event(1, "confirm", bank=f"books|{FP}|1")],
        [event(1, "confirm", books=f"books|{FP}|2+1")],
        [event(1, "classify", key="x", classification=None)],
        [event(1, "classify", key=f"bank|{FP}|1", classification="odd")],
        [event(1, "complete")],
        [event(1, "confirm", at="never")],
        [event(1, "other")],
    ]
    (tmp_path / "good.json").write_text(json.dumps(session(good)))
    for i, events in enumerate(bad):
        (tmp_path / f"bad{i}.json").write_text(json.dumps(session(events)))
    (tmp_path / "late.json").write_text(json.dumps(session(good) | {"savedAt": 5}))
    got = documents.read_sessions(spark, [str(tmp_path)])
    assert [(r["id"], r["account"], r["revision"]) for r in got["sessions"].collect()] == [("s1", "A", 3)]
    assert [r["action"] for r in got["events"].orderBy("seq").collect()] == ["confirm", "unmatch", "classify", "clear", "complete"]
    assert got["problems"].select("file").distinct().count() == len(bad) + 1
    out = str(tmp_path / "again")
    documents.write_sessions(documents.session_documents(got["sessions"], got["events"], got["snapshots"]), out)
    again = documents.read_sessions(spark, [out], lines=True)
    assert again["problems"].count() == 0
    for name in ("events", "snapshots"):
        a, b = (sorted(map(str, x[name].drop("file").collect())) for x in (got, again))
        assert a == b


SIDES = "account string, side string, fingerprint string, record_number long, day date, amount long, reference string, description string"
SEP, OCT = ("sep", "2026-09-01", "2026-09-30"), ("oct", "2026-10-01", "2026-10-31")


def unit(side, n, month, day, amount, reference, text):
    return ("A", side, f"{side}-{month}", n, date(2026, month, day), amount, reference, text)


def months(spark):
    """Two months of one account: receipts match, one cheque of September clears in October, one does not."""
    return spark.createDataFrame(
        [
            unit("bank", 1, 9, 10, 30000, None, "Receipt"),
            unit("books", 1, 9, 10, 30000, None, "Receipt"),
            unit("books", 2, 9, 15, -5000, "102", "Cheque 102 issued"),
            unit("books", 3, 9, 29, -20000, "101", "Cheque 101 issued"),
            unit("bank", 11, 10, 2, -20000, "101", "Cheque 101 cleared"),
            unit("bank", 12, 10, 20, -5000, "102", "Cheque 102 cleared"),
            unit("bank", 13, 10, 31, -1000, None, "Bank charge"),
            unit("books", 11, 10, 30, 50000, None, "Receipt"),
        ],
        SIDES,
    )


@pytest.mark.parametrize("window, left, cleared", [(3, {("bank", -5000, "Cheque 102 cleared"), ("bank", -1000, "Bank charge"), ("books", 50000, "Receipt"), ("books", -5000, "Cheque 102 issued")}, 1), (40, {("bank", -1000, "Bank charge"), ("books", 50000, "Receipt")}, 2)])
def test_what_a_month_leaves_is_the_next_ones_opening(spark, window, left, cleared):
    got = H.chain(months(spark), [SEP, OCT], lambda pairs: pairs, MatchingRules(days_after=window, share_references=True))
    sums = {(r["period"], r["side"]): (r["opening"], r["movement"], r["matched"], r["outstanding"]) for r in got["sums"].collect()}
    assert sums["sep", "bank"] == (0, 30000, 30000, 0) and sums["sep", "books"] == (0, 5000, 30000, -25000)
    assert all(o + m == x + r for o, m, x, r in sums.values())
    assert sums["oct", "books"][0] == -25000 and sums["oct", "books"][1] == 50000  # the carried cheques are not in the movement
    items = got["items"].filter("period = 'oct'").collect()
    assert {(r["side"], r["amount"], r["description"]) for r in items} == left
    assert {r["lineage"] for r in items if r["inherited"]} == ({"books|books-9|2"} if window == 3 else set())
    assert got["cleared"].filter("period = 'oct'").count() == cleared
    # importing September's items after October's is refused: what October cleared cannot be outstanding again
    old = got["items"].filter("period = 'sep'").select(F.lit("sep.json").alias("file"), "account", F.lit("INR").alias("currency"), F.lit("2026-09-30").cast("date").alias("period_end"), "side", "day", (F.col("amount") / 100).cast("decimal(18,2)").cast("string").alias("amount"), "reference", "lineage")
    assert H.item_problems(old).count() == 0
    target = spark.createDataFrame([("A", "INR", date(2026, 11, 1))], "account string, currency string, period_start date")
    said = H.import_problems(old, target, items_of(got, "oct"), got["cleared"].filter("period = 'oct'").select("lineage"), spark.createDataFrame([("sep.json", "books|books-9|3")], "file string, lineage string"))
    assert said.filter("message = 'already cleared'").count() == cleared
    assert said.filter("message = 'listed as cleared and as outstanding'").count() == 1
    assert H.accepted(old, said).count() == 0


def items_of(got, period):
    return got["items"].filter(F.col("period") == period).select("lineage")


@pytest.mark.parametrize("amount, minor, sound", [("1.500", 2, True), (".5", 2, True), ("+5", 2, True), ("5.5", 0, False), ("1,000", 2, False), ("1.505", 2, False), (None, 2, False)])
def test_amounts_of_items(spark, amount, minor, sound):
    item = spark.createDataFrame([("f", "bank", date(2026, 1, 1), amount, "l")], "file string, side string, day date, amount string, lineage string")
    assert (H.item_problems(item, minor).count() == 0) == sound


def test_mapping_proposals(spark):
    bank = spark.createDataFrame([("13/09/2026", "01/01/2026", "1,000.00", "", "RF1", "a", "5.00 Cr"), ("01/10/2026", "", "", "(5)", None, "b", "")], ["Txn Date", "Value Date", "Deposit Amt", "Withdrawal Amt", "Chq./Ref.No.", "Narration", "Closing Balance"])
    got = propose(bank, "bank")
    assert (got.date, got.date_format, got.other_formats, got.date_kind) == ("Txn Date", "DD/MM/YYYY", (), "transaction")
    assert (got.money_in, got.money_out, got.amount) == ("Deposit Amt", "Withdrawal Amt", None)
    assert (got.grouped, got.parentheses, got.trailing_minus) == (True, True, False)
    assert (got.reference, got.description, got.balance, got.balance_marks) == ("Chq./Ref.No.", "Narration", "Closing Balance", "cr-positive")
    ledger = propose(spark.createDataFrame([("2026-09-01", "5", "", "x"), (None, "", "7-", "y")], ["Date", "Debit", "Credit", "Refund Ref"]), "books")
    assert (ledger.money_in, ledger.money_out, ledger.trailing_minus, ledger.reference) == ("Debit", "Credit", True, "Refund Ref")
    plain = propose(spark.createDataFrame([("1/2/2026", "5")], ["Value date", "Amount"]), "bank")
    assert (plain.date, plain.date_format, plain.other_formats, plain.date_kind, plain.amount) == ("Value date", "DD/MM/YYYY", ("MM/DD/YYYY",), "value", "Amount")
    nothing = propose(spark.createDataFrame([("x",)], ["a"]), "bank")
    assert nothing.date is nothing.amount is nothing.reference is None


def test_search_reaches_every_section(spark):
    cols = "id string, v string, w string, record_number long"
    old = spark.createDataFrame([("1", "a", "1", 1), ("2", "Needle", "1", 2), ("D", "x", "1", 3), ("D", "y", "1", 4), ("", "z", "1", 5), ("7", "n", "needles", 6)], cols)
    new = spark.createDataFrame([("1", "aNEEDLEa", "1", 1), ("3", "the needle", "1", 2), ("7", "n", "5", 6)], cols)
    from tallyframe.config import NumericRule

    rules = CompareRules(key=("id",), numeric={"w": NumericRule()})
    rows = C.keyed(old, new, rules)
    classes = C.classify(rows)
    compared = C.compare_values(classes, ["id", "v", "w"], rules)
    sections = sinks.compare_sections(rows, classes, compared) | {"Changed": compared}
    hits = {name: C.search(name, sections[name], " NEEDLE ").count() for name in sections if name != "Summary"}
    assert hits == {"Added": 1, "Removed": 1, "Changed": 2, "Ambiguous keys": 0, "Empty keys": 0, "Numeric warnings": 1}
    assert C.search("Ambiguous keys", sections["Ambiguous keys"], "d").count() == 2
    assert C.search("Added", sections["Added"], "  ").count() == 1
    head = sinks.manifest(sections["Summary"], rules, "a.csv", "b.csv", "now").first()
    assert json.loads(head["rulesUsed"])["key"] == ["id"] and head["summary"]["added"] == 1 and head["files"]["old"] == "a.csv"


def test_changes_as_one_spreadsheet_file(spark, tmp_path):
    old = spark.createDataFrame([("1", '=a "q"', 1), ("2", "b,c", 2)], "id string, v string, record_number long")
    new = spark.createDataFrame([("1", "two\nlines", 1), ("3", " d", 2)], "id string, v string, record_number long")
    rules = CompareRules(key=("id",))
    classes = C.classify(C.keyed(old, new, rules))
    out = C.export_rows(classes, C.compare_values(classes, ["id", "v"], rules), ["id", "v"], ["id", "v"])
    sinks.write_changes_text(out, str(tmp_path / "r"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("part-*")))
    want = ["change_type,key,column,before,after", "added,3,id,,3", 'added,3,v,," d"', "removed,2,id,2,", 'removed,2,v,"b,c",', 'changed,1,v,"\'=a ""q""","two\nlines"']
    assert data.decode() == "﻿" + "".join(line + "\r\n" for line in want)


def test_a_file_that_is_not_utf8_is_refused(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b"id,v\n1,caf\xe9\n")
    _, _, issues = delimited.read_table(spark, str(p), delimiter=",")
    assert "not valid UTF-8" in {r["message"] for r in issues.collect()}


def test_documents_of_any_length_in_pieces(spark, tmp_path, monkeypatch):
    from tallyframe import scratch
    from tallyframe.sources import pieces

    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}/s")
    heads = spark.createDataFrame([("A", 1, None), ("B/é", 2, "x"), ("C", 3, 'q"\n')], "account string, n int, t string")
    made = {"A": 400, "B/é": 3}
    items = spark.createDataFrame([(a, k, (k * 7919) % n, f'v"{k}\n') for a, n in made.items() for k in range(n)] + [("gone", 1, 1, "")], "account string, k int, at int, v string").repartition(5)
    names = spark.createDataFrame([("A", "two"), ("A", "one"), ("A", "one"), ("C", "}],{")], "account string, item string")
    out = pieces.lines(heads, {"items": (items.select("account", F.struct("k", "v", F.lit(None).cast("int").alias("z")).alias("item"), "at"), ["at"]), "names": (names, ["item"])})
    pieces.write(out, f"{tmp_path}/d", 9)
    got = {r["document"]: json.loads(r["value"]) for r in pieces.joined(spark, f"{tmp_path}/d").collect()}
    want = lambda n: [{"k": k, "v": f'v"{k}\n', "z": None} for k in sorted(range(n), key=lambda k: (k * 7919) % n)]
    assert got == {"A": {"n": 1, "t": None, "items": want(400), "names": ["one", "one", "two"]}, "B/é": {"n": 2, "t": "x", "items": want(3), "names": []}, "C": {"n": 3, "t": 'q"\n', "items": [], "names": ["}],{"]}}
    parts = sorted(p for p in (tmp_path / "d" / "document=A").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 3 and json.loads("".join(p.read_text() for p in parts)) == got["A"]
    scratch.discard(out)
    assert not list((tmp_path / "s").iterdir())


def test_sessions_are_judged_once(spark, tmp_path):
    from tallyframe.sources import documents

    (tmp_path / "s.json").write_text('{"format": "other", "events": [], "snapshots": []}')
    found = documents.read_sessions(spark, [str(tmp_path / "s.json")])
    assert found["problems"].count() > 5 and found["sessions"].count() == 0
    for name in ("sessions", "events", "snapshots", "problems"):
        assert any("/session-problems-" in f for f in found[name].inputFiles())
