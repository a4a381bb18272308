"""Decisions over group units, replay from a kept state, and histories that several writers append to."""

import threading

import numpy as np
import pytest

from tallyframe.operators import decisions as D
from tallyframe.operators import history as H

EVENT = "account string, seq long, action string, bank string, books string, key string, classification string, reason string"
FP = "a" * 64


def key(side, *records, fp=FP):
    return f"{side}|{fp}|{'+'.join(map(str, sorted(records)))}"


def members(unit):
    side, fp, records = unit.split("|")
    return [(side, r) for r in records.split("+")]


def fold(events, allowed=lambda e: True, present=lambda e: True):
    """Outcome of each event of one history, by the rules as written down."""
    used, active, refused, lapsed, classified, out = {}, set(), set(), set(), set(), []
    for e in events:
        seq, action, bank, books, own = e[1:6]
        edge = (bank, books)
        if action == "complete":
            out.append("applied")
            continue
        if action in ("classify", "clear"):
            ok = present(e) and not any(m in used for m in members(own)) and (action == "classify" or own in classified) and allowed(e)
            if ok:
                (classified.add if action == "classify" else classified.discard)(own)
            out.append("applied" if ok else "lapsed")
            continue
        if action == "unmatch" and present(e) and edge in lapsed:
            lapsed.discard(edge)
            out.append("skipped")
            continue
        both = members(bank) + members(books)
        ok = present(e)
        if action == "confirm":
            ok = ok and edge not in refused and not any(m in used for m in both) and allowed(e)
            if ok:
                used.update(dict.fromkeys(both))
                active.add(edge)
            else:
                lapsed.add(edge)
        elif action == "unmatch":
            ok = ok and edge in active
            if ok:
                active.discard(edge)
                for m in both:
                    del used[m]
        elif action == "reject":
            ok = ok and edge not in active and edge not in refused
            refused |= {edge} if ok else set()
        else:
            ok = ok and edge in refused
            refused -= {edge} if ok else set()
        out.append("applied" if ok else "lapsed")
    return out, active, refused


def made(account, n, seed):
    r = np.random.default_rng(seed)
    bank = [key("bank", *x) for x in ([1], [2], [1, 2], [2, 3], [3], [4, 5, 6], [6])]
    books = [key("books", *x) for x in ([1], [2], [1, 2], [3])]
    out = []
    for k in range(n):
        action = str(r.choice(["confirm", "confirm", "confirm", "unmatch", "unmatch", "reject", "restore", "classify", "clear", "complete"]))
        own = action in ("classify", "clear")
        pair = not own and action != "complete"
        out.append((account, k + 1, action, str(r.choice(bank)) if pair else None, str(r.choice(books)) if pair else None, str(r.choice(bank)) if own else None, "investigate" if action == "classify" else None, None))
    return out


def outcomes(df):
    return [r["outcome"] for r in sorted(df.collect(), key=lambda r: (r["account"], r["seq"]))]


@pytest.mark.parametrize("whole", [200_000, 10])
def test_groups_against_a_plain_fold(spark, monkeypatch, whole):
    monkeypatch.setattr(D, "WHOLE", whole)
    events = {a: made(a, n, seed) for a, n, seed in (("A", 120, 1), ("B", 60, 2), ("C", 5, 3))}
    judged = lambda e: (e[1] * 7) % 5 != 0
    here = lambda e: e[1] % 11 != 0
    rows = [e for a in events.values() for e in a]
    verdicts = spark.createDataFrame([(e[0], e[1], judged(e), here(e), "told") for e in rows], "account string, seq long, allowed boolean, present boolean, why string")
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    got = D.replay(df, verdicts)
    assert outcomes(got) == [o for a in sorted(events) for o in fold(events[a], judged, here)[0]]
    for r in got.collect():
        assert (r["reason_lapsed"] is not None) == (r["outcome"] == "lapsed")
    # the facts are those of the fold
    live = {(r["account"], r["bank"], r["books"], r["value"]) for r in D.facts(got).filter("kind = 'pair' and value is not null").collect()}
    want = {(a, *edge, value) for a in events for edges, value in zip(fold(events[a], judged, here)[1:], ("confirm", "reject")) for edge in edges}
    assert live == want


def test_a_member_of_a_group_is_used_and_free_again(spark):
    pair = lambda seq, action, bank, books: ("A", seq, action, key("bank", *bank), key("books", *books), None, None, None)
    one = ("A", 7, "classify", None, None, key("bank", 2), "investigate", None)
    log = [pair(1, "confirm", [1, 2], [1]), pair(2, "confirm", [2], [2]), pair(3, "unmatch", [2], [2]), pair(4, "confirm", [3], [1]), pair(5, "reject", [1, 2], [1]), pair(6, "reject", [1], [1]), one, pair(8, "unmatch", [1, 2], [1]), pair(9, "confirm", [2], [2])]
    got = {r["seq"]: (r["outcome"], r["reason_lapsed"]) for r in D.replay(spark.createDataFrame(log, EVENT)).collect()}
    assert got == {
        1: ("applied", None), 2: ("lapsed", "a bank transaction is in another match"), 3: ("skipped", None), 4: ("lapsed", "a books transaction is in another match"), 5: ("lapsed", "the pair is matched"),
        6: ("applied", None), 7: ("lapsed", "a matched transaction is not classified"), 8: ("applied", None), 9: ("applied", None),
    }


def test_members_of_group_events(spark):
    two = f"bank|{FP}|1+20&bank|{'b' * 64}|3"
    got = D.event_members(spark.createDataFrame([("A", 1, "confirm", two, key("books", 4), None, None, None), ("A", 2, "complete", None, None, None, None, None), ("A", 3, "classify", None, None, key("bank", 9), "investigate", None)], EVENT))
    assert sorted((r["seq"], r["side"], r["fingerprint"][0], r["record_number"]) for r in got.collect()) == [(1, "bank", "a", 1), (1, "bank", "a", 20), (1, "bank", "b", 3), (1, "books", "a", 4), (3, "bank", "a", 9)]


def test_advance_equals_replay_of_all_on_every_prefix(spark):
    events = made("A", 40, 5)
    whole = outcomes(D.replay(spark.createDataFrame(events, EVENT)))
    for cut in (0, 13):
        before = D.facts(D.replay(spark.createDataFrame(events[:cut], EVENT)))
        assert outcomes(D.advance(before, spark.createDataFrame(events[cut:], EVENT))[0]) == whole[cut:]


def test_history_equals_replay_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "FOLDERS", 2)  # facts are merged on the way
    log = {a: made(a, 60, seed) for a, seed in (("A", 7), ("B", 8))}
    h = H.History(spark, f"file://{tmp_path}/h")
    for a, b in ((0, 20), (20, 21), (21, 60)):
        h.append(spark.createDataFrame([e for es in log.values() for e in es[a:b]], EVENT), lapsing=True)
    assert outcomes(h.events()) == [o for a in log for o in fold(log[a])[0]]
    assert {(r["account"], r["bank"], r["books"]) for r in h.state().filter("kind = 'pair' and value = 'confirm'").collect()} == {(a, *e) for a in log for e in fold(log[a])[1]}
    assert h.version() == 3 and outcomes(h.events(version=1)) == [o for a in log for o in fold(log[a][:20])[0]]
    monkeypatch.setattr(H, "NAMED", 0)  # facts by a join instead of a filter
    more = [("A", 61, "reject", key("bank", 77), key("books", 77), None, None, None), ("B", 63, "reject", key("bank", 77), key("books", 77), None, None, None)]
    taken, refused = h.append(spark.createDataFrame(more, EVENT))
    assert outcomes(taken) == ["applied"] and [r["account"] for r in refused.collect()] == ["B"]


def one(account, seq, record, action="confirm"):
    return (account, seq, action, key("bank", record), key("books", record), None, None, None)


def test_the_second_writer_of_a_number_is_refused(spark, tmp_path, monkeypatch):
    h, other = (H.History(spark, f"file://{tmp_path}/h") for _ in range(2))
    h.append(spark.createDataFrame([one("A", 1, 1), one("B", 1, 1)], EVENT))
    real, did = H.put_if_absent, []

    def late(spark, path, text):
        if not did:  # between the reading and the commit of the first writer another one commits
            did.append(1)
            taken, refused = other.append(spark.createDataFrame([one("A", 2, 2)], EVENT))
            assert taken.count() == 1 and refused.count() == 0
        return real(spark, path, text)

    monkeypatch.setattr(H, "put_if_absent", late)
    taken, refused = h.append(spark.createDataFrame([one("A", 2, 3), one("B", 2, 3)], EVENT))
    assert [(r["account"], r["seq"]) for r in taken.collect()] == [("B", 2)] and [r["account"] for r in refused.collect()] == ["A"]
    assert sorted((r["account"], r["seq"], r["bank"]) for r in h.events().collect()) == sorted((a, s, key("bank", k)) for a, s, k in (("A", 1, 1), ("B", 1, 1), ("A", 2, 2), ("B", 2, 3)))
    assert h.version() == 3


def test_writers_at_one_time(spark, tmp_path):
    H.History(spark, f"file://{tmp_path}/h").append(spark.createDataFrame([one(a, 1, 1) for a in "ABC"], EVENT))
    done = {}

    def work(name, account, record):
        taken, refused = H.History(spark, f"file://{tmp_path}/h").append(spark.createDataFrame([one(account, 2, record)], EVENT))
        done[name] = (taken.count(), refused.count())

    threads = [threading.Thread(target=work, args=x) for x in (("a", "A", 5), ("b", "B", 5), ("same 1", "C", 6), ("same 2", "C", 7))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert done["a"] == done["b"] == (1, 0) and sorted([done["same 1"], done["same 2"]]) == [(0, 1), (1, 0)]
    got = H.History(spark, f"file://{tmp_path}/h").events()
    assert got.count() == 6 and got.groupBy("account", "seq").count().filter("count > 1").count() == 0


def test_put_if_absent_has_one_winner(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if H.put_if_absent(spark, f"file://{tmp_path}/x.json", str(k)) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert len(won) == 1 and (tmp_path / "x.json").read_text() == str(won[0]) and [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []


def test_new_events_are_computed_once(spark, tmp_path):
    from tallyframe.operators import history as H

    made = spark.sparkContext.accumulator(0)
    schema = "account string, seq long, action string, bank long, books long, side string, record_number long, classification string"

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = 40 * H.NAMED
    row = "'A' account, id + 1 seq, 'confirm' action, id bank, id books"
    new = spark.range(0, n, 1, 2).selectExpr(*row.split(", "), "cast(null as string) side", "cast(null as long) record_number", "cast(null as string) classification").mapInArrow(counted, schema)
    kept = H.History(spark, str(tmp_path / "h"))
    taken, refused = kept.append(new)
    assert taken.count() == n and refused.count() == 0
    assert made.value == n
