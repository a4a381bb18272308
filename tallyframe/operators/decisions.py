"""The decision log and what it makes of candidates (F1-F16).

Events come in two forms. By record: (account, seq, action, bank, books, side, record_number, classification, exceptions,
reason) with whole numbers. By unit key, as session documents have them: (account, seq, action, bank, books, key,
classification, ...) with texts, where a key of several members is a group. Pair actions are confirm, unmatch, reject
and restore; classify and clear name a record or key; complete names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import direction as direction_of
from ..functions.text import found, unit_members
from ..scratch import discard, materialize, reading
from .components import components
from .numbering import numbered

PAIR = ("confirm", "unmatch", "reject", "restore")
#: What an open unit may be classified as, by side and direction (null: any).
FITTING = (("bank", None, "record-in-books"), ("bank", None, "investigate"), ("books", "out", "outstanding-payment"), ("books", "out", "investigate"), ("books", "in", "deposit-in-transit"), ("books", "in", "investigate"))


def last_by_edge(events: DataFrame) -> DataFrame:
    """The last pair event of each edge: the state of a history in which nothing lapses."""
    nth = F.row_number().over(Window.partitionBy("account", "bank", "books").orderBy(F.col("seq").desc()))
    return events.filter(F.col("action").isin(*PAIR)).withColumn("nth", nth).filter("nth = 1").drop("nth")


def active(last: DataFrame) -> DataFrame:
    return last.filter("action = 'confirm'").select("account", "bank", "books", "seq")


def rejected(last: DataFrame) -> DataFrame:
    return last.filter("action = 'reject'").select("account", "bank", "books", "seq")


def last_classification(events: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("account", "side", "record_number").orderBy(F.col("seq").desc()))
    last = events.filter(F.col("action").isin("classify", "clear")).withColumn("nth", nth)
    return last.filter("nth = 1 and action = 'classify'").select("account", "side", "record_number", "classification", "seq")


def fitting(units: DataFrame) -> DataFrame:
    """(account, side, record_number, classification) that a unit may be given."""
    table = units.sparkSession.createDataFrame(list(FITTING), "side string, direction string, classification string")
    way = F.when(F.col("amount") > 0, "in").otherwise("out")
    u = units.withColumn("way", way).alias("u")
    return u.join(table.alias("t"), (F.col("u.side") == F.col("t.side")) & (F.col("t.direction").isNull() | (F.col("t.direction") == F.col("u.way")))).select("u.account", "u.side", "u.record_number", "t.classification")


def missing_sources(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with a member whose source is not loaded: (account, seq)."""
    return members.join(sources, "fingerprint", "left_anti").select("account", "seq").distinct()


def available(pairs: DataFrame, confirmed: DataFrame, refused: DataFrame) -> DataFrame:
    """Candidates less those of used units and less rejected edges."""
    out = pairs.join(confirmed.select("account", "bank"), ["account", "bank"], "left_anti").join(confirmed.select("account", "books"), ["account", "books"], "left_anti")
    return out.join(refused.select("account", "bank", "books"), ["account", "bank", "books"], "left_anti")


def unmatched(units: DataFrame, confirmed: DataFrame, side: str, suggestions: DataFrame, classified: DataFrame) -> DataFrame:
    """Units that no active match uses, with open suggestions and classification."""
    rest = units.join(confirmed.select("account", F.col(side).alias("record_number")), ["account", "record_number"], "left_anti")
    rest = rest.join(suggestions.withColumnRenamed(side, "record_number"), ["account", "record_number"], "left")
    rest = rest.join(classified.filter(F.col("side") == side).select("account", "record_number", "classification"), ["account", "record_number"], "left")
    return rest.withColumn("suggestions", F.coalesce("suggestions", F.lit(0)))


def confirmed_view(confirmed: DataFrame, bank: DataFrame, books: DataFrame, checked: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Active matches with both units, the days between and the difference; with check_pairs() of them also the tier that
    they meet now (null if they break a rule), with the log also the reason that was given. Order by seq to show them."""
    b = bank.select("account", F.col("record_number").alias("bank"), F.col("day").alias("bank_day"), F.col("amount").alias("bank_amount"))
    l = books.select("account", F.col("record_number").alias("books"), F.col("day").alias("books_day"), F.col("amount").alias("books_amount"))
    out = confirmed.join(b, ["account", "bank"]).join(l, ["account", "books"]).withColumns({"gap": F.datediff("bank_day", "books_day"), "difference": F.col("bank_amount") - F.col("books_amount")})
    if checked is not None:
        out = out.join(checked.select("account", "bank", "books", "tier"), ["account", "bank", "books"], "left")
    if events is not None:
        out = out.join(events.select("account", "seq", "reason"), ["account", "seq"], "left")
    return out


def decision_summary(pairs_left: DataFrame, confirmed: DataFrame, refused: DataFrame, bank: DataFrame | None = None, books: DataFrame | None = None, replayed: DataFrame | None = None) -> DataFrame:
    """One row per account: suggested (pairs, or the `suggestions` of units), confirmed and rejected pairs; with the units of both sides also what no match uses,
    with replay() also the events that lapsed."""
    one = lambda df, name: df.groupBy("account").agg(F.count("*").alias(name))
    suggested = pairs_left.groupBy("account").agg(F.sum("suggestions").alias("suggested")) if "suggestions" in pairs_left.columns else one(pairs_left, "suggested")
    parts = [suggested, one(confirmed, "confirmed"), one(refused, "rejected")]
    for units, side in ((bank, "bank"), (books, "books")):
        if units is not None:
            rest = units.join(confirmed.select("account", F.col(side).alias("record_number")), ["account", "record_number"], "left_anti")
            parts.append(one(rest, f"{side}_unmatched"))
    if replayed is not None:
        parts.append(one(replayed.filter("outcome = 'lapsed'"), "lapsed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "account", "full")
    return out.na.fill(0)


def shown(rows: DataFrame, texts: list[str], needle: str = "", direction: str | None = None, amount: str = "amount") -> DataFrame:
    """A view (suggested, confirmed, unmatched, rejected, problems) as a reviewer narrows it: by a text in any of the
    columns shown, and by the direction of an amount, which views without amounts, as that of problems, do not have."""
    out = rows.filter(found(needle, *[F.col(c) for c in texts]))
    return out if direction is None or amount not in rows.columns else out.filter(direction_of(F.col(amount)) == direction)


def history_problems(events: DataFrame) -> DataFrame:
    """(account, seq, message): sequence gaps, unknown actions, missing ends, exceptions without a reason."""
    pair = F.col("action").isin(*PAIR)
    known = [*PAIR, "classify", "clear", "complete"]
    said = F.array_compact(
        F.array(
            F.when(F.col("seq") != F.col("want"), F.lit("sequence is not contiguous")),
            F.when(~F.col("action").isin(*known), F.lit("unknown action")),
            F.when(pair & (F.col("bank").isNull() | F.col("books").isNull()), F.lit("pair without both ends")),
            F.when((F.size(F.coalesce("exceptions", F.array().cast("array<string>"))) > 0) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), F.lit("exception without a reason")),
        )
    )
    placed = numbered(events, ["account"], [F.col("seq")], "want")
    return reading(placed.select("account", "seq", F.explode(said).alias("message")), placed)


def _by_key(events: DataFrame) -> bool:
    return "key" in events.columns


def _members(events: DataFrame) -> dict[str, Column]:
    """The members that bank, books and own (what classify names) stand for, as arrays of text, empty where there is none.
    A text that is no unit key stands for itself."""
    none = F.array().cast("array<string>")
    if _by_key(events):
        one = lambda m: F.concat_ws("|", m["side"], m["fingerprint"], m["record"].cast("string"))
        listed = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.coalesce(F.transform(unit_members(F.col(c)), one), F.array(c)))
        return {"bank": listed("bank"), "books": listed("books"), "own": listed("key")}
    end = lambda side, c: F.when(F.col(c).isNull(), none).otherwise(F.array(F.concat_ws("|", side, F.col(c).cast("string"))))
    return {"bank": end(F.lit("bank"), "bank"), "books": end(F.lit("books"), "books"), "own": end(F.col("side"), "record_number")}


def event_members(events: DataFrame) -> DataFrame:
    """Each event's transactions (F15): (account, seq, side, record_number); of events by unit key each member of a group,
    with its fingerprint: (account, seq, side, fingerprint, record_number). Keys in no canonical form have none."""
    if _by_key(events):
        named = F.array_compact(F.array("bank", "books", "key"))
        one = events.select("account", "seq", F.explode(named).alias("unit")).select("account", "seq", F.inline(unit_members(F.col("unit"))))
        return one.select("account", "seq", "side", "fingerprint", F.col("record").alias("record_number"))
    ends = F.array_compact(
        F.array(
            F.when(F.col("bank").isNotNull(), F.struct(F.lit("bank").alias("side"), F.col("bank").alias("record_number"))),
            F.when(F.col("books").isNotNull(), F.struct(F.lit("books").alias("side"), F.col("books").alias("record_number"))),
            F.when(F.col("record_number").isNotNull(), F.struct("side", "record_number")),
        )
    )
    return events.select("account", "seq", F.inline(ends))


def snapshots(members: DataFrame, units: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """The values of transactions when decided. batch (account, side, unit, record_number): the members of a batch, for
    which an event names the batch's first record; each of them gets a row."""
    if batch is not None:
        inside = members.withColumnRenamed("record_number", "unit").join(batch, ["account", "side", "unit"], "left")
        members = inside.select("account", "seq", "side", F.coalesce("record_number", "unit").alias("record_number"))
    return members.join(units.select("account", "side", "record_number", "day", "amount", "reference"), ["account", "side", "record_number"], "left")


def judge(events: DataFrame, checked: DataFrame, candidates: DataFrame, units: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """What the data say of each event (F3): (account, seq, allowed, present, why).

    checked: check_pairs() of the events' pairs; candidates (account, bank, books); units (account, side, record_number,
    amount) are the valid transactions; missing (account, seq) as missing_sources() tells. A suggested or set
    confirmation must be a candidate still; a manual one (events without `origin` count as such) must name every rule
    that it breaks and give a reason that is not blank; a classification must fit its unit. Other pair events are only
    held against the history, by replay().
    """
    origin = F.col("origin") if "origin" in events.columns else F.lit("manual")
    none = F.array().cast("array<string>")
    e = events.withColumn("origin", origin).join(checked.select("account", "bank", "books", "blocked", F.col("exceptions").alias("broken"), F.lit(True).alias("checked")).dropDuplicates(["account", "bank", "books"]), ["account", "bank", "books"], "left")
    e = e.join(candidates.select("account", "bank", "books", F.lit(True).alias("candidate")).distinct(), ["account", "bank", "books"], "left")
    e = e.join(fitting(units).withColumnRenamed("classification", "fits").groupBy("account", "side", "record_number").agg(F.collect_set("fits").alias("fits")), ["account", "side", "record_number"], "left")
    confirm = (
        F.when(F.col("checked").isNull(), "not in the data")
        .when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(F.col("origin").isin("suggested", "set"), F.when(F.col("candidate").isNull(), "no longer suggested"))
        .when(F.size(F.array_except(F.coalesce("broken", none), F.coalesce("exceptions", none))) > 0, "a broken rule is not named")
        .when((F.size(F.coalesce("broken", none)) > 0) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason")
    )
    own = F.when(F.col("fits").isNull(), "not in the data").when((F.col("action") == "classify") & ~F.array_contains("fits", F.col("classification")), "does not fit")
    why = F.when(F.col("action") == "confirm", confirm).when(F.col("action").isin("classify", "clear"), own)
    gone = (missing if missing is not None else events.select("account", "seq").limit(0)).select("account", "seq", F.lit(True).alias("gone")).distinct()
    e = e.join(gone, ["account", "seq"], "left").withColumn("why", F.when(F.col("gone"), F.lit("its source is not loaded")).otherwise(why))
    return e.select("account", "seq", F.col("why").isNull().alias("allowed"), F.col("gone").isNull().alias("present"), "why")


#: Accounts with more events than this are replayed by components of linked events, all others each as a whole.
WHOLE = 200_000


def replay(events: DataFrame, verdicts: DataFrame | None = None, state: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Walks each history by seq: the events by record or by unit key, each with its outcome and, if it lapsed, why.

    verdicts: what the data say, by event (account, seq, allowed, present, why) as judge() gives it, or by pair (account,
    bank, books, allowed) for confirmations; a pair that is not there is not allowed. Without verdicts only the history
    itself is held against its own rules (F1): a transaction has one active match, also as a member of a group; a pair of
    units is active, rejected or neither; a unit with a matched transaction is not classified, and only what is classified
    is cleared. An event that its source, the data or the history refuses lapses. An unmatch of a pair whose confirmation
    lapsed is skipped, once for all lapses before it; rejections survive, and a confirmation may take a unit that is
    classified. state: what histories before these events have come to, as facts() tells; the walk starts from there.

    A history is a stream in one task, which holds its live state alone. Where an account has more than WHOLE events, those
    that share no transaction, not even through others, do not touch each other, and each component is a stream of its own.
    few: events that are known to name few transactions are walked in one task, and not counted first.
    """
    own = ["key"] if _by_key(events) else ["side", "record_number"]
    shown = ["account", "seq", "action", "bank", "books", *own, "classification"]
    if verdicts is None:
        judged = events.withColumns({"allowed": F.lit(True), "present": F.lit(True), "why": F.lit(None).cast("string")})
    elif "seq" in verdicts.columns:
        why = F.col("why") if "why" in verdicts.columns else F.lit(None).cast("string").alias("why")
        judged = events.drop("allowed", "present", "why").join(verdicts.select("account", "seq", "allowed", "present", why), ["account", "seq"], "left")
    else:
        judged = events.drop("allowed", "present", "why").join(verdicts.select("account", "bank", "books", "allowed"), ["account", "bank", "books"], "left").withColumns({"present": F.lit(True), "why": F.lit(None).cast("string")})
        judged = judged.withColumn("allowed", F.when(F.col("action") == "confirm", F.coalesce("allowed", F.lit(False))).otherwise(True))
    unit = F.col("key") if _by_key(events) else F.concat_ws("|", "side", F.col("record_number").cast("string"))
    judged = judged.select(
        *shown, F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("present", F.lit(True)).alias("present"), "why",
        *[m.alias(f"{k}_members") for k, m in _members(judged).items()], F.col("bank").cast("string").alias("bank_unit"), F.col("books").cast("string").alias("books_unit"), unit.alias("own_unit"), F.lit(False).alias("given"),
    )
    if state is not None:
        judged = judged.unionByName(_given(state), allowMissingColumns=True)
    many = None if few else events.groupBy("account").count().filter(F.col("count") > WHOLE)
    if few or many.isEmpty():
        dealt = judged.withColumn("component", F.xxhash64("account"))
    else:
        dealt = _apart(judged, many.select("account"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*judged.select(*shown).schema.fields, StructField("outcome", StringType()), StructField("reason_lapsed", StringType())])
    dealt = dealt.coalesce(1) if few else dealt.repartition(parts, "component")
    return dealt.sortWithinPartitions("component", "account", "seq").mapInArrow(_walk, schema)


def _apart(judged: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with the component of events and facts that share transactions, in the accounts that are too long to be whole."""
    node = F.struct("account", F.lit("event").alias("kind"), F.concat_ws("|", F.col("seq").cast("string"), F.col("given").cast("string"), "bank_unit", "books_unit", "own_unit").alias("name"))
    long = judged.join(accounts, "account", "left_semi").withColumn("node", node)
    member = F.explode(F.concat("bank_members", "books_members", "own_members"))
    edges = long.select("node", "account", member.alias("name")).select(F.col("node").alias("a"), F.struct("account", F.lit("member").alias("kind"), "name").alias("b"))
    named = long.join(components(edges, "a", "b"), "node", "left").withColumn("component", F.xxhash64(F.coalesce("component", "node"))).drop("node")  # components of one hash may share a state
    return judged.join(accounts, "account", "left_anti").withColumn("component", F.xxhash64("account")).unionByName(named)


class _State:
    """One component's history so far."""

    def __init__(self):
        self.used: dict = {}
        self.active, self.refused, self.lapsed, self.classified = set(), set(), set(), set()

    def outcome(self, r) -> tuple[str, str | None]:
        action, account = r["action"], r["account"]
        if action == "complete":
            return "applied", None
        if action in ("classify", "clear"):
            unit = (account, r["own_unit"])
            why = (
                None if r["given"]
                else "its source is not loaded" if not r["present"]
                else "a matched transaction is not classified" if any((account, m) in self.used for m in r["own_members"])
                else "it is not classified" if action == "clear" and unit not in self.classified
                else None if r["allowed"]
                else r["why"] or "the data do not allow it"
            )
            if why is None:
                (self.classified.add if action == "classify" else self.classified.discard)(unit)
            return ("lapsed", why) if why else ("applied", None)
        edge = (account, r["bank_unit"], r["books_unit"])
        if action == "lapse":  # of a state: a confirmation that lapsed and that no unmatch has met yet
            self.lapsed.add(edge)
            return "applied", None
        if action == "unmatch" and r["present"] and edge in self.lapsed:
            self.lapsed.discard(edge)
            return "skipped", None
        members = [(account, m) for m in (*r["bank_members"], *r["books_members"])]
        why = None if r["given"] else self.against(r, edge, action)
        if why is not None:
            if action == "confirm":
                self.lapsed.add(edge)
            return "lapsed", why
        if action == "confirm":
            self.active.add(edge)
            self.used.update(dict.fromkeys(members, edge))
        elif action == "unmatch":
            self.active.discard(edge)
            for m in members:
                self.used.pop(m, None)
        else:
            (self.refused.add if action == "reject" else self.refused.discard)(edge)
        return "applied", None

    def against(self, r, edge, action) -> str | None:
        """What speaks against a pair event, in the order: source, history, data."""
        if not r["present"]:
            return "its source is not loaded"
        if action == "confirm":
            if edge in self.refused:
                return "the pair is rejected"
            for side in ("bank", "books"):
                if any((r["account"], m) in self.used for m in r[f"{side}_members"]):
                    return f"a {side} transaction is in another match" if edge not in self.active else "the pair is matched"
            return None if r["allowed"] else r["why"] or "the data do not allow it"
        if action == "unmatch":
            return None if edge in self.active else "the pair is not matched"
        if action == "reject":
            return "the pair is matched" if edge in self.active else "the pair is rejected" if edge in self.refused else None
        return "unknown action" if action != "restore" else None if edge in self.refused else "the pair is not rejected"


def _walk(batches):
    """Arrow rows in order of component and seq, with the outcome of each. Numbers stay whole, nulls stay nulls."""
    import pyarrow as pa
    import pyarrow.compute

    at, state = None, _State()
    for batch in batches:
        outcomes = []
        for r in batch.to_pylist():
            if r["component"] != at:
                at, state = r["component"], _State()
            outcomes.append(state.outcome(r))
        kept = batch.schema.names[: batch.schema.names.index("allowed")]
        out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array([o[i] for o in outcomes], pa.string()) for i in range(2)]], names=[*kept, "outcome", "reason_lapsed"])
        yield out.filter(pa.compute.invert(batch.column("given")))


#: What identifies a fact of a history's state. unit: what a classification is of.
FACT = ["account", "kind", "bank", "books", "unit"]


def facts(replayed: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What histories have come to: (account, kind, bank, books, unit, members, value, seq), a row per fact, from the outcomes
    of replay() and the state that it began with.

    kind pair: value confirm (active) or reject; lapse: a confirmation that lapsed and that no unmatch has met; unit: value
    is the classification; account: seq is the last one; complete: that of the last completion. A null value says that the
    fact holds no more, so that it can overrule an older one. Everything is a last event by key: no walk.
    """
    by_key = _by_key(replayed)
    text = lambda c: F.col(c).cast("string").alias(c)
    none = F.lit(None).cast("string")
    m = _members(replayed)
    unit = F.col("key") if by_key else F.when(F.col("record_number").isNotNull(), F.concat_ws("|", "side", F.col("record_number").cast("string")))
    rows = replayed.select("account", "seq", "action", text("bank"), text("books"), unit.alias("unit"), "classification", "outcome", F.concat(m["bank"], m["books"], m["own"]).alias("members"))
    done = F.col("outcome") == "applied"
    pair, own = F.col("action").isin(*PAIR), F.col("action").isin("classify", "clear")
    lapse = ((F.col("action") == "confirm") & (F.col("outcome") == "lapsed")) | (F.col("outcome") == "skipped")
    no_members = F.array().cast("array<string>")

    def made(when, kind, value, of_account=False):
        ends = [none.alias("bank"), none.alias("books"), none.alias("unit")] if of_account else ["bank", "books", "unit"]
        return rows.filter(when).select("account", F.lit(kind).alias("kind"), *ends, (no_members if of_account else F.col("members")).alias("members"), value.cast("string").alias("value"), "seq")

    new = made(done & pair, "pair", F.when(F.col("action").isin("confirm", "reject"), F.col("action")))
    new = new.unionByName(made(lapse & pair, "lapse", F.when(F.col("action") == "confirm", F.lit("confirm"))))
    new = new.unionByName(made(done & own, "unit", F.when(F.col("action") == "classify", F.coalesce("classification", F.lit("")))))
    new = new.unionByName(made(F.lit(True), "account", F.lit("last"), True)).unionByName(made(F.col("action") == "complete", "complete", F.lit("complete"), True))
    return latest(new if state is None else new.unionByName(state.select(new.columns)))


def latest(rows: DataFrame) -> DataFrame:
    """Of facts that tell of one thing, the one with the last seq."""
    at = F.struct("seq", "value", "members")
    return rows.groupBy(*FACT).agg(F.max(at).alias("at")).select(*FACT, F.col("at")["members"].alias("members"), F.col("at")["value"].alias("value"), F.col("at")["seq"].alias("seq"))


def _given(state: DataFrame) -> DataFrame:
    """Facts as rows that a walk takes as they are."""
    none = F.array().cast("array<string>")
    action = F.when(F.col("kind") == "lapse", "lapse").when(F.col("kind") == "unit", "classify").otherwise(F.col("value"))
    live = state.filter("value IS NOT NULL AND kind IN ('pair', 'lapse', 'unit')")
    return live.select(
        "account", "seq", action.alias("action"), F.lit(True).alias("allowed"), F.lit(True).alias("present"), F.lit(None).cast("string").alias("why"), F.col("members").alias("bank_members"), none.alias("books_members"), none.alias("own_members"),
        F.col("bank").alias("bank_unit"), F.col("books").alias("books_unit"), F.col("unit").alias("own_unit"), F.lit(True).alias("given"),
    )


def load(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of histories (F13): an account's history is taken whole or, with any problem, not at all.

    Problems are those of history_problems() and events that contradict the history before them.
    """
    walked = replay(events).filter("outcome != 'applied'").select("account", "seq", F.lit("contradicts the history before it").alias("message"))
    told = history_problems(events)
    problems = materialize(told.unionByName(walked), "history-problems")
    discard(told)
    return reading(events.join(problems.select("account").distinct(), "account", "left_anti"), problems), problems


def append(log: DataFrame, new: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused accounts): new events of an account are taken whole if they follow its last seq without a gap
    and none of them would lapse, else not at all. Only histories that get new events are replayed; `advance` starts from
    a state that was kept, History keeps it in a folder."""
    touched = log.join(new.select("account").distinct(), "account", "left_semi")
    bad = out_of_turn(new, touched.groupBy("account").agg(F.max("seq").alias("last")))
    failed = replay(touched.unionByName(new), verdicts).join(new.select("account", "seq"), ["account", "seq"], "left_semi").filter("outcome != 'applied'").select("account")
    bad = bad.unionByName(failed).distinct()
    return new.join(bad, "account", "left_anti"), bad


def out_of_turn(new: DataFrame, last: DataFrame) -> DataFrame:
    """Accounts whose new events do not follow the last seq (account, last) one by one."""
    return turns(new, last).filter("out_of_turn").select("account")


def turns(new: DataFrame, last: DataFrame, *more: Column) -> DataFrame:
    """(account, out_of_turn, ...): whether an account's new events do not follow its last seq one by one."""
    once = F.countDistinct("seq") == F.count("*")
    asked = new.groupBy("account").agg(F.min("seq").alias("low"), (once & (F.max("seq") - F.min("seq") + 1 == F.count("*"))).alias("whole"), *more)
    out = (F.col("low") != F.coalesce("last", F.lit(0)) + 1) | ~F.col("whole")
    return asked.join(last, "account", "left").withColumn("out_of_turn", out).drop("low", "whole", "last")


def advance(state: DataFrame, new: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(replayed, refused accounts): new events walked from the state (facts) that histories have come to, so the time does
    not depend on how long they are. Only facts of the transactions that new events name are walked through; which accounts
    are taken is as in append()."""
    named = new.select("account", F.explode(F.concat(*_members(new).values())).alias("member")).distinct()
    met = state.withColumn("member", F.explode("members")).join(named, ["account", "member"], "left_semi").drop("member").distinct()
    replayed = replay(new, verdicts, met)
    last = state.filter("kind = 'account'").select("account", F.col("seq").alias("last"))
    bad = out_of_turn(new, last).unionByName(replayed.filter("outcome != 'applied'").select("account")).distinct()
    return replayed, bad
