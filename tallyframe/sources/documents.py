"""Versioned JSON documents: outstanding items and sessions with their decision log.

A document is read as a variant, so that a number where text is due is told and not read as text, and is taken whole or
not at all: with any problem its rows appear only among the problems. Documents are written one to a line, one for each
account (and session); their lists also exist as tables, which is the form for lists of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, decimals
from ..functions.text import is_sha256, is_txn_key, is_unit_key
from ..operators.decisions import PAIR
from ..scratch import materialize, reading
from . import pieces

OUTSTANDING, SESSION, VERSION = "outstanding-items", "reconciliation-session", 1
#: What events may say.
ACTIONS, ORIGINS = (*PAIR, "classify", "complete"), ("suggested", "manual", "set")
CLASSIFICATIONS, RULES = ("outstanding-payment", "deposit-in-transit", "record-in-books", "investigate"), ("amount", "date", "reference")


def _documents(spark: SparkSession, paths: list[str], lines: bool) -> DataFrame:
    """(file, doc): a document for each file, or for each line."""
    rows = spark.read.text(paths, wholetext=not lines)
    at = F.concat_ws("#", F.col("_metadata.file_path"), F.xxhash64("value").cast("string")) if lines else F.col("_metadata.file_path")
    return rows.select(at.alias("file"), F.try_parse_json("value").alias("doc"))


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", kind)


def _kind(doc: Column, path: str) -> Column:
    """The JSON type of a value: STRING, BIGINT, VOID for null, ...; null if it is not there."""
    return F.schema_of_variant(_get(doc, path, "variant"))


def _text(doc: Column, path: str) -> Column:
    return F.when(_kind(doc, path) == "STRING", _get(doc, path, "string"))


def _day(doc: Column, path: str) -> Column:
    return dates.parse_date(_text(doc, path), "YYYY-MM-DD")


def _whole(doc: Column, path: str) -> Column:
    return F.when(_kind(doc, path) == "BIGINT", _get(doc, path, "long"))


def _list(doc: Column, path: str) -> Column:
    return F.when(F.startswith(_kind(doc, path), F.lit("ARRAY")), _get(doc, path, "array<variant>"))


def _told(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """(file, place, message) of each check that does not hold; a null does not hold."""
    said = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)) for holds, message in checks]))
    return rows.select("file", "place", F.explode(said).alias("message"))


def _text_or_null(doc: Column, path: str) -> Column:
    return F.coalesce(_kind(doc, path).isin("STRING", "VOID"), F.lit(False))


def _period_checks(doc: Column, path: str) -> list[tuple[Column, str]]:
    start, end = _day(doc, f"{path}.start"), _day(doc, f"{path}.end")
    return [(start.isNotNull() & end.isNotNull(), f"{path} must have two dates"), (F.coalesce(start <= end, F.lit(True)), f"{path} ends before it starts")]


def read_outstanding(spark: SparkSession, paths: list[str], lines: bool = False) -> dict[str, DataFrame]:
    """files, items, cleared and problems of outstanding-items documents.

    files (file, session_id, account, currency, minor_units, period_start, period_end); items (file, nth, lineage, side,
    day, amount as exact text, reference, description and where the item came from); cleared (file, lineage).
    """
    docs = _documents(spark, paths, lines)
    doc, item = F.col("doc"), F.col("item")
    minor = _whole(doc, "minorUnits")
    heads = docs.withColumn("place", F.lit("document"))
    no_doc = _told(heads, (doc.isNotNull(), "not a JSON document"))
    said = _told(
        heads.filter("doc is not null"),
        (_text(doc, "format") == OUTSTANDING, "not an outstanding-items document"),
        (_whole(doc, "version") == VERSION, "its version is not supported"),
        (_list(doc, "items").isNotNull() & _list(doc, "cleared").isNotNull(), "items or cleared is not a list"),
        (minor.between(0, 4), "minorUnits must be from 0 to 4"),
        *[(_text(doc, c).isNotNull(), f"{c} must be text") for c in ("exportedAt", "sessionId", "account", "currency")],
        *_period_checks(doc, "period"),
    )
    listed = docs.select("file", minor.alias("minor"), F.posexplode(_list(doc, "items")).alias("nth", "item"))
    plain = decimals.clean(F.coalesce(_text(item, "amount"), F.lit("")))
    value = plain.try_cast("decimal(38,4)")
    of_items = _told(
        listed.withColumn("place", F.concat(F.lit("items["), F.col("nth").cast("string"), F.lit("]"))),
        (plain.isNotNull() & (decimals.fraction_digits(plain) <= F.col("minor")), "amount must be exact decimal text of the currency"),
        (F.coalesce(value != 0, F.lit(True)), "amount is zero"),
        (F.coalesce(_text(item, "direction") == F.when(value > 0, "in").otherwise("out"), value.isNull()), "its direction is not that of its amount"),
        (_text(item, "side").isin("bank", "books"), "side must be bank or books"),
        (_day(item, "date").isNotNull(), "date must be a date"),
        (_text(item, "lineage").isNotNull(), "lineage must be text"),
        *[(_text_or_null(item, c), f"{c} must be text or null") for c in ("reference", "description")],
        (_whole(item, "origin.recordNumber") >= 1, "origin.recordNumber is not a number from 1 on"),
        *[(_text(item, f"origin.{c}").isNotNull(), f"origin.{c} must be text") for c in ("sessionId", "fileName", "fingerprint")],
        *_period_checks(item, "origin.period"),
    )
    gone = docs.select("file", F.posexplode(_list(doc, "cleared")).alias("nth", "item"))
    of_cleared = _told(gone.withColumn("place", F.concat(F.lit("cleared["), F.col("nth").cast("string"), F.lit("]"))), (F.schema_of_variant("item") == "STRING", "must be text"))
    problems = no_doc.unionByName(said).unionByName(of_items).unionByName(of_cleared)
    sound = lambda df: df.join(problems.select("file").distinct(), "file", "left_anti")
    text = lambda c, name: _text(item, c).alias(name)
    return {
        "files": sound(docs.select("file", _text(doc, "sessionId").alias("session_id"), _text(doc, "account").alias("account"), _text(doc, "currency").alias("currency"), minor.cast("int").alias("minor_units"), _day(doc, "period.start").alias("period_start"), _day(doc, "period.end").alias("period_end"))),
        "items": sound(
            listed.select(
                "file", "nth", text("lineage", "lineage"), text("side", "side"), _day(item, "date").alias("day"), text("amount", "amount"), text("reference", "reference"), text("description", "description"),
                text("origin.sessionId", "origin_session"), _day(item, "origin.period.start").alias("origin_start"), _day(item, "origin.period.end").alias("origin_end"), text("origin.fileName", "origin_file"), text("origin.fingerprint", "fingerprint"), _whole(item, "origin.recordNumber").alias("record_number"),
            )
        ),
        "cleared": sound(gone.select("file", F.expr("try_variant_get(item, '$', 'string')").alias("lineage"))),
        "problems": problems,
    }


def _outstanding(files: DataFrame, items: DataFrame, exported_at: str) -> tuple[list, Column]:
    """(fields of the document's head from files, one item from items)"""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    value = F.col("amount").try_cast("decimal(38,4)")
    origin = F.struct(F.col("origin_session").alias("sessionId"), F.struct(day("origin_start").alias("start"), day("origin_end").alias("end")).alias("period"), F.col("origin_file").alias("fileName"), "fingerprint", F.col("record_number").alias("recordNumber"))
    one = F.struct("side", day("day").alias("date"), "lineage", "amount", F.when(value > 0, "in").otherwise("out").alias("direction"), "reference", "description", origin.alias("origin"))
    head = [
        F.lit(OUTSTANDING).alias("format"), F.lit(VERSION).alias("version"), F.lit(exported_at).alias("exportedAt"), F.col("session_id").alias("sessionId"), F.col("account"), F.col("currency"), F.col("minor_units").alias("minorUnits"),
        F.struct(day("period_start").alias("start"), day("period_end").alias("end")).alias("period"),
    ]
    return head, one


def outstanding_documents(files: DataFrame, items: DataFrame, cleared: DataFrame, exported_at: str) -> DataFrame:
    """One row per account with the whole document as a struct; the columns are those of read_outstanding, by account.

    Items are in the order of side, day and lineage, cleared lineages in their own. outstanding_pieces() is the form for
    documents of any length.
    """
    head, one = _outstanding(files, items, exported_at)
    of_items = items.groupBy("account").agg(F.array_sort(F.collect_list(one)).alias("items"))
    of_cleared = cleared.groupBy("account").agg(F.array_sort(F.collect_set("lineage")).alias("cleared"))
    docs = files.join(of_items, "account", "left").join(of_cleared, "account", "left")
    no_items = F.array().cast(of_items.schema["items"].dataType)
    return docs.select(*head, F.coalesce("items", no_items).alias("items"), F.coalesce("cleared", F.array().cast("array<string>")).alias("cleared"))


def outstanding_pieces(files: DataFrame, items: DataFrame, cleared: DataFrame, exported_at: str) -> DataFrame:
    """The same documents as lines for pieces.write(): no account's items are gathered. Two accounts of one name would be
    one document, so files has each account once."""
    head, one = _outstanding(files, items, exported_at)
    heads = files.select(F.col("account").alias("name"), *head)
    listed = items.select(F.col("account").alias("name"), one.alias("item"), "side", "day", "lineage")
    gone = cleared.select(F.col("account").alias("name"), F.col("lineage").alias("item")).distinct()
    return pieces.lines(heads, {"items": (listed, ["side", "day", "lineage"]), "cleared": (gone, [])}, by="name")


def write_documents(docs: DataFrame, folder: str) -> None:
    docs.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_sessions(spark: SparkSession, paths: list[str], lines: bool = False) -> dict[str, DataFrame]:
    """sessions, events, snapshots and problems of session documents.

    What the events say of each other (a pair confirmed twice, ...) is for decisions.load to judge, which takes or
    refuses a history whole as well. sessions keep mappings, accounting and opening as JSON text.
    """
    docs = _documents(spark, paths, lines)
    doc, e = F.col("doc"), F.col("item")
    heads = docs.withColumn("place", F.lit("document"))
    stamp = lambda c, path: F.try_to_timestamp(_text(c, path)).isNotNull()
    said = _told(heads, (doc.isNotNull(), "not a JSON document")).unionByName(
        _told(
            heads.filter("doc is not null"),
            (_text(doc, "format") == SESSION, "not a session document"),
            (_whole(doc, "version") == VERSION, "its version is not supported"),
            *[(_text(doc, c).isNotNull(), f"{c} must be text") for c in ("id", "context.account", "context.currency")],
            (_whole(doc, "context.minorUnits").between(0, 4), "context.minorUnits must be from 0 to 4"),
            (stamp(doc, "savedAt"), "savedAt must be a time"),
            (_whole(doc, "revision") >= 0, "revision must be a whole number"),
            *[(_whole(doc, f"rules.{c}") >= 0, f"rules.{c} must be a whole number") for c in ("bankDaysBefore", "bankDaysAfter")],
            *[(_kind(doc, f"rules.{c}") == "BOOLEAN", f"rules.{c} must be true or false") for c in ("referencesShared", "referenceCaseInsensitive")],
            *[(is_sha256(_text(doc, f"sources.{s}.fingerprint")), f"sources.{s}.fingerprint must be a SHA-256") for s in ("bank", "books")],
            *[(_list(doc, c).isNotNull(), f"{c} must be a list") for c in ("events", "snapshots")],
        )
    )
    of = lambda what: docs.select("file", F.posexplode(_list(doc, what)).alias("nth", "item")).withColumn("place", F.concat(F.lit(f"{what}["), F.col("nth").cast("string"), F.lit("]")))
    events, snaps = of("events"), of("snapshots")
    action, pair = _text(e, "action"), _text(e, "action").isin(*PAIR)
    unless = lambda applies, holds: ~F.coalesce(applies, F.lit(False)) | F.coalesce(holds, F.lit(False))
    broken = _list(e, "exceptions")
    names = F.transform(broken, lambda x: F.call_function("try_variant_get", x, F.lit("$"), F.lit("string")))
    of_events = _told(
        events,
        (_whole(e, "seq") == F.col("nth") + 1, "the history must be complete and in order"),
        (action.isin(*ACTIONS), "unknown action"),
        (stamp(e, "at"), "at must be a time"),
        (unless(action == "complete", _text(e, "basis").isNotNull()), "basis must be text"),
        (unless(action == "classify", is_unit_key(_text(e, "key"))), "not a transaction key"),
        (unless((action == "classify") & (_kind(e, "classification") != "VOID"), _text(e, "classification").isin(*CLASSIFICATIONS)), "unknown classification"),
        *[(unless(pair, is_unit_key(_text(e, s), s)), f"not a {s} transaction key") for s in ("bank", "books")],
        (unless(action == "confirm", _text(e, "origin").isin(*ORIGINS)), "unknown origin"),
        (unless((action == "confirm") & broken.isNotNull(), F.forall(names, lambda x: F.coalesce(x.isin(*RULES), F.lit(False)))), "unknown rule"),
        (unless((action == "confirm") & (F.size(broken) > 0), F.trim(_text(e, "reason")) != ""), "breaks rules without a reason"),
    )
    of_snaps = _told(
        snaps,
        (is_txn_key(_text(e, "key")), "not a transaction key"),
        (_day(e, "date").isNotNull(), "date must be a date"),
        (decimals.clean(_text(e, "amount")).isNotNull(), "amount must be exact decimal text"),
        (_text(e, "direction").isin("in", "out"), "direction must be in or out"),
        *[(_text_or_null(e, c), f"{c} must be text or null") for c in ("reference", "description")],
    )
    # judged once, for all that is read of sound documents
    problems = materialize(said.unionByName(of_events).unionByName(of_snaps), "session-problems")
    sound = lambda df: reading(df.join(problems.select("file").distinct(), "file", "left_anti"), problems)
    as_text = lambda c: F.to_json(_get(doc, c, "variant"))
    return {
        "sessions": sound(docs.select("file", _text(doc, "id").alias("id"), _text(doc, "savedAt").alias("saved_at"), _whole(doc, "revision").alias("revision"), _text(doc, "context.account").alias("account"), _text(doc, "context.currency").alias("currency"), _whole(doc, "context.minorUnits").cast("int").alias("minor_units"), *[as_text(c).alias(c) for c in ("rules", "sources", "mappings", "accounting", "opening")])),
        "events": sound(events.select("file", _whole(e, "seq").alias("seq"), _text(e, "at").alias("at"), F.when((action == "classify") & (_kind(e, "classification") == "VOID"), "clear").otherwise(action).alias("action"), _text(e, "bank").alias("bank"), _text(e, "books").alias("books"), _text(e, "key").alias("key"), _text(e, "classification").alias("classification"), _text(e, "origin").alias("origin"), names.alias("exceptions"), _text(e, "reason").alias("reason"), _text(e, "basis").alias("basis"))),
        "snapshots": sound(snaps.select("file", _text(e, "key").alias("key"), _day(e, "date").alias("day"), _text(e, "amount").alias("amount"), _text(e, "direction").alias("direction"), _text(e, "reference").alias("reference"), _text(e, "description").alias("description"))),
        "problems": problems,
    }


def session_documents(sessions: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per session (file) with the whole document as JSON text (value), of the tables that read_sessions gives."""
    own = F.col("action").isin("classify", "clear")
    event = F.struct("seq", "at", F.when(F.col("action") == "clear", "classify").otherwise(F.col("action")).alias("action"), "bank", "books", "key", "classification", "origin", "exceptions", "reason", "basis")
    # fields that an event of its kind does not have are left out, a classification that is cleared is null
    text = F.when(own & F.col("classification").isNull(), F.regexp_replace(F.to_json(event), r"\}\z", ',"classification":null}')).otherwise(F.to_json(event))
    listed = events.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("e"))
    snap = F.struct("key", F.date_format("day", "yyyy-MM-dd").alias("date"), "amount", "direction", "reference", "description")
    shown = snapshots.groupBy("file").agg(F.array_sort(F.collect_list(F.to_json(snap, {"ignoreNullFields": "false"}))).alias("s"))
    j = sessions.join(listed, "file", "left").join(shown, "file", "left")
    head = F.to_json(F.struct(F.lit(SESSION).alias("format"), F.lit(VERSION).alias("version"), "id", F.col("saved_at").alias("savedAt"), "revision", F.struct("account", "currency", F.col("minor_units").alias("minorUnits")).alias("context")))
    array = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), c))
    rest = F.concat_ws(",", *[part(c, F.col(c)) for c in ("rules", "sources", "mappings", "accounting", "opening")], part("events", array(F.transform("e", lambda x: x["t"]))), part("snapshots", array(F.col("s"))))
    return j.select("file", F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(","), rest, F.lit("}")).alias("value"))


def write_sessions(docs: DataFrame, folder: str) -> None:
    docs.select("value").write.mode("overwrite").text(folder)
