"""Balances, the bridge between the sides, and statuses (G1-G13). Amounts are exact; one row per account comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import cash_balance, clean, rescaled
from ..functions.text import trim
from .numbering import numbered


def totals(units: DataFrame, side: str) -> DataFrame:
    """(account, <side>_movement, <side>_opening): items carried in are never part of the movement."""
    of = lambda carried: F.coalesce(F.sum(F.when(F.col("is_carried") == carried, F.col("amount"))), F.lit(0))
    return units.groupBy("account").agg(of(False).alias(f"{side}_movement"), of(True).alias(f"{side}_opening"))


def check_source(facts: DataFrame) -> DataFrame:
    """facts (account, opening, closing, movement, invalid): state, expected closing and difference."""
    expected = F.col("opening") + F.col("movement")
    state = F.when(F.col("opening").isNull() | F.col("closing").isNull(), "missing-balances").when(F.col("invalid") > 0, "invalid-rows").when(expected == F.col("closing"), "validated").otherwise("mismatch")
    return facts.select("account", state.alias("state"), F.when(state == "mismatch", expected).alias("expected"), F.when(state == "mismatch", F.col("closing") - expected).alias("difference"))


def running_balance(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """rows (account, record_number, amount, balance); openings (account, opening). Each balance must be the previous
    stated one plus the amount; an unreadable (null) amount or balance breaks too. (account, state, record_number, and
    the balance expected there and found)"""
    placed = numbered(rows.select("account", "record_number", "amount", "balance"), ["account"], [F.col("record_number")], "nth")
    previous = placed.select("account", (F.col("nth") + 1).alias("nth"), F.col("balance").alias("before"))
    walked = placed.join(previous, ["account", "nth"], "left").join(openings, "account", "left")
    want = F.when(F.col("nth") == 1, F.col("opening")).otherwise(F.col("before")) + F.col("amount")
    bad = F.when(F.col("amount").isNull() | F.col("balance").isNull(), "unreadable").when(~F.coalesce(want == F.col("balance"), F.lit(False)), "break")
    found = walked.withColumn("bad", bad).groupBy("account").agg(F.min_by(F.when(F.col("bad").isNotNull(), F.struct("bad", "record_number", want.alias("expected"), F.col("balance").alias("found"))), F.when(F.col("bad").isNotNull(), F.col("record_number"))).alias("b"))
    return found.select("account", F.coalesce("b.bad", F.lit("consistent")).alias("state"), *[F.col(f"b.{c}").alias(c) for c in ("record_number", "expected", "found")])


def stated_balances(stated: DataFrame, minor: int = 2) -> DataFrame:
    """stated (account, side, kind opening or closing, text, basis asset or liability) as exact amounts: (account, side,
    opening, closing, unreadable kinds). Text that is not a number of the currency gives null and is told."""
    value = cash_balance(rescaled(clean(trim(F.col("text")), grouped=True), minor), F.col("basis"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    bad = F.when(F.col("value").isNull() & (trim(F.coalesce("text", F.lit(""))) != ""), F.col("kind"))
    return stated.withColumn("value", value).groupBy("account", "side").agg(of("opening"), of("closing"), F.array_sort(F.array_compact(F.collect_list(bad))).alias("unreadable"))


def remaining(units: DataFrame, confirmed: DataFrame, side: str) -> DataFrame:
    """Sums of what no active match uses: current (<side>_unmatched) and carried (<side>_carried)."""
    rest = units.join(confirmed.select("account", F.col(side).alias("record_number")), ["account", "record_number"], "left_anti")
    of = lambda carried: F.coalesce(F.sum(F.when(F.col("is_carried") == carried, F.col("amount"))), F.lit(0))
    return rest.groupBy("account").agg(of(False).alias(f"{side}_unmatched"), of(True).alias(f"{side}_carried"), F.count("*").alias(f"{side}_open_units"))


def bridge(balances: DataFrame, sums: DataFrame, differences: DataFrame, states: DataFrame, searched: DataFrame) -> DataFrame:
    """What of the closing difference is explained.

    balances (account, bank_open, bank_close, books_open, books_close); sums of totals() and remaining() of both sides;
    differences (account, difference) of active matches; states (account, bank_state, books_state); searched (account,
    incomplete). Missing sums count as 0.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = differences.groupBy("account").agg(F.sum("difference").alias("matched_difference"))
    j = balances.join(sums, "account", "left").join(d, "account", "left").join(states, "account", "left").join(searched, "account", "left")
    opening = (F.col("bank_open") - F.col("books_open")) == (zero("bank_opening") - zero("books_opening"))
    explained = (zero("bank_carried") - zero("books_carried")) + (zero("bank_unmatched") - zero("books_unmatched")) + zero("matched_difference")
    actual = F.col("bank_close") - F.col("books_close")
    gaps = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("bank_state") == "validated", F.lit(False)), F.lit("bank source is not validated")),
            F.when(~F.coalesce(F.col("books_state") == "validated", F.lit(False)), F.lit("books source is not validated")),
            F.when(~F.coalesce(F.col("opening_ok"), F.lit(False)), F.lit("opening balances do not agree with carried items")),
            F.when(F.coalesce("incomplete", F.lit(False)), F.lit("the search is not complete")),
            F.when(~F.coalesce(F.col("unexplained") == 0, F.lit(False)), F.lit("a difference is unexplained")),
        )
    )
    out = j.withColumns({"opening_ok": opening, "explained": explained, "actual": actual}).withColumn("unexplained", F.col("actual") - F.col("explained"))
    out = out.withColumn("gaps", gaps)
    return out.select("account", "opening_ok", "explained", "actual", "unexplained", "gaps", (F.size("gaps") == 0).alias("complete"))


def unclassified(open_units: DataFrame) -> DataFrame:
    return open_units.groupBy("account").agg(F.count_if(F.col("classification").isNull()).alias("unclassified"))


def variances(confirmed: DataFrame) -> DataFrame:
    """Active matches with a difference and no reason, by account."""
    return confirmed.groupBy("account").agg(F.count_if((F.col("difference") != 0) & (F.trim(F.coalesce("reason", F.lit(""))) == "")).alias("unexplained_variances"))


def statuses(bridged: DataFrame, states: DataFrame, open_units: DataFrame, variance: DataFrame, completion: DataFrame) -> DataFrame:
    """sources_validated, bridge_complete, outstanding_reviewed, completed, can_complete and the reasons against."""
    j = bridged.join(states, "account", "left").join(unclassified(open_units), "account", "left").join(variance, "account", "left").join(completion, "account", "left")
    sources = F.coalesce((F.col("bank_state") == "validated") & (F.col("books_state") == "validated"), F.lit(False))
    reviewed = (F.coalesce("unclassified", F.lit(0)) == 0) & (F.coalesce("unexplained_variances", F.lit(0)) == 0)
    j = j.withColumns({"sources_validated": sources, "outstanding_reviewed": reviewed})
    able = F.col("sources_validated") & F.col("complete") & F.col("outstanding_reviewed")
    reasons = F.array_distinct(
        F.concat(
            "gaps",
            F.array_compact(F.array(F.when(F.coalesce("unclassified", F.lit(0)) > 0, F.lit("open items are not classified")), F.when(F.coalesce("unexplained_variances", F.lit(0)) > 0, F.lit("a variance has no reason")))),
        )
    )
    done = F.coalesce("current", F.lit(False)) & able
    return j.select("account", "sources_validated", F.col("complete").alias("bridge_complete"), "outstanding_reviewed", done.alias("completed"), able.alias("can_complete"), reasons.alias("reasons"))


def completion(events: DataFrame, setups: DataFrame) -> DataFrame:
    """Whether each account's last event is a completion on the present setup: (account, current).
    events have `basis`, setups (account, fingerprint)."""
    last = events.groupBy("account").agg(F.max_by("action", "seq").alias("action"), F.max_by("basis", "seq").alias("basis"))
    return last.join(setups, "account", "left").select("account", F.coalesce((F.col("action") == "complete") & (F.col("basis") == F.col("fingerprint")), F.lit(False)).alias("current"))


def mark_complete(events: DataFrame, log: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) completion events (account, seq, basis): one is taken if its account may be completed now and
    it is the next of its log. refused has the reasons (G13)."""
    last = log.groupBy("account").agg(F.max("seq").alias("last"))
    j = events.join(last, "account", "left").join(status.select("account", "can_complete", "reasons"), "account", "left")
    stale = F.col("seq") != F.coalesce("last", F.lit(0)) + 1
    why = F.concat(F.when(stale, F.array(F.lit("not the next event"))).otherwise(F.array().cast("array<string>")), F.when(~F.coalesce("can_complete", F.lit(False)), F.coalesce("reasons", F.array(F.lit("no status")))).otherwise(F.array().cast("array<string>")))
    j = j.withColumn("why", F.when(~stale & F.coalesce("can_complete", F.lit(False)), F.lit(None)).otherwise(why))
    return j.filter("why is null").select(*events.columns), j.filter("why is not null").select(*events.columns, F.col("why").alias("reasons"))
