"""Carrying outstanding items from one period into the next (H1-H9)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchingRules
from ..functions import decimals
from ..functions.text import lineage
from ..scratch import discard, materialize, reading
from . import classes, match
from .numbering import numbered

ITEM = "file string, account string, currency string, period_end date, side string, record_number long, day date, amount string, reference string, lineage string"


def item_problems(items: DataFrame, minor: int = 2) -> DataFrame:
    """(file, lineage, message) of items that refuse their whole file. Amounts are exact decimal text with at most
    `minor` decimals, further zeros aside; a direction, where items have one, is that of the sign."""
    plain = decimals.clean(F.col("amount"))
    value = plain.try_cast("decimal(38,4)")
    way = F.when(F.col("direction") != F.when(value > 0, "in").otherwise("out"), F.lit("direction does not match the sign")) if "direction" in items.columns else F.lit(None).cast("string")
    said = F.array_compact(
        F.array(
            F.when(~F.coalesce(plain.isNotNull() & (decimals.fraction_digits(plain) <= minor), F.lit(False)), F.lit("amount is not a decimal of the currency")),
            F.when(value == 0, F.lit("amount is zero")),
            way,
            F.when(~F.coalesce(F.col("side").isin("bank", "books"), F.lit(False)), F.lit("unknown side")),
            F.when(F.col("day").isNull(), F.lit("no date")),
            F.when(F.trim(F.coalesce("lineage", F.lit(""))) == "", F.lit("no provenance")),
        )
    )
    return items.select("file", "lineage", F.explode(said).alias("message"))


def import_problems(items: DataFrame, target: DataFrame, imported: DataFrame, cleared: DataFrame, own_cleared: DataFrame | None = None) -> DataFrame:
    """(file, lineage, severity, message). target (account, currency, period_start, minor_units where items have them);
    imported and cleared (lineage) of files taken before; own_cleared (file, lineage) is what the files say is cleared."""
    precise = "minor_units" in items.columns and "minor_units" in target.columns
    more = [F.col("minor_units").alias("own_units")] if precise else []
    j = items.join(target.select("account", F.col("currency").alias("own"), "period_start", *more), "account", "left")
    say = lambda when, severity, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    header = F.array_compact(
        F.array(
            say(F.col("period_start").isNull(), "error", "another account"),
            say(F.col("own") != F.col("currency"), "error", "another currency"),
            *([say(F.col("own_units") != F.col("minor_units"), "error", "another precision")] if precise else []),
            say(F.col("period_end") >= F.col("period_start"), "error", "its period is not before this one"),
            say(F.datediff("period_start", "period_end") > 1, "warning", "a gap between the periods"),
            say(F.col("day") >= F.col("period_start"), "error", "dated inside the period"),
        )
    )
    error = lambda df, message: df.select("file", "lineage", F.lit("error").alias("severity"), F.lit(message).alias("message"))
    out = j.select("file", "lineage", F.inline(header))
    out = out.unionByName(error(items.groupBy("file", "lineage").agg(F.count("*").alias("n")).filter("n > 1"), "listed twice"))
    out = out.unionByName(error(items.join(imported, "lineage", "left_semi"), "already imported")).unionByName(error(items.join(cleared, "lineage", "left_semi"), "already cleared"))
    if own_cleared is not None:
        out = out.unionByName(error(items.join(own_cleared, ["file", "lineage"], "left_semi"), "listed as cleared and as outstanding"))
        out = out.unionByName(error(own_cleared.join(imported, "lineage", "left_semi"), "cleared there, but imported here as outstanding"))
    return out


def accepted(items: DataFrame, *problems: DataFrame) -> DataFrame:
    """Items of files without an error: one refuses its whole file, warnings do not."""
    for p in problems:
        bad = p.filter("severity = 'error'") if "severity" in p.columns else p
        items = items.join(bad.select("file").distinct(), "file", "left_anti")
    return items


def order_conflicts(items: DataFrame) -> DataFrame:
    """Items that an earlier file (by `place`) lists too: (place, lineage, earlier)."""
    w = Window.partitionBy("lineage").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    return items.withColumn("earlier", F.min("place").over(w)).filter("earlier is not null").select("place", "lineage", "earlier")


def import_order(items: DataFrame, cleared: DataFrame) -> DataFrame:
    """What files say against the files before them: (place, lineage, message, earlier).

    items and cleared (place, lineage): what each file lists as outstanding and as cleared; files are imported by place. A
    listed item that an earlier file lists or clears, and a clearance of what an earlier file lists, are told with the
    first such place. All that earlier files say counts, also of files that are refused. A lineage's fold over the files
    comes to its first listing and first clearance, so no lineage is gathered.
    """
    marks = items.select("place", "lineage", F.lit(True).alias("listed")).unionByName(cleared.select("place", "lineage", F.lit(False).alias("listed")))
    first = marks.groupBy("lineage").agg(F.min(F.when(F.col("listed"), F.col("place"))).alias("l"), F.min(F.when(~F.col("listed"), F.col("place"))).alias("c"))
    say = lambda when, message, earlier: F.when(when & (F.col(earlier) < F.col("place")), F.struct(F.lit(message).alias("message"), F.col(earlier).alias("earlier")))
    listed = F.col("listed")
    said = F.array_compact(F.array(say(listed, "already imported", "l"), say(listed, "already cleared", "c"), say(~listed, "cleared there, but imported here as outstanding", "l")))
    return marks.join(first, "lineage").select("place", "lineage", F.inline(said))


def overlaps(items: DataFrame, units: DataFrame) -> DataFrame:
    """Carried items equal to a current transaction on side, day, amount and reference (null equals null); reported,
    never dropped. (lineage, record_numbers)"""
    i, u = items.alias("i"), units.alias("u")
    same = (F.col("i.account") == F.col("u.account")) & (F.col("i.side") == F.col("u.side")) & (F.col("i.day") == F.col("u.day")) & (F.col("i.amount") == F.col("u.amount")) & F.col("i.reference").eqNullSafe(F.col("u.reference"))
    return i.join(u, same).groupBy("i.lineage").agg(F.array_sort(F.collect_list("u.record_number")).alias("record_numbers"))


def opening_units(items: DataFrame) -> DataFrame:
    """Carried items as units, numbered within file and side."""
    placed = numbered(items, ["file", "side"], [F.col("day"), F.col("lineage")], "item")
    return reading(placed.select("account", "side", F.col("item").cast("long").alias("item"), "file", "day", "amount", "reference", "lineage", F.lit(True).alias("is_carried")), placed)


def outstanding(open_units: DataFrame, carried: DataFrame, confirmed_lineages: DataFrame) -> DataFrame:
    """Items for the next period: unmatched units of this one with a new lineage, and carried ones not yet cleared.

    A batch is one item as it is one unit: its first record, latest day and sum, described by its name and size.
    """
    has = open_units.columns
    text = F.col("description") if "description" in has else F.lit(None).cast("string")
    if "batch" in has and "members" in has:
        text = F.when(F.col("batch").isNotNull() & (F.col("members") > 1), F.concat(F.lit("Batch "), "batch", F.lit(": "), F.col("members").cast("string"), F.lit(" records"))).otherwise(text)
    new = open_units.select("account", "side", "day", "amount", "reference", text.alias("description"), lineage(F.col("side"), F.col("fingerprint"), F.col("record_number")).alias("lineage"), F.lit(False).alias("inherited"))
    old_text = F.col("description") if "description" in carried.columns else F.lit(None).cast("string")
    old = carried.join(confirmed_lineages, "lineage", "left_anti").select("account", "side", "day", "amount", "reference", old_text.alias("description"), "lineage", F.lit(True).alias("inherited"))
    return new.unionByName(old)


def cleared_lineages(inherited: DataFrame, consumed: DataFrame) -> DataFrame:
    return inherited.select("lineage").union(consumed.select("lineage")).distinct()


def chain(sides: DataFrame, periods: list[tuple[str, str, str]], decide: Callable[[DataFrame], DataFrame] | None, rules: MatchingRules = MatchingRules()) -> dict[str, DataFrame]:
    """Runs periods one after the other, each with the items that the one before left outstanding (H9).

    sides (account, side, fingerprint, record_number, day, amount, reference, description) holds the units of all
    periods; periods are (name, first day, last day) in order; decide takes candidates and gives the confirmed (account,
    bank, books); without it, units that are each other's first candidate are, for which no candidates are made. A carried unit keeps its lineage and the negative of its record number.

    Returns `sums` (period, account, side, opening, movement, matched, outstanding; opening + movement = matched +
    outstanding), `items` outstanding at the end of each period (period and what outstanding() gives) and `cleared`
    (period, lineage), all that have been cleared so far. Each period's items are written before the next one starts.
    """
    carried = sides.limit(0).select("account", "side", "record_number", "day", "amount", "reference", "description").withColumn("lineage", F.lit(None).cast("string"))
    gone = carried.select("lineage")
    sums, items, cleared, kept = [], [], [], []
    for name, first, last in periods:
        own = sides.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        pool = materialize(own.withColumns({"is_carried": F.lit(False), "lineage": lineage(F.col("side"), F.col("fingerprint"), F.col("record_number"))}).drop("fingerprint").unionByName(carried.withColumn("is_carried", F.lit(True))), "pool")
        of = lambda side, pool=pool: pool.filter(F.col("side") == side)
        chosen = classes.mutual_firsts(of("bank"), of("books"), rules) if decide is None else decide(match.candidates(of("bank"), of("books"), rules))
        confirmed = materialize(chosen.select("account", "bank", "books"), "confirmed")
        used = confirmed.select("account", F.lit("bank").alias("side"), F.col("bank").alias("record_number")).unionByName(confirmed.select("account", F.lit("books").alias("side"), F.col("books").alias("record_number")))
        marked = pool.join(used.distinct().withColumn("used", F.lit(True)), ["account", "side", "record_number"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
        marked = materialize(marked, "marked")
        discard(pool, confirmed)
        kept.append(marked)
        total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0)).alias(c)
        sums.append(marked.groupBy("account", "side").agg(total(F.col("is_carried"), "opening"), total(~F.col("is_carried"), "movement"), total(F.col("used"), "matched"), total(~F.col("used"), "outstanding")).withColumn("period", F.lit(name)))
        left = marked.filter("not used")
        items.append(left.select(F.lit(name).alias("period"), "account", "side", "day", "amount", "reference", "description", "lineage", F.col("is_carried").alias("inherited")))
        kept.append(gone)
        gone = materialize(cleared_lineages(gone, marked.filter("used and is_carried")), "cleared")
        cleared.append(gone.select(F.lit(name).alias("period"), "lineage"))
        carried = left.select("account", "side", (-F.abs("record_number")).alias("record_number"), "day", "amount", "reference", "description", "lineage")
    # all three read the tables of the periods, which go with the sums
    return {"sums": reading(reduce(DataFrame.unionByName, sums), *kept, gone), "items": reduce(DataFrame.unionByName, items), "cleared": reduce(DataFrame.unionByName, cleared)}
