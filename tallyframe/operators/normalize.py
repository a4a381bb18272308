"""Two sides of a reconciliation as transactions and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SideMapping
from ..functions import dates, decimals
from ..functions.text import trim
from .numbering import numbered


def _read_amounts(rows: DataFrame, cells: dict[str, str], m: SideMapping, minor: int) -> DataFrame:
    """Adds <name>_text, _plain, _value and _bad of each cell; blank gives neither value nor problem.

    Each step is a column of its own that the next ones take by name, so no text is trimmed or matched twice.
    """
    of = lambda what: {n: F.col(f"{n}_{what}") for n in cells}
    rows = rows.withColumns({f"{n}_text": trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for n, c in cells.items()})
    rows = rows.withColumns({f"{n}_plain": decimals.clean(t, grouped=m.grouped, trailing_minus=m.trailing_minus, parentheses=m.parentheses) for n, t in of("text").items()})
    rows = rows.withColumns({f"{n}_digits": decimals.fraction_digits(p) for n, p in of("plain").items()})
    rows = rows.withColumns({f"{n}_value": F.when(F.col(f"{n}_digits") <= minor, p.try_cast(f"decimal(28,{minor})")) for n, p in of("plain").items()})

    def bad(n: str) -> Column:
        t, name = F.col(f"{n}_text"), n.strip("_").replace("_", " ")
        told = lambda what: F.concat(F.lit(f"{name}: "), t, F.lit(what))
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(F.col(f"{n}_plain").isNull(), told(" is not a number"))
            .when(F.col(f"{n}_digits") > minor, told(f" has more than {minor} decimals"))
            .when(F.col(f"{n}_value").isNull(), told(" is out of range"))
        )

    return rows.withColumns({f"{n}_bad": bad(n) for n in cells})


def _cash_flow(rows: DataFrame, m: SideMapping, minor: int) -> DataFrame:
    """Adds _flow (signed amount, money in is positive) and _flow_bad (its problem). Of a split row the money-in cell is
    read to its end first, so a problem of it, a negative amount too, comes before any of the money-out cell."""
    if m.amount is not None:
        rows = _read_amounts(rows, {"_amount": m.amount}, m, minor)
        value = F.col("_amount_value")
        problem = F.coalesce("_amount_bad", F.when(value.isNull(), F.lit("no amount")))
        return rows.withColumns({"_flow_bad": problem, "_flow": F.when(F.col("_amount_bad").isNull(), -value if m.positive_is == "out" else value)})
    rows = _read_amounts(rows, {"_money_in": m.money_in, "_money_out": m.money_out}, m, minor)
    i, o = F.col("_money_in_value"), F.col("_money_out_value")
    used = (lambda v: v.isNotNull() & (v != 0)) if m.unused == "blank-or-zero" else (lambda v: v.isNotNull())
    problem = F.coalesce(
        F.col("_money_in_bad"),
        F.when(i < 0, F.lit("money in is negative")),
        F.col("_money_out_bad"),
        F.when(o < 0, F.lit("money out is negative")),
        F.when(used(i) & used(o), F.lit("money in and money out are both used")),
        F.when(i.isNull() & o.isNull(), F.lit("no amount")),
    )
    value = F.when(used(i), i).when(used(o), -o).otherwise(F.lit(0))
    rows = rows.withColumn("_flow_bad", problem)
    return rows.withColumn("_flow", F.when(F.col("_flow_bad").isNull(), value.cast(f"decimal(28,{minor})")))


def normalize_side(rows: DataFrame, side: str, m: SideMapping, minor: int = 2, scope: tuple[str, ...] = ("account",)) -> DataFrame:
    """One row per record: scope, side, record_number, day, amount, reference, description, batch, problems, status.

    Date and amount problems are told independently; status is `problem`, `zero` or `valid`. A blank or null reference
    or batch is null. Names of the steps on the way begin with an underscore and replace columns of such names.
    """
    m.check(rows.columns, minor)
    rows = _cash_flow(rows, m, minor).withColumn("_date", trim(F.coalesce(F.col(f"`{m.date}`").cast("string"), F.lit(""))))
    rows = rows.withColumn("_date_fits", dates.fits(F.col("_date"), m.date_format))
    rows = rows.withColumn("_day", F.when(F.col("_date_fits"), dates.read(F.col("_date"), m.date_format)))
    rows = rows.withColumn("_date_bad", dates.problem(F.col("_date"), F.col("_date_fits"), F.col("_day"), m.date_format))
    word = lambda c: F.nullif(trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c else F.lit(None).cast("string")
    told = lambda field, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(field).alias("field"), F.col(c).alias("message")))
    problems = F.array_compact(F.array(told("date", "_date_bad"), told("amount", "_flow_bad")))
    status = F.when(F.col("_date_bad").isNotNull() | F.col("_flow_bad").isNotNull(), "problem").when(F.col("_flow") == 0, "zero").otherwise("valid")
    read = F.struct(F.col("_day").alias("day"), F.col("_flow").alias("amount"), word(m.reference).alias("reference"), word(m.description).alias("description"), word(m.batch).alias("batch"), problems.alias("problems"), status.alias("status"))
    # a generator of one row: filters on what was read stay behind it, where they take it as a column; moved before the
    # steps, they would hold every step again for each use of it
    return rows.select(*scope, F.lit(side).alias("side"), F.col("record_number").cast("long").alias("record_number"), F.inline_outer(F.array(read)))


def problem_rows(side: DataFrame) -> DataFrame:
    return side.select(*[c for c in ("account",) if c in side.columns], "side", "record_number", F.inline("problems"))


def problems_by_record(side: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Problem and zero rows, fields and messages listed date first, with the record as it came (`cells`) where originals
    (record_number and the columns of the source) are given. Order by record_number to show them."""
    out = side.filter("status != 'valid'").select("side", "record_number", "status", F.transform("problems", lambda p: p["field"]).alias("fields"), F.transform("problems", lambda p: p["message"]).alias("messages"))
    if originals is None:
        return out
    cells = F.struct(*[F.col(f"`{c}`") for c in originals.columns if c != "record_number"])
    return out.join(originals.select("record_number", cells.alias("cells")), "record_number", "left")


def side_summary(side: DataFrame, scope: tuple[str, ...] = ("account",), batch_problems: DataFrame | None = None, by_batch: bool = False) -> DataFrame:
    """Counts of a side. `matchable` leaves out valid rows whose batch has a problem (batch_problems of batch_units).

    by_batch: a batch has a problem if one of its own records in `side` has; this is told from counts by batch, in one
    reading of the side and without a join. Rows without a batch are each on their own.
    """
    valid = F.col("status") == "valid"
    counts = {
        "records": F.count("*"),
        "valid": valid,
        "matchable": valid & F.col("blocked").isNull(),
        "money_in": valid & (F.col("amount") > 0),
        "money_out": valid & (F.col("amount") < 0),
        "zero": F.col("status") == "zero",
        "problem_records": F.col("status") == "problem",
        "problems": F.coalesce(F.sum(F.size("problems")), F.lit(0)).cast("long"),
    }
    if by_batch:
        side = side.withColumn("blocked", F.lit(None).cast("boolean"))
    elif batch_problems is not None:
        side = side.join(batch_problems.select(*scope, "record_number", F.lit(True).alias("blocked")).distinct(), [*scope, "record_number"], "left")
    else:
        side = side.withColumn("blocked", F.lit(None).cast("boolean"))
    aggs = [(c if n in ("records", "problems") else F.count_if(c)).alias(n) for n, c in counts.items()]
    if not by_batch:
        return side.groupBy(*scope, "side").agg(*aggs, F.countDistinct("batch").alias("batches"))
    whole = side.groupBy(*scope, "side", "batch").agg(*aggs)
    whole = whole.withColumn("matchable", F.when(F.col("batch").isNotNull() & (F.col("problem_records") > 0), F.lit(0)).otherwise(F.col("matchable")))
    return whole.groupBy(*scope, "side").agg(*[F.sum(n).alias(n) for n in counts], F.count("batch").alias("batches"))


def side_sample(rows: DataFrame, side: DataFrame, most: int = 10, scope: tuple[str, ...] = ("account",)) -> DataFrame:
    """The first `most` records of each scope as they came beside what was read of them: a report of fixed length."""
    nth = F.row_number().over(Window.partitionBy(*scope).orderBy("record_number"))
    return side.withColumn("nth", nth).filter(F.col("nth") <= most).join(rows.select("record_number", *[c for c in rows.columns if c not in side.columns]), "record_number")


def batch_units(rows: DataFrame, amount: str = "amount", scope: tuple[str, ...] = ("account",)) -> tuple[DataFrame, DataFrame]:
    """(units, problems) of rows (scope, record_number, day, amount, reference, batch, has_problem).

    Rows of a batch become one unit: exact sum, latest day, no reference, the first record's number. A batch of one
    row stays as it is; rows without a batch are units. A batch with a problem record or with both directions is not
    matched: a problem for each of its good members. Rows with amount 0 are no members. One shuffle by batch, with
    partial sums first.
    """
    keys = [*scope, "batch"]
    a = F.col(amount)
    member = ~F.coalesce(F.col("has_problem"), F.lit(False)) & (a != 0)
    single = rows.filter(F.col("batch").isNull() & member).select(*scope, "record_number", F.lit(None).cast("string").alias("batch"), "day", a.alias("amount"), "reference", F.lit(1).cast("long").alias("members"))
    grouped = (
        rows.filter(F.col("batch").isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(F.when(member, F.col("record_number"))).alias("record_number"),
            F.max(F.when(member, F.col("day"))).alias("day"),
            F.sum(F.when(member, a)).alias("amount"),
            F.min(F.when(member, F.col("reference"))).alias("reference"),
            F.count_if(member).alias("members"),
            F.bool_or(F.coalesce(F.col("has_problem"), F.lit(False))).alias("broken"),
            (F.min(F.when(member, F.signum(a))) != F.max(F.when(member, F.signum(a)))).alias("mixed"),
        )
        .filter("members > 0 or broken")
    )
    good = grouped.filter(~F.col("broken") & ~F.coalesce(F.col("mixed"), F.lit(False)) & (F.col("members") > 0))
    units = good.select(*scope, "record_number", F.col("batch").cast("string").alias("batch"), "day", "amount", F.when(F.col("members") == 1, F.col("reference")).alias("reference"), "members")
    bad = grouped.filter(F.col("broken") | F.col("mixed")).select(*keys, "broken")
    message = F.when(F.col("broken"), F.lit("batch has a record with a problem")).otherwise(F.lit("batch mixes money in and money out"))
    problems = rows.filter(member).join(bad, keys).select(*scope, "record_number", "batch", message.alias("message"))
    return units.unionByName(single), problems


def batch_members(rows: DataFrame, units: DataFrame, scope: tuple[str, ...] = ("account",)) -> DataFrame:
    """(scope, unit record_number, member record_number, nth) of batch units, in record order."""
    named = units.filter("batch is not null").select(*scope, F.col("batch"), F.col("record_number").alias("unit"))
    members = rows.filter("batch is not null").select(*scope, F.col("batch").cast("string").alias("batch"), "record_number").join(named, [*scope, "batch"])
    return numbered(members, [*scope, "batch"], [F.col("record_number")], "nth").select(*scope, "unit", "record_number", "nth")


def all_carried(members: Column) -> Column:
    return F.forall(members, lambda m: m["is_carried"])


def pool(units: DataFrame, opening: DataFrame) -> DataFrame:
    """Units of the period and items carried into it."""
    return units.withColumn("is_carried", F.lit(False)).unionByName(opening.withColumn("is_carried", F.lit(True)), allowMissingColumns=True)
