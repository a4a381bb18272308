"""Trimming, keys, escaping, search and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends of Unicode, and the byte order mark.
SPACE = "\t\n\x0b\f\r \u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """All Unicode white space, not spaces alone."""
    return F.btrim(c, F.lit(SPACE))


def key_part(c: Column, trimmed: bool = True, folded: bool = False) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = trim(c) if trimmed else c
    return F.lower(c) if folded else c


def _json(parts: Column) -> Column:
    """A list as JSON, control characters with lower-case digits (Spark writes \\u001F)."""
    out = F.to_json(parts)
    lowered = out
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # the only escapes that have letters
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), lowered).otherwise(out)


def encode_key(parts: Column) -> Column:
    """Text that no two different lists of parts share."""
    return _json(parts)


def key_cell(parts: Column) -> Column:
    return F.when(F.size(parts) == 1, parts[0]).otherwise(_json(parts))


def is_plain_decimal(c: Column) -> Column:
    return c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)\z")


def escape_formula(c: Column) -> Column:
    """A quote before text that a spreadsheet would run, but not before a plain number."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~is_plain_decimal(c), F.concat(F.lit("'"), c)).otherwise(c)


def txn_key(side: Column, fingerprint: Column, record: Column) -> Column:
    return F.concat_ws("|", side, fingerprint, record.cast("string"))


def is_txn_key(c: Column) -> Column:
    return c.rlike(r"^(bank|books)\|[0-9a-f]{64}\|[1-9][0-9]*\z")


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def unit_key(side: Column, members: Column) -> Column:
    """members: array of (fingerprint, record). `side|fp|r+r&side|fp|r`, by fingerprint and record number."""
    put = F.array_sort(members)
    prints = F.array_distinct(F.transform(put, lambda m: m["fingerprint"]))
    part = lambda p: F.concat(side, F.lit("|"), p, F.lit("|"), F.array_join(F.transform(F.filter(put, lambda m: m["fingerprint"] == p), lambda m: m["record"].cast("string")), "+"))
    return F.array_join(F.transform(prints, part), "&")


def unit_members(c: Column) -> Column:
    """The members of a unit key as array of (side, fingerprint, record); null if it is not a key in canonical form: one
    side, fingerprints in order, records of each in numeric order, nothing twice."""
    known = c.rlike(r"^(bank|books)\|[0-9a-f]{64}\|[1-9][0-9]{0,17}(\+[1-9][0-9]{0,17})*(&(bank|books)\|[0-9a-f]{64}\|[1-9][0-9]{0,17}(\+[1-9][0-9]{0,17})*)*\z")
    fields = F.transform(F.split(F.when(known, c), "&"), lambda p: F.split(p, r"\|"))
    records = lambda f: F.transform(F.split(f[2], r"\+"), lambda r: r.cast("long"))
    rising = lambda xs: xs == F.array_sort(F.array_distinct(xs))
    sound = (F.size(F.array_distinct(F.transform(fields, lambda f: f[0]))) == 1) & rising(F.transform(fields, lambda f: f[1])) & F.forall(fields, lambda f: rising(records(f)))
    members = F.flatten(F.transform(fields, lambda f: F.transform(records(f), lambda r: F.struct(f[0].alias("side"), f[1].alias("fingerprint"), r.alias("record")))))
    return F.when(sound, members)


def is_unit_key(c: Column, side: str | None = None) -> Column:
    members = unit_members(c)
    out = members.isNotNull()
    return out if side is None else out & (F.get(members, F.lit(0))["side"] == side)


def setup_fingerprint(*parts: Column) -> Column:
    """Changes when any part of a setup does; not a security measure."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def references_agree(bank: Column, books: Column, shared: bool, folded: bool) -> Column:
    """Null where references are not shared or one is missing."""
    if not shared:
        return F.lit(None).cast("boolean")
    return (F.lower(bank) == F.lower(books)) if folded else (bank == books)


def counted(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def place_label(side: Column, record: Column, carried_file: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """"Bank record 3", or for carried items (those with a file) where they first appeared."""
    own = F.concat(F.initcap(side), F.lit(" record "), F.format_number(record, 0))
    if carried_file is None:
        return own
    carried = F.concat(F.lit("Carried · "), own, F.lit(" of "), carried_file, F.lit(" ("), start.cast("string"), F.lit(" to "), end.cast("string"), F.lit(")"))
    return F.when(carried_file.isNotNull(), carried).otherwise(own)


def date_evidence(gap: Column) -> Column:
    way = F.when(gap > 0, F.lit(" after books")).otherwise(F.lit(" before books"))
    return F.when(gap == 0, F.lit("same date")).otherwise(F.concat(F.lit("bank date "), counted(F.abs(gap), "day"), way))


def evidence_text(gap: Column, agree: Column) -> Column:
    return F.concat(F.lit("Amount exact; "), date_evidence(gap), F.when(agree, F.lit("; reference matched.")).otherwise(F.lit(".")))


def reference_evidence(agree: Column, bank: Column, books: Column, shared: bool) -> Column:
    """What is known of the references of a pair that meets the rules."""
    if not shared:
        return F.lit("references not compared")
    absent = F.when(bank.isNull() & books.isNull(), "reference absent on both sides").when(bank.isNull(), "reference absent in bank").otherwise("reference absent in books")
    return F.when(agree, F.lit("reference matched")).otherwise(absent)


def competition_text(unique: Column, bank_units: Column, books_units: Column, pairs: Column) -> Column:
    many = F.concat(counted(bank_units, "bank transaction"), F.lit(" and "), counted(books_units, "books transaction"), F.lit(" compete through "), counted(pairs, "pair"), F.lit("; no unique pairing"))
    return F.when(unique, F.lit("Only candidate for both transactions")).otherwise(many)


def relation_text(bank_members: Column, books_members: Column) -> Column:
    """For pairs with a batch or group; null for two single transactions."""
    said = F.concat(counted(bank_members, "bank transaction"), F.lit(" ↔ "), counted(books_members, "books transaction"))
    return F.when((bank_members > 1) | (books_members > 1), said)


def running_text(state: Column, record: Column, expected: Column, found: Column) -> Column:
    """What the running-balance check found; the amounts are exact decimals."""
    broken = F.concat(F.lit("breaks at record "), record.cast("string"), F.lit(": expected "), expected.cast("string"), F.lit(", found "), found.cast("string"))
    return F.when(state == "consistent", F.lit("consistent with every record")).when(state == "break", broken).otherwise(F.concat(F.lit("can't be checked past record "), record.cast("string")))


def source_gap(side: str, state: Column, invalid: Column) -> Column:
    """Why a side's balances do not validate; null once they do."""
    name = side.capitalize()
    bad = F.concat(F.lit(f"{name}: "), invalid.cast("string"), F.when(invalid == 1, F.lit(" invalid record has")).otherwise(F.lit(" invalid records have")), F.lit(" no trustworthy amount"))
    return (
        F.when(state == "missing-balances", F.lit(f"{name}: opening and closing balances are needed"))
        .when(state == "invalid-rows", bad)
        .when(state == "mismatch", F.lit(f"{name}: opening plus movements does not equal the closing balance"))
    )


def edge_key(bank: Column, books: Column) -> Column:
    return F.concat_ws("~", bank, books)


def found(needle: str, *shown: Column) -> Column:
    """Whether any shown text holds the needle; never across two of them."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    return F.exists(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in shown]), lambda x: F.contains(F.lower(x), F.lit(needle)))


def lineage(side: Column, fingerprint: Column, record: Column) -> Column:
    return txn_key(side, fingerprint, record)


def direction(amount: Column) -> Column:
    return F.when(amount > 0, "in").otherwise("out")
