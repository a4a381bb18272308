"""Queries of the scalar functions (B)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import dates, decimals, text
from .adapters import sql, view

QUERIES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql(oracle) if oracle else None)
        return f

    return add


# strict number text, shared by the SQL below
_PLAIN = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"
_GROUPED = r"([0-9]+|[0-9]{1,3}(,[0-9]{3})+|[0-9]{1,2}(,[0-9]{2})*,[0-9]{3})"
_BODY = rf"({_GROUPED}(\.[0-9]*)?|\.[0-9]+)"
_ANY = rf"[+-]?{_BODY}|{_BODY}-|\({_BODY}\)"


@query("SELECT record_number, trim(id) AS trimmed, lower(trim(id || name)) AS key FROM new_customer")
def b01_key_parts(spark, sf):
    """Trim, fold, normalised key part."""
    return view(spark, sf, "new_customer").select("record_number", text.trim(F.col("id")).alias("trimmed"), text.key_part(F.concat("id", "name"), True, True).alias("key"))


@query(f"""SELECT record_number, raw, CAST(CAST(CASE WHEN regexp_full_match(raw, '{_ANY}') THEN CASE WHEN raw LIKE '-%' OR raw LIKE '(%' OR raw LIKE '%-' THEN '-' ELSE '' END || regexp_replace(raw, '[,()+-]', '', 'g') END
  AS DECIMAL(28,4)) * 10000 AS BIGINT) AS value, regexp_full_match(raw, '{_PLAIN}') AS is_plain FROM amount_text""")
def b04_parse_decimal(spark, sf):
    """Strict numbers, groups, trailing minus, brackets, plain test."""
    c = F.col("raw")
    value = decimals.parse(c, "decimal(28,4)", grouped=True, trailing_minus=True, parentheses=True)
    return view(spark, sf, "amount_text").select("record_number", "raw", (value * 10000).cast("long").alias("value"), text.is_plain_decimal(c).alias("is_plain"))


@query("""SELECT o.record_number, abs(CAST(o.acctbal AS DECIMAL(18,2)) - CAST(n.acctbal AS DECIMAL(18,2))) <= 0.01 AS near, CAST((CAST(o.acctbal AS DECIMAL(18,2)) + CAST(n.acctbal AS DECIMAL(18,2))) * 100 AS BIGINT) AS total,
  CAST(-CAST(o.acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS negated, CAST(o.acctbal AS DECIMAL(18,2)) < CAST(n.acctbal AS DECIMAL(18,2)) AS less
  FROM old_customer o JOIN new_customer n ON o.record_number = n.record_number WHERE n.acctbal <> 'N/A'""")
def b09_exact_arithmetic(spark, sf):
    """Tolerance, add, subtract, negate, compare."""
    o, n = view(spark, sf, "old_customer"), view(spark, sf, "new_customer").select("record_number", F.col("acctbal").alias("other"))
    a, b = (decimals.parse(F.col(c), "decimal(18,2)") for c in ("acctbal", "other"))
    return o.join(n, "record_number").filter(b.isNotNull()).select("record_number", decimals.within(a, b, Decimal("0.01")).alias("near"), ((a + b) * 100).cast("long").alias("total"), (-a * 100).cast("long").alias("negated"), (a < b).alias("less"))


@query(f"""SELECT record_number, CASE WHEN regexp_full_match(raw, '{_PLAIN}') AND (NOT contains(raw, '.') OR length(rtrim(split_part(raw, '.', 2), '0')) <= 2) THEN CAST(CAST(raw AS DECIMAL(28,2)) AS STRING) END AS formatted FROM amount_text""")
def b11_rescale(spark, sf):
    """Exact rescale and canonical text."""
    plain = decimals.clean(F.col("raw"))
    return view(spark, sf, "amount_text").select("record_number", decimals.rescaled(plain, 2).cast("string").alias("formatted"))


@query("""SELECT o_orderkey, CAST(d AS STRING) AS day, CAST(d - DATE '1970-01-01' AS BIGINT) AS number FROM (SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}')
  THEN TRY_CAST(split_part(raw, '/', 3) || '-' || lpad(split_part(raw, '/', 2), 2, '0') || '-' || lpad(split_part(raw, '/', 1), 2, '0') AS DATE) END AS d FROM date_text)""")
def b13_parse_date(spark, sf):
    """Strict dates and day numbers."""
    d = dates.parse_date(F.col("raw"), "DD/MM/YYYY")
    return view(spark, sf, "date_text").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("day"), F.unix_date(d).cast("long").alias("number"))


# year, month and day as places in the text, and the pattern; formats with month names or two-digit years fit no such text
_FORMS = """f(format, pattern, y, m, d) AS (VALUES ('YYYY-MM-DD', '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}', 1, 2, 3), ('YYYY/MM/DD', '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}', 1, 2, 3), ('DD/MM/YYYY', '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}', 3, 2, 1), ('DD-MM-YYYY', '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}', 3, 2, 1),
  ('DD.MM.YYYY', '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}', 3, 2, 1), ('MM/DD/YYYY', '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}', 3, 1, 2), ('MM-DD-YYYY', '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}', 3, 1, 2))"""
_RAW = """t AS (SELECT CASE WHEN day(o_orderdate) <= 12 THEN 'early' ELSE 'late' END AS part, CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) AS raw FROM orders)"""


@query(f"""WITH {_RAW}, {_FORMS} SELECT part, format FROM t, f GROUP BY part, format HAVING bool_and(regexp_full_match(raw, pattern) AND TRY_CAST(split_part(translate(raw, '/.', '--'), '-', y) || '-' || lpad(split_part(translate(raw, '/.', '--'), '-', m), 2, '0') || '-' || lpad(split_part(translate(raw, '/.', '--'), '-', d), 2, '0') AS DATE) IS NOT NULL)""")
def b15_fitting_formats(spark, sf):
    """The formats that every value fits; days up to the twelfth fit month first as well."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderdate", F.date_format("o_orderdate", "d/M/yyyy").alias("raw"))
    early = F.dayofmonth("o_orderdate") <= 12
    one = lambda part, when: dates.fitting_formats(rows.filter(when), "raw").select(F.lit(part).alias("part"), "format")
    return one("early", early).unionByName(one("late", ~early))


@query("""SELECT id, CAST(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CAST(acctbal AS DECIMAL(18,2)) WHEN CAST(acctbal AS DECIMAL(18,2)) < 0 THEN NULL WHEN CAST(id AS BIGINT) % 3 = 1 THEN CAST(acctbal AS DECIMAL(18,2)) ELSE -CAST(acctbal AS DECIMAL(18,2)) END * 100 AS BIGINT) AS balance,
  CAST(-CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CAST(acctbal AS DECIMAL(18,2)) WHEN CAST(acctbal AS DECIMAL(18,2)) < 0 THEN NULL WHEN CAST(id AS BIGINT) % 3 = 1 THEN CAST(acctbal AS DECIMAL(18,2)) ELSE -CAST(acctbal AS DECIMAL(18,2)) END * 100 AS BIGINT) AS cash FROM old_customer""")
def b16_balances(spark, sf):
    """Balances with Cr and Dr marks; liability basis."""
    k = F.col("id").cast("long") % 3
    marked = F.concat("acctbal", F.when(k == 0, "").when(k == 1, " Cr").otherwise(" DR"))
    b = decimals.balance(marked, 2, "cr")
    return view(spark, sf, "old_customer").select("id", (b * 100).cast("long").alias("balance"), (decimals.cash_balance(b, F.lit("liability")) * 100).cast("long").alias("cash"))


@query("""SELECT record_number, '["' || id || '","' || nation || '"]' AS encoded, id AS cell, CASE WHEN acctbal LIKE '-%' AND NOT regexp_full_match(acctbal || 'x', '[+-]?[0-9]+') THEN '''' || acctbal || 'x' ELSE acctbal || 'x' END AS escaped, acctbal AS plain FROM old_customer""")
def b18_keys_and_escapes(spark, sf):
    """Encoded keys, key cells, formula escapes."""
    return view(spark, sf, "old_customer").select("record_number", text.encode_key(F.array("id", "nation")).alias("encoded"), text.key_cell(F.array("id")).alias("cell"), text.escape_formula(F.concat("acctbal", F.lit("x"))).alias("escaped"), text.escape_formula(F.col("acctbal")).alias("plain"))


@query("""SELECT account, batch, string_agg(CAST(record_number AS STRING), '+' ORDER BY record_number) AS records, 'books|' || sha256(batch) || '|' || string_agg(CAST(record_number AS STRING), '+' ORDER BY record_number) AS unit, true AS sound, true AS is_hash FROM books_lines GROUP BY account, batch""")
def b21_unit_keys(spark, sf):
    """Transaction and unit keys, hash check, lineage."""
    rows = view(spark, sf, "books_lines").withColumn("fp", F.sha2("batch", 256))
    out = rows.groupBy("account", "batch").agg(F.collect_list(F.struct(F.col("fp").alias("fingerprint"), F.col("record_number").alias("record"))).alias("m"), F.bool_and(text.is_txn_key(text.txn_key(F.lit("books"), F.col("fp"), F.col("record_number")))).alias("sound"), F.first("fp").alias("fp"))
    records = F.array_join(F.transform(F.array_sort("m"), lambda x: x["record"].cast("string")), "+")
    return out.select("account", "batch", records.alias("records"), text.unit_key(F.lit("books"), F.col("m")).alias("unit"), "sound", text.is_sha256(F.col("fp")).alias("is_hash"))


@query("""SELECT account, record_number, 'Bank record ' || format('{:,}', record_number) AS label, CASE WHEN amount > 0 THEN 'in' ELSE 'out' END AS direction, CAST(day - 3 AS DATE) AS low, CAST(day + 3 AS DATE) AS high,
  'Amount exact; ' || CASE WHEN record_number % 3 = 0 THEN 'same date' WHEN record_number % 3 = 1 THEN 'bank date 1 day after books' ELSE 'bank date 2 days before books' END || CASE WHEN reference IS NOT NULL THEN '; reference matched.' ELSE '.' END AS evidence FROM bank""")
def b26_windows_and_labels(spark, sf):
    """Windows, labels, evidence, direction."""
    low, high = dates.books_window(F.col("day"), 3, 3)
    k = F.col("record_number") % 3
    gap = F.when(k == 0, 0).when(k == 1, 1).otherwise(-2)
    return view(spark, sf, "bank").select("account", "record_number", text.place_label(F.lit("bank"), F.col("record_number")).alias("label"), text.direction(F.col("amount")).alias("direction"), low.alias("low"), high.alias("high"), text.evidence_text(gap, text.references_agree(F.col("reference"), F.col("reference"), True, False)).alias("evidence"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the')")
def b30_search(spark, sf):
    """Text search over several columns."""
    return spark.read.parquet(f"{sf}/documents.parquet").filter(text.found(" THE ", F.col("text"), F.col("source"))).select("doc_id", "source")


@query("""SELECT id, sha256('{"id":"' || id || '","nation":"' || nation || '","acctbal":"' || acctbal || '"}') AS fingerprint FROM old_customer""")
def b24_setup_fingerprint(spark, sf):
    """The hash of a setup changes with any part; only its stability is fixed."""
    return view(spark, sf, "old_customer").select("id", text.setup_fingerprint(F.col("id"), F.col("nation"), F.col("acctbal")).alias("fingerprint"))


@query("""SELECT account, record_number, CASE WHEN amount > 0 THEN 'Only candidate for both transactions' ELSE format('{:,}', record_number) || CASE WHEN record_number = 1 THEN ' bank transaction and ' ELSE ' bank transactions and ' END || '1 books transaction compete through 2 pairs; no unique pairing' END AS competition,
  CASE WHEN record_number % 2 = 0 THEN format('{:,}', record_number % 4 + 2) || ' bank transactions ↔ 1 books transaction' END AS relation, CASE WHEN reference IS NULL THEN 'reference absent on both sides' ELSE 'reference matched' END AS reference_text,
  CASE record_number % 3 WHEN 0 THEN 'consistent with every record' WHEN 1 THEN 'breaks at record ' || CAST(record_number AS STRING) || ': expected ' || CAST(amount AS STRING) || ', found ' || CAST(amount + 1 AS STRING) ELSE 'can''t be checked past record ' || CAST(record_number AS STRING) END AS running,
  CASE record_number % 4 WHEN 0 THEN 'Bank: opening and closing balances are needed' WHEN 1 THEN 'Bank: ' || CAST(record_number % 2 + 1 AS STRING) || CASE WHEN record_number % 2 = 0 THEN ' invalid record has' ELSE ' invalid records have' END || ' no trustworthy amount' WHEN 2 THEN 'Bank: opening plus movements does not equal the closing balance' END AS gap FROM bank""")
def b28_reason_texts(spark, sf):
    """Competition, relation and reference texts, what a running balance and a source lack."""
    n, a = F.col("record_number"), F.col("amount")
    state = lambda k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % k + 1).cast("int"))
    return view(spark, sf, "bank").select(
        "account",
        "record_number",
        text.competition_text(a > 0, n, F.lit(1), F.lit(2)).alias("competition"),
        text.relation_text(F.when(n % 2 == 0, n % 4 + 2).otherwise(1), F.lit(1)).alias("relation"),
        text.reference_evidence(F.col("reference").isNotNull(), F.col("reference"), F.col("reference"), True).alias("reference_text"),
        text.running_text(state(3, "consistent", "break", "unreadable"), n, a, a + 1).alias("running"),
        text.source_gap("bank", state(4, "missing-balances", "invalid-rows", "mismatch", "validated"), n % 2 + 1).alias("gap"),
    )


_UNITS = """u AS (SELECT account, batch, 'books|' || sha256(batch) || '|' AS head, min(record_number) AS low, max(record_number) AS high FROM books_lines GROUP BY account, batch)"""


@query(f"""WITH {_UNITS}, k AS (SELECT account, batch, 'sound' AS form, head || CAST(low AS STRING) || CASE WHEN high > low THEN '+' || CAST(high AS STRING) ELSE '' END AS key, true AS ok, CASE WHEN high > low THEN 2 ELSE 1 END AS members FROM u UNION ALL SELECT account, batch, 'twice', head || CAST(low AS STRING) || '+' || CAST(low AS STRING), false, NULL FROM u
  UNION ALL SELECT account, batch, 'order', head || CAST(high + 1 AS STRING) || '+' || CAST(low AS STRING), false, NULL FROM u UNION ALL SELECT account, batch, 'sides', head || CAST(low AS STRING) || '&' || replace(head, 'books', 'bank') || CAST(low AS STRING), false, NULL FROM u) SELECT account, batch, form, key, ok, members FROM k""")
def b22_parse_unit_keys(spark, sf):
    """Unit keys in canonical form, and those that repeat a record, are out of order or mix sides."""
    head = F.concat(F.lit("books|"), F.sha2("batch", 256), F.lit("|"))
    u = view(spark, sf, "books_lines").groupBy("account", "batch").agg(F.min("record_number").alias("low"), F.max("record_number").alias("high")).withColumn("head", head)
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    forms = {
        "sound": F.concat("head", low, F.when(F.col("high") > F.col("low"), F.concat(F.lit("+"), high)).otherwise("")),
        "twice": F.concat("head", low, F.lit("+"), low),
        "order": F.concat("head", (F.col("high") + 1).cast("string"), F.lit("+"), low),
        "sides": F.concat("head", low, F.lit("&"), F.replace("head", F.lit("books"), F.lit("bank")), low),
    }
    keys = u.select("account", "batch", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("key")) for k, c in forms.items()])).alias("x")).select("account", "batch", "x.form", "x.key")
    members = text.unit_members(F.col("key"))
    return keys.select("account", "batch", "form", "key", text.is_unit_key(F.col("key")).alias("ok"), F.when(members.isNotNull(), F.size(members)).alias("members"))
