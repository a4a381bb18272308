"""Queries of the comparison operators (C, A11-A13) over two snapshots of customer."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CompareRules, NumericRule
from ..operators import compare as C
from ..operators import paging
from .adapters import sql, view

QUERIES: dict = {}
RULES = CompareRules(key=("id",), case_insensitive=("segment",), numeric={"acctbal": NumericRule(Decimal("0.01"))}, ignored=("name",))
EXACT = CompareRules(key=("id",))

_K = "k AS (SELECT 'old' AS side, trim(id) AS k, * FROM old_customer UNION ALL SELECT 'new' AS side, trim(id) AS k, * FROM new_customer)"
_CLS = f"{_K}, cls AS (SELECT k, count(*) FILTER (WHERE side = 'old') AS o, count(*) FILTER (WHERE side = 'new') AS n FROM k WHERE k <> '' GROUP BY k)"
_NUM = r"CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN CAST({0} AS DECIMAL(28,2)) END"
_M = f"""{_CLS}, m AS (SELECT cls.k, a.record_number AS ro, b.record_number AS rn, a.id AS a_id, b.id AS b_id, a.name AS a_name, b.name AS b_name, a.nation AS a_nation, b.nation AS b_nation,
  a.acctbal AS a_bal, b.acctbal AS b_bal, a.segment AS a_seg, b.segment AS b_seg, {_NUM.format("a.acctbal")} AS a_num, {_NUM.format("b.acctbal")} AS b_num
  FROM cls JOIN k a ON a.k = cls.k AND a.side = 'old' JOIN k b ON b.k = cls.k AND b.side = 'new' WHERE o = 1 AND n = 1)"""
_CH = f"""{_M}, ch AS (SELECT k, ro, rn, 'id' AS "column", a_id AS before, b_id AS after FROM m WHERE a_id <> b_id
  UNION ALL SELECT k, ro, rn, 'nation', a_nation, b_nation FROM m WHERE a_nation <> b_nation
  UNION ALL SELECT k, ro, rn, 'acctbal', a_bal, b_bal FROM m WHERE CASE WHEN a_num IS NOT NULL AND b_num IS NOT NULL THEN abs(a_num - b_num) > 0.01 ELSE a_bal <> b_bal END
  UNION ALL SELECT k, ro, rn, 'segment', a_seg, b_seg FROM m WHERE lower(a_seg) <> lower(b_seg))"""
_SUM = f"""{_CH}, s AS (SELECT (SELECT count(*) FROM cls WHERE o = 0 AND n = 1) AS added, (SELECT count(*) FROM cls WHERE o = 1 AND n = 0) AS removed, (SELECT count(DISTINCT k) FROM ch) AS changed,
  (SELECT count(*) FROM m) - (SELECT count(DISTINCT k) FROM ch) AS unchanged, (SELECT count(*) FROM cls WHERE o > 1 OR n > 1) AS ambiguous, (SELECT count(*) FROM k WHERE k = '') AS empty_key,
  (SELECT count(*) FILTER (WHERE a_num IS NULL) + count(*) FILTER (WHERE b_num IS NULL) FROM m) AS warnings)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql(oracle) if oracle else None)
        return f

    return add


def _sides(spark, sf):
    return view(spark, sf, "old_customer"), view(spark, sf, "new_customer")


def _rows(spark, sf, rules=RULES):
    return C.keyed(*_sides(spark, sf), rules)


def _classes(spark, sf, rules=RULES):
    return C.classify(_rows(spark, sf, rules))


def _compared(spark, sf, rules=RULES):
    old, new = _sides(spark, sf)
    return C.compare_values(C.classify(C.keyed(old, new, rules)), C.compared_columns(old, new, rules), rules)


def _key(df, *more):
    return df.select(F.col("key")[0].alias("key"), *more)


@query("SELECT * FROM (VALUES ('id','shared',0),('name','shared',1),('nation','shared',2),('segment','shared',3),('acctbal','added',3)) t(name, kind, place)")
def c01_schema_diff(spark, sf):
    old, new = _sides(spark, sf)
    return C.schema_diff(old.drop("acctbal"), new)


@query(f"WITH {_K} SELECT side, record_number FROM k WHERE k = ''")
def c03_empty_keys(spark, sf):
    return C.empty_keys(_rows(spark, sf)).select("side", "record_number")


@query(f"WITH {_CLS} SELECT k AS key, o AS n_old, n AS n_new FROM cls WHERE o > 1 OR n > 1")
def c04_ambiguous_keys(spark, sf):
    return _key(_classes(spark, sf).filter("kind = 'ambiguous'"), "n_old", "n_new")


@query(f"WITH {_CLS} SELECT cls.k AS key, record_number, acctbal FROM cls JOIN k ON k.k = cls.k WHERE o = 0 AND n = 1")
def c05_added(spark, sf):
    return _key(_classes(spark, sf).filter("kind = 'added'"), "new.record_number", "new.row.acctbal")


@query(f"WITH {_CLS} SELECT cls.k AS key, record_number, acctbal FROM cls JOIN k ON k.k = cls.k WHERE o = 1 AND n = 0")
def c06_removed(spark, sf):
    return _key(_classes(spark, sf).filter("kind = 'removed'"), "old.record_number", "old.row.acctbal")


@query(f"WITH {_M} SELECT k AS key, ro AS old_record, rn AS new_record FROM m")
def c07_matched(spark, sf):
    return _key(_classes(spark, sf).filter("kind = 'matched'"), F.col("old.record_number").alias("old_record"), F.col("new.record_number").alias("new_record"))


@query(f"""WITH {_M} SELECT k AS key, "column", before, after FROM (SELECT k, 'id' AS "column", a_id AS before, b_id AS after FROM m UNION ALL SELECT k, 'name', a_name, b_name FROM m UNION ALL SELECT k, 'nation', a_nation, b_nation FROM m
  UNION ALL SELECT k, 'acctbal', a_bal, b_bal FROM m UNION ALL SELECT k, 'segment', a_seg, b_seg FROM m) WHERE before <> after""")
def c08_exact_changes(spark, sf):
    return _key(C.change_rows(_compared(spark, sf, EXACT)), "column", "before", "after")


@query(f"""WITH {_CH} SELECT k AS key, ro AS old_record, rn AS new_record, "column", before, after FROM ch""")
def c13_changes(spark, sf):
    """Case, tolerance, ignored columns; one row per changed field."""
    return _key(C.change_rows(_compared(spark, sf)), "old_record", "new_record", "column", "before", "after")


@query(f"""WITH {_M} SELECT k AS key, 'acctbal' AS "column", side, CASE side WHEN 'old' THEN ro ELSE rn END AS record_number, '"' || v || '" is not a number; compared as text' AS message
  FROM (SELECT k, ro, rn, 'old' AS side, a_bal AS v, a_num AS x FROM m UNION ALL SELECT k, ro, rn, 'new', b_bal, b_num FROM m) WHERE x IS NULL""")
def c11_warnings(spark, sf):
    return _key(C.warning_rows(_compared(spark, sf)), "column", "side", "record_number", "message")


@query(f"""WITH {_CH} SELECT "column", count(*) AS records FROM ch GROUP BY "column" """)
def c14_changes_by_column(spark, sf):
    return C.changes_by_column(_compared(spark, sf))


@query(f"WITH {_SUM} SELECT * FROM s")
def c15_compare_summary(spark, sf):
    old, new = _sides(spark, sf)
    rows = C.keyed(old, new, RULES)
    classes = C.classify(rows)
    return C.summary(rows, classes, C.compare_values(classes, C.compared_columns(old, new, RULES), RULES))


@query(f"""WITH {_SUM}, c AS (SELECT "column", count(*) AS n FROM ch GROUP BY "column") SELECT added || ' added, ' || removed || ' removed, ' || changed || ' changed (' || (SELECT string_agg("column" || ': ' || n, ', ' ORDER BY n DESC, "column") FROM c) || ').' AS sentence FROM s""")
def b32_summary_sentence(spark, sf):
    return C.summary_text(c15_compare_summary(spark, sf), C.changes_by_column(_compared(spark, sf)))


@query(f"""WITH {_CLS} SELECT kind, count(*) AS keys FROM (SELECT CASE WHEN o > 1 OR n > 1 THEN 'ambiguous' WHEN o = 0 THEN 'added' WHEN n = 0 THEN 'removed' ELSE 'matched' END AS kind FROM cls) GROUP BY kind""")
def c16_key_preflight(spark, sf):
    return _classes(spark, sf).groupBy("kind").agg(F.count("*").alias("keys"))


@query(f"WITH {_CLS} SELECT cls.k AS key, side, record_number, o AS n_old, n AS n_new FROM cls JOIN k ON k.k = cls.k WHERE o > 1 OR n > 1")
def c17_ambiguous_members(spark, sf):
    rows = _rows(spark, sf)
    return _key(C.ambiguous_members(rows, C.classify(rows)), "side", "record_number", "n_old", "n_new")


@query(f"WITH {_CLS} SELECT key, side, record_number, nth FROM (SELECT cls.k AS key, side, record_number, row_number() OVER (PARTITION BY cls.k, side ORDER BY record_number) AS nth FROM cls JOIN k ON k.k = cls.k WHERE o > 1 OR n > 1) WHERE nth <= 1")
def c18_capped_members(spark, sf):
    rows = _rows(spark, sf)
    return _key(C.capped_members(C.ambiguous_members(rows, C.classify(rows)), 1), "side", "record_number", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_CH} SELECT DISTINCT k AS key FROM ch WHERE "column" = 'acctbal' """)
def c19_changed_in_column(spark, sf):
    return _key(C.changed_in(_compared(spark, sf), "acctbal"))


@query(f"""WITH {_CH} SELECT DISTINCT k AS key FROM ch WHERE contains(lower(a_key), 'n/a') OR contains(lower(before), 'n/a') OR contains(lower(after), 'n/a') OR contains("column", 'n/a')""".replace("contains(lower(a_key), 'n/a') OR ", ""))
def c20_search(spark, sf):
    return _key(C.search_changes(_compared(spark, sf), " N/A "))


@query(f"WITH {_CLS} SELECT k AS key FROM cls JOIN (SELECT k AS kk, min(record_number) AS r FROM k GROUP BY k) ON kk = k WHERE o = 1 AND n = 1 ORDER BY r LIMIT 50 OFFSET 100")
def c21_page(spark, sf):
    matched = _classes(spark, sf).filter("kind = 'matched'").select(F.col("key")[0].alias("key"), F.col("old.record_number").alias("r"))
    return C.page(matched, ["r"], 100, 50).select("key")


@query(f"""WITH {_CLS}, o AS (SELECT k AS key, min(record_number) AS r FROM k JOIN cls USING (k) WHERE o = 1 AND n = 1 GROUP BY k), t AS (SELECT count(*) AS total FROM o), s AS (SELECT * FROM o WHERE contains(key, '1'))
  SELECT 'page' AS what, key, (SELECT total FROM t) AS total FROM (SELECT * FROM o ORDER BY r LIMIT 100 OFFSET 50) UNION ALL SELECT 'last', key, (SELECT total FROM t) FROM (SELECT * FROM o ORDER BY r LIMIT 50 OFFSET (SELECT total - 7 FROM t))
  UNION ALL SELECT 'search', key, (SELECT count(*) FROM s) FROM (SELECT * FROM s ORDER BY r LIMIT 40 OFFSET 20)""")
def c21_kept_pages(spark, sf):
    """Pages of a kept result, its last one, and a page of a search in it, with the totals."""
    matched = _classes(spark, sf).filter("kind = 'matched'").select(F.col("key")[0].alias("key"), F.col("old.record_number").alias("r"))
    kept = paging.paged(matched, ["r"])
    hits = kept.where(F.contains("key", F.lit("1")))
    one = lambda name, pages, at, n: pages.page(at, n).select(F.lit(name).alias("what"), "key", F.lit(pages.total).cast("long").alias("total"))
    return one("page", kept, 50, 100).unionByName(one("last", kept, kept.total - 7, 50)).unionByName(one("search", hits, 20, 40))


@query(f"WITH {_K} SELECT record_number, (SELECT count(*) FROM k WHERE k = '') AS total FROM k WHERE k = '' ORDER BY record_number LIMIT 5")
def c22_preview(spark, sf):
    return C.preview(C.empty_keys(_rows(spark, sf)).select("record_number"), ["record_number"], 5)


@query(f"""WITH {_CH} SELECT 'changed' AS change_type, b_id AS key, "column", before, after FROM ch JOIN (SELECT k AS kk, b_id FROM m) ON kk = k
  UNION ALL SELECT 'added', id, c, '', v FROM (SELECT cls.k, id, unnest(['id','name','nation','acctbal','segment']) AS c, unnest([id, name, nation, acctbal, segment]) AS v FROM cls JOIN k ON k.k = cls.k WHERE o = 0 AND n = 1)
  UNION ALL SELECT 'removed', id, c, v, '' FROM (SELECT cls.k, id, unnest(['id','name','nation','acctbal','segment']) AS c, unnest([id, name, nation, acctbal, segment]) AS v FROM cls JOIN k ON k.k = cls.k WHERE o = 1 AND n = 0)""")
def a11_changes_report(spark, sf):
    """The long report."""
    old, new = _sides(spark, sf)
    classes = C.classify(C.keyed(old, new, RULES))
    cols = [c for c in old.columns if c != "record_number"]
    return C.export_rows(classes, C.compare_values(classes, C.compared_columns(old, new, RULES), RULES), cols, cols).select("change_type", "key", "column", "before", "after")


@query(f"""WITH {_SUM}, ln AS (SELECT 'Summary' AS section, concat_ws('|', added, removed, changed, unchanged, ambiguous, empty_key, warnings) AS line FROM s UNION ALL SELECT 'Added', concat_ws('|', record_number, id) FROM cls JOIN k ON k.k = cls.k WHERE o = 0 AND n = 1
  UNION ALL SELECT 'Removed', concat_ws('|', record_number, id) FROM cls JOIN k ON k.k = cls.k WHERE o = 1 AND n = 0 UNION ALL SELECT 'Changed', concat_ws('|', k, ro, rn, "column", before, after) FROM ch
  UNION ALL SELECT 'Ambiguous keys', concat_ws('|', cls.k, side, record_number, id, o, n) FROM cls JOIN k ON k.k = cls.k WHERE o > 1 OR n > 1 UNION ALL SELECT 'Empty keys', concat_ws('|', side, record_number, id) FROM k WHERE k = ''
  UNION ALL SELECT 'Numeric warnings', concat_ws('|', k, 'acctbal', side, CASE side WHEN 'old' THEN ro ELSE rn END, '"' || v || '" is not a number; compared as text') FROM (SELECT k, ro, rn, 'old' AS side, a_bal AS v, a_num AS x FROM m UNION ALL SELECT k, ro, rn, 'new', b_bal, b_num FROM m) WHERE x IS NULL) SELECT section, line FROM ln""")
def a13_section_tables(spark, sf):
    """The seven sections, line by line."""
    from ..sources import sinks

    old, new = _sides(spark, sf)
    rows = C.keyed(old, new, RULES)
    classes = C.classify(rows)
    sections = sinks.compare_sections(rows, classes, C.compare_values(classes, C.compared_columns(old, new, RULES), RULES))
    out = []
    for name, df in sections.items():
        cells = [F.array_join(c, ",") if kind.startswith("array") else F.col(c).cast("string") for c, kind in df.drop("row").dtypes]
        out.append(df.select(F.lit(name).alias("section"), F.concat_ws("|", *cells).alias("line")))
    return reduce(DataFrame.unionByName, out)


@query(f"""WITH {_SUM} SELECT 'csv-diff-report' AS format, 1 AS version, added, warnings, 'id' AS key, '0.01' AS tolerance FROM s""")
def a12_report_manifest(spark, sf):
    """The head of the JSON report: what it is, the rules it used and the counts."""
    from ..sources import sinks

    head = sinks.manifest(c15_compare_summary(spark, sf), RULES, "old", "new", "2024-01-01T00:00:00Z")
    rule = lambda path: F.get_json_object("rulesUsed", path)
    return head.select("format", "version", "summary.added", "summary.warnings", rule("$.key[0]").alias("key"), rule("$.numeric.acctbal.tolerance").alias("tolerance"))


@query(f"""WITH {_M}, h AS (SELECT 'Added' AS section, record_number FROM cls JOIN k ON k.k = cls.k WHERE o = 0 AND n = 1 AND (contains(lower(id), 'build') OR contains(lower(name), 'build') OR contains(lower(nation), 'build') OR contains(lower(acctbal), 'build') OR contains(lower(segment), 'build'))
  UNION ALL SELECT 'Removed', record_number FROM cls JOIN k ON k.k = cls.k WHERE o = 1 AND n = 0 AND (contains(lower(id), 'build') OR contains(lower(name), 'build') OR contains(lower(nation), 'build') OR contains(lower(acctbal), 'build') OR contains(lower(segment), 'build'))) SELECT section, record_number FROM h""")
def c20_search_records(spark, sf):
    """C20: records added and removed with a text in any value."""
    from ..sources import sinks

    rows = _rows(spark, sf)
    classes = C.classify(rows)
    sections = sinks.compare_sections(rows, classes, _compared(spark, sf))
    one = lambda name: C.search(name, sections[name], "Build").select(F.lit(name).alias("section"), "record_number")
    return one("Added").unionByName(one("Removed"))
