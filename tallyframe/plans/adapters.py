"""The two sides that the operators need, derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

UNITS = "CAST(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * floor(value / 10) * 1000 AS BIGINT)"


def _events(kind: str) -> str:
    return f"""SELECT 'ACC' || CAST(user_id % 4 AS STRING) AS account, event_id AS record_number, CAST(ts AS DATE) AS day, {UNITS} AS amount,
      CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'R' || CAST(event_id % 4 AS STRING) END AS reference, 'U' || CAST(user_id % 2 AS STRING) AS description, event_id % 9 = 0 AS is_carried
      FROM events WHERE event_type = '{kind}' AND abs({UNITS}) > 0"""


VIEWS = {
    "old_customer": """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CAST(c_nationkey AS STRING) AS nation, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) AS acctbal,
      c_mktsegment AS segment, c_custkey + 1 AS record_number FROM customer WHERE c_custkey % 50 <> 7""",
    "new_customer": """SELECT CASE WHEN c_custkey % 40 = 9 THEN '  ' || CAST(c_custkey AS STRING) || ' ' ELSE CAST(c_custkey AS STRING) END AS id,
      CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) ELSE c_name END AS name, CAST(c_nationkey AS STRING) AS nation,
      CASE WHEN c_custkey % 25 = 6 THEN 'N/A' WHEN c_custkey % 10 = 3 THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) + CAST(0.01 AS DECIMAL(15,2)) AS STRING)
        WHEN c_custkey % 10 = 4 THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) + CAST(1.00 AS DECIMAL(15,2)) AS STRING) ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) END AS acctbal,
      CASE WHEN c_custkey % 17 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, c_custkey + 1 AS record_number FROM customer WHERE c_custkey % 50 <> 13
      UNION ALL SELECT CAST(c_custkey AS STRING), c_name, CAST(c_nationkey AS STRING), '0.00', c_mktsegment, 1000000 + c_custkey FROM customer WHERE c_custkey % 60 = 21
      UNION ALL SELECT '', c_name, CAST(c_nationkey AS STRING), '0.00', c_mktsegment, 2000000 + c_custkey FROM customer WHERE c_custkey % 70 = 5""",
    "bank": _events("purchase"),
    "books": _events("view"),
    "books_lines": """SELECT 'ACC' || CAST(l_orderkey % 4 AS STRING) AS account, CAST(l_orderkey AS STRING) AS batch, l_orderkey * 10 + l_linenumber AS record_number, CAST(l_shipdate AS DATE) AS day,
      CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 100) AS BIGINT) * (CASE WHEN l_orderkey % 37 = 0 AND l_linenumber = 2 THEN -1 ELSE 1 END) AS amount,
      CAST(l_partkey AS STRING) AS reference, l_orderkey % 41 = 0 AND l_linenumber = 1 AS has_problem FROM lineitem""",
    "amount_text": """SELECT l_orderkey * 10 + l_linenumber AS record_number, 'ACC' || CAST(l_orderkey % 4 AS STRING) AS account,
      CASE l_linenumber WHEN 1 THEN CAST(100 + l_orderkey % 900 AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || '.' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')
        WHEN 2 THEN CAST(l_partkey AS STRING) || '.' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') || '-' WHEN 3 THEN '(' || CAST(l_partkey AS STRING) || ')' WHEN 4 THEN 'N/A' WHEN 5 THEN '1e5'
        WHEN 6 THEN '-.' || CAST(l_suppkey % 10 AS STRING) || '00' ELSE CAST(l_partkey AS STRING) || '.505' END AS raw,
      CASE WHEN l_linenumber IN (1, 2) THEN CAST(l_partkey AS STRING) || '.' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') WHEN l_linenumber = 3 THEN '-5' WHEN l_linenumber = 5 THEN '0' ELSE '' END AS money_in,
      CASE WHEN l_linenumber IN (2, 4) THEN CAST(l_suppkey AS STRING) || '.5' WHEN l_linenumber = 6 THEN 'x' ELSE '' END AS money_out,
      CAST(day(l_shipdate) AS STRING) || '/' || CAST(CASE WHEN l_partkey % 31 = 0 THEN 13 ELSE month(l_shipdate) END AS STRING) || '/' || CAST(year(l_shipdate) AS STRING) AS day_text FROM lineitem""",
    "date_text": """SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 1 THEN '31/02/2024' WHEN o_orderkey % 31 = 2 THEN '001/02/2024' WHEN o_orderkey % 31 = 3 THEN '' WHEN o_orderkey % 31 = 4 THEN '1/2/24'
      ELSE CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) END AS raw FROM orders""",
    "log": """SELECT 'U' || CAST(user_id AS STRING) AS account, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
      CASE event_id % 6 WHEN 0 THEN 'confirm' WHEN 1 THEN 'confirm' WHEN 2 THEN 'unmatch' WHEN 3 THEN 'reject' WHEN 4 THEN 'restore' ELSE 'classify' END AS action,
      CASE WHEN event_id % 6 < 5 THEN event_id % 7 END AS bank, CASE WHEN event_id % 6 < 5 THEN event_id % 5 END AS books,
      CASE WHEN event_id % 6 = 5 THEN 'bank' END AS side, CASE WHEN event_id % 6 = 5 THEN event_id % 7 END AS record_number,
      CASE WHEN event_id % 6 = 5 THEN 'investigate' END AS classification, event_id % 11 = 0 AS broken FROM events""",
}
BASE = ("customer", "events", "lineitem", "orders", "documents", "conversations")


def sql(query: str) -> str:
    """The query with the views that it names, as DuckDB reads it."""
    need: list[str] = []

    def add(text: str):
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(re.sub(r"'[^']*'", "", query))
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    own = query.strip()
    if own.upper().startswith("WITH RECURSIVE ") and ctes:
        return f"WITH RECURSIVE {ctes}, {own[15:]}"
    if own.upper().startswith("WITH "):
        return f"WITH {ctes}, {own[5:]}" if ctes else own
    return f"WITH {ctes} {own}" if ctes else own


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A view over the given tables. dealt: a table whose scan has fewer parts than there are cores (a file of one row group
    is one part) is dealt to all of them first, for views and operators that compute much for each row."""
    for t in BASE:
        if re.search(rf"\bFROM {t}\b", VIEWS[name]):
            rows, cores = spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark.sparkContext.defaultParallelism
            if dealt and rows.rdd.getNumPartitions() < cores:
                rows = rows.repartition(cores)
            rows.createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])
