"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Every step is an aggregate (with partial sums before its shuffle) and a join that adaptive execution may split, so a
node with very many neighbours never has them gathered in one task. Each round is written to the shared folder, and
the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u > v). Large: each larger neighbour of a node is tied to the least of the node and its neighbours."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own link to its least neighbour is kept by the step of the smaller end
        out = out.unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """Rows (node, component): component is the least node reachable; only nodes with a link appear.

    Null ends, self links, repeated and reversed links change nothing. Raises if `rounds` do not suffice (paths double
    each round, so 40 cover any table). The ends may be of any type that has an order. The result reads one table of the
    shared folder, which `discard` of the result deletes.
    """
    x, y = F.col(a), F.col(b)
    edges = materialize(links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds if not edges.isEmpty() else 0):
        before, edges = edges, materialize(_star(_star(edges, small=False), small=True), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        if mark is not None:
            raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch_path = edges.scratch_path
    return out
