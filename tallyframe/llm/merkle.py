"""Operator 13: a Merkle manifest of a dataset by a butterfly exchange of subtree roots.

A row's leaf is the SHA-256 of its fields. Leaves of a group (`by`) stand in key order; runs of eight nodes hash to their
parent, level by level, to the group's subroot, and the subroots, in group order, likewise to the root. A row's proof is
the siblings on its way up; whoever has it can check the row against the root alone.

Leaves are dealt to aligned blocks of 512 (three levels), each of which is hashed in one task. Above that, blocks swap:
in round r, the blocks whose numbers differ in octal digit r alone exchange the hashes of their level-r ancestors, and
each of them hashes the parent for itself. So every block knows its own ancestors and their siblings after the last round;
nothing is sent down again, and no task has more than eight rows of a group to hold together. In a subtree that is not
full, its blocks stand in for the partners that it lacks. The subroots of the groups are swapped in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize, spread, whole_tiles

FANOUT = 8  # fixed value
LEVELS = 3  # of a tree inside a block
BLOCK = FANOUT**LEVELS
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def butterfly(blocks: DataFrame, most: int) -> DataFrame:
    """blocks (g, block, of, hash, others) with hash and path raised to the root of each g.

    Blocks 0 to of - 1 of a g are the nodes of its lowest level; most is the largest `of`. path has a struct for each level
    that hashed more than one node: hex digests of the siblings before and after, joined. A node without siblings is
    hashed alone.
    """
    state, width = blocks.select("g", "block", "of", "hash", F.array().cast(_PATH).alias("path")), 1
    while width < most:
        block, of, fan = F.col("block"), F.col("of"), F.lit(FANOUT)
        node = F.expr(f"block div {width}")
        there = F.least(F.lit(width), of - node * width)  # blocks below the node
        nodes = F.ceil(of / width).cast("long")
        digit, high = node % fan, F.expr(f"block div {width * FANOUT}")
        serves = F.when(nodes - high * fan > 1, F.sequence(block % width, F.lit(width - 1).cast("long"), there)).otherwise(F.array(block % width))
        sent = state.withColumn("node", node).withColumn("digit", digit).withColumn("high", high).withColumn("open", nodes > 1).withColumn("low", F.explode(serves))
        group = Window.partitionBy("g", "high", "low").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = sent.withColumn("all", F.collect_list("hash").over(group)).filter(block % width == F.col("low"))
        side = F.struct(F.array_join(F.slice("all", F.lit(1), F.col("digit").cast("int")), "").alias("before"), F.array_join(F.slice("all", F.col("digit").cast("int") + 2, F.lit(FANOUT)), "").alias("after"))
        state = met.select(
            "g",
            "block",
            "of",
            F.when(F.col("open"), F.sha2(F.array_join("all", ""), 256)).otherwise(F.col("hash")).alias("hash"),
            F.when(F.col("open"), F.concat("path", F.array(side))).otherwise(F.col("path")).alias("path"),
        )
        width *= FANOUT
    return state


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(hashes: list[str], levels: int | None) -> list[list[str]]:
    """Nodes of each level from the leaves up: `levels` of them, or until one node remains."""
    out = [hashes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([_sha("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def _roots(frames):
    """(g, block, leaves, hash) of each block of a partition, hashed until one node remains."""
    for frame, starts in whole_tiles(frames, ["g", "block"]):
        ends, hashes = np.array([*starts[1:], len(frame)]), frame["leaf"].tolist()
        tops = [_levels(hashes[a:b], None)[-1][0] for a, b in zip(starts, ends)]
        yield pd.DataFrame({"g": frame["g"].to_numpy()[starts], "block": frame["block"].to_numpy()[starts], "leaves": ends - starts, "hash": tops})


def _proofs(keep: bool):
    def proven(rows: pd.DataFrame) -> pd.DataFrame:
        """A block's own row, which has the path above it, comes first; its leaves follow."""
        top, rows = rows.iloc[0], rows.iloc[1:]
        tree = _levels(rows["leaf"].tolist(), LEVELS if top["of"] > 1 else None)
        above = [(x["before"], x["after"]) for x in top["path"]]
        shared, proofs, folded = "".join(a + b for a, b in above), [], []
        for i, given in enumerate(rows["given"].tolist()):
            sides, at = [], i
            for nodes in tree[:-1]:
                first = at - at % FANOUT
                sides.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])))
                at //= FANOUT
            for before, after in sides + above:
                given = _sha(before + given + after)
            proofs.append("".join(a + b for a, b in sides) + shared)
            folded.append(given)
        return rows.assign(subroot=top["subroot"], root=top["root"], proof_sha256=[_sha(p) for p in proofs], folded_root=folded, proof=proofs if keep else None)

    def work(frames):
        for frame, starts in whole_tiles(frames, ["g", "block"]):
            for a, b in zip(starts, [*starts[1:], len(frame)]):
                yield proven(frame.iloc[a:b])[_OUT]

    return work


_OUT = ["name", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]


def manifest(docs: DataFrame, fields: list[str], by: str = "lang", key: str = "doc_id", given: list[Column] | None = None, proofs: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    `fields` are hashed in their order. `given` are the same fields as they are found now (themselves by default): their
    leaf is folded with the row's siblings to folded_root, and verified tells whether that is the root. proof (if
    `proofs`, else null) is what proof_sha256 hashes: the siblings' digests, level by level.

    Groups are ordered by the text of `by`, null first; rows of a group by key, null first, and rows of one key by leaf.
    Null fields hash as `-`, so they differ from empty ones. A table without rows has no row and no root.
    """
    kind = docs.schema[key].dataType
    whole = leaf([F.col(c) for c in fields])
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("g"), F.col(key).alias("key"), whole.alias("leaf"), (leaf(given) if given else whole).alias("given"))
    rows = numbered(rows, ["g"], ["key", "leaf"], "place").select("g", F.expr(f"(place - 1) div {BLOCK}").alias("block"), "place", F.col("key").cast("string").alias("name"), "leaf", "given")
    n = spread(docs)
    hashed = rows.select("g", "block", "place", "leaf").repartition(n, "g", "block").sortWithinPartitions("g", "block", "place")
    blocks = materialize(hashed.mapInPandas(_roots, "g string, block long, leaves long, hash string"), "blocks")
    counts = blocks.groupBy("g").agg((F.max("block") + 1).alias("of"))
    most = counts.agg(F.max("of")).first()[0] or 0
    blocks = blocks.join(counts, "g")
    for level in range(LEVELS):  # of several blocks, the last may be short: its top is hashed alone up to the others' level
        short = (F.col("of") > 1) & (F.col("leaves") <= FANOUT**level)
        blocks = blocks.withColumn("hash", F.when(short, F.sha2("hash", 256)).otherwise(F.col("hash")))
    blocks = materialize(butterfly(blocks, most), "paths")
    tops = materialize(blocks.filter("block = 0").select("g", "hash"), "subroots")
    groups = numbered(tops, [], ["g"], "place").select(F.lit("").alias("g"), (F.col("place") - 1).alias("block"), F.lit(tops.count()).cast("long").alias("of"), "hash", F.col("g").alias("name"))
    upper = butterfly(groups, tops.count()).join(groups.select("block", "name"), "block").select(F.col("name").alias("g"), F.col("hash").alias("root"), F.col("path").alias("upper"))
    own = blocks.join(upper, "g").select("g", "block", F.lit(0).cast("long").alias("place"), F.col("hash").alias("subroot"), "root", F.concat("path", "upper").alias("path"), "of")
    dealt = own.unionByName(rows, allowMissingColumns=True).repartition(n, "g", "block").sortWithinPartitions("g", "block", "place")
    out = dealt.mapInPandas(_proofs(proofs), ", ".join(f"{c} string" for c in _OUT))
    return out.select(F.col("name").cast(kind).alias("doc_id"), *_OUT[1:-1], (F.col("folded_root") == F.col("root")).alias("verified"), "proof")


def tampered_manifest(docs: DataFrame, fields: list[str]) -> DataFrame:
    """The manifest, checked against rows of which a third, by the checksum of the key, have had their text lower-cased
    in A-Z since."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.col("text")
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, folded).otherwise(text)
    return manifest(docs, fields, given=[changed if c == "text" else F.col(c) for c in fields])
