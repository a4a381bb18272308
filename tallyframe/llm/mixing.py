"""Operator 10: mixing sources to target weights.

Each source's words, in an order fixed by a hash of the document key, are packed into blocks of a fixed number of
words. The mix is a number of slots per source, dealt over output shards: each shard draws its counts from a
multinomial over what the sources still have to give, so that all shards together give each source its slots. The
k-th slot of a source takes block number perm(k mod blocks) by a pseudorandom permutation of the source's block
numbers, and slots join blocks on (source, number).

Running word offsets are made in two steps (totals of hashed buckets, then inside a bucket), so a source that holds
most of the rows is never in one task. What reaches the driver is one row per source.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, spread, word_count

WEIGHTS = (3, 1, 2)  # fixed values: repeating, in order of the sources
BLOCK = 64


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Each source's share of `share` times all words; none above `most` times its own, the excess goes to the rest."""
    total = share * sum(sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots by (shard, source): a multinomial draw for each shard over what is left, never above it; sums are exact."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        want = -(-int(left.sum()) // (shards - k))
        while want > 0 and left.sum() > 0:
            draw = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += draw
            left -= draw
            want -= int(draw.sum())
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where number k of 0..n-1 goes in the pseudorandom permutation named by key.

    Four Feistel rounds permute the numbers below the next power of four; a result of n or more goes through again.
    """
    k, n, key = (np.asarray(x, dtype=np.uint64) for x in (k, n, key))
    half = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def rounds(x, half, mask, key):
        left, right = x >> half, x & mask
        for r in range(4):
            h = (right + key * np.uint64(2 * r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)
            left, right = right, left ^ (h & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = rounds(k, half, mask, key)
        while len(far := np.flatnonzero(out >= n)):
            out[far] = rounds(out[far], half[far], mask[far], key[far])
    return out.astype(np.int64)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, shards: int | None = None, seed: int = 17):
    """Returns (pieces, sources): pieces has a row for each stretch of a document in a block with how often the mix
    takes it; sources has a row per source with size, target, blocks and slots.

    Sources in code point order, null last, weigh `weights` in turn. Documents without words give nothing but stay in
    `pieces` with null block. A source whose target is 0 gets no slots. Rows with equal keys are told apart by text.
    Reruns give the same rows: order and draws depend on keys, texts and the seed alone.
    """
    small_batches(docs)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"), *_places(key, text, source, seed))
    rows = rows.withColumn("bucket", F.pmod(F.col("place"), F.lit(1024)))
    rows = materialize(rows, "sizes")
    per = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    own = per.groupBy("source").agg(F.sum("words").alias("source_size")).collect()
    # one row per source; code point order is the order of Python's strings
    names = sorted((r["source"] for r in own if r["source"] is not None)) + [None] * any(r["source"] is None for r in own)
    size_of = {r["source"]: int(r["source_size"]) for r in own}
    sizes = [size_of[s] for s in names]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    blocks = [-(-s // block) for s in sizes]
    last = [s - (b - 1) * block if b else 0 for s, b in zip(sizes, blocks)]
    slots = [_slots(t, s, b, l, block, most) for t, s, b, l in zip(target, sizes, blocks, last)]
    spark = docs.sparkSession
    sources = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(names, sizes, target, blocks, slots))], "s int, source string, source_size long, target double, blocks long, slots long")
    shards = shards or max(16, -(-sum(slots) // 2**24))
    dealt = shard_counts(slots, shards, seed)
    begun = np.cumsum(dealt, axis=0) - dealt
    counts = spark.createDataFrame([(k, i, int(dealt[k, i]), int(begun[k, i]), int(blocks[i])) for k in range(shards) for i in range(len(names)) if dealt[k, i]], "shard int, s int, n long, begun long, blocks long")
    slot = counts.repartition(F.col("shard"), F.col("s")).select("shard", "s", "blocks", "begun", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4096))).alias("run"), "n")
    # a stated number: by size alone these few rows, each of 4,096 slots, would be merged into one task
    slot = slot.repartition(spread(docs), "shard", "s", "run").select("shard", "s", "blocks", F.explode(F.sequence(F.col("begun") + F.col("run") * 4096, F.col("begun") + F.least(F.col("n"), (F.col("run") + 1) * 4096) - 1)).alias("slot"))
    slot = slot.withColumn("number", _number(F.col("slot"), F.col("blocks"), F.col("s"), seed))
    taken = slot.groupBy("s", "number").agg(F.count("*").alias("times"))

    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).drop("words")
    small = sources.select("s", F.col("source").alias("name"))
    placed = rows.join(before, rows["source"].eqNullSafe(before["source"]) & (rows["bucket"] == before["bucket"])).select("doc_id", rows["source"], "size", "place", "twin", rows["bucket"], "before")
    order = Window.partitionBy("source", "bucket").orderBy("place", "twin", "doc_id", "size")
    placed = placed.withColumns({"first": F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(order)})
    placed = placed.join(small, placed["source"].eqNullSafe(small["name"])).drop("name")
    pieces = placed.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block)))).alias("number"))
    # both sides grow with the corpus, so neither is ever broadcast
    pieces = pieces.join(taken.hint("merge"), ["s", "number"], "left").select(
        "doc_id",
        "source",
        "s",
        "size",
        "place",
        "twin",
        "nth",
        F.col("number").alias("block"),
        F.when(F.col("number").isNotNull(), F.greatest(F.lit(0), F.col("number") * block - F.col("first"))).alias("from_word"),
        F.when(F.col("number").isNotNull(), F.least(F.col("size"), (F.col("number") + 1) * block - F.col("first"))).alias("to_word"),
        F.coalesce("times", F.lit(0)).alias("times"),
    )
    return pieces, sources


def _places(key: str, text: str, source: str, seed: int) -> list:
    """Two hashes, 128 bits together, that name a row and give its place."""
    own = [F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string")]
    return [F.xxhash64(F.lit(seed), *own).alias("place"), F.xxhash64(F.lit(~seed), *own).alias("twin")]


def _number(slot, n, source, seed):
    """Block number of a source's slot."""

    @F.pandas_udf("long")
    def number(slot: pd.Series, n: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series(permuted(slot % n, n, source.astype("int64") * 1_000_003 + seed))

    return number(slot, n, source)


def _slots(target: float, size: int, blocks: int, last: int, block: int, most: int) -> int:
    """Slots whose words come nearest to the target, at most `most` for each block."""
    if not blocks:
        return 0
    return max(0, min(most * blocks, round(target * blocks / size)))


def taken_words(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. See mix."""
    pieces, sources = mix(docs, key, text, source, **options)
    per = pieces.groupBy("doc_id", "s", "place", "twin", "nth").agg(F.first("size").alias("size"), F.sum(F.coalesce((F.col("to_word") - F.col("from_word")) * F.col("times"), F.lit(0))).cast("long").alias("taken"))
    return per.join(sources.select("s", "source_size", "target"), "s").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", seed: int = 17, **options) -> DataFrame:
    """The mix as documents: the columns of docs, a row for each time round in which the mix takes words of a document,
    with the words it takes then as text (a document taken whole keeps its text as it is; parts are joined by a line
    end). Documents without taken words give no row. Of rows that repeat key, text and source, other columns come from
    one of them.
    """
    pieces, _ = mix(docs, key, text, source, seed=seed, **options)
    runs = pieces.filter("times > 0").select("place", "twin", "nth", "size", "from_word", "to_word", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("round"))
    runs = runs.groupBy("place", "twin", "nth", "round").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("parts"))
    names = docs.columns
    inner = docs.select("*", *_places(key, text, source, seed)).toDF(*[f"c{i}" for i in range(len(names))], "own_place", "own_twin").dropDuplicates(["own_place", "own_twin"])

    @F.pandas_udf("string")
    def part(texts: pd.Series, sizes: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([_part(t, n, [(x["from_word"], x["to_word"]) for x in p]) for t, n, p in zip(texts, sizes, parts)], dtype=object)

    t = names.index(text)
    joined = inner.join(runs, (inner["own_place"] == runs["place"]) & (inner["own_twin"] == runs["twin"])).withColumn(f"c{t}", part(F.col(f"c{t}"), F.col("size"), F.col("parts")))
    if n_chars in names:
        joined = joined.withColumn(f"c{names.index(n_chars)}", F.length(F.col(f"c{t}")).cast("long"))
    return joined.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _part(text: str, size: int, parts: list[tuple[int, int]]) -> str:
    merged: list[list[int]] = []
    for a, b in parts:
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if merged == [[0, size]]:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)
