"""Operator 5: documents whose word shingle sets have a Jaccard similarity of at least a threshold, as groups.

1. Each text becomes a sorted array of distinct 64-bit shingle hashes. Texts with equal sets are one class, named by
   its least document; only that one goes on.
2. Candidate tiles. Two different sets that are similar enough have so few elements in one of them only that, along
   the hash order, two of their first common elements stand next to each other in both arrays. So each set gives the
   neighbouring pairs of its first elements as keys (how many follows from the threshold, see `reach`), and two sets
   that link share a key. Such keys are rare among texts that only share a passage or common phrases.
3. Each document is first compared with the least document that shares its key, which is linear work and joins most
   copies. Keys whose documents are all joined by then are done.
4. The documents of the other keys go to size-banded tiles: bands of set sizes are so wide that sets that can link lie
   in the same band or in neighbours, and a tile is a key with a band and the visitors from the band below. A tile
   larger than a block becomes tiles for its pairs of blocks. Inside, bitmaps of the sets are compared: an element whose
   bit the other bitmap lacks is in one set only, so the bit counts bound the overlap from above. Only pairs of
   different groups that pass are compared by exact intersection of the sorted arrays.
5. Links make groups by connected components.

Keys that a large share of the documents has (found in a sample of documents; a wrong guess costs time, not links) have
their least document found by an aggregate with partial sums and joined by broadcast, all others by a window, so that
no task holds all rows of a hot key.

No pair that links is lost: every pair with a common key is either joined already or compared.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import discard, held, map_texts, materialize, release, slices, spread, whole_tiles

BITS = 2048
BLOCK = 256
SAMPLED = 64  # one class in so many is looked at for hot keys
HOT = 1000  # a key is hot if more than one in so many of the sampled classes has it, and more than 20


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text; of the whole sequence if it has fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    memo = held("words", _Memo)
    if len(memo) > 150_000:
        memo.clear()
    get = memo.__getitem__
    h = np.fromiter(map(get, words), dtype=np.uint64, count=len(words))
    take = min(k, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - take + 1, take, dtype=np.uint64)
        for j in range(take):
            acc = (acc ^ h[j : len(words) - take + 1 + j]) * _C
            acc ^= acc >> np.uint64(29)
        acc = acc * np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def reach(n: int, t: Fraction) -> int:
    """How many of a set's first elements must give keys.

    With overlap o, the sets have d = a + b - 2o elements in one set only; among d + 2 common elements some two have
    none of these between them, and the last of these stands at most d + 2 + (a - o) from the start.
    """
    most = 0
    for b in (math.ceil(n * t), n, math.floor(n / t)):
        o = math.ceil(t * (n + b) / (1 + t))
        most = max(most, 2 * n + b - 3 * o + 2)
    return min(n, most + 1)


def keys(s: np.ndarray, t: Fraction) -> np.ndarray:
    head = s[: reach(len(s), t)]
    with np.errstate(over="ignore"):
        h = (head[:-1] * _C ^ head[1:]) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _digest(s: np.ndarray) -> int:
    """With the size, the name of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else 0


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=bool)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _ok(overlap, a, b, t: Fraction):
    return t.denominator * overlap >= t.numerator * (a + b - overlap)


def _sets(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    def run(texts):
        n, digest, own = [], [], []
        for text in texts:
            s = shingles(text, k)
            n.append(len(s))
            digest.append(_digest(s))
            own.append(keys(s, t) if len(s) > 1 else np.zeros(0, dtype=np.int64))
        return n, digest, own

    return map_texts(docs, "text", lambda: run, "n long, digest long, keys array<long>").drop("text")


FILTER_BITS = 1 << 23


def _chosen(ids: DataFrame) -> np.ndarray:
    """A bitmap of a fixed size (1 MB) over hashed ids: whatever the corpus, so much reaches the driver and no more."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    found = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8 + 2 * 4096, dtype=np.uint8)
    for r in found:
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _arrays(docs: DataFrame, k: int, chosen: np.ndarray) -> DataFrame:
    """(id, n, digest, bits, elements) of the documents that the bitmap holds (and a few more, which a join drops)."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = docs.select("id", F.bitmap_bucket_number(h).alias("bucket"), F.bitmap_bit_position(h).alias("bit"), "text")

    def work(frames):
        bits = shared.value
        for frame in frames:
            at, bit = frame["bucket"].to_numpy() * 4096 + frame["bit"].to_numpy() // 8, frame["bit"].to_numpy() % 8
            own = frame[(bits[at] >> bit) & 1 == 1]
            for part in slices([own], "text", 3_000_000) if len(own) else ():
                got = [shingles(text, k) for text in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in got], "digest": [_digest(s) for s in got], "bits": [bitmap(s) for s in got], "elements": [s.tobytes() for s in got]})
        release()

    return rows.mapInPandas(work, "id long, n long, digest long, bits binary, elements binary")


def _verified(pairs: DataFrame, arrays: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that link: bounded by bit counts first, then by intersection."""

    @F.pandas_udf("boolean")
    def may(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(v), dtype=np.uint64).reshape(len(v), -1) for v in (x, y))
        only_x, only_y = (np.bitwise_count(u & ~v).sum(axis=1).astype(np.int64) for u, v in ((p, q), (q, p)))
        a, b = n.to_numpy(), m.to_numpy()
        return pd.Series(_ok(np.minimum(a - only_x, b - only_y), a, b, t))

    @F.pandas_udf("boolean")
    def link(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            u, v = np.frombuffer(u, dtype=np.uint64), np.frombuffer(v, dtype=np.uint64)
            out.append(bool(_ok(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), t)))
        return pd.Series(out, dtype=bool)

    def side(c: str, *cols: str) -> DataFrame:
        return arrays.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])

    bounded = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    num, den = t.numerator, t.denominator
    bounded = bounded.filter((F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num) & may("a_bits", "b_bits", "a_n", "b_n")).select("a", "b")
    exact = bounded.join(side("a", "elements"), "a").join(side("b", "elements"), "b")
    return exact.filter(link("a_elements", "b_elements")).select("a", "b")


def _tile_pairs(rows: DataFrame, t: Fraction, parts: int, most: int = 60_000) -> DataFrame:
    """Pairs of different groups in tiles (key, tile, i, j) whose bit counts allow a link; `most` are looked at at once.

    Two visitors of a tile are at home in the tile of the band below and meet there.
    """
    num, den = t.numerator, t.denominator
    keys = ["key", "tile", "i", "j"]

    def work(frames):
        for frame, starts in whole_tiles(frames, keys):
            group, n, own, ids, home = (frame[c].to_numpy() for c in ("group", "n", "block", "id", "home"))
            bits = np.frombuffer(b"".join(frame["bits"]), dtype=np.uint64).reshape(len(frame), -1)
            at, ends = np.arange(len(frame)), np.append(starts[1:], len(frame))
            sizes = ends - starts
            # rows of a tile of two blocks are sorted by block: those of the first meet those of the second only
            crossed = np.repeat(own[starts] != own[ends - 1], sizes)
            turn = np.repeat(starts + np.add.reduceat((own == np.repeat(own[starts], sizes)).astype(np.int64), starts), sizes)
            single = np.repeat((frame["i"].to_numpy() != frame["j"].to_numpy())[starts], sizes) & ~crossed
            first = np.where(crossed, np.where(at < turn, turn, np.repeat(ends, sizes)), at + 1)
            many = np.where(single, 0, np.repeat(ends, sizes) - first)
            step = (np.cumsum(many) - many) // most
            for k in np.unique(step):
                own_rows = np.flatnonzero(step == k)
                c = many[own_rows]
                x = np.repeat(own_rows, c)
                y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[own_rows], c)
                ok = (home[x] | home[y]) & (group[x] != group[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                p, q = bits[x], bits[y]
                both = np.bitwise_count(p & q).sum(axis=1, dtype=np.int64)
                only_x, only_y = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) - both for v in (p, q))
                ok = _ok(np.minimum(n[x] - only_x, n[y] - only_y), n[x], n[y], t)
                x, y = ids[x[ok]], ids[y[ok]]
                if len(x):
                    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
        release()

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "block").mapInPandas(work, "a long, b long")


def _hot_keys(own: DataFrame) -> DataFrame:
    """Keys that many of the sampled classes have. A class has its keys once each but for chance, so with K keys a class
    on the average there are at most K * HOT of them, whatever the number of documents."""
    part = own.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    few = part.agg(F.count("*")).first()[0] // HOT
    keyed = part.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    return keyed.filter(F.col("rows") > max(20, few)).select("key")


def _tiled(own: DataFrame) -> DataFrame:
    """(key, id, least) of the keys of more than one document; own: (id, keys)."""
    hot = materialize(_hot_keys(own), "hot-keys")
    keyed = own.select("id", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    cold = keyed.join(F.broadcast(hot), "key", "left_anti").withColumns({"least": F.min("id").over(same), "most": F.max("id").over(same)})
    out = cold.filter("least < most").select("key", "id", "least")
    if not hot.isEmpty():
        known = materialize(keyed.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most"), "hot-least")
        out = out.unionByName(keyed.join(F.broadcast(known), "key").select("key", "id", "least"))
    return out.distinct()


def _banded(rows: DataFrame, sizes: DataFrame, t: Fraction) -> DataFrame:
    """(key, tile, id, group, home, block, i, j) of tiles whose documents are not all of one group; rows: (key, id, group)."""
    # a little narrower than 1/t, so that rounding moves no two sets that can link more than one band apart
    width = max(-math.log(t), 0.01) * 1.001
    banded = rows.join(sizes, "id").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    banded = banded.select("key", "id", "group", "band", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tile")).withColumn("home", F.col("band") == F.col("tile"))
    open_tiles = banded.groupBy("key", "tile").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.bool_or("home").alias("any_home"), F.count("*").alias("rows"))
    open_tiles = open_tiles.filter("g0 < g1 and any_home").select("key", "tile", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    blocked = banded.join(open_tiles, ["key", "tile"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocked.select("key", "tile", "id", "group", "home", "block", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Words are runs of anything but ASCII white space, A-Z in lower case. Null, empty and blank texts have an empty set
    and link with nothing; equal sets always link. Rows that share a key count as one document for links; a row with a
    null key links with nothing and has a null component_id. threshold is exact (a fraction from 3/4 up to 1).
    """
    t = Fraction(threshold)
    if not Fraction(3, 4) <= t <= 1:
        raise ValueError("threshold must be from 3/4 to 1")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sets = materialize(_sets(rows, k, t), "sets")
    slim = materialize(sets.drop("keys"), "sizes")
    reps = materialize(slim.filter("id is not null and n > 0").groupBy("n", "digest").agg(F.min("id").alias("rep")), "classes")
    first = reps.select("n", "digest", F.col("rep").alias("id"))
    own = materialize(sets.filter("id is not null and n > 1").join(first, ["n", "digest", "id"], "left_semi").select("id", "keys"), "keys")
    discard(sets)
    tiled = materialize(_tiled(own), "tiles")
    discard(own)

    # candidates are few: a fixed-size bitmap of them spares shuffling the other texts
    arrays = _arrays(rows.filter("id is not null and text is not null"), k, _chosen(tiled.select("id").distinct()))
    arrays = arrays.join(first.join(tiled.select("id").distinct(), "id", "left_semi"), ["id", "n", "digest"], "left_semi")
    arrays = materialize(arrays.dropDuplicates(["id", "n", "digest"]).drop("digest"), "arrays")

    pivots = tiled.filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_verified(pivots, arrays, t), "links")
    groups = components(links, "a", "b")
    joined = materialize(groups, "joined")
    discard(links, groups)

    grouped = tiled.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 < g1").select("key")
    blocked = _banded(grouped.join(open_keys, "key"), first.select("id", "n"), t).join(arrays.select("id", "n", "bits"), "id")
    pairs = materialize(_tile_pairs(blocked, t, spread(docs)).distinct(), "pairs")
    more = materialize(_verified(pairs, arrays, t), "more-links")
    discard(tiled, arrays, pairs)

    # equal sets of rows with different keys are tied to their class's first document
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    discard(joined, more)
    named = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component_id"))
    out = slim.join(named, ["n", "digest"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One document of each group of similar ones (the least key) and all others; of rows that repeat it, one stays."""
    groups = similar_groups(docs, key, **options).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    names = docs.columns
    at = names.index(key)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = inner.join(groups, inner[f"c{at}"] == groups["__kept"], "left_semi").dropDuplicates([f"c{at}"])
    return kept.unionByName(inner.filter(F.col(f"c{at}").isNull())).toDF(*names)
