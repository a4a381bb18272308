"""Operator 9: near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points in order. The inverted lists are keyed by label and two of a
vector's nearest pivots, so two vectors meet in a list when they share at least two pivots; the number of pivots they
share up to that list tells which list owns the pair, so a pair found in several lists counts once. Pairs that meet
are verified by cosine in double precision. Equal vectors are one class and are not compared again.

The number of reference points grows with the square root of the number of classes, so that a list stays as long on a
larger table, up to what a broadcast of a stated size holds. They come from a bounded sample of the vectors, thinned so
that a dense cluster does not take them all, and filled up with seeded random directions; every row is indexed. Where
vectors have few dimensions, or vary in few of them, many points would part near vectors: so pairs at the threshold itself
are made from the sample, and the points are halved until enough of these pairs would meet. A list longer than a block is
dealt to tasks by pairs of blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import discard, materialize, small_batches, spread, whole_tiles

NEAREST = 8  # pivots that describe a vector
SAMPLE = 4  # vectors a reference point that the points are chosen from
BROADCAST = 1 << 22  # numbers in all reference points, at most: 32 MB
BLOCK = 128
PROBES = 1024  # sampled vectors that the number of points is tried with
MET = 0.95  # of pairs at the threshold, the share that must meet


def pivots_for(classes: int, dim: int) -> int:
    """192 for up to 1,024 classes, then in proportion to the square root of their number, up to the broadcast bound."""
    return max(1, min(max(192, round(6 * math.sqrt(classes))), BROADCAST // max(dim, 1)))


def references(sample: np.ndarray, dim: int, count: int, apart: float = 0.6, seed: int = 11) -> np.ndarray:
    """count directions: sampled ones whose cosine with each other is below `apart`, then random ones."""
    out, n = np.empty((count, dim)), 0
    for v in sample:
        if n == count:
            break
        u = v / np.linalg.norm(v)
        if not n or np.abs(out[:n] @ u).max() < apart:
            out[n], n = u, n + 1
    rest = np.random.default_rng(seed + dim).normal(size=(count - n, dim))
    out[n:] = rest / np.linalg.norm(rest, axis=1, keepdims=True)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of very large or small numbers times a power of two: exact, and squares then neither overflow nor vanish."""
    most = np.abs(x).max(axis=1)
    if 1e-100 < most.min() and most.max() < 1e100:
        return x
    return np.ldexp(x, -np.frexp(most)[1][:, None])


def nearest(x: np.ndarray, refs: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """The first `count` of each vector's pivots, nearest first; ties by number."""
    x = scaled(x)
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ refs.T
    return np.argsort(-near, axis=1, kind="stable")[:, :count]


def share_met(sample: np.ndarray, refs: np.ndarray, threshold: float, count: int = NEAREST) -> float:
    """Of pairs at the threshold, made of each sampled vector and the direction of the next one, the share that two pivots join."""
    x = scaled(sample[:PROBES])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.roll(x, 1, axis=0)
    y = y - (y * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(y, axis=1)
    x, y = x[size > 1e-6], y[size > 1e-6] / size[size > 1e-6, None]
    if not len(x):
        return 1.0
    z = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y
    a, b = nearest(x, refs, count), nearest(z, refs, count)
    return float(np.mean((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= 2))


def fitted(sample: np.ndarray, refs: np.ndarray, threshold: float, count: int = NEAREST) -> np.ndarray:
    """The first of refs, as many as are left when MET of the pairs at the threshold meet. With `count` all vectors meet."""
    while len(refs) > count and share_met(sample, refs, threshold, count) < MET:
        refs = refs[: max(count, len(refs) // 2)]
    return refs


def random_pivots(dim: int) -> int:
    """Points of a length that has no sample of its own: 192, fewer below 12 dimensions, where 192 would part near vectors."""
    return max(NEAREST, min(192, 16 * dim))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, pivots: int | None = None, count: int = NEAREST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal length are compared. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, and so do rows with a null key (null component_id, not kept). Equal
    vectors link with each other (their cosine is 1). A row is a vector of its own: rows that repeat a key, with the
    same vector or another, count and are counted by what their own vectors link with. `pivots` fixes the number of
    reference points (default: pivots_for, halved until pairs at the threshold meet). Up to 64 vector lengths have points
    from a sample; vectors of further lengths are described by random directions.
    """
    spark = vectors.sparkSession
    small_batches(vectors)
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), x.alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    # a class is named by 128 bits of its label and vector; -0.0 is 0.0
    text = F.concat_ws(",", F.transform("x", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("string")))
    digest = F.md5(F.concat_ws("|", F.octet_length("label").cast("string"), "label", text))
    rows = rows.withColumn("digest", F.when(sound & F.col("label").isNotNull() & F.col("id").isNotNull(), digest))
    slim = materialize(rows.select("id", "digest"), "rows")
    reps = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.any_value("label").alias("label"), F.any_value("x").alias("x"))
    # nodes are in the order of the least ids, so the least node of a component tells its least id
    node = F.concat(F.lpad((F.col("rep").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), "digest")
    reps = materialize(reps.select(node.alias("node"), "digest", "times", "label", F.size("x").alias("dim"), "x"), "classes")

    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    refs: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():  # a length beyond the 64 commonest is described by random directions
        many = pivots or pivots_for(n, dim)
        sample = reps.filter(F.col("dim") == dim).select("x", F.xxhash64("node", F.lit(4)).alias("h"), "node").orderBy("h", "node").limit(SAMPLE * many).select("x").toPandas()["x"]
        vectors_of = scaled(np.array(sample.tolist()))
        refs[dim] = references(vectors_of, dim, many)
        if not pivots:
            refs[dim] = fitted(vectors_of, refs[dim], threshold, count)
        if sum(r.size for r in refs.values()) > BROADCAST:
            break
    shared = spark.sparkContext.broadcast(refs)

    def describe(frames):
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                at = shared.value.get(dim)
                if at is None:
                    at = references(np.zeros((0, dim)), dim, pivots or random_pivots(dim))
                near = nearest(np.array(own["x"].tolist()), at, count)
                yield pd.DataFrame({"node": own["node"].to_numpy(), "label": own["label"].to_numpy(), "dim": dim, "near": np.sort(near, axis=1).astype(np.int32).tolist()})

    described = materialize(reps.select("node", "label", "dim", "x").mapInPandas(describe, "node string, label string, dim int, near array<int>"), "described")
    two = F.array(*[F.struct(F.get("near", F.lit(a)).alias("p"), F.get("near", F.lit(b)).alias("q")) for a, b in combinations(range(count), 2)])
    listed = described.select("node", "label", "dim", F.explode(two).alias("pq")).select("node", "label", "dim", "pq.p", "pq.q").filter("q is not null")
    lists = listed.groupBy("label", "dim", "p", "q").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    met = listed.join(lists, ["label", "dim", "p", "q"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    met = met.select("node", "label", "dim", "p", "q", "block", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"))
    met = met.join(described.select("node", "near"), "node").join(reps.select("node", "x", "times"), "node")

    keys = ["label", "dim", "p", "q", "i", "j"]

    def work(frames):
        for frame, starts in whole_tiles(frames, keys):
            node, xs, near, times, own, last, crossed = (frame[c].to_numpy() for c in ("node", "x", "near", "times", "block", "q", "j"))
            crossed, out = crossed != frame["i"].to_numpy(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
                x = scaled(np.vstack(xs[a:b]))
                norm = np.sqrt((x * x).sum(axis=1))
                fits = np.triu(x @ x.T / norm[:, None] / norm[None, :] >= threshold, 1)
                if crossed[a]:
                    fits &= own[a:b, None] != own[None, a:b]
                u, v = np.nonzero(fits)
                if not len(u):
                    continue
                # the list owns a pair if p and q are the first two pivots that they share
                of = np.vstack(near[a:b])
                many = np.concatenate([((of[u[k : k + 8192], :, None] == of[v[k : k + 8192], None, :]) & (of[u[k : k + 8192]] <= last[a])[:, :, None]).sum(axis=(1, 2)) for k in range(0, len(u), 8192)])
                u, v = u[many == 2], v[many == 2]
                if not len(u):
                    continue
                t = times[a:b].astype(float)
                n = np.bincount(u, t[v], b - a) + np.bincount(v, t[u], b - a)
                on = np.flatnonzero(n)
                out.append(pd.DataFrame({"node": node[a:b][on], "n": n[on].astype(np.int64), "other": None}))
                linked = np.zeros((b - a, b - a), dtype=bool)
                linked[u, v] = linked[v, u] = True
                u, v = _forest(linked)
                out.append(pd.DataFrame({"node": node[a:b][u], "n": 0, "other": node[a:b][v]}))
            if out:
                yield pd.concat(out)

    found = met.repartition(spread(vectors), *keys).sortWithinPartitions(*keys).mapInPandas(work, "node string, n long, other string")
    found = materialize(found, "links")
    links = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other is not null"), "node", "other")
    discard(described)
    tied = reps.select("node", "digest", "times").join(links, "node", "left").join(groups, "node", "left")
    least = (F.substring(F.coalesce("component", "node"), 1, 20).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
    named = tied.select("digest", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), least.alias("component_id"))
    out = slim.join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _forest(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the tile's components together, one fewer than the nodes of each."""
    left = set(np.flatnonzero(fits.any(axis=1)).tolist())
    xs, ys = [], []
    free = np.zeros(len(fits), dtype=bool)
    free[list(left)] = True
    while free.any():
        todo = [int(np.flatnonzero(free)[0])]
        free[todo[0]] = False
        while todo:
            a = todo.pop()
            new = np.flatnonzero(fits[a] & free)
            free[new] = False
            xs += [a] * len(new)
            ys += new.tolist()
            todo += new.tolist()
    return np.array(xs, dtype=np.int64), np.array(ys, dtype=np.int64)
