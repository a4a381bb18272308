"""Operator 6: benchmark passages in documents, found with an FM-index over each shard of the documents.

A shard is the part of an Arrow batch that one task holds. Its documents become one sequence of word symbols: words of
the test phrases have a symbol of their own, any other word ends a run, and runs are parted by symbol 0. (A run that is
shorter than the shortest phrase cannot hold one and is left out.) The sequence's suffixes are sorted, the
Burrows-Wheeler column is kept in a wavelet matrix, all phrases are searched backwards at once, and the positions of
their occurrences come from suffix positions sampled every 32 symbols and at each run's start. Spans are then merged.

Test phrases go to the tasks in blocks of a bounded number of bytes. With more than one block the documents pass through
one search after the other and are written in between, so that one block at a time is in the driver, a plan and a Python
worker, and memory does not grow with the test set.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize

#: Bytes of words stay (upper case made lower); all other ASCII bytes become a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order, by doubling the compared length."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        both = rank * (n + 2) + second
        order = np.argsort(both, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks over a sequence of symbols, a bit plane at a time."""

    def __init__(self, s: np.ndarray):
        self.levels = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        start = np.zeros_like(i)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((c >> (self.levels - 1 - depth)) & 1).astype(bool)
            a, b = ones[start], ones[i]
            start, i = np.where(up, zeros + a, start - a), np.where(up, zeros + b, i - b)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[i]
            up = ones[i + 1] > a
            c = c * 2 + up
            i = np.where(up, zeros + a, i - a)
        return c


class FMIndex:
    SAMPLE = 32

    def __init__(self, s: np.ndarray):
        """s: symbols; 0 parts runs and must be the last."""
        order = suffix_order(s)
        before = s[order - 1]
        self.n, self.column = len(s), WaveletMatrix(before)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s))))
        kept = (order % self.SAMPLE == 0) | (before == 0)
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.sampled = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, all of one length)."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for c in phrases.T[::-1]:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                break
            seen = c[on] < len(self.first) - 1
            hi[on[~seen]] = lo[on[~seen]]
            on = on[seen]
            lo[on] = self.first[c[on]] + self.column.rank(c[on], lo[on])
            hi[on] = self.first[c[on]] + self.column.rank(c[on], hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows: steps back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = at[todo]
            todo = todo[self.kept[r + 1] == self.kept[r]]
            r = at[todo]
            c = self.column.symbol(r)
            at[todo] = self.first[c] + self.column.rank(c, r)
            steps[todo] += 1
        return self.sampled[self.kept[at]] + steps


class Phrases:
    """The windows of a block of test items as symbol rows by length, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                of[tuple(ids[k : k + window])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(p) for p in of}):
            own = [p for p in of if len(p) == n]
            self.by_length[n] = np.array(own, dtype=np.int64), [sorted(of[p]) for p in own]
        self.least = min(self.by_length, default=0)

    def find(self, texts: list[str | None]) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Words of each text; merged spans of hit words and the items, for texts that have any."""
        counts, ids, get = [], [], self.vocabulary.get
        for text in texts:
            w = words(text)
            counts.append(len(w))
            ids += [get(x, 0) for x in w]
            ids.append(0)
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str]] = defaultdict(set)
        s = np.array(ids, dtype=np.int64)
        inside = np.diff(np.concatenate(([0], (s > 0).astype(np.int8), [0])))
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        long = ends - starts >= max(1, self.least)
        starts, ends = starts[long], ends[long]
        if not len(starts) or not self.by_length:
            return counts, spans, found
        sizes = ends - starts + 1  # with the 0 behind each run
        offset = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(offset[-1]) - np.repeat(offset[:-1], sizes) + np.repeat(starts, sizes)  # in s; ends[-1] is in s, as a 0 follows each text
        index = FMIndex(s[place])
        heads = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
        cover = np.zeros(len(s) + 1, dtype=np.int64)
        for n, (rows, items) in self.by_length.items():
            lo, hi = index.search(rows)
            many = hi - lo
            which = np.repeat(np.arange(len(rows)), many)
            if not len(which):
                continue
            at = place[index.locate(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            doc = np.searchsorted(heads, at, side="right") - 1
            for key in np.unique(doc * len(rows) + which).tolist():
                found[key // len(rows)].update(items[key % len(rows)])
        hit = np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist()):
            doc = int(np.searchsorted(heads, a, side="right") - 1)
            spans.setdefault(doc, []).append((a - int(heads[doc]), b - int(heads[doc])))
        return counts, spans, found


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the hit words, from the first character of a span's first word to the last of its last."""
    raw = text.encode()
    clean, at, places = raw.translate(_TABLE), 0, []
    for w in clean.split():
        at = clean.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def _blocks(items: DataFrame, item: str, text: str, most: int):
    """The number of blocks of about `most` bytes of text, and the blocks, each brought to the driver by itself."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    own = (rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return n, ([(r["i"], r["t"]) for r in x.toLocalIterator()] for x in own)


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, cut: bool = False, block_bytes: int = 8_000_000) -> DataFrame:
    """All columns of docs, then n_words, spans (array of [first, end) word positions, merged) and hit_items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Every
    occurrence in the whole text counts, overlapping ones too. Null and empty texts have no words and no spans; items
    that are null, empty or repeated add nothing; a null item id is written as the empty string. An empty item table
    gives no hits. cut=True also replaces the text by the text without the spans. No shuffle: rows stay in their task.
    """
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    t = own[names.index(text)]
    out, spent = docs.toDF(*own), None
    n, blocks = _blocks(items, item, item_text, block_bytes)
    at_once = cut and n == 1  # then the search cuts too, and a task needs one Python worker
    for k, block in enumerate(blocks):
        phrases = Phrases(block, window)
        if k:
            out = materialize(out, "searched")
            if k > 1:
                discard(spent)
            spent = out
        got = map_texts(out.drop("n_words"), t, lambda p=phrases: _finder(p, at_once), "n_words long, new_spans array<struct<first:long,end:long>>, new_items array<string>" + ", less string" * at_once)
        if at_once:
            got = got.withColumn(t, F.coalesce("less", t))
        spans, hit = F.col("new_spans"), F.col("new_items")
        if k:
            spans, hit = _merged(F.concat("spans", spans)), F.array_sort(F.array_union("hit_items", hit))
        out = got.select(*own, "n_words", spans.alias("spans"), hit.alias("hit_items"))
    if cut and not at_once:
        out = _cut(out, t)
    return out.toDF(*names, "n_words", "spans", "hit_items")


def _finder(phrases: Phrases, cut: bool):
    def run(texts):
        counts, spans, items = phrases.find(texts)
        n = range(len(texts))
        got = counts, [[{"first": a, "end": b} for a, b in spans.get(k, ())] for k in n], [sorted(items.get(k, ())) for k in n]
        return (*got, [without(texts[k], spans[k]) if k in spans else None for k in n]) if cut else got

    return run


def _merged(spans):
    """Sorted spans with overlapping and touching ones joined."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<first:long,end:long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def _cut(out: DataFrame, text: str) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def less(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or not len(s) else without(t, [(x["first"], x["end"]) for x in s]))

    return out.withColumn(text, F.when(F.size("spans") > 0, less(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 10) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    got = find_passages(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), items, "text", item, window=window)
    return got.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
