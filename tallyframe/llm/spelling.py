"""Operator 12: spelling variants by Bloom-guided neighbourhoods.

Words are counted over whole texts. Each word's edits are probed against Bloom filters of the vocabulary, one for each
word length, in blocks of 64 bits, so that a probe reads one number. Only edits that a filter has are shuffled, to a join
with the vocabulary that tells which of them are words.

Of a pair of near words one edit suffices: the longer word less a letter (the first of a run of equal letters), or the
word with the greater letter at the place where two of one length differ, with each letter below it there. So no pair is
made twice. A word's hash is the xor of a number for each letter and place, so an edit's hash takes one step.

A filter that is broadcast holds at most FILTER_BYTES: a larger vocabulary is cut into parts by hash, and the probes of
each part have a broadcast of their own. A false positive costs a row of the join; no link is lost.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, small_batches

LEAST = 7  # code points of a word
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint64)
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)  # shorter runs give no word
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARDS = 64  # lengths from here on share a filter
BITS = 16  # of a filter for each word
FILTER_BYTES = 32 << 20
WORDS = 20_000  # words and letters that are hashed, edits that are probed, counts that are held together
LETTERS = 1_000_000
PROBES = 1_000_000
COUNTS = 200_000


def _counts(batches):
    """(word, n) of a partition's texts; a word may come several times."""
    found: dict[str, int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for name, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            runs = RUN.findall(text or "")
            seed = zlib.crc32(f"{name or ''}:".encode())
            for run, n in Counter(runs).items():
                word = run.translate(LOWER)
                h = zlib.crc32(word.encode(), seed)
                if h % 31 == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < LEAST:
                        continue
                found[word] = found.get(word, 0) + n
            if len(found) >= COUNTS:
                yield flush()
    yield flush()
    release()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of LEAST code points and 2 occurrences or more."""
    small_batches(docs)
    rows = docs.select(F.col(key).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _number(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return _mix((place.astype(np.uint64) << np.uint64(8)) | letter)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words of one length."""
    letters = _letters(words)
    return np.bitwise_xor.reduce(_number(np.arange(letters.shape[1]), letters), axis=1)


class Filters:
    """The places of the filters: of each length's shard, from `counts` (rows by shard), cut into `parts` by hash."""

    def __init__(self, counts: dict[int, int], parts: int):
        self.parts, size = parts, np.zeros(SHARDS + 1, dtype=np.int64)
        for shard, n in counts.items():
            size[shard] = n * BITS // (64 * parts) + 1
        self.size, self.first, self.slots = size, np.cumsum(size) - size, int(size.sum())

    def place(self, length: int, h: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of hashes that belong to the part, their slots, their bits)"""
        shard = min(length, SHARDS)
        at = np.arange(len(h)) if self.parts == 1 else np.flatnonzero(_mix(h) % np.uint64(self.parts) == np.uint64(part))
        h = h[at]
        slot = self.first[shard] + (((h >> np.uint64(32)) * np.uint64(self.size[shard])) >> np.uint64(32)).astype(np.int64)
        bits = np.zeros(len(h), dtype=np.uint64)
        for k in range(5):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return at, slot, bits

    def has(self, table: np.ndarray, length: int, h: np.ndarray, part: int) -> np.ndarray:
        """Index of the hashes that the part's table may hold."""
        if not self.size[min(length, SHARDS)]:
            return np.zeros(0, dtype=np.int64)
        at, slot, bits = self.place(length, h, part)
        return at[(table[slot] & bits) == bits]


def _by_length(batches, columns: int):
    """Lists of the columns, the first of which has words, for words of one length, about WORDS or LETTERS together."""
    held, letters = [[] for _ in range(columns)], 0
    for batch in batches:
        for i in range(columns):
            held[i] += batch.column(i).to_pylist()
        letters += sum(map(len, held[0][-batch.num_rows :])) if batch.num_rows else 0
        if len(held[0]) >= WORDS or letters >= LETTERS:
            yield from _groups(held)
            held, letters = [[] for _ in range(columns)], 0
    yield from _groups(held)


def _groups(held):
    sizes = np.array([len(w) for w in held[0]], dtype=np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length).tolist()
        step = max(1, LETTERS // int(length))
        for a in range(0, len(at), step):
            yield int(length), [[column[i] for i in at[a : a + step]] for column in held]


def _filled(filters: Filters, part: int):
    def fill(batches):
        for length, (words,) in _by_length(batches, 1):
            _, slot, bits = filters.place(length, hashes(words), part)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    return fill


def edits(words: list[str], has) -> list[tuple[int, str]]:
    """(index of the word, edit) of each edit of words of one length that has(length, hashes) may find."""
    letters = _letters(words)
    m, length = letters.shape
    place = np.arange(length)
    own = _number(place, letters)
    whole, out = np.bitwise_xor.reduce(own, axis=1), []
    # less one letter: the letters before it as they are, those behind it one place lower
    lower = _number(place[:-1], letters[:, 1:])
    before = np.bitwise_xor.accumulate(own, axis=1) ^ own
    behind = np.zeros_like(own)
    behind[:, :-1] = np.bitwise_xor.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    first = np.ones((m, length), dtype=bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    at = np.flatnonzero(first)
    for k in at[has(length - 1, (before ^ behind).ravel()[at])].tolist():
        w, p = words[k // length], k % length
        out.append((k // length, w[:p] + w[p + 1 :]))
    # each letter by those below it, PROBES at a time
    base, rank = (whole[:, None] ^ own).ravel(), np.searchsorted(ALPHABET, letters.ravel())
    ends, a = np.cumsum(rank), 0
    while a < len(rank):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PROBES, side="right")))
        n = rank[a:b]
        k = np.repeat(np.arange(a, b), n)
        letter = ALPHABET[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
        hit = has(length, base[k] ^ _number(k % length, letter))
        for i, c in zip(k[hit].tolist(), letter[hit].tolist()):
            w, p = words[i // length], i % length
            out.append((i // length, w[:p] + chr(c) + w[p + 1 :]))
        a = b
    return out


def _probed(filters: Filters, part: int, table):
    def probe(batches):
        bits = table.value
        has = lambda length, h: filters.has(bits, length, h, part)
        for length, (words, n) in _by_length(batches, 2):
            found = edits(words, has)
            cols = [[e for _, e in found], [words[i] for i, _ in found], [n[i] for i, _ in found]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["edit", "word", "n"])
        release()

    return probe


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words that differ by one code point, once. words (word, n) is read often; tables that
    the result reads are in its `spent`."""
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(SHARDS))
    counts = {r[0]: r[1] for r in words.groupBy(shard).count().collect()}  # SHARDS rows at most
    parts = max(1, math.ceil(sum(counts.values()) * BITS / 8 / FILTER_BYTES))
    filters, found, spent = Filters(counts, parts), None, []
    for part in range(parts):
        bits = words.select("word").mapInArrow(_filled(filters, part), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(filters.slots, dtype=np.uint64)
        table[bits["slot"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(table)
        rows = words.select("word", "n").mapInArrow(_probed(filters, part, shared), "edit string, word string, n long")
        if parts > 1:  # one broadcast at a time
            rows = materialize(rows, "probes")
            shared.destroy()
            spent.append(rows)
        found = rows if found is None else found.unionByName(rows)
    out = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("near_n")), "edit").select("word", "n", F.col("edit").alias("near"), "near_n")
    out.spent = spent
    return out


def spelling_forms(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 10) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word is a run of Latin letters, A-Z lower-cased, of 7 code points or more with 2 occurrences or more, after the
    stated deletions (a checksum of key and run names them; a null key counts as empty). Null and empty texts have no
    words, repeated rows count again, a table without words gives no rows. The form is the near word with most
    occurrences, ties to the least by code points, if it has `times` those of the word; else it is null.
    """
    words = materialize(vocabulary(docs, key, text), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct("word", "near", F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    ok = -F.col("best")["m"] >= times * F.col("n")
    told = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best")["near"]).alias("form"), F.when(ok, -F.col("best")["m"]).alias("form_n")), "forms")
    roots = materialize(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    # n grows `times` with each step, which bounds a chain; its known part doubles each round
    most, steps = words.agg(F.max("n")).first()[0] or 0, 1
    while 2 * times ** (steps + 1) <= most:
        last = roots
        roots = materialize(last.join(last.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(last)
        steps *= 2
    discard(words, *pairs.spent)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
