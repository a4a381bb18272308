"""Operator 8: token ids as length-delimited binary records with a separate offset index.

A shard file is a run of records in ascending key order:

    length   uint64 little-endian: bytes of the payload
    check    uint32: masked CRC-32 of the length field
    payload  int64 key, bytes of an id (2 or 4), then the ids, all little-endian
    check    uint32: masked CRC-32 of the payload

A mask rotates the checksum and adds a constant, so that a record that itself holds checksums is not mistaken for
sound. The index file `<shard>.idx` has one (key int64, offset uint64, length uint64) entry per record: a reader that
shuffles seeks straight to a record. Files are written under a temporary name and renamed, so a task that is lost and
run again leaves the same bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, new_path, release, slices, small_batches

_MASK = 0xA282EAD8  # fixed value of the format
_ENTRY = "<qQQ"  # key, offset, length of a record in the index


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", masked(length)) + data + struct.pack("<I", masked(data))


class BadRecord(ValueError):
    """A record whose lengths or checksums do not hold."""


def records(stream, where: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a stream, checked."""
    at = 0
    while head := stream.read(12):
        if len(head) < 12:
            raise BadRecord(f"{where}: cut at {at}")
        n, check = struct.unpack("<QI", head)
        if masked(head[:8]) != check:
            raise BadRecord(f"{where}: length at {at}")
        data, tail = stream.read(n), stream.read(4)
        if len(data) < n or len(tail) < 4 or masked(data) != struct.unpack("<I", tail)[0]:
            raise BadRecord(f"{where}: payload at {at}")
        yield at, data
        at += 12 + n + 4


def payload(key: int, ids: np.ndarray) -> bytes:
    """Ids take two bytes where all of a sequence fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<qB", key, width) + ids.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> tuple[int, np.ndarray]:
    key, width = struct.unpack_from("<qB", data)
    return key, np.frombuffer(data, dtype=f"<u{width}", offset=9).astype("<u4")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class WordEncoder(dict):
    """The ids of texts by a tokenizer that drops white space: a dictionary from words to native uint32 ids.

    White space ends every piece of such a tokenizer, so a text's ids are its words' ids in turn. Words are cut at ASCII
    white space alone; whatever else the tokenizer holds for white space lies inside a word and is left to it. A word
    of Latin-1 letters is one piece that normalisation only lower-cases, so it goes straight to the tokenizer's model,
    and ASCII punctuation behind it is a piece of its own; both are tried on probes first and not used if the tokenizer
    differs. All other words are encoded whole, so what a word gives never depends on words seen before. Of the words
    met last, between `most` and twice as many are remembered.
    """

    PROBES = ("the", "Straße", "été", "ÀÉÎÕÜ", "x", "naïvetés", "antidisestablishmentarianism", "zwölftausend", "ñandú", "qqqzzz")
    ENDS = (".", ",", ".,", "'", "\"", "###", "!?", "&&&", "...", "-", "<|", "|>", "_")
    PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: bytewise.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha()}
        self.direct = all(self._model(w) == self._whole(w) and all(self._whole(w + e) == self._whole(w) + self._whole(e) for e in self.ENDS) for w in self.PROBES)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, letters: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(letters.lower().translate(self.letters))]

    def _ids(self, word: bytes) -> bytes:
        if self.direct:
            core = word.rstrip(self.PUNCTUATION)
            t = core.decode()
            if t.isalpha() and (t.isascii() or max(t) <= "\xff"):
                if len(core) == len(word):
                    return array("I", self._model(t)).tobytes()
                return self[core] + self[word[len(core) :]]
        return array("I", self._whole(word.decode())).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if (got := self.old.get(word)) is None:
            got = self._ids(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Native uint32 ids of each text (null: none)."""
        get = self.__getitem__
        # special tokens keep their case; in other texts upper case is no other word
        return [b"" if not x else b"".join(map(get, b.split() if b"<|" in (b := x.encode()) else b.lower().split())) for x in texts]


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that its words outlive a task."""
    return held(("encoder", path), lambda: WordEncoder(path))


def write_records(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes whole texts (null: empty), ends each with end_id and writes shards in ascending key order.

    Returns the manifest: a row (shard, path, records, ids, bytes) for each written shard; shards are in key order.
    Rows with equal keys follow each other by text and all stay; null keys come first and are written as the least
    int64 (-2**63). An empty table gives an empty manifest. Shards are cut by key and text hash, so that one repeated
    key does not fill one task. Executors write to `folder` (default: a new one in the shared folder).
    """
    small_batches(docs)
    folder = folder or new_path(docs.sparkSession, "records")
    spark = docs.sparkSession
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("k"), F.col(text).cast("string").alias("t"))
    tie = F.xxhash64("t")
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("k"), tie).sortWithinPartitions(F.col("k"), tie, F.col("t"))

    def work(frames):
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        end = struct.pack("=I", end_id)
        part = TaskContext.get().partitionId()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}.rec"
        own = f"{base}/.{uuid.uuid4().hex}"
        n = ids = at = 0
        with store.open_output_stream(own) as out, store.open_output_stream(own + ".idx") as index:
            for batch in slices(frames, "t", 2_000_000):
                for k, body in zip(batch["k"].tolist(), encode([None if pd.isna(x) else x for x in batch["t"]])):
                    record = frame(payload(k, np.frombuffer(body + end, dtype=np.uint32)))
                    out.write(record)
                    index.write(struct.pack(_ENTRY, k, at, len(record)))
                    n, ids, at = n + 1, ids + len(body) // 4 + 1, at + len(record)
        if not n:
            store.delete_file(own)
            store.delete_file(own + ".idx")
            return
        for made, final in ((own, name), (own + ".idx", name + ".idx")):
            if store.get_file_info(final).type.name != "NotFound":  # of a task that ran before and was lost
                store.delete_file(final)
            store.move(made, final)
        yield pd.DataFrame({"shard": [part], "path": [f"{folder}/part-{part:06d}.rec"], "records": [n], "ids": [ids], "bytes": [at]})
        release()

    return rows.mapInPandas(work, "shard long, path string, records long, ids long, bytes long")


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads shards back, checks every length and checksum, and numbers the ids of all records.

    The manifest has one row per shard, so its running sum is small and made on the driver. Returns one row per
    record: doc_id, start (ids of all records before it), n_tokens, ids_crc32, shard, offset.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["shard"])
    plan, start = [], 0
    for r in rows:
        plan.append((r["path"], r["shard"], start))
        start += r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"
    shards = spark.createDataFrame(plan, "path string, shard long, start long")
    if plan:
        shards = shards.repartition(len(plan))

    def work(frames):
        for batch in frames:
            for path, shard, start in zip(batch["path"], batch["shard"].tolist(), batch["start"].tolist()):
                folder, _, name = path.rpartition("/")
                store, base = _open(folder)
                out = []
                with store.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    for at, data in records(stream, path):
                        key, ids = unpacked(data)
                        out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), shard, at))
                        start += len(ids)
                        if len(out) >= 20_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        return pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])

    return shards.mapInPandas(work, schema).withColumn("doc_id", F.expr(f"nullif(doc_id, {-(2**63) + 1} - 1)"))


def read_one(folder: str, name: str, at: int) -> tuple[int, np.ndarray]:
    """One record by its offset, as a shuffling reader takes it from the index: (key, ids)."""
    store, base = _open(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        f.seek(at)
        _, data = next(records(f, name))
    return unpacked(data)


def read_index(folder: str, name: str) -> list[tuple[int, int, int]]:
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/{name}.idx") as f:
        return list(struct.iter_unpack(_ENTRY, f.read()))


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the records of docs and returns what is read back from the files: see write_records and read_records."""
    from .common import materialize

    return read_records(materialize(write_records(docs, tokenizer, end_id, key, text, folder), "manifest"))
