"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute known
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, new_path  # noqa: F401  the operators take them from here

#: The bytes of words for op10: anything but ASCII white space.
_WORD_BYTE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> int:
    """Partitions for shuffled work: the session's number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words_of(texts: pa.Array) -> np.ndarray:
    """Words of each text of an Arrow string array by op10's rule (0 for null), counted in its byte buffer: a word starts
    at a word byte behind white space or at a text's start."""
    texts = texts.cast("large_string")
    out = np.zeros(len(texts), dtype=np.int64)
    at, data = (np.frombuffer(x if x is not None else b"", dtype=d) for x, d in zip(texts.buffers()[1:], ("<i8", "u1")))
    at = at[texts.offset : texts.offset + len(texts) + 1]
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        word = _WORD_BYTE[data[at[0] : at[-1]]]
        start, first = word.copy(), at[full] - at[0]
        start[1:] &= ~word[:-1]
        start[first] = word[first]
        out[full] = np.add.reduceat(start, first, dtype=np.int64)
    out[texts.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


def word_count(text: Column) -> Column:
    """Words of op10's rule; 0 for null."""

    @F.arrow_udf("long")
    def count(t: pa.Array) -> pa.Array:
        return pa.array(words_of(t))

    return count(text)


_HELD: dict = {}
_C = ctypes.CDLL(None)


def held(name, make: Callable):
    """What a Python worker remembers from task to task, one operator's at a time: the next one's takes its place."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Gives memory that is free back to the system at the end of a task: a Python worker outlives it and would keep
    the most it ever held, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(frames: Iterable[pd.DataFrame], column: str, chars: int) -> Iterator[pd.DataFrame]:
    """Cuts batches so that their texts hold about `chars` code points; one row is never cut."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        step = (np.cumsum(sizes) - sizes) // chars
        for k in np.unique(step):
            yield frame[step == k]


def whole_tiles(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, starts) with starts of the runs of equal keys, for a partition sorted by them; no run is ever cut. Holds
    one batch and one run."""
    rest = None
    for frame in frames:
        if rest is not None and len(rest):
            frame = pd.concat([rest, frame], ignore_index=True)
        if frame.empty:
            continue
        new = np.zeros(len(frame), dtype=bool)
        new[0] = True
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        rest = frame.iloc[starts[-1] :]
        if len(starts) > 1:
            yield frame.iloc[: starts[-1]], starts[:-1]
    if rest is not None and len(rest):
        yield rest, np.zeros(1, dtype=np.int64)


def tiles(frames: Iterable[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], Iterable[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """Calls work(tile) for each run of rows with equal keys in a partition sorted by them."""
    for frame, starts in whole_tiles(frames, keys):
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            yield from work(frame.iloc[a:b])


def small_batches(df: DataFrame) -> None:
    """Arrow batches of 1,000 rows from now on: with the default of 10,000, long texts would fill tens of MB in the JVM
    and again in each Python worker. And one pool of Python workers for all kinds of functions: with tracebacks cut
    short for some of them alone, an executor starts two, and each keeps its idle workers. The session keeps the
    settings, as plans run after the call that makes them."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")


def map_texts(docs: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], list]], fields: str, chars: int = 4_000_000) -> DataFrame:
    """All columns of docs, then `fields`, which the function that make() returns computes from a list of texts.

    Runs in Arrow batches cut to about `chars` code points. Columns of docs pass through untouched, whatever their
    types and names; where a field's name is taken, the new column comes last under the same name, so select first.
    """
    small_batches(docs)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    new = StructType.fromDDL(fields)
    out = StructType([*inner.schema.fields, *new.fields])
    arrow = to_arrow_schema(new)

    def work(batches):
        fn = make()
        for whole in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            step = (np.cumsum(lengths) - lengths) // chars
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                got = fn(batch.column(at).to_pylist())
                got = [pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(got, arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *got], names=out.names)
        release()

    return inner.mapInArrow(work, out).toDF(*names, *new.names)
