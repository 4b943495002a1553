"""What the operators of this subpackage share: reading tables, shared scratch space, vectorised hashing.

Nothing here keeps state between queries. Everything that runs inside tasks works on one Arrow batch at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from loomgraph.session import settled, shared_dir, spread

__all__ = ["arrow_batches", "crc_mod", "lean", "map_batches", "mix64", "paused_gc", "pick_sample", "segment_hashes", "settled", "shared_dir", "table", "texts_of", "word_hashes", "worker_table"]

#: Rows of one Arrow batch that carries whole texts. With long texts a batch of this many rows stays a few MB.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch (Spark cuts a batch at whichever limit comes first).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark so that any file system Spark knows will do; a small one over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small enough for executors with little memory beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def paused_gc() -> Iterator[None]:
    """No search for reference cycles while a block of texts is worked on: there are none, but millions of small objects."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_HELD: dict[Hashable, object] = {}


def worker_table(key: Hashable, make: Callable[[], object]):
    """What this Python worker keeps from task to task under ``key``; it keeps one such thing, and drops it for the next."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _drop_tables(but: Hashable) -> None:
    for key in [k for k in _HELD if k != but]:
        del _HELD[key]


def _release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], table: Hashable = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for Python workers that live on beside an executor's heap, through stages of other operators: before it, a table
    kept under another key than ``table`` is dropped; after it, free memory goes back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_tables(table)
        yield from run(batches)
        _release_memory()

    return task


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str, table: Hashable = None) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once in each task and gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(lean(run, table), schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


# -- hashing of byte strings, vectorised --------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply), wrapping."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's multiplier modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _STEP)])
    return _POWERS[:n]


#: Symbols that one step of ``segment_hashes`` holds at a time.
_STRIDE = 1 << 20


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment ``codes[start:end]`` of non-negative integers.

    A polynomial over randomised symbol values, then finalised together with the segment's length. Segments must be
    sorted and must not overlap; empty ones hash alike. Works in steps of about ``_STRIDE`` symbols."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    total = np.cumsum(size)
    lo = 0
    while lo < len(starts):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + _STRIDE, side="right")))
        s, n = starts[lo:hi], size[lo:hi]
        full = n > 0
        if not full.all():
            s, n = s[full], n[full]
        if len(n):
            place = np.arange(int(n.sum()), dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            place -= np.repeat(first, n)
            sym = codes[place + np.repeat(s, n)]
            sym = _BYTE_VALUES[sym] if codes.dtype == np.uint8 else mix64((sym.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
            sym *= powers(int(n.max()))[place]
            part = np.zeros(hi - lo, np.uint64)
            part[full] = np.add.reduceat(sym, first)
            out[lo:hi] = part
        lo = hi
    return mix64(out + size.astype(np.uint64) * _GOLDEN)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a byte string, and the place where each begins."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    return segment_hashes(b, starts, ends), starts


#: Documents of all classes together that a sample has at most.
SAMPLE_MOST = 20_000
#: Parts that each class is dealt into by a hash, so that no task ranks a whole class.
SAMPLE_PARTS = 16


def pick_sample(docs: DataFrame, classes: DataFrame | None, per_class: int, max_chars: int) -> list:
    """At most ``per_class`` documents (rounded up to SAMPLE_PARTS) of each value of ``class`` in ``classes(doc_id, class)``, or
    without that of the column ``class`` of ``docs``, whose texts have 1 to ``max_chars`` code points: the bounded sample that a
    classifier is fitted on; never more than SAMPLE_MOST in all, shared out evenly. Each part of a class gives its share, in the
    order of a hash of doc_id. The first pass moves ids only, the second reads the texts of the ids chosen, the least text of the
    rows that have the same doc_id and class. Rows: (doc_id, text, class)."""
    sized = docs.where(F.col("doc_id").isNotNull() & F.length("text").between(1, max_chars))
    if classes is None:
        keys = sized.where(F.col("class").isNotNull()).select("doc_id", "class")
    else:
        keys = sized.select("doc_id").join(classes.where(F.col("class").isNotNull()).select("doc_id", "class"), "doc_id")
    keys = keys.withColumn("_order", F.xxhash64("doc_id")).withColumn("_part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLE_PARTS)))
    rank = F.row_number().over(W.partitionBy("class", "_part").orderBy("_order", "doc_id"))
    found = keys.withColumn("_rank", rank).where(F.col("_rank") <= -(-per_class // SAMPLE_PARTS)).select("doc_id", "class", "_order").distinct().collect()
    if not found:
        return []
    found.sort(key=lambda r: (str(r["class"]), r["_order"], r["doc_id"]))
    most = max(1, SAMPLE_MOST // len({r["class"] for r in found}))
    found = [r for _, rows in groupby(found, key=lambda r: r["class"]) for r in islice(rows, most)][:SAMPLE_MOST]
    chosen = docs.sparkSession.createDataFrame(sorted({(r[0], str(r[1])) for r in found}), "doc_id long, class string")  # bounded: per_class ids of each class
    if classes is None:
        rows = sized.select("doc_id", "text", F.col("class").cast("string").alias("class")).join(F.broadcast(chosen), ["doc_id", "class"])
    else:
        rows = sized.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "class").agg(F.min("text").alias("text")).select("doc_id", "text", "class").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "", r["class"]))
