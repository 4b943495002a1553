"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the shortest string that is no phrase yet. The hashes of the phrases are a
set; its smallest values (after scrambling) are the fingerprint, from which the likeness of two sets, the share of phrases they
have in common, is estimated as from minimum hashes. Texts that would compress each other have many phrases in common.

A parse depends on nothing that comes later, so an edited text that shares its beginning with the original is parsed from where
the original's dictionary stood at that place.

For neighbours in the order of doc_id, texts are partitioned by range with bounds taken from the ids themselves, and sorted in
each task; the document at a bound goes to both tasks it parts, as the neighbour of the last document before it. So texts are
shuffled once, and no task holds more than two of them beside its sort.

Defined results: null and empty texts have the empty fingerprint, which is like another empty one (1) and unlike all others (0);
long texts are parsed whole; equal texts have equal fingerprints; documents of equal id are ordered by text; without a
doc_id they come last; the only document of a table is its own neighbour; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, mix64, segment_hashes

#: Values in a fingerprint.
KEPT = 96
#: Bytes of text in a partition, about.
PART_BYTES = 128 << 20


def parse(codes: list[int], tree: dict[int, int], node: int = 0) -> tuple[list[int], int]:
    """Where phrases end, continuing in the dictionary ``tree`` at ``node``; and the node where the text ends (0: right after
    a phrase). A node is a phrase; its children are found under (node * 2**21 + code point)."""
    ends: list[int] = []
    new = len(tree)
    found = tree.get
    base = node << 21
    for place, c in enumerate(codes, 1):
        key = base | c
        node = found(key)
        if node is None:
            new += 1
            tree[key] = new
            ends.append(place)
            base = 0
        else:
            base = node << 21
    return ends, base >> 21


def fingerprint(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The KEPT smallest scrambled hashes of the phrases of a text that end at ``ends`` (sorted; the last at its end)."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    h = np.unique(mix64(segment_hashes(codes, starts, ends)) >> np.uint64(32)).astype(np.uint32)
    return h[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of phrases in common, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    rank = np.cumsum(np.concatenate([[True], ~twice]))  # place among the distinct values of both
    most = min(KEPT, int(rank[-1]))
    return float(np.count_nonzero(twice & (rank[1:] <= most)) / most)


def encoded(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype(">u4").tobytes()).decode()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Parsed:
    """A text with its fingerprint."""

    def __init__(self, text: str, cut: int | None = None):
        """With ``cut``, remember the state of the parse after so many code points."""
        self.text, self.codes = text, _codes(text)
        self.tree: dict[int, int] = {}
        listed = self.codes.tolist()
        self.cut = len(listed) if cut is None else cut
        head, self.node = parse(listed[: self.cut], self.tree)
        self.head = np.array(head, np.int64)
        self.known = len(self.tree)
        ends, at = self.head, self.node
        if self.cut < len(listed):
            tail, at = parse(listed[self.cut :], self.tree, self.node)
            ends = np.concatenate([ends, np.array(tail, np.int64) + self.cut])
        self.fp = fingerprint(self.codes, _closed(ends, len(listed)))

    def edited(self, tail: str) -> np.ndarray:
        """Fingerprint of the text up to ``cut`` with ``tail`` behind it."""
        for key in list(self.tree)[self.known :]:  # a dict keeps the order in which phrases came
            del self.tree[key]
        more = _codes(tail)
        ends, _ = parse(more.tolist(), self.tree, self.node)
        codes = np.concatenate([self.codes[: self.cut], more])
        return fingerprint(codes, _closed(np.concatenate([self.head, np.array(ends, np.int64) + self.cut]), len(codes)))


def _closed(ends: np.ndarray, n: int) -> np.ndarray:
    """A text may end within a phrase that is known already; that is its last one."""
    return ends if not n or (len(ends) and ends[-1] == n) else np.append(ends, n)


def _ids(values: list[int]) -> Column:
    """A fixed array of ids, as one value of the plan however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_neighbours(docs: DataFrame, partitions: int) -> DataFrame:
    """(part, copy, doc_id, text) partitioned and sorted by doc_id from the largest; the first row of each partition, and for
    the last partition the first row of all, is there once more at the end of the partition before, marked ``copy``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    steps = [(i + 1) / partitions for i in range(partitions - 1)]
    row = docs.select(F.percentile_approx("doc_id", F.lit(steps) if steps else F.lit([0.5]), max(100_000, 20 * partitions)).alias("at"), F.max("doc_id").alias("top")).first()
    bounds = sorted(set(row["at"] or []) - {row["top"]}, reverse=True) if steps else []
    n = len(bounds) + 1
    # Partition k has the ids from bounds[k - 1] (included, from above) down to bounds[k] (left out). An id is looked up among every
    # width-th bound first, then among those up to the next.
    width = max(1, math.isqrt(len(bounds)))
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    whole = F.size(F.filter(_ids(bounds[width - 1 :: width]), lambda b: b >= doc_id)) * width
    dealt = source.withColumn("whole", whole).withColumn("part", F.col("whole") + F.size(F.filter(F.slice(_ids(bounds), F.col("whole") + 1, F.lit(width)), lambda b: b >= doc_id))).drop("whole")
    at_bound = F.coalesce(F.get(_ids(bounds), F.col("part") - 1) == F.col("doc_id"), F.lit(False))
    first = F.when(F.col("doc_id").isNull() & F.lit(row["top"] is not None), F.lit(False)).otherwise(F.col("doc_id").eqNullSafe(F.lit(row["top"])) | at_bound)
    back = F.when(F.col("part") == 0, F.lit(n - 1)).otherwise(F.col("part") - 1).cast("int")
    own, copy = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy")), F.struct(back.alias("part"), F.lit(True).alias("copy"))
    both = dealt.withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))).select("to.part", "to.copy", "doc_id", "text")
    return both.repartitionById(n, F.col("part")).sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "text")


def compare_neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For each document: n_chars, its fingerprint; of its text with the last third replaced by the beginning of the next
    document (from the largest doc_id down; after the last the first): edited_sha256 and edited_fingerprint; and the likeness
    of its fingerprint to that one, near_edited, and to the next document's, near_next. Unset, there are
    as many ``partitions`` as Spark has shuffle partitions, or more, so that each has PART_BYTES of text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    if not partitions:
        size = docs.select(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
        partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, Parsed] | None = None
        for batch in batches:
            out: list[tuple] = []
            for copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("copy", "doc_id", "text")), strict=True):
                if copy and held is None:
                    break  # other copies of the same neighbour
                now = Parsed(text, len(text) - len(text) // 3)
                if held is not None:
                    before_id, before = held
                    tail = text[: len(before.text) // 3]
                    edited = before.edited(tail)
                    sha = hashlib.sha256((before.text[: before.cut] + tail).encode("utf-8")).hexdigest()
                    out.append((before_id, len(before.text), sha, encoded(before.fp), encoded(edited), likeness(before.fp, edited), likeness(before.fp, now.fp)))
                held = None if copy else (doc_id, now)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return with_neighbours(docs, partitions).mapInArrow(run, schema)
