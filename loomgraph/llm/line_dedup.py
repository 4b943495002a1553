"""Removal of lines that many documents share, by range-partitioned hashes.

Each line long enough becomes a row (128-bit hash of its key, doc_id, position). The rows are partitioned by range over all of
these columns, so that even a line of a third of all documents is spread over many tasks, and sorted within each task with the
largest doc_id first. A task streams through them: the first document of a hash holds the occurrence that stays, the others
are marked. A hash that reaches the edge of a batch is settled afterwards from small summaries (at most three doc_ids of each
batch and hash). What is kept is a compressed bitmap of kept lines for each document that loses any; texts are read once
more only where the bitmaps are applied.

Defined results: null and empty texts are one empty line and stay as they are; very long texts are ordinary; repeated rows of
a document count as one document and lose the same lines; rows without doc_id keep all lines and count for nothing; an empty
table gives an empty result; other columns, whatever their names, pass through ``drop_lines`` untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, settled

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_DROP, _OPEN, _SEEN = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, and with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _mark(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, then doc_id from the largest: those to drop; those of the first and the last hash of a batch,
    which other batches may share, as they are, with up to ``min_docs`` doc_ids of each such hash and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = len(doc)
        run = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        change = run | np.concatenate([[True], doc[1:] != doc[:-1]])
        start = np.flatnonzero(run)
        of = np.cumsum(run) - 1
        nth = np.cumsum(change)
        nth = nth - nth[start][of]  # which document of its hash, from 0
        ends = np.append(start[1:], n) - 1
        docs_of = nth[ends] + 1
        edge = np.zeros(len(start), bool)
        edge[[0, -1]] = True
        drop = ~edge[of] & (docs_of[of] >= min_docs) & (nth > 0)
        is_open = edge[of]
        seen = is_open & change & (nth < min_docs)
        at = np.concatenate([np.flatnonzero(drop), np.flatnonzero(is_open), np.flatnonzero(seen)])
        kind = np.repeat(np.array([_DROP, _OPEN, _SEEN], np.int32), [drop.sum(), is_open.sum(), seen.sum()])
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[at]) for x in (h1, h2, doc, pos))], names=["kind", "h1", "h2", "doc_id", "pos"])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, count = [], []
        places = batch.column("places")
        values, ends = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy()
        for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
            own = np.unique(values[lo:hi])
            keep = np.ones((int(own[-1]) // 8 + 1) * 8, bool)  # whole bytes, so that no bit is left to padding
            keep[own] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
            count.append(len(own))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(count, pa.int64())], names=["doc_id", "keep", "n_dropped"])


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, keep, n_dropped) of each document that loses lines; ``keep`` is a zlib-compressed bitmap, one bit for each line
    from the first on, set where the line stays; all lines behind its end stay."""
    spark = docs.sparkSession
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    keyed = lines.withColumn("key", key).where(F.char_length("key") >= min_chars)
    rows = settled(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc_id", "pos"))
    arrow_batches(spark, rows=20_000)
    order = ["h1", "h2", F.col("doc_id").desc(), "pos"]
    marked = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(lambda it: _mark(it, min_docs)), "kind int, h1 long, h2 long, doc_id long, pos int"))
    summary = marked.where(F.col("kind") == _SEEN).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n"))
    late = marked.where(F.col("kind") == _OPEN).join(summary.where(F.col("n") >= min_docs), ["h1", "h2"]).where("doc_id != keeper")
    drops = marked.where(F.col("kind") == _DROP).select("doc_id", "pos").unionByName(late.select("doc_id", "pos"))
    return drops.groupBy("doc_id").agg(F.collect_list("pos").alias("places")).mapInArrow(lean(_bitmap), "doc_id long, keep binary, n_dropped long")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with each text reduced to the lines its bitmap keeps. With ``counts``: also n_lines (before) and n_dropped."""
    arrow_batches(docs.sparkSession)
    columns = docs.columns
    maps = bitmaps.select(F.col("doc_id").alias("_llm_doc_id"), F.col("keep").alias("_llm_keep")).hint("shuffle_hash")
    joined = docs.join(maps, F.col("doc_id") == F.col("_llm_doc_id"), "left").drop("_llm_doc_id")
    schema = docs.schema.simpleString()[7:-1] if not counts else docs.schema.simpleString()[7:-1] + ",n_lines long,n_dropped long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("_llm_keep").to_pylist(), strict=True):
                if packed is not None and text is not None:
                    lines = text.split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)]
                    stay = np.ones(len(lines), bool)
                    stay[: len(keep)] = keep
                    texts.append("\n".join([x for x, ok in zip(lines, stay.tolist(), strict=True) if ok]))
                    n_lines.append(len(lines))
                    n_dropped.append(int(len(lines) - stay.sum()))
                else:
                    texts.append(text)
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            names = list(columns)
            if counts:
                arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                names += ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(lean(run), schema)
