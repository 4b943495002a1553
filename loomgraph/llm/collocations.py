"""Phrase collocations: phrases of several words that occur together more often than their parts would by chance.

Texts are lower-cased (A-Z), split at marks and line ends into pieces, and those at blanks into words. Two passes over all texts:

1. Every task counts all phrases of 1 to ``MOST_WORDS`` words into a count-min sketch of its own. Cells stop at the least count
   that is asked for, as that is all that the sum is compared with; so sketches are small, and merging them by parts, as they
   arrive, keeps every decision. A merged cell is never under the count of any phrase in it: what it rules out is not frequent.
2. Every phrase whose cells, and whose parts' cells, reach the least count is counted exactly: within a task by ids of words
   (never by hashes), then by Spark. What is frequent is thus complete and exact; what the sketch let through by mistake falls
   to the exact count.

A phrase's first part and rest are as frequent as the phrase, so scores need nothing but the table of frequent phrases: parts
are joined to it, salted, as one word may begin a third of all phrases.

The sketch has a cell for each 32 bytes of text, 2**25 at least and 2**27 at most; in larger corpora more phrases go through to the
exact count, which then costs more shuffle, but gives the same rows.

Defined results: a null text is empty; a null lang is ``und``; texts without words and empty tables give nothing; repeated rows
count as often as they are there; very long texts are worked on in segments that end between pieces; other columns, whatever
their names, are not looked at; ties go to the more frequent phrase, then by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, mix64, segment_hashes, settled

MOST_WORDS = 5
OTHER = "und"
#: Bytes of text worked on at a time, and in a task, about.
SEGMENT, TASK = 4 << 20, 128 << 20
#: Rows of a sketch, the fewest and the most cells of a row, cells that travel together, and bytes of text for each cell.
ROWS, FEWEST, MOST, PART, BYTES_A_CELL = 2, 1 << 25, 1 << 27, 1 << 20, 32
#: Rows of phrases that a task holds before it adds them up.
HELD = 1 << 20
#: Copies of each part of a phrase, and of each language's total, that joins with phrases are dealt over.
SALTS = 16

_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_BREAK)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHAIN = np.uint64(0xD6E8FEB86659FD93)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and where each value begins and the last ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a segment: exact ids, hashes that depend on the language, and in which piece each stands."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, langs: np.ndarray, lang_hashes: np.ndarray):
        """``docs``: where documents begin in ``data``, first 0; ``langs``: the code of each one's language."""
        kind = _KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = docs[docs < len(data)]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        self.n = len(starts)
        doc = np.searchsorted(docs, starts, side="right") - 1
        self.lang = langs[doc]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + doc
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.count_nonzero(inside)).astype(np.int64)
        body = _LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        self.words = words.dictionary
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, at = _flat(self.words)
        self.hashes = mix64(segment_hashes(flat, at[:-1], at[1:])[self.ids] ^ lang_hashes[self.lang])

    def whole(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which of the places ``at`` begin ``k`` words of one piece."""
        last = np.minimum(at + (k - 1), self.n - 1)
        return (at + k <= self.n) & (self.piece[last] == self.piece[at])

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words at each of the places ``at``, a space between two."""
        columns = [self.words.take(pa.array(self.ids[at + j])) for j in range(k)]
        return columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))


def chain(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mix64(hashes * _CHAIN + more)


def segments(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """The words of a batch of (text, lang), segment by segment, with the names that language codes stand for."""
    data, docs = _flat(batch.column("text"))
    lang = pc.fill_null(batch.column("lang").cast(pa.large_string()), OTHER).dictionary_encode()
    codes, names = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang.dictionary.to_pylist()
    flat, at = _flat(lang.dictionary)
    lang_hashes = segment_hashes(flat, at[:-1], at[1:])
    ends = np.unique(np.concatenate([docs[1:], np.flatnonzero(_KIND[data] == 2) + 1]))  # pieces end there
    begin = 0
    while begin < len(data):
        fit = np.searchsorted(ends, begin + SEGMENT, side="right") - 1
        end = int(ends[max(fit, np.searchsorted(ends, begin, side="right"))])
        first = np.searchsorted(docs, begin, side="right") - 1
        last = np.searchsorted(docs, end, side="left")
        words = Words(data[begin:end], np.maximum(docs[first:last] - begin, 0), codes[first:last], lang_hashes)
        if words.n:
            yield words, names
        begin = end


class Sketch:
    """A count-min sketch whose cells stop at ``least``."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least
        self.cells = np.zeros((ROWS, width), cell_type(least))

    def places(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return ((hashes >> np.uint64(32 * row)) & np.uint64(self.width - 1)).astype(np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        for row in range(ROWS):
            at = np.sort(self.places(hashes, row))
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1]) if len(at) else np.zeros(0, np.int64)
            n = np.minimum(np.diff(np.append(first, len(at))), self.least).astype(self.cells.dtype)
            self.cells[row, at[first]] = np.minimum(self.cells[row, at[first]] + n, self.least)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        flat = self.cells.reshape(-1)
        for k in range(len(flat) // PART):
            part = flat[k * PART : (k + 1) * PART]
            if part.any():
                yield k, part


def cell_type(least: int) -> type:
    """Twice the least count fits, so that two cells add up."""
    return np.uint8 if least < 128 else np.uint16 if least < 1 << 15 else np.uint32


def sketch_width(text_bytes: int) -> int:
    """Cells of a row for a corpus of so many bytes."""
    return min(MOST, max(FEWEST, 1 << max(0, -(-text_bytes // BYTES_A_CELL) - 1).bit_length()))


def all_hashes(words: Words) -> np.ndarray:
    """Hashes of all phrases of the segment, of 1 word and more."""
    found, now = [words.hashes], words.hashes
    for k in range(2, MOST_WORDS + 1):
        if words.n < k:
            break
        now = chain(now[:-1], words.hashes[k - 1 :])
        found.append(now[words.piece[k - 1 :] == words.piece[: words.n - k + 1]])
    return np.concatenate(found)


def merged_bits(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """For every cell of the sketch of all ``texts(text, lang)``, a bit: it reaches ``least``. Sketches are merged part by part
    where the parts are dealt to; the driver sees bits only (8 MB for 2**25 cells a row)."""
    kind = cell_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, least)
        for batch in batches:
            for words, _ in segments(batch):
                sketch.add(all_hashes(words))
        codec = pa.Codec("zstd", compression_level=1)
        for k, part in sketch.parts():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "cells": pa.array([codec.compress(part.tobytes(), asbytes=True)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, packed in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                more = np.frombuffer(codec.decompress(packed, PART * np.dtype(kind).itemsize), kind)
                sums[k] = np.minimum(sums[k] + more, least).astype(kind) if k in sums else more.copy()
        for k, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "cells": pa.array([np.packbits(cells >= least).tobytes()], pa.binary())})

    parts = texts.mapInArrow(lean(count), "part int, cells binary").repartition("part")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for row in parts.mapInArrow(lean(merge), "part int, cells binary").collect():
        bits[row["part"] * (PART // 8) : (row["part"] + 1) * (PART // 8)] = np.frombuffer(bytes(row["cells"]), np.uint8)
    return bits


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which phrases may reach the least count, by the merged sketch's bits."""
    width = len(bits) * 8 // ROWS
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):
        at = (hashes >> np.uint64(32 * row)) & np.uint64(width - 1)
        out &= (bits[(at >> np.uint64(3)) + np.uint64(row * width // 8)] << (at & np.uint64(7)).astype(np.uint8)) & 128 > 0
    return out


def survivors(words: Words, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a phrase, a place of each distinct one, how often) of the segment's phrases that pass, as do all their parts."""
    size = len(words.words)
    alive, code, now = passing(words.hashes, bits), words.lang * size + words.ids, words.hashes
    at = np.flatnonzero(alive)
    for k in range(1, MOST_WORDS + 1):
        if k > 1:
            near = np.zeros(words.n + 1, bool)
            near[at] = True
            at = at[near[at + 1]]
            at = at[words.whole(at, k)]
            longer = np.zeros(words.n, np.uint64)
            longer[at] = chain(now[at], words.hashes[at + (k - 1)])
            now = longer
            at = at[passing(now[at], bits)]
            code = code * size
            code[at] += words.ids[at + (k - 1)]
        if not len(at):
            return
        dense, _ = pd.factorize(code[at])  # ids of phrases stay under the segment's words, so codes of one word more fit 64 bits
        n = np.bincount(dense)
        first = np.zeros(len(n), np.int64)
        first[dense[::-1]] = at[::-1]
        yield k, first, n
        code = np.zeros(words.n, np.int64)
        code[at] = dense


def frequent_phrases(texts: DataFrame, least: int, width: int | None = None) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of 1 to MOST_WORDS words that occurs at least ``least`` times in its language,
    and for each language a row of 0 words with the number of all its words. ``width``: cells of a row of the sketch, a power
    of two; without it as many as the texts' size asks for."""
    spark = texts.sparkSession
    arrow_batches(spark)
    texts = texts.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # Large tasks: each hands on a sketch, and a row for every frequent phrase that it meets.
    texts = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK)))
    shared = spark.sparkContext.broadcast(merged_bits(texts, width or sketch_width(size), least))  # 32 MB at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for words, names in segments(batch):
                names = np.array(names, object)
                totals = np.bincount(words.lang, minlength=len(names))
                there = np.flatnonzero(totals)
                held.append(_rows(names[there], 0, pa.array([""] * len(there)), totals[there]))
                held += [_rows(names[words.lang[at]], k, words.phrases(at, k), n) for k, at, n in survivors(words, shared.value)]
                if sum(len(x) for x in held) > HELD:
                    held = _added(held)
                    if sum(len(x) for x in held) > HELD // 2:
                        yield from held
                        held = []
        yield from _added(held)

    counted = texts.mapInArrow(lean(count), "lang string, words int, phrase string, f long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def _rows(langs: np.ndarray, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(n), k, np.int32)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def _added(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The rows with those of one phrase as one."""
    if not rows:
        return []
    keys = ["lang", "words", "phrase"]
    return pa.Table.from_batches(rows).group_by(keys, use_threads=False).aggregate([("f", "sum")]).select([*keys, "f_sum"]).rename_columns([*keys, "f"]).to_batches()


def _salted(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every frequent phrase of two words or more, by its lowest-scoring cut."""
    phrases = frequent.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    totals = _salted(frequent.where("words = 0").select("lang", F.col("f").alias("n")))
    parts = _salted(frequent.where(F.col("words").between(1, MOST_WORDS - 1)).select("lang", F.col("phrase").alias("part"), "f"))
    cuts = phrases.join(totals, ["lang", "salt"]).withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    whole = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "salt", "left"]).join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "salt", "right"])
    # Decimals of 38 digits: exact for up to 10**17 words.
    d = "cast({} as decimal(19, 0))".format
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {d('a')} * {d('n')}) div ({d('l')} * {d('r')})")
    lowest = whole.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def subsumed(frequent: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, longer): phrases that stand inside a longer frequent one, and the highest count of those."""
    longer = frequent.where("words >= 3").select("lang", "words", "phrase", "f").withColumn("w", F.split("phrase", " "))
    inside = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    return longer.select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(texts: DataFrame, least: int = 100, share: int = 100, most: int = 2000, width: int | None = None) -> DataFrame:
    """The first ``most`` collocations of each language of ``texts(text, lang)``: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to 5 words that occurs ``a`` >= ``least`` times scores floor(1000 * a * n / (l * r)) for a cut into parts that
    occur l and r times; its lowest-scoring cut counts, the first of equals. Phrases inside a longer one that occurs at least
    ``share`` percent as often are dropped."""
    frequent = settled(frequent_phrases(texts, least, width))
    kept = scored(frequent).join(subsumed(frequent, share), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # First within parts of a language, so that no task ranks all of it.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("_part", part).withColumn("_place", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= most)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
