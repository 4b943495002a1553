"""Best-fit packing of tokenised documents by swap-based local search.

A document's ids (and the id that ends it) are cut only where they exceed a sequence. Pieces are dealt by a hash into blocks
of bounded size. A block starts plainly: each piece, in the order of ids, goes into the fullest bin that has room. Then local
search empties bins: the emptiest underfull bin gives its pieces away, by moves into other underfull bins, exchanges of one of
its pieces for a smaller one there, or of two of its pieces for one. Every step raises the sum of squared fills, so the search
ends: when no bin can be emptied any more, or there are as few as the tokens need. Bins that stay underfull are broken up, and
their pieces packed together in a second round, so that blocks cost hardly more sequences than one great block would.

Defined results: null and empty texts are the end id alone; a piece as long as a sequence has one to itself; repeated rows
(the same doc_id twice) are packed as separate documents; an empty table gives an empty result; other columns are not looked
at. Every piece of every document is packed exactly once, and a sequence is filled from 0 without gaps.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import _SIGNS, MergeReplay
from loomgraph.llm.common import arrow_batches, lean, paused_gc, settled, texts_of, worker_table

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together in one task.
BLOCK = 4096
#: Words of texts whose ids are put together at a time.
STEP_WORDS = 1 << 18
#: Distinct pieces of text that a worker remembers the ids of.
CACHE_WORDS = 900_000
#: Characters of texts that are encoded together.
GROUP_CHARS = 1 << 24

# White space as Unicode has it; Python's own split also takes the four separators 1C to 1F, which tokenizers keep.
_SPACE = re.compile("[ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 bytes for themselves, the others for
    the code points from 256 on, in order."""
    visible = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    rest = iter(range(256, 512))
    return [chr(c) if c in visible else chr(next(rest)) for c in range(256)]


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it: each distinct run of visible
    characters is encoded once, most of them together by merge replay, the others by the library. Words of letters are known by
    their lower case alone, and the signs behind them by themselves. Cutting, counting and joining are done on arrays of words.
    Texts that hold one of the vocabulary's special tokens are encoded by the library as a whole, as that looks for those before
    anything else."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.replay = None
        conf = json.loads(Path(path).read_text(encoding="utf-8"))
        added = conf.get("added_tokens") or []
        # One that is looked for in the normalised text could be anywhere.
        self.special = [""] if any(t["normalized"] for t in added) else [t["content"] for t in added]
        model, suffix = conf["model"], conf["model"].get("end_of_word_suffix")
        kinds = {x["type"] for x in (conf.get("normalizer") or {}).get("normalizers", [])}
        if model["type"] == "BPE" and suffix and {"NFC", "Lowercase"} <= kinds and self.encode_one("a" + _SIGNS) == self.encode_one("a") + self.encode_one(_SIGNS):
            vocab, signs = model["vocab"], _byte_signs()
            made = {}
            for rank, merge in enumerate(model["merges"]):
                left, right = merge.split(" ") if isinstance(merge, str) else merge
                made[vocab[left], vocab[right]] = (rank, vocab[left + right])
            self.replay = MergeReplay([vocab[c] for c in signs], [vocab[c + suffix] for c in signs], made)

    def encode_one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """The ids of lower words of letters by replay, of all else by the library."""
        plain, rest = [], []
        for w in new:
            (plain if self.replay and w.isalpha() and (w.isascii() or "\u03a3" not in w) and w == w.lower() else rest).append(w)
        self.known.update(zip(plain, self.replay.encode([w.encode("utf-8") for w in plain]) if plain else [], strict=True))
        for at in range(0, len(rest), 10_000):
            for w, e in zip(rest[at : at + 10_000], self.tokenizer.encode_batch_fast(rest[at : at + 10_000], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _parts(self, words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, pa.StringArray]:
        """Words of letters, with signs behind them or without, are one or two words to the tokenizer, once lowered: what is
        encoded for each of ``words``, both parts or the word itself and nothing. First the place of each word in these."""
        if not self.replay:
            return np.arange(len(words)), words, pa.array([""] * len(words), pa.string())
        ascii_ = pc.string_is_ascii(words)
        place = np.argsort(np.argsort(~ascii_.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        easy = words.filter(ascii_)
        bodies = pc.ascii_rtrim(easy, _SIGNS)
        plain = pc.ascii_is_alpha(bodies)
        size = pc.binary_length(easy).to_numpy(zero_copy_only=False).astype(np.int64)
        signs = np.where(plain.to_numpy(zero_copy_only=False), size - pc.binary_length(bodies).to_numpy(zero_copy_only=False), 0)
        data = np.frombuffer(easy.buffers()[2] or b"", np.uint8)
        begins = np.frombuffer(easy.buffers()[1], np.int32)[easy.offset : easy.offset + len(easy) + 1].astype(np.int64) if len(easy) else np.zeros(1, np.int64)
        behind = _runs(data, begins[1:] - signs, signs)
        ends = pa.StringArray.from_buffers(len(easy), pa.py_buffer(np.concatenate([[0], np.cumsum(signs)]).astype(np.int32)), pa.py_buffer(behind.tobytes()))
        heads, tails = [], []
        for w in words.filter(pc.invert(ascii_)).to_pylist():
            body = w if w.isalpha() else w.rstrip(_SIGNS)
            low = body.lower()
            split = body.isalpha() and low.isalpha() and "\u03a3" not in body
            heads.append(low if split else w)
            tails.append(w[len(body) :] if split else "")
        keys = pc.if_else(plain, pc.ascii_lower(bodies), easy)
        return place, pa.concat_arrays([keys, pa.array(heads, pa.string())]), pa.concat_arrays([ends, pa.array(tails, pa.string())])

    def _encode_cut(self, cut: pa.ListArray) -> Iterator[bytes]:
        """Ids of each list of words."""
        words = cut.flatten().dictionary_encode()
        place, heads, tails = self._parts(words.dictionary)
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        parts = both.dictionary.to_pylist()
        with paused_gc():
            if len(self.known) > self.cache_words:
                self.known = {w: self.known[w] for w in parts if w in self.known}
            self._learn([w for w in parts if w not in self.known])
            table = [self.known[w] for w in parts]
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        which = both.indices.to_numpy().reshape(2, -1).T[place].ravel()  # of each distinct word its two parts
        ids = _runs(np.frombuffer(b"".join(table), "<u4"), (np.cumsum(size) - size)[which], size[which])
        size = size[which].reshape(-1, 2).sum(axis=1)
        first = np.cumsum(size) - size
        which = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        out = np.empty(int(ends[-1]), "<u4")
        for at in range(0, len(which), STEP_WORDS):
            some = which[at : at + STEP_WORDS]
            out[ends[at] : ends[at + len(some)]] = _runs(ids, first[some], size[some])
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return (out[a:b].tobytes() for a, b in zip(bounds, bounds[1:]))

    def encode(self, texts: list[str], group: int = GROUP_CHARS) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text. Texts are taken in groups of about ``group`` characters."""
        whole = {i: self.encode_one(t) for i, t in enumerate(texts) if any(x in t for x in self.special)}
        lo = 0
        while lo < len(texts):
            some, held = [], 0
            while lo + len(some) < len(texts) and (not some or held + len(texts[lo + len(some)]) <= group):
                t = "" if lo + len(some) in whole else texts[lo + len(some)]
                held += len(t)
                # The tokenizer does that first, and a word of such a text is such a word.
                some.append(t if t.isascii() or not self.replay or is_normalized("NFC", t) else normalize("NFC", t))
            column = pa.array(some, pa.string())
            if pc.any(pc.match_substring_regex(column, _SEPARATORS.pattern)).as_py():
                cut = pa.array([[w for w in _SPACE.split(t) if w] for t in some], pa.list_(pa.string()))
            else:
                cut = pc.utf8_split_whitespace(column)  # at what str.split cuts at
            yield from (whole.get(i, ids) for i, ids in enumerate(self._encode_cut(cut), lo))
            lo += len(some)


def _runs(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``first`` and have such sizes, one after another."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True, cache_words: int = CACHE_WORDS, group: int = GROUP_CHARS) -> DataFrame:
    """The pieces of each row's whole ``text``: doc_id, piece, start, length, ids_crc32 and, if asked for, the ``ids``. The
    tokenizer's file has to be at ``tokenizer_path`` wherever tasks run. A worker needs some 12 bytes for each character of a
    ``group``, and 200 for each word of its table: the results do not depend on either."""
    arrow_batches(docs.sparkSession, rows=5000, size=min(16 << 20, group))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    end = int(end_id).to_bytes(4, "little")
    table = ("word_tokenizer", tokenizer_path, cache_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_table(table, lambda: WordTokenizer(tokenizer_path, cache_words))  # what one task has learnt serves the next
        for batch in batches:
            doc, number, start, length, crc, own = [], [], [], [], [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(texts_of(batch.column("_llm_text")), group), strict=True):
                data += end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    doc.append(doc_id)
                    number.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        own.append(np.frombuffer(part, "<i4"))
            arrays = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if ids:
                ends = np.cumsum([0, *map(len, own)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *own]))))
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", F.col("text").alias("_llm_text")).mapInArrow(lean(run, table), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places of ``lengths``: in the order given, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they have left
    has = 0  # bit r is set where room[r] isn't empty
    bins: list[list[int]] = []
    for i, need in enumerate(lengths.tolist()):
        fits = has >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                has ^= 1 << left
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= need
        if left:
            room[left].append(b)
            has |= 1 << left
    return bins


class LocalSearch:
    """Steps that raise the sum of squared fills of ``bins`` (places of ``lengths``) until bins empty."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.size, self.capacity = bins, lengths, lengths.tolist(), capacity
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.steps: Counter[str] = Counter()
        self.of = np.empty(len(lengths), np.int64)  # the bin of each piece, and what that has left; 0 in the bin that gives
        self.room = np.empty(len(lengths), np.int64)
        self.at: list[set[int]] = [set() for _ in range(capacity + 1)]  # bins by what they have left
        self.has = 0  # bit r is set where at[r] isn't empty
        for b, own in enumerate(bins):
            self.of[own] = b
            self._enter(b)

    def _leave(self, b: int) -> None:
        left = self.capacity - self.fill[b]
        self.at[left].discard(b)
        if not self.at[left]:
            self.has &= ~(1 << left)

    def _enter(self, b: int) -> None:
        left = self.capacity - self.fill[b]
        self.room[self.bins[b]] = left
        if left and self.bins[b]:
            self.at[left].add(b)
            self.has |= 1 << left

    def _exchange(self, giver: int, given: tuple[int, ...], b: int, back: int | None, kind: str) -> None:
        self._leave(b)
        for i in given:
            self.bins[giver].remove(i)
            self.bins[b].append(i)
            self.of[i] = b
        moved = sum(self.size[i] for i in given)
        if back is not None:
            self.bins[b].remove(back)
            self.bins[giver].append(back)
            self.of[back] = giver
            self.room[back] = 0
            moved -= self.size[back]
        self.fill[giver] -= moved
        self.fill[b] += moved
        self._enter(b)
        self.steps[kind] += 1

    def _move(self, giver: int) -> bool:
        """The longest piece that fits into a bin fuller than the giver is without it goes into the fullest such bin."""
        for i in sorted(self.bins[giver], key=lambda i: (-self.size[i], i)):
            if fits := self.has >> self.size[i]:
                left = self.size[i] + (fits & -fits).bit_length() - 1
                if self.capacity - left > self.fill[giver] - self.size[i]:
                    self._exchange(giver, (i,), min(self.at[left]), None, "move")
                    return True
        return False

    def _swap(self, giver: int, others: np.ndarray, gives: dict[int, tuple[int, ...]], kind: str) -> tuple[int, ...]:
        """The exchange of one of ``gives`` (by their length) for a smaller one of ``others`` that raises the sum most."""
        room, theirs = self.room[others], self.lengths[others]
        ahead = self.capacity - room - self.fill[giver]
        best, found = 0, None
        for s, given in gives.items():
            delta = s - theirs
            gain = np.where((delta > 0) & (delta <= room), delta * (ahead + delta), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = int(gain[k]), (given, int(others[k]))
        if not found:
            return ()
        given, back = found
        self._exchange(giver, given, int(self.of[back]), back, kind)
        return given

    def _give(self, giver: int) -> None:
        own = self.bins[giver]
        self._leave(giver)
        self.room[own] = 0
        others = np.zeros(0, np.int64)
        looked = False
        while own:
            if self._move(giver):
                continue
            if not looked:
                others, looked = np.flatnonzero(self.room > 0), True
            if not len(others):
                break
            # What is given counts by its length alone, so one piece of a length and one pair of a sum do for all.
            ones = {self.size[i]: (i,) for i in own}
            given = self._swap(giver, others, ones, "one_for_one")
            if not given:
                seen: Counter[int] = Counter()
                some = [i for i in own if (seen.update([self.size[i]]), seen[self.size[i]] <= 2)[1]]
                twos: dict[int, tuple[int, ...]] = {}
                for x, i in enumerate(some):
                    for j in some[x + 1 :]:
                        twos.setdefault(self.size[i] + self.size[j], (i, j))
                given = self._swap(giver, others, twos, "two_for_one")
            if not given:
                break
            others = np.concatenate([others, given]).astype(np.int64)
        self._enter(giver)

    def run(self) -> list[list[int]]:
        least = -(-sum(self.size) // self.capacity)
        count = sum(map(bool, self.bins))
        emptied = True
        while emptied and count > least:
            emptied = False
            for giver in sorted((b for b, own in enumerate(self.bins) if own and self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b)):
                if count <= least:
                    break
                if self.fill[giver] < self.capacity:
                    self._give(giver)
                    if not self.bins[giver]:
                        count, emptied = count - 1, True
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each length: its bin, its offset there, and the bin's fill."""
    bins = LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()
    where, offset, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for b, own in enumerate(bins):
        ends = np.cumsum(lengths[own])
        where[own], offset[own], filled[own] = b, ends - lengths[own], ends[-1]
    return where, offset, filled


def _packed(rows: DataFrame, blocks: int, capacity: int, base: int) -> DataFrame:
    """``rows`` packed in so many blocks: sequence_id, offset and the sequence's fill are added. ``base`` parts the numbers
    of one round from another's."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable")
        where, pdf["offset"], pdf["_fill"] = pack(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = (pdf["_block"].to_numpy(np.int64) * 2 + base) * (1 << 24) + where
        return pdf.drop(columns="_block")

    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    schema = rows.schema.simpleString()[7:-1] + ",offset long,_fill long,sequence_id long"
    return rows.withColumn("_block", block).groupBy("_block").applyInPandas(work, schema)


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32 and no long columns) with sequence_id and offset."""
    columns = rows.columns
    rows = settled(rows)
    n = rows.count()
    if n <= block:
        return _packed(rows, 1, capacity, 0).select(*columns, "sequence_id", "offset")
    first = settled(_packed(rows, -(-n // block), capacity, 0))
    # Few bins of a block are left underfull; together they are few pieces, packed anew in blocks of their own.
    loose = F.col("_fill") < capacity - max(1, capacity // 512)
    again = first.where(loose).select(*columns)
    left = again.count()
    second = _packed(again, max(1, -(-left // block)), capacity, 1)
    return first.where(~loose).unionByName(second).select(*columns, "sequence_id", "offset")


def pack_whole(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """As ``pack_pieces``, for ``rows`` with long columns (the ids): only what packing reads goes through its tasks; the places
    it gives are joined to the rows afterwards."""
    columns = rows.columns
    kept = settled(rows.withColumn("_llm_row", F.monotonically_increasing_id()))
    placed = pack_pieces(kept.select("doc_id", "piece", "length", "ids_crc32", "_llm_row"), capacity, block)
    return kept.join(placed.select("_llm_row", "sequence_id", "offset"), "_llm_row").select(*columns, "sequence_id", "offset")
