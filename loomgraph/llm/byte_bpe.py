"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Pre-tokens are not encoded one after another. All distinct ones that a block of texts adds are laid out as one chain of byte
symbols, with an inverted index from each mergeable pair (known by the rank of the token it makes) to the places where it
stands. Merges are then replayed in rank order over the whole chain: each takes the places of one pair, joins them, and
touches only the neighbours, whose new pairs go into the index. Where a join creates a pair of the same or a lower rank, that
one is replayed first, as encoding word by word would.

Texts are cut at single blanks between two visible characters, where no pre-token can reach across; what such a piece
encodes to is remembered in a bounded table, so that frequent words cost one look-up.

Defined results: null and empty texts have no tokens; long texts are encoded whole; strings that look like special tokens
are ordinary text; repeated rows encode alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, map_batches, texts_of, worker_table

#: Pieces of text, and pre-tokens, that a task remembers; beyond that it forgets all of them.
CACHE_PIECES = 700_000

# White space beside a blank, or of another kind than blanks and line ends, calls for the slower cut.
_ODD_SPACE = re.compile(r"[^\S \n]")
_SIGNS = "!#$%&*+,-./:;<=>?@[]^_|~()"
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines() if path else [])}


class MergeReplay:
    """Encodes many pre-tokens at once."""

    #: Stands for "no token is made of this pair".
    NONE = np.int32(2**31 - 1)

    def __init__(self, first: list[int], last: list[int], made: dict[tuple[int, int], tuple[int, int]]):
        """``first`` and ``last``: the symbol of each byte, and of a byte that ends a word. ``made``: pair of symbols ->
        (rank of its merge, symbol it becomes)."""
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        keys = sorted((a << 24 | b, rank, made_of) for (a, b), (rank, made_of) in made.items())
        self.pairs = np.array([k for k, _, _ in keys] or [-1], np.int64)
        self.rank_of_pair = np.array([r for _, r, _ in keys] or [0], np.int32)
        self.symbol_of_rank = np.zeros(max((r for _, r, _ in keys), default=0) + 1, np.int64)
        for _, rank, made_of in keys:
            self.symbol_of_rank[rank] = made_of

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> MergeReplay:
        """For a vocabulary whose tokens' numbers are their ranks: every split of a token into two tokens makes it."""
        byte = [ranks.get(bytes([c]), 0) for c in range(256)]
        made = {(ranks[t[:i]], ranks[t[i:]]): (r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        return cls(byte, byte, made)

    def products(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair makes."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of_pair[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit symbols of each word."""
        size = np.array([len(w) for w in words], np.int64)
        if not size.sum():
            return [b""] * len(words)
        begins = np.concatenate([[0], np.cumsum(size)])
        n = int(begins[-1])
        data = np.frombuffer(b"".join(words), np.uint8)
        chain = self.first[data]
        tail = begins[1:][size > 0] - 1
        chain[tail] = self.last[data[tail]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        after[tail] = -1
        before[begins[:-1][size > 0]] = -1
        pair = np.full(n, self.NONE, np.int32)  # what the pair that begins at each place makes
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.products(chain[inner], chain[inner + 1])
        places = np.flatnonzero(pair != self.NONE)
        places = places[np.argsort(pair[places], kind="stable")]
        first = np.flatnonzero(np.diff(pair[places], prepend=-1))
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(pair[places[first]].tolist(), np.split(places, first[1:]), strict=True)} if len(places) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            at = np.array(found)
            at = at[pair[at] == rank]  # else a neighbour has been merged meanwhile
            if len(at) > 1:
                at.sort()
                if (twice := at[1:] == at[:-1]).any():
                    at = at[np.concatenate([[True], ~twice])]
                later = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
                if later.any():
                    # One merge of a word at a time: it may make a pair that comes before the next.
                    index[rank] = at[later].tolist()
                    heapq.heappush(heap, rank)
                    at = at[~later]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            chain[at], chain[gone], pair[gone], after[at] = self.symbol_of_rank[rank], -1, self.NONE, beyond
            pair[at] = self.NONE
            has = beyond >= 0
            right, right_of = at[has], beyond[has]
            before[right_of] = right
            left_of = before[at]
            has = left_of >= 0
            left, left_of = at[has], left_of[has]
            where = np.concatenate([right, left_of])
            new = self.products(chain[where], np.concatenate([chain[right_of], chain[left]]))
            pair[where] = new
            real = new != self.NONE
            for r, p in zip(new[real].tolist(), where[real].tolist(), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)
        left = chain >= 0
        ends = np.concatenate([[0], np.cumsum(left)])[begins].tolist()
        data = chain[left].astype("<i4").tobytes()
        return [data[4 * lo : 4 * hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.replay = MergeReplay.of_ranks(ranks)
        self.find = regex.compile(pattern).findall
        self.first: dict[str, bytes] = {}  # pieces at the beginning of a text
        self.later: dict[str, bytes] = {}  # pieces after a blank
        self.words: dict[str, bytes] = {}
        letters = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
        self.plain = self.find(letters) == [letters] and self.find(" a" + _SIGNS) == [" a", _SIGNS] and self.find("a" + _SIGNS) == ["a", _SIGNS]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cut at blanks that stand between two visible characters; each piece but the first lacks its leading blank."""
        if "  " in text or "\n " in text or " \n" in text or _ODD_SPACE.search(text):
            return _SAFE_BLANK.split(text)
        return text.split(" ")

    def _learn(self, table: dict[str, bytes], pieces: list[str], lead: str) -> None:
        """Encode pieces with ``lead`` before them. Where the pattern keeps letters, and signs after them, together (which is
        tried once, on all letters), a word with signs behind it needs no search."""
        parts: list[list[str]] = []
        for p in pieces:
            if self.plain:
                body = p if p.isalpha() else p.rstrip(_SIGNS)
                if body.isalpha():
                    parts.append([lead + body] if len(body) == len(p) else [lead + body, p[len(body) :]])
                    continue
            parts.append(self.find(lead + p))
        known = self.words
        new = []
        for w in {w for words in parts for w in words if w not in known}:
            data = w.encode("utf-8")
            whole = self.ranks.get(data)  # a pre-token that is a token needs no merges
            if whole is None:
                new.append((w, data))
            else:
                known[w] = whole.to_bytes(4, "little")
        known.update(zip([w for w, _ in new], self.replay.encode([data for _, data in new]), strict=True))
        for piece, words in zip(pieces, parts, strict=True):
            table[piece] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def _look_up(self, heads: set[str], tails: set[str]) -> None:
        if len(self.first) + len(self.later) + len(self.words) > CACHE_PIECES:
            # Of what is remembered, keep what this block needs.
            self.first = {p: self.first[p] for p in heads & self.first.keys()}
            self.later = {p: self.later[p] for p in tails & self.later.keys()}
            self.words = {}
        for table, pieces, lead in ((self.first, heads, ""), (self.later, tails, " ")):
            if new := [p for p in pieces if p not in table]:
                self._learn(table, new, lead)

    def encode(self, texts: list[str], group: int = 1 << 23) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Texts are taken in groups of about ``group`` characters."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, held, cut = lo, 0, []
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= group):
                cut.append(self.pieces(texts[hi]))
                held += len(texts[hi])
                hi += 1
            heads = {p[0] for p in cut}
            tails: set[str] = set()
            for p in cut:
                tails.update(p[1:])
            self._look_up(heads, tails)
            first, later = self.first, self.later.__getitem__
            for p in cut:
                out.append(b"".join([first[p[0]], *map(later, p[1:])]))
            lo = hi
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian 32-bit ids stand for."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, np.int32).tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, with ``ids array<int>`` of the whole ``text`` and ``decoded binary``, the bytes that
    those ids decode to. The file of ranks has to be at ``ranks_path`` wherever tasks run."""
    arrow_batches(docs.sparkSession, rows=2500)
    source = docs.select(*keep, F.col("text").alias("_llm_text"))
    schema = docs.select(*keep).schema.simpleString()[7:-1] + ",ids array<int>,decoded binary"

    table = ("byte_bpe", ranks_path, pattern)

    def make():
        codec = worker_table(table, lambda: Codec(read_ranks(ranks_path), pattern))  # what one task has learnt serves the next

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode(texts_of(batch.column("_llm_text")))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array([codec.decode(x) for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*keep, "ids", "decoded"])

        return work

    return map_batches(source, make, schema, table)
