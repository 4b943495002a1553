"""Near-duplicate detection by circulant MinHash, with exact verification.

A document is its set of distinct word shingles. Two permutations make the whole signature: the first scatters a shingle's
hash over a fixed universe, the second gives values there, and coordinate k looks it up k places further round the circle, so
that all coordinates of a shingle are one slice of a table. Bands of coordinates make candidates; links are confirmed on
full sets.

Documents with equal sets are one class, whose smallest doc_id goes through banding for all of them. Every member of a band's
bucket is compared with one of its members, another in each band; that joins most groups of near copies, with one pair for
each member. Buckets whose other members are then still in different components are compared in full, but never as rows of
pairs: those with the same largest component form a group, the members outside of that component are dealt into blocks of
bounded size, and so is the component. A task gets the sets of two blocks, counts all intersections at once, and returns no
more than the links that join components there. Pairs within a component are not looked at, and no candidate is dropped.
Components are found by spreading the smallest id along links with shortcuts, as joins.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing (their component is their own
id); fewer words than a shingle make one shingle of all of them; very long texts are ordinary; repeated rows get the same
answer; rows without doc_id are in no component (null) and kept; an empty table gives an empty result; other columns are not
looked at and pass through ``drop_duplicates`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, mix64, settled, word_hashes

SHINGLE = 5
SIMILAR = 80  # per cent
BANDS, ROWS = 40, 6
UNIVERSE_BITS = 20
#: Ids that are broadcast at most (8 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 1_000_000
#: Sets, and shingles of all of them (but for a single larger set), in one block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: Rows of buckets with the same largest component that make one group; beyond that each bucket is a group.
GROUP_ROWS = 100_000
#: Parts that a key is split into where a row of its own is joined to many.
SALTS = 16
#: Cells of the tables of members by shingles that a comparison holds at a time.
TABLE_CELLS = 1 << 22

_ODD = np.uint64(0xD1342543DE82EF95)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered."""
    if not text:
        return np.zeros(0, np.uint64)
    words, _ = word_hashes(text.encode("utf-8").lower())  # lower() of bytes takes A-Z only
    if not len(words):
        return words
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    h = np.full(n, size_here, np.uint64)
    for i in range(size_here):
        h = mix64((h ^ words[i : i + n]) * _ODD)
    return np.unique(h)


class Circulant:
    """Signatures of ``BANDS * ROWS`` coordinates, folded into one hash for each band."""

    def __init__(self, seed: int = 2024):
        rng = np.random.default_rng(seed)
        size, k = 1 << UNIVERSE_BITS, BANDS * ROWS
        self.scatter = rng.permutation(size).astype(np.int32)
        values = rng.permutation(size).astype(np.int32)
        self.circle = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: k - 1]]), k)

    def signatures(self, sets: list[np.ndarray], step: int = 2048) -> np.ndarray:
        """A row for each (non-empty) set."""
        out = np.full((len(sets), self.circle.shape[1]), 1 << UNIVERSE_BITS, np.int32)
        if not sets:
            return out
        at = self.scatter[(mix64(np.concatenate(sets)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        for lo in range(0, len(at), step):
            hi = min(len(at), lo + step)
            first = int(np.searchsorted(begins, lo, side="right")) - 1
            last = int(np.searchsorted(begins, hi, side="left"))
            cut = np.maximum(begins[first:last], lo) - lo
            out[first:last] = np.minimum(out[first:last], np.minimum.reduceat(self.circle[at[lo:hi]], cut, axis=0))
        return out

    @staticmethod
    def bands(signatures: np.ndarray) -> np.ndarray:
        sig = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD + np.zeros((len(sig), 1), np.uint64)
        for r in range(ROWS):
            h = mix64((h ^ sig[:, :, r]) * _ODD)
        return h.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): the set's size, 128 bits that stand for the set, and its band hashes."""
    arrow_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "f1", "f2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant()
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("_llm_text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            f1 = np.array([np.sum(mix64(s)) for s in sets], np.uint64)
            f2 = np.array([np.sum(mix64(s * _ODD)) for s in sets], np.uint64)
            full = np.flatnonzero(n)
            bands = circulant.bands(circulant.signatures([sets[i] for i in full]))
            ends = np.cumsum(np.concatenate([[0], n > 0])) * BANDS
            arrays = [batch.column("doc_id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", F.col("text").alias("_llm_text")).mapInArrow(lean(run), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set) of the documents whose id is in ``ids(id)``."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select("doc_id", F.col("text").alias("_llm_text")).join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("_llm_text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "set"])

    # A repeated row must not double the pairs it is in.
    return chosen.mapInArrow(lean(run), "id long, set array<long>").dropDuplicates(["id"])


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links(a, b)``; comp is the smallest id that it is linked with, over any number of steps.
    First each id takes the smallest of its neighbours, and of what that has taken; what is then linked are few ids for a
    group of copies, over which the smallest spreads."""
    links = settled(links.select("a", "b"))
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("near"))
    near = settled(near)
    taken = settled(near.join(near.select(F.col("id").alias("near"), F.col("near").alias("next")), "near").select("id", F.col("next").alias("to")))
    of_a, of_b = taken.select(F.col("id").alias("a"), F.col("to").alias("ta")), taken.select(F.col("id").alias("b"), F.col("to").alias("tb"))
    left = links.join(of_a, "a").select("ta", "b").distinct().join(of_b, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    spread = _spread(left.distinct()).select(F.col("id").alias("to"), "comp")
    return taken.join(spread, "to", "left").select("id", F.coalesce("comp", "to").alias("comp"))


def _spread(links: DataFrame) -> DataFrame:
    """What ``connected_components`` gives, link by link."""
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = settled(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp")))
    while True:
        theirs = both.join(label.select(F.col("id").alias("b"), F.col("comp").alias("low")), "b").select(F.col("a").alias("id"), "low", F.lit(None).cast("long").alias("was"))
        own = label.select("id", F.col("comp").alias("low"), F.col("comp").alias("was"))
        near = theirs.unionByName(own).groupBy("id").agg(F.min("low").alias("comp"), F.max("was").alias("was"))
        # A shortcut: the label of one's label.
        ahead = label.select(F.col("id").alias("comp"), F.col("comp").alias("ahead"))
        moved = settled(near.join(ahead, "comp", "left").select("id", "was", F.least("comp", "ahead").alias("comp")))
        if not moved.where("was != comp").limit(1).count():
            return label.select("id", "comp")
        label = moved


def joined_components(comp: np.ndarray, right: np.ndarray, within: bool, values: np.ndarray, begins: np.ndarray, similar: int) -> list[tuple[int, int]]:
    """Of sets ``values[begins[i] : begins[i + 1]]`` in components ``comp``: pairs of components that a link joins, no more than
    it takes to join them. Compared are the sets on the right with those on the left, and ``within`` with each other too."""
    size = np.diff(begins)
    rows, cols = (np.arange(len(comp)) if within else np.flatnonzero(~right)), np.flatnonzero(right)
    may = (comp[rows][:, None] != comp[cols]) & (np.minimum(size[rows][:, None], size[cols]) * 100 >= np.maximum(size[rows][:, None], size[cols]) * similar)
    if not may.any():
        return []
    # Only sets that may be linked with any by their sizes, and only shingles that two sets have.
    rows, cols, may = rows[may.any(axis=1)], cols[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    used = np.zeros(len(comp), bool)
    used[rows] = used[cols] = True
    owner = np.repeat(np.arange(len(comp)), size)
    owner, values = owner[used[owner]], values[used[owner]]
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    owner, code = owner[times[code] > 1], code[times[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros(may.shape, np.float32)
    width = max(64, TABLE_CELLS // max(1, int(used.sum())))
    place = np.cumsum(used) - 1
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        first, last = np.searchsorted(code, [lo, lo + width])
        has = np.zeros((int(used.sum()), min(width, int(code[-1]) + 1 - lo)), np.float32)
        has[place[owner[first:last]], code[first:last] - lo] = 1
        common += has[place[rows]] @ has[place[cols]].T
    both = common.astype(np.int64)
    x, y = np.nonzero(may & (both * 100 >= (size[rows][:, None] + size[cols] - both) * similar))
    pairs = np.unique(np.sort(np.stack([comp[rows[x]], comp[cols[y]]], axis=1), axis=1), axis=0).tolist()
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    found = []
    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        if p != q:
            above[q] = p
            found.append((a, b))
    return found


def _with_own(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each of the ``keys``. A key of many rows is met in many
    tasks; neither side is broadcast, as both grow with the input."""
    salted = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*keys, "_salt"]).drop("_salt")


def _blocks_compared(rest: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): links between components of ``rest(bucket, id, n, comp)`` that join all those which a link between members of
    one bucket joins."""
    parts = rest.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("top")).where("comps > 1")
    dealt = settled(rest.join(open_.select("bucket", "top"), "bucket"))
    # Members of buckets whose largest component is the same meet in one group, so that one that they share is not compared in each.
    rows_of = dealt.groupBy("top").agg(F.count("*").alias("rows"))
    grouped = _with_own(dealt, rows_of, ["top"]).select("top", F.when(F.col("rows") > GROUP_ROWS, F.col("bucket")).otherwise(F.lit(0)).alias("part"), "id", "n", "comp").distinct()
    grouped = settled(grouped.withColumn("inner", F.col("comp") == F.col("top")))

    def blocks(inner: bool) -> Column:
        mine = F.col("inner") if inner else ~F.col("inner")
        return F.greatest(F.lit(1), F.ceil(F.count_if(mine) / BLOCK_SETS), F.ceil(F.sum(F.when(mine, F.col("n"))) / BLOCK_SHINGLES)).cast("int")

    shape = grouped.groupBy("top", "part").agg(blocks(True).alias("inner_blocks"), blocks(False).alias("blocks"))
    placed = _with_own(grouped, shape, ["top", "part"])
    at = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("inner_blocks")).otherwise(F.col("blocks"))).cast("int")
    placed = placed.withColumn("at", at)
    # Cells (0, x, y): block x of the component with block y of the others; (1, x, y): blocks x < y of the others.
    cell = lambda kind, x, y, right: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(right).alias("right"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    met = F.transform(upto(F.col("blocks")), lambda y: cell(0, F.col("at"), y, False))
    own = F.transform(upto(F.col("inner_blocks")), lambda x: cell(0, x, F.col("at"), True))
    before = F.transform(F.filter(upto(F.col("blocks")), lambda x: x < F.col("at")), lambda x: cell(1, x, F.col("at"), True))
    behind = F.transform(F.filter(upto(F.col("blocks")), lambda y: y > F.col("at")), lambda y: cell(1, F.col("at"), y, False))
    cells = placed.select("top", "part", "id", "comp", F.explode(F.when(F.col("inner"), met).otherwise(F.concat(own, before, behind))).alias("c"))
    rows = cells.join(sets, "id").select("top", "part", "c.kind", "c.x", "c.y", "c.right", "comp", "set")

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = table.column("set").combine_chunks()
        begins = held.offsets.to_numpy().astype(np.int64)
        values = held.values.to_numpy(zero_copy_only=False)[begins[0] : begins[-1]]
        # The first block of the component has the others of each block meet each other.
        within = table.column("kind")[0].as_py() == 0 and table.column("x")[0].as_py() == 0
        found = joined_components(table.column("comp").to_numpy(), table.column("right").to_numpy(), within, values, begins - begins[0], similar)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("top", "part", "kind", "x", "y").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``: documents are linked where
    100 * |intersection| >= ``similar`` * |union| of their shingle sets; the smallest doc_id of a component is kept."""
    sketch = settled(sketches(docs, size))
    real = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = settled(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")))
    firsts = real.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    rows = firsts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # Each bucket has an order of its own, so that its first member is another one in each band that a group shares.
    turn = F.xxhash64("bucket", "id")
    first = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("id", turn).alias("first"), F.min_by("n", turn).alias("first_n")).where("low != high")
    members = settled(rows.join(first.drop("low", "high"), "bucket"))
    sets = settled(_sets_of(docs, members.select("id").distinct(), size))
    rest = members.where("id != first")
    # Pairs whose sizes alone rule a link out are not looked up.
    pairs = rest.where(F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * similar).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    labels = connected_components(with_b.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * similar).select("a", "b"))
    named = rest.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp"))
    joined = settled(_blocks_compared(named, sets, similar).distinct())
    # Those links join components, of which there are fewer than documents.
    alone = joined.select(F.col("a").alias("id")).unionByName(joined.select(F.col("b").alias("id"))).distinct().select("id", F.col("id").alias("comp"))
    known = labels.unionByName(alone).groupBy("id").agg(F.min("comp").alias("comp"))
    above = connected_components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("above"))
    labels = known.join(above, "comp", "left").select("id", F.coalesce("above", "comp").alias("comp"))
    component = classes.join(labels, "id", "left").select("f1", "f2", F.coalesce("comp", "id").alias("_comp"))
    out = sketch.select("doc_id", "n_shingles", "f1", "f2").join(component, ["f1", "f2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id."""
    gone = settled(near_duplicates(docs, size, similar).where(~F.col("kept")).select(F.col("doc_id").alias("_llm_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("_llm_gone"), "left_anti")
