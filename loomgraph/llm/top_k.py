"""Exact search of the highest inner products, by branch and bound over a vertical layout.

Vectors become whole numbers, floor(scale * x), and are written once as blocks in which every dimension lies by itself, in the
smallest type that holds the block's numbers. Blocks are dealt into parts of bounded size, queries into groups; a pair of part and
group is one task's work. There each query takes its dimensions from the largest on, a few at a time, and adds up the products of
all candidates at once. After each step a candidate's product can grow by |rest of query| * |rest of candidate| at most; those that
cannot reach the query's k-th best so far are dropped, and the rest is moved together before the next step. Each pair yields the k
best of each of its queries, so that pairs of vectors never become rows.

The work is queries times vectors, as an exact search of a stated query set is; a part is sent to each group of QUERIES queries.

Defined results: vectors that are null or have null or non-finite components (or such after scaling) take no part; vectors are
compared with those of their own length (empty ones with each other, at 0). Every row is a candidate of its own: of two rows with
one id each can find the other. Ties go to the smaller id, null ids last, and a query whose id is null asks nothing unless it is
told to. Products are exact, however large; beyond a long a score is shown as the long's end. Fewer candidates than k give fewer
rows; an empty table gives none. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, shared_dir

#: Rows of a block, candidates of a part, queries of a group, about; dimensions of a step.
BLOCK, PART, QUERIES, STEP = 8192, 1 << 16, 1 << 13, 16
#: Whole numbers up to here are exact as doubles, and so are their sums.
EXACT = 1 << 53

_LAYOUT = "uid string, d int, n int, query boolean, kind string, ids binary, missing binary, places binary, numbers binary"
_KINDS = (np.int16, np.int32, np.float64)


def _pack(numbers: np.ndarray) -> tuple[str, bytes]:
    """Rows of whole numbers, turned so that each dimension is one run, in the smallest type that holds them."""
    top = np.abs(numbers).max() if numbers.size else 0
    kind = next(k for k in _KINDS if k is np.float64 or top <= np.iinfo(k).max)
    return np.dtype(kind).str, np.ascontiguousarray(numbers.T.astype(kind)).tobytes()


def _blocks(uid: str, ids: np.ndarray, missing: np.ndarray, numbers: np.ndarray, asks: np.ndarray) -> Iterator[tuple]:
    """The layout's rows of one block: all of it as candidates, and its queries with their places in it."""
    every = np.arange(len(ids))
    for query, at in ((False, every), (True, np.flatnonzero(asks))):
        if len(at):
            kind, packed = _pack(numbers[at])
            yield uid, numbers.shape[1], len(at), query, kind, ids[at].tobytes(), missing[at].tobytes(), at.astype(np.int32).tobytes(), packed


def write_layout(vectors: DataFrame, asks: Column, scale: float, path: str) -> None:
    """Write ``vectors(vec_id, embedding)`` in blocks, vertically, under ``path``; rows where ``asks`` holds also as queries."""
    spark = vectors.sparkSession
    arrow_batches(spark, rows=BLOCK, size=32 << 20)
    rows = vectors.select("vec_id", F.coalesce(asks, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda x: F.lit(float(scale)) * x)
    rows = rows.where(F.col("v").isNotNull()).withColumn("v", scaled).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: dict[int, list] = {}  # by length: batches of rows that do not fill a block yet

        def close(d: int) -> None:
            ids, missing, asked, numbers = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            out.extend(_blocks(uuid.uuid4().hex, ids, missing, numbers, asked))

        for batch in batches:
            v = batch.column("v")
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            ids = batch.column("vec_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids, asked = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("asks").to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                numbers = np.floor(flat[(ends[at] - d)[:, None] + np.arange(d)])
                held.setdefault(d, []).append((ids[at], missing[at], asked[at], numbers))
                if sum(len(x[0]) for x in held[d]) >= BLOCK:
                    close(d)
            yield from _batch(out)
        for d in list(held):
            close(d)
        yield from _batch(out)

    rows.mapInArrow(lean(lay), _LAYOUT).write.parquet(path)


def _batch(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The layout's rows that are done."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _LAYOUT.split(", ")]
    for row in out:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
    out.clear()


class Rows:
    """Blocks of one length put together."""

    def __init__(self, blocks: pa.Table):
        read = {c: blocks.column(c).to_pylist() for c in ("uid", "n", "kind", "ids", "missing", "places", "numbers")}
        whole = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in read[c]])
        self.ids, self.missing, self.places = whole("ids", np.int64), whole("missing", np.uint8), whole("places", np.int32)
        self.uids = np.repeat(np.array(read["uid"], object), read["n"])
        d = blocks.column("d")[0].as_py()
        self.numbers = np.concatenate([np.frombuffer(b, k).reshape(d, n) for b, k, n in zip(read["numbers"], read["kind"], read["n"], strict=True)], axis=1).astype(float)

    def sorted(self) -> Rows:
        """By id, so that of equal products the first has the smaller id; null ids last."""
        order = np.lexsort((self.ids, self.missing))
        self.ids, self.missing, self.places, self.uids, self.numbers = self.ids[order], self.missing[order], self.places[order], self.uids[order], np.ascontiguousarray(self.numbers[:, order])
        return self


def best(query: np.ndarray, numbers: np.ndarray, squares: np.ndarray, mass: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the ``k`` columns of ``numbers`` with the highest products with ``query``, but for column ``own``
    (-1: none) and those under ``least``. ``squares``: of the numbers, ``mass``: their sums."""
    order = np.argsort(-np.abs(query), kind="stable")
    alive = np.arange(numbers.shape[1])
    total, whole = np.zeros(len(alive)), True
    if own >= 0:
        alive, mass, total, whole = np.delete(alive, own), np.delete(mass, own), total[1:], False
    for begin in range(0, len(order), STEP):
        dims = order[begin : begin + STEP]
        total = total + query[dims] @ (numbers[dims] if whole else numbers[np.ix_(dims, alive)])
        rest = order[begin + STEP :]
        if not len(rest):
            break
        mass = mass - (squares[dims] if whole else squares[np.ix_(dims, alive)]).sum(axis=0)
        reach = np.sqrt(np.maximum(mass, 0.0) * float((query[rest] ** 2).sum()))
        low = least
        if len(total) > k:
            low = max(low, float(np.partition(total - reach, len(total) - k)[len(total) - k]))
        stay = total + reach >= low - 1 - 1e-9 * abs(low)  # no candidate that may tie is dropped
        if not stay.all():
            alive, total, mass, whole = alive[stay], total[stay], mass[stay], False
    if len(total) > k:
        stay = total >= np.partition(total, len(total) - k)[len(total) - k]
        alive, total = alive[stay], total[stay]
    first = np.argsort(-total, kind="stable")[:k]
    return alive[first], total[first]


def best_exact(query: np.ndarray, numbers: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for numbers whose products doubles do not hold."""
    total = np.array([sum(int(a) * int(b) for a, b in zip(query, column, strict=True)) for column in numbers.T], object)
    order = [i for i in sorted(range(len(total)), key=lambda i: -total[i]) if i != own][:k]
    return np.array(order, np.int64), total[order]


def search(queries: Rows, part: Rows, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, places in the part, products) of every query."""
    part = part.sorted()
    d, n = part.numbers.shape
    sizes = [float(np.abs(x.numbers).max()) if x.numbers.size else 0.0 for x in (queries, part)]
    in_doubles = max(sizes) ** 2 * d < EXACT
    where = {x: i for i, x in enumerate(zip(part.uids, part.places.tolist(), strict=True))}
    blocks = [(begin, part.numbers[:, begin : begin + BLOCK]) for begin in range(0, n, BLOCK)] if in_doubles else []
    blocks = [(begin, few, few * few) for begin, few in blocks]
    blocks = [(begin, few, squares, squares.sum(axis=0)) for begin, few, squares in blocks]
    for q in range(len(queries.ids)):
        query = queries.numbers[:, q]
        own = where.get((queries.uids[q], int(queries.places[q])), -1)
        if not in_doubles:
            yield q, *best_exact(query, part.numbers, own, k)
            continue
        at, total = np.zeros(0, np.int64), np.zeros(0)
        for begin, few, squares, mass in blocks:
            inside = own - begin if begin <= own < begin + BLOCK else -1
            more, products = best(query, few, squares, mass, inside, k, total[-1] if len(total) == k else -np.inf)
            at, total = np.concatenate([at, more + begin]), np.concatenate([total, products])
            first = np.argsort(-total, kind="stable")[:k]  # earlier places have the smaller ids
            at, total = at[first], total[first]
        yield q, at, total


#: The ends of a long, and what makes every larger or smaller product of two doubles a positive number of 270 bytes.
LONG, BEYOND = (-(1 << 63), (1 << 63) - 1), 1 << 2150


def shown(score: int) -> tuple[int, bytes]:
    """A score as a long, and what orders those that a long does not hold."""
    return (score, b"") if LONG[0] <= score <= LONG[1] else (LONG[score > 0], (score + BEYOND).to_bytes(270, "big"))


def exact_top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors(vec_id, embedding)`` with the highest inner products of whole
    numbers with each row for which ``asks`` holds, itself left out."""
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    write_layout(vectors, asks, scale, path)
    layout = lambda: spark.read.schema(_LAYOUT).parquet(path)  # noqa: E731  # each side of a pair has columns of its own
    n = layout().groupBy("query").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()  # two rows at most
    n = {r["query"]: r for r in n}
    if True not in n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Small tables still give work to all cores.
    parts = min(n[False]["blocks"], max(-(-n[False]["n"] // PART), 2 * spark.sparkContext.defaultParallelism))
    groups = -(-n[True]["n"] // QUERIES)
    dealt = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    there = layout().where("not query").withColumn("part", dealt(parts)).withColumn("group", each(groups))
    asked = layout().where("query").withColumn("group", dealt(groups)).withColumn("part", each(parts))
    keys = ["d", "group", "part"]
    found = [("uid", pa.string()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("lacks", pa.bool_()), ("score", pa.int64()), ("beyond", pa.binary())]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            queries, part = Rows(left), Rows(right)
            for q, at, total in search(queries, part, k):
                asked_by = queries.uids[q], int(queries.places[q]), None if queries.missing[q] else int(queries.ids[q])
                rows += [(*asked_by, int(part.ids[a]), bool(part.missing[a]), *shown(int(x))) for a, x in zip(at, total, strict=True)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(found)], names=[name for name, _ in found])

    near = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(pair, "uid string, place int, query_id long, vec_id long, lacks boolean, score long, beyond binary")
    order = [F.desc("score"), F.desc("beyond"), F.col("lacks"), F.col("vec_id")]
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("uid", "place").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(~F.col("lacks"), F.col("vec_id")).alias("vec_id"), "score")
