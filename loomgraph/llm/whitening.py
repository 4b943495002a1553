"""Whitening of embeddings: principal components of their integer vectors, at unit variance.

Two passes fit, a third projects:

1. Exact whole-number sums of every dimension, added up by numpy in each task and as decimals by Spark: the mean is exact.
2. Centred vectors (n * x - S) / n, in which only the division rounds, are multiplied with themselves by matrix products of whole
   blocks; ``treeAggregate`` merges the tasks' d x d sums on the executors. LAPACK's symmetric solver gives the components.
3. Mean and components (8 x d numbers) go to all tasks as a broadcast, and every vector is projected where it is.

How far the result is from white is measured on the projected vectors themselves, by another tree of small sums.

Defined results: a vector takes no part if it is null, is empty, has a null or non-finite entry or one of 2**51 or more, or is not
as long as most vectors are (of two equally common lengths the longer counts). Repeated rows count as often as they are there, and
each gets its rows; a null id stays null; other columns, whatever their names, are not looked at. A component without variance
(one vector, or all alike) has ``whitened`` 0, and ``explained`` 0 where nothing varies; the identity is measured on the others.
``deviation`` is exact at any size, in 38 digits. A table without such vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on have no exact whole number after scaling.
TOO_LARGE = float(1 << 51)
#: Of the trace: variance below this is none.
NONE_LEFT = 1e-13


@dataclass
class Whitening:
    """n vectors, their exact sums, the components (rows, by falling variance) with their variances, and the trace."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors without null or non-finite entries."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def whole_numbers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of a batch's vectors of length ``d``, exact."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they are enough, else in numbers of any length."""
    if 2 * n * largest < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(c: np.ndarray) -> list[int]:
    """Sums of squares of the rows, exact."""
    if c.dtype == np.int64 and (not c.size or int(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 62):
        return (c * c).sum(axis=1).tolist()
    return (c.astype(object) ** 2).sum(axis=1).tolist()


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """How many vectors, the exact sum of each dimension, and the largest size of a number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, np.zeros(d, object), 0
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch, d)
                top = int(np.abs(x).max())
                n, largest = n + len(x), max(largest, top)
                sums += x.sum(axis=0) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(d, dtype=np.int32)), "s": pa.array([str(int(s)) for s in sums]), "n": pa.array([n] * d, pa.int64()), "largest": pa.array([largest] * d, pa.int64())})

    parts = rows.mapInArrow(lean(add), "dim int, s string, n long, largest long")
    found = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(28, 0)")).alias("s"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("dim").collect()  # d rows
    return found[0]["n"], [int(r["s"]) for r in found], max(r["largest"] for r in found)


def _product_sums(rows: DataFrame, d: int, make) -> np.ndarray:
    """The sum over all vectors of the outer product of what ``make`` gives for each (rows of ``d`` numbers), merged in a tree."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = make(batch)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    plus = lambda a, b: b if a is None else a if b is None else a + b
    take = lambda a, row: plus(a, np.frombuffer(bytes(row["m"])).reshape(d, d))
    return rows.mapInArrow(lean(multiply), "m binary").rdd.treeAggregate(None, take, plus, 3)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable ``vectors(vec_id, embedding)``; none without any."""
    arrow_batches(vectors.sparkSession, rows=10_000)
    usable = _usable(vectors)
    length = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return None
    d = length["d"]
    rows = usable.where(F.size("v") == d)
    n, sums, largest = _sums(rows, d)
    scatter = _product_sums(rows, d, lambda batch: centred(whole_numbers(batch, d), n, sums, largest).astype(float) / n)
    variances, columns = np.linalg.eigh(scatter / n)
    order = np.argsort(-variances, kind="stable")[:components]
    parts = columns.T[order]
    parts *= np.where(np.take_along_axis(parts, np.abs(parts).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)  # either sign would do
    found = Whitening(n, sums, largest, parts, np.maximum(variances[order], 0.0), float(np.trace(scatter) / n))
    spread = _product_sums(rows, len(order), lambda batch: project(found, whole_numbers(batch, d))) / n
    there = np.flatnonzero(found.variances > NONE_LEFT * found.trace)
    off = np.abs(spread - np.eye(len(order)))[np.ix_(there, there)]
    found.identity_error = float(off.max()) if off.size else 0.0
    return found


def project(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened components of whole-number vectors."""
    there = model.variances > NONE_LEFT * model.trace
    scale = np.divide(1.0, np.sqrt(model.variances), out=np.zeros_like(model.variances), where=there)
    return (centred(x, model.n, model.sums, model.largest).astype(float) / model.n) @ (model.components * scale[:, None]).T


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and each component from 1."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    arrow_batches(spark, rows=10_000)
    d, k = model.components.shape[1], len(model.components)
    shared = spark.sparkContext.broadcast(model)  # k x d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.variances / m.trace if m.trace > 0 else np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch, d)
            row = np.repeat(np.arange(len(x)), k)
            far = deviations(centred(x, m.n, m.sums, m.largest))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), m.n)),
                    pa.array([str(v) for v in far]).take(pa.array(row)), pa.array(project(m, x).reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), m.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = _usable(vectors).where(F.size("v") == d).mapInArrow(lean(run), schema.replace("decimal(38, 0)", "string"))
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38, 0)"))
