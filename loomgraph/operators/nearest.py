"""The nearest vectors of a set of queries, by matrix products of blocks.

Queries and vectors are dealt into blocks of bounded size. Query blocks whose bytes are known to be small go to every task;
beyond that, blocks of vectors are sent to each query block by an equi-join. A pair of blocks gives the best ``k`` of each of its
queries only, so that pairs never become rows.

Defined results: a vector that is null, empty or of another length than the query's has the likeness 0; a vector is not compared
with the query of its own id, if ids are of one kind; ties go to the smaller id; an empty table on either side gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import settled

#: Queries and vectors in a block, about.
QUERIES, VECTORS = 1024, 4096
#: Bytes of query vectors that may be sent to all tasks.
SMALL = 32 << 20


def _blocked(rows: DataFrame, key: str, vector: str, size: int, count: int) -> tuple[DataFrame, int]:
    """Rows gathered into blocks of about ``size`` by the hash of their id and vector, and the number of blocks."""
    n = max(1, -(-count // size))
    block = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    gathered = rows.select(F.struct(F.col(key).alias("id"), F.col(vector).alias("v")).alias("x"), block.alias(f"{key}_block")).groupBy(f"{key}_block").agg(F.collect_list("x").alias(f"{key}_rows"))
    return gathered, n


def _likeness(q: list, v: list) -> np.ndarray:
    """Dot products of unit vectors, 0 where lengths differ."""
    out = np.zeros((len(q), len(v)))
    lengths = np.array([0 if x is None else len(x) for x in v])
    own = np.array([0 if x is None else len(x) for x in q])
    for n in set(own.tolist()) - {0}:
        a, b = np.flatnonzero(own == n), np.flatnonzero(lengths == n)
        if len(b):
            out[np.ix_(a, b)] = np.array([q[i] for i in a]) @ np.array([v[i] for i in b]).T
    return np.round(out, 6)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, likeness, rank): the ``k`` vectors most like each of ``queries(query_id, q)`` among all of
    ``vectors(vec_id, e)``, unit vectors both; likeness to 6 places."""
    asked, rows = settled(queries.select("query_id", "q")), settled(vectors.select("vec_id", "e"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("numbers")).first()
    q_blocks, n = _blocked(asked, "query_id", "q", QUERIES, size["n"])
    v_blocks, _ = _blocked(rows, "vec_id", "e", VECTORS, rows.count())
    copies = v_blocks.withColumn("query_id_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = copies.join(F.broadcast(q_blocks) if size["numbers"] * 8 <= SMALL else q_blocks.hint("shuffle_hash"), "query_id_block")
    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_rows, v_rows in zip(batch["query_id_rows"], batch["vec_id_rows"], strict=True):
                v_ids = np.array([x["id"] for x in v_rows], object)
                by_id = np.argsort(v_ids, kind="stable")
                v_ids = v_ids[by_id]
                found = _likeness([x["v"] for x in q_rows], [v_rows[i]["v"] for i in by_id])
                q_ids = np.array([x["id"] for x in q_rows], object)
                found[q_ids[:, None] == v_ids[None, :]] = -np.inf
                best = np.argsort(-found, axis=1, kind="stable")[:, :k]
                likeness = np.take_along_axis(found, best, axis=1)
                there = likeness > -np.inf
                yield pd.DataFrame({"query_id": np.repeat(q_ids, there.sum(axis=1)), "vec_id": v_ids[best[there]], "likeness": likeness[there]})

    near = pairs.select("query_id_rows", "vec_id_rows").mapInPandas(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, likeness double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("likeness"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
