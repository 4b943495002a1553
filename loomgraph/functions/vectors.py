"""Embeddings: hashed bags of tokens, their mean and cosine, and a hook for models of the user's own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import embedding_tokens

DIM = 64
TINY = 1e-9


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though ``use`` may refer to it within a function of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(vector: Column) -> Column:
    """The vector at length 1; one of (nearly) no length stays as it is."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return bind(norm, lambda n: F.when(n <= TINY, v).otherwise(F.transform(v, lambda x: x / n)))

    return bind(vector, scaled)


def hash_embedding_builtin(text: Column, dim: int = DIM) -> Column:
    """Each token adds 1 or -1 to the bucket that its SHA-1 names. Built-in functions only: the yardstick of the faster way."""
    hashes = F.transform(embedding_tokens(text), lambda t: F.sha1(t.cast("binary")))
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    placed = F.transform(hashes, lambda h: sign(h) * (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim + 1))
    count = lambda p, n: F.size(F.filter(p, lambda x: x == n)).cast("double")
    sums = bind(placed, lambda p: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda b: count(p, b) - count(p, -b)))
    return unit(sums)


def hash_vectors(token_lists: list[list[str]], dim: int = DIM) -> np.ndarray:
    """Rows of unit vectors; each distinct token of the batch is hashed once."""
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(t, len(index)) for tokens in token_lists for t in tokens], np.int64)
    digests = [hashlib.sha1(t.encode()).digest() for t in index]
    bucket = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], np.int64)
    sign = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
    row = np.repeat(np.arange(len(token_lists)), [len(t) for t in token_lists])
    out = np.bincount(row * dim + bucket[ids], weights=sign[ids], minlength=len(token_lists) * dim).reshape(-1, dim) if len(ids) else np.zeros((len(token_lists), dim))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm <= TINY, out, out / np.maximum(norm, TINY))


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """The same vectors by one vectorised helper; tokens are cut by Spark."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors([list(t) if t is not None else [] for t in tokens], dim)))

    return embed(embedding_tokens(text))


def chunk_mean_embedding(chunks: Column, dim: int = 64) -> Column:
    """Mean of the hashed vectors of an array of chunks, at unit length, where the row is: nothing is exploded or shuffled."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        rows = [[list(t) for t in ts] if ts is not None else [] for ts in tokens]
        vectors = np.asarray(hash_vectors([t for ts in rows for t in ts], dim), float).reshape(-1, dim)
        out, at = [], 0
        for ts in rows:
            mean = vectors[at : at + len(ts)].sum(axis=0) / max(1, len(ts))
            at += len(ts)
            norm = float(np.sqrt((mean * mean).sum()))
            out.append(mean if norm <= TINY else mean / norm)
        return pd.Series(out)

    return embed(F.transform(chunks, embedding_tokens))


#: What known models want before a query and before a document.
PREFIXES = {
    "nlpai-lab/kure-v1": ("query: ", "passage: "),
    "dragonkue/bge-m3-ko": ("Represent this sentence for searching relevant passages: ", ""),
}


def prefixes(model: str, query: str | None = None, document: str | None = None) -> tuple[str, str]:
    """Prefixes of a model's queries and documents: those given, else those known for it, else none."""
    known = PREFIXES.get(model.strip().lower(), ("", ""))
    return known[0] if query is None else query, known[1] if document is None else document


def _unit_rows(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.where(norm <= TINY, v, v / np.maximum(norm, TINY))


def model_embedding(df: DataFrame, column: str, out: str, embed: Callable[[list[str]], list[list[float]]], prefix: str = "", size: int = 64) -> DataFrame:
    """``df`` with the vectors that the user's batch function gives for ``prefix`` + text, ``size`` texts at a time, at unit
    length. For a column of lists of texts it is the mean of a list's vectors (those as long as the first), at unit length; an
    empty list has an empty vector."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    lists = isinstance(df.schema[column].dataType, T.ArrayType)

    def vectors(texts: list[str]) -> list[np.ndarray]:
        return [_unit_rows(np.asarray(v, float)) for i in range(0, len(texts), size) for v in embed([prefix + t for t in texts[i : i + size]])]

    def mean(vs: list[np.ndarray]) -> np.ndarray:
        same = [v for v in vs if len(v) == len(vs[0])]
        return _unit_rows(np.sum(same, axis=0) / len(same)) if same else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(column).to_pylist()
                groups = [[t or "" for t in v or []] for v in values] if lists else [[v or ""] for v in values]
                flat, at, found = vectors([t for g in groups for t in g]), 0, []
                for g in groups:
                    found.append(mean(flat[at : at + len(g)]) if lists else flat[at])
                    at += len(g)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Embedder:
    """How texts become vectors: by a batch function of the user's own, with a model's prefixes, or without one by hashed
    tokens. The function is shipped to the workers, and may load its model there."""

    embed: Callable[[list[str]], list[list[float]]] | None = None
    dim: int = DIM
    query_prefix: str = ""
    document_prefix: str = ""

    @classmethod
    def of_model(cls, model: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], query: str | None = None, document: str | None = None, fallback: bool = False, dim: int = DIM) -> Embedder:
        """The embedder of a model that ``load`` gives the function of; where that fails hashed tokens, if ``fallback`` says so."""
        try:
            found = load()
        except Exception as e:
            if not fallback:
                raise RuntimeError(f"the model {model} could not be loaded: {e}") from e
            return cls(dim=dim)
        return cls(found, dim, *prefixes(model, query, document))

    def of_queries(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return df.withColumn(out, hash_embedding(F.col(column), self.dim)) if self.embed is None else model_embedding(df, column, out, self.embed, self.query_prefix)

    def of_chunks(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """The mean of the vectors of each row's array of texts."""
        return df.withColumn(out, chunk_mean_embedding(F.col(column), self.dim)) if self.embed is None else model_embedding(df, column, out, self.embed, self.document_prefix)


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors over those as long as the first, at unit length."""

    def mean(vs: Column) -> Column:
        first = F.element_at(vs, 1)
        same = F.filter(vs, lambda v: F.size(v) == F.size(first))
        total = F.aggregate(same, F.transform(first, lambda _: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        return bind(F.size(same), lambda n: F.transform(total, lambda x: x / n))

    return F.when(F.size(vectors) > 0, unit(bind(vectors, mean))).otherwise(F.array().cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 where either is missing or empty, or their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(F.coalesce(a, F.array().cast("array<double>"))) == 0) | (F.size(a) != F.size(b)) | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(dot)
