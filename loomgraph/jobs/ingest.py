"""From turns to graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import Embedder
from loomgraph.operators.extraction import with_chunks, with_entities, with_relations
from loomgraph.operators.graph import Graph, build, skip_stored, turn_uid
from loomgraph.session import settled
from loomgraph.vocabulary import Chunking, Vocabulary


def with_vectors(chunked: DataFrame, embedder: Embedder = Embedder()) -> DataFrame:
    """``chunked`` with ``embedding``, the mean of its chunks' vectors."""
    return embedder.of_chunks(chunked, "chunks", "embedding")


def extracted(
    turns: DataFrame, vocabulary: Vocabulary = Vocabulary(), chunking: Chunking = Chunking(), now: Column | None = None, vectors: bool = True, embedder: Embedder = Embedder()
) -> DataFrame:
    """Stored turns with their entities and relations: everything that is said about a turn by itself."""
    rows = turns.withColumn("turn_uid", turn_uid())
    chunked = with_chunks(rows, chunking)
    chunked = with_vectors(chunked, embedder) if vectors else chunked.withColumn("embedding", F.array().cast("array<double>"))
    stored = chunked.withColumns(
        {
            "importance_score": X.importance(F.col("text"), vocabulary), "chunk_count": F.size("chunks"), "recall_count": F.lit(0).cast("bigint"),
            "last_recalled_at": F.lit(None).cast("timestamp"), "updated_at": now if now is not None else F.col("timestamp"),
        }
    ).drop("chunks")
    return with_relations(with_entities(stored, vocabulary), vocabulary)


def ingest(turns: DataFrame, vocabulary: Vocabulary = Vocabulary(), chunking: Chunking = Chunking(), stored: DataFrame | None = None, now: Column | None = None, embedder: Embedder = Embedder(), entity_vectors: bool = False) -> Graph:
    """The graph of ``turns``, without those that ``stored`` has already. What extraction finds is kept once: mentions, entities
    and relations all read it. With ``entity_vectors`` entities have the mean of their turns' vectors."""
    rows = turns
    if stored is not None:
        rows = skip_stored(turns.withColumn("turn_uid", turn_uid()), stored).drop("turn_uid")
    return build(settled(extracted(rows, vocabulary, chunking, now, embedder=embedder)), vocabulary, entity_vectors)


def rebuild(conversations: DataFrame, stored: DataFrame, vocabulary: Vocabulary = Vocabulary(), chunking: Chunking = Chunking()) -> Graph:
    """The graph of all stored turns of some conversations, found anew."""
    again = stored.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return ingest(again.select("conversation_id", "turn_id", "speaker", "text", "timestamp"), vocabulary, chunking)
