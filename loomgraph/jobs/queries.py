"""The library's operators as queries on the given tables: conversations are turns, documents long turns, benchmark texts
queries, labels relevance, events recalls. None of them leaves out rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import Embedder, hash_embedding, hash_embedding_builtin, unit
from loomgraph.jobs.ingest import extracted, ingest, rebuild, with_vectors
from loomgraph.jobs.oracle import COMMON, FURTHER, PRUNING, VOCABULARY, oracle_sql
from loomgraph.jobs.retrieve import evaluate_profiles, gather, rank_pool, retrieve, run_profiles, with_profiles, write_report
from loomgraph.operators import evaluate, graph, lexical, name_index, rank, store, text_index, traverse
from loomgraph.operators.extraction import explode_chunks, with_chunks, with_entities, with_relations
from loomgraph.operators.nearest import nearest
from loomgraph.session import settled, shared_dir, spread
from loomgraph.sources.turns import in_conversation, read_event_logs, read_examples, read_session_history, read_turns, union_sources
from loomgraph.streaming.ingest import stream_ingest, stream_recall, stream_turns
from loomgraph.vocabulary import PROFILES, Chunking, Retrieval, Vocabulary

Query = Callable[[SparkSession, str], DataFrame]

CHUNKS = Chunking(default_size=64, default_overlap=8, structured_size=48, structured_overlap=6)
#: What the library ships, but that importance and recency count as well.
PARAMS = Retrieval(recency_weight=0.1, importance_weight=0.1)
NOW = "2026-04-01 00:00:00"
GRAPH_WORDS = VOCABULARY(2)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _now():
    return F.lit(NOW).cast("timestamp")


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns; a conversation begins an hour after the one before, a turn lasts 15 seconds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = F.lit(1_770_595_200) + F.col("conv_id") * 3600 + F.col("turn") * 15
    return _table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("conversation_id"), F.concat(F.lit("t"), "turn").alias("turn_id"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.timestamp_seconds(at).alias("timestamp")
    )


def _uid_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(spark, sf_dir).withColumn("turn_uid", graph.turn_uid())


def _graph(spark: SparkSession, sf_dir: str, vectors: bool = True) -> graph.Graph:
    return graph.build(settled(extracted(turns_of(spark, sf_dir), GRAPH_WORDS, CHUNKS, vectors=vectors)), GRAPH_WORDS)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with entities and relations, found once and kept, as ingestion keeps them."""
    return settled(with_relations(with_entities(_uid_turns(spark, sf_dir), GRAPH_WORDS), GRAPH_WORDS))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("conversation_id"))


def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _uid_turns(spark, sf_dir).select("turn_uid", X.normalize_surface(F.col("text")).alias("normal"))
    named = rows.withColumn("canonical", X.canonical_of(F.col("normal"), GRAPH_WORDS))
    return named.select("turn_uid", "normal", "canonical", X.entity_id(F.col("canonical")).alias("entity_id"), X.entity_type(F.col("canonical"), GRAPH_WORDS).alias("entity_type"))


def text_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uid_turns(spark, sf_dir).select("turn_uid", X.importance(F.col("text"), GRAPH_WORDS).alias("importance"), X.relation_type(F.col("text"), GRAPH_WORDS).alias("relation_type"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("turn_uid"), F.coalesce("text", F.lit("")).alias("text"))
    rows = explode_chunks(with_chunks(docs, CHUNKS))
    return rows.select("turn_uid", "chunk_no", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"), "chunk_profile", "chunk_size", "chunk_overlap")


def _long_vectors(rows: DataFrame) -> DataFrame:
    return rows.select("turn_uid", F.posexplode_outer("v").alias("dim", "value")).select("turn_uid", "dim", (F.round(F.col("value"), 6) + F.lit(0.0)).alias("value")).where("value != 0")


def embed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(_uid_turns(spark, sf_dir).select("turn_uid", hash_embedding(F.col("text")).alias("v")))


def embed_turns_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(_uid_turns(spark, sf_dir).select("turn_uid", hash_embedding_builtin(F.col("text")).alias("v")))


def embed_chunk_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(with_vectors(with_chunks(_uid_turns(spark, sf_dir), CHUNKS)).select("turn_uid", F.col("embedding").alias("v")))


def cosine_to_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to each vector whose id is divisible by 100: a stated query set against all rows."""
    rows = settled(_table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("e")))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    return nearest(asked, rows, 5).select("query_id", "vec_id", "likeness", "rank")


def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_entities(_uid_turns(spark, sf_dir), VOCABULARY(3)).select("turn_uid", F.posexplode_outer("entities").alias("place", "e")).where("place is not null")
    return rows.select("turn_uid", "place", "e.canonical_name", "e.surface", "e.entity_type", "e.confidence")


def large_vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    """10,000 phrases, 4,950 synonyms and 300 keywords, made of the commonest words of the turns (400 words come to the driver)."""
    words = _uid_turns(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("w"))
    ranked = [r[0] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(COMMON + FURTHER).collect()]
    top = ranked[:COMMON]
    pairs = [f"{a} {b}" for a in top for b in top]
    turned = {f"{a} {b}": f"{b} {a}" for i, a in enumerate(top) for b in top[:i]}
    return replace(VOCABULARY(1), keywords=tuple(ranked[COMMON:]), phrases=tuple(pairs), synonyms=turned)


def extract_entities_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a vocabulary of more than 15,000 entries."""
    rows = with_entities(_uid_turns(spark, sf_dir), large_vocabulary(spark, sf_dir)).select("turn_uid", F.posexplode_outer("entities").alias("place", "e")).where("place is not null")
    return rows.select("turn_uid", "place", "e.canonical_name", "e.surface", "e.entity_type", "e.confidence")


def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("turn_uid", F.posexplode("relations").alias("place", "r")).select("turn_uid", "place", "r.source", "r.target", "r.relation_type", "r.confidence")


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_entities(graph.mention_rows(_words(spark, sf_dir), GRAPH_WORDS)).select("entity_id", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


def graph_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_mentions(graph.mention_rows(_words(spark, sf_dir), GRAPH_WORDS))


def _edges(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    return graph.with_evidence(relations, evidence).select("source_entity_id", "target_entity_id", "relation_type", "weight", F.size("evidence_turn_ids").cast("long").alias("n_evidence"), F.md5(F.array_join("evidence_turn_ids", ",").cast("binary")).alias("evidence_md5"))


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.relation_rows(_words(spark, sf_dir), GRAPH_WORDS)
    return _edges(graph.build_relations(rows), graph.build_evidence(rows))


def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's turns, as rows."""
    return graph.build_evidence(graph.relation_rows(_words(spark, sf_dir), GRAPH_WORDS))


def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.adjacency(graph.build_relations(graph.relation_rows(_words(spark, sf_dir), GRAPH_WORDS)), 40)
    return edges.select("source_entity_id", "target_entity_id", "relation_type", "forward", "weight", "place", F.round("edge_score", 6).alias("edge_score"))


def graph_merge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads that share turns: weights add up, evidence does not."""
    rows = settled(graph.relation_rows(_words(spark, sf_dir), GRAPH_WORDS))
    first, second = (rows.where(f"crc32(cast(turn_uid as binary)) % 3 != {k}") for k in (0, 1))
    evidence = graph.merge_evidence(graph.build_evidence(first), graph.build_evidence(second))
    return _edges(graph.merge_relations(graph.build_relations(first), graph.build_relations(second)), evidence)


def graph_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(graph.mention_rows(_words(spark, sf_dir), GRAPH_WORDS))
    half = lambda k: graph.build_entities(rows.where(f"crc32(cast(turn_uid as binary)) % 3 != {k}"))
    merged = graph.merge_entities(half(0), half(1))
    return merged.select("entity_id", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


def skip_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _uid_turns(spark, sf_dir)
    return graph.skip_stored(turns, turns.where("speaker = 'user'")).select("turn_uid", "speaker")


def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    s = graph.ingest_statistics(words, with_chunks(words, CHUNKS))
    kinds = [F.coalesce(F.element_at("by_relation", k), F.lit(0)).cast("long").alias(k.lower()) for k in ("COMPARES", "DEPENDS_ON", "IMPLEMENTS", "EXPLAINS", "RELATED_TO")]
    profiles = [F.coalesce(F.element_at("by_profile", k), F.lit(0)).cast("long").alias(f"chunks_{k}") for k in ("default", "structured")]
    return s.select("turns", "mentions", "relations", *kinds, *profiles, "avg_chunks", "max_chunks")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _uid_turns(spark, sf_dir)
    return graph.turns_of_conversations(turns, turns.select("conversation_id")).select("conversation_id", "turn_uid", "place", F.unix_seconds("timestamp").alias("at"))


def query_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = settled(graph.build_entities(graph.mention_rows(_words(spark, sf_dir), GRAPH_WORDS)))
    found = traverse.seeds(traverse.query_names(_questions(spark, sf_dir), GRAPH_WORDS), entities, PARAMS.seed_limit)
    return found.select("query_id", "entity_id", "canonical_name", F.round("score", 6).alias("score"), "place")


def _named(spark: SparkSession, words: DataFrame) -> name_index.NameIndex:
    """An index of names that grew in three loads that share entities, two of them written as one in between."""
    rows = settled(graph.mention_rows(words, GRAPH_WORDS))
    index = name_index.NameIndex(spark, f"{shared_dir(spark)}/names-{uuid.uuid4().hex}", buckets=8)  # these tables are small
    for k in range(3):
        name_index.add(index, graph.build_entities(rows.where(f"crc32(cast(turn_uid as binary)) % 3 = {k}")))
        if k == 1:
            name_index.compact(index)
    return index


def query_seeds_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_seeds`` from a stored index of names."""
    words = _words(spark, sf_dir)
    entities = graph.build_entities(graph.mention_rows(words, GRAPH_WORDS))
    found = traverse.seeds(traverse.query_names(_questions(spark, sf_dir), GRAPH_WORDS), entities, PARAMS.seed_limit, index=_named(spark, words))
    return found.select("query_id", "entity_id", "canonical_name", F.round("score", 6).alias("score"), "place")


def beam_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``beam_traversal`` from a stored index of names and a stored adjacency."""
    words = _words(spark, sf_dir)
    entities = graph.build_entities(graph.mention_rows(words, GRAPH_WORDS))
    start = settled(traverse.seeds(traverse.query_names(_questions(spark, sf_dir), GRAPH_WORDS), entities, PARAMS.seed_limit, index=_named(spark, words)))
    adjacent = store.store_adjacency(graph.build_relations(graph.relation_rows(words, GRAPH_WORDS)), max(40, 2 * PARAMS.beam_width))
    return _paths(traverse.traverse(start, adjacent, PARAMS))


def _paths(reached: traverse.Reached) -> DataFrame:
    path = F.concat_ws(">", F.transform("steps", lambda s: F.concat(s.relation_type, F.when(s.forward, F.lit("+")).otherwise(F.lit("-")), s.to_entity_id)))
    return reached.entities.select("query_id", "entity_id", F.round("score", 6).alias("score"), path.alias("path"))


def _reach(spark: SparkSession, sf_dir: str, params: Retrieval = PARAMS) -> traverse.Reached:
    words = _words(spark, sf_dir)
    entities = graph.build_entities(graph.mention_rows(words, GRAPH_WORDS))
    relations = graph.build_relations(graph.relation_rows(words, GRAPH_WORDS))
    start = traverse.seeds(traverse.query_names(_questions(spark, sf_dir), GRAPH_WORDS), entities, params.seed_limit)
    return traverse.traverse(start, settled(graph.adjacency(relations, max(40, 2 * params.beam_width))), params)


def beam_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_reach(spark, sf_dir))


def beam_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under the threshold for every query, 0 for those without; the threshold is one that many paths of these tables miss."""
    pruned = _reach(spark, sf_dir, PARAMS.but(prune_threshold=PRUNING)).pruned
    return _questions(spark, sf_dir).select("query_id").join(pruned, "query_id", "left").select("query_id", F.coalesce("pruned", F.lit(0)).alias("pruned"))


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_uid_turns(spark, sf_dir)).select("term", "turn_uid", "tf", F.col("len").cast("long").alias("len"))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _uid_turns(spark, sf_dir)
    found = lexical.search(_questions(spark, sf_dir), turns, lexical.postings(turns), 200)
    return found.select("query_id", "turn_uid", F.round("lexical_raw", 6).alias("lexical_raw"))


def _prepared(spark: SparkSession, sf_dir: str):
    g = _graph(spark, sf_dir)
    recalled = store.with_recall(g.turns, store.recall_state(_recalls(spark, sf_dir)))
    return graph.Graph(settled(recalled), settled(g.entities), settled(g.mentions), settled(g.relations), settled(g.evidence)), _questions(spark, sf_dir)


def _recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of recalls: each recalls the first turn of the conversation that has its user's number."""
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("conv-"), "user_id", F.lit(":t0")).alias("turn_uid"), (F.col("ts").cast("timestamp") + F.expr("interval 770 days")).alias("recalled_at"), F.col("event_id").alias("query_id"))


def recall_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recall_state(_recalls(spark, sf_dir)).select("turn_uid", "recall_count", F.unix_micros("last_recalled_at").alias("last_us"))


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both kinds, with how many entities are matched in each."""
    g, asked = _prepared(spark, sf_dir)
    pool = gather(asked, g, PARAMS, GRAPH_WORDS)
    n = pool.matched.groupBy("query_id", "turn_uid").agg(F.count("*").alias("n_matched"))
    return pool.candidates.join(n, ["query_id", "turn_uid"], "left").select("query_id", "turn_uid", F.col("lexical_raw").isNotNull().alias("by_text"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def _ranked_columns(ranked: DataFrame) -> DataFrame:
    parts = ("graph_signal", "embedding_signal", "lexical_signal", "importance_component", "recency_component")
    return ranked.select("query_id", "turn_uid", "rank", "score", *parts)


def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph, text, vectors, importance and recency together."""
    g, asked = _prepared(spark, sf_dir)
    return _ranked_columns(rank_pool(gather(asked, g, PARAMS, GRAPH_WORDS), asked, g, PARAMS, _now()))


def retrieve_graph_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, asked = _prepared(spark, sf_dir)
    params = PROFILES["graph_only"]
    return _ranked_columns(rank_pool(gather(asked, g, params, GRAPH_WORDS), asked, g, params, _now()))


def _length_scores(queries: list[str], texts: list[str]) -> list[float]:
    return [len(q) / max(1, len(q) + len(t)) for q, t in zip(queries, texts, strict=True)]


def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked by a scorer that anyone can check: the query's share of both lengths."""
    g, asked = _prepared(spark, sf_dir)
    params = PARAMS.but(rerank=True, rerank_top_n=5)
    ranked = rank_pool(gather(asked, g, params, GRAPH_WORDS), asked, g, params, _now(), _length_scores)
    return ranked.select("query_id", "turn_uid", "rank", "score", "rerank_component")


def retrieve_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ranked turn rests on: matched entities, path steps, evidence."""
    g, asked = _prepared(spark, sf_dir)
    pool = gather(asked, g, PARAMS, GRAPH_WORDS)
    told = rank.trace(settled(rank_pool(pool, asked, g, PARAMS, _now())), pool.matched, pool.reached.entities, g.evidence, g.entities)
    none = F.array().cast("array<string>")
    return told.select(
        "query_id", "turn_uid", "rank", F.array_join(F.coalesce("matched_entities", none), "|").alias("matched"), F.coalesce(F.size("path_summary"), F.lit(0)).alias("n_steps"),
        F.size(F.coalesce("evidence_turn_ids", none)).alias("n_evidence"), F.md5(F.array_join(F.coalesce("evidence_turn_ids", none), ",").cast("binary")).alias("evidence_md5"),
    )


def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the keywords: matching entities and their neighbours."""
    words = _words(spark, sf_dir)
    names = spark.createDataFrame([(k,) for k in GRAPH_WORDS.keywords], "name string")
    entities = graph.build_entities(graph.mention_rows(words, GRAPH_WORDS))
    _, edges = graph.subgraph(names, entities, graph.build_relations(graph.relation_rows(words, GRAPH_WORDS)), 100)
    return edges.select("name", "source", "target", "label")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as examples: relevant are turns that hold one of its words of seven letters or more."""
    words = F.array_distinct(F.filter(X.search_terms(F.col("text")), lambda w: F.char_length(w) >= 7))
    asked = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), F.explode_outer(words).alias("term"))
    hits = asked.join(lexical.postings(_uid_turns(spark, sf_dir)).select("term", "turn_uid"), "term")
    return hits.groupBy("item_id", "query").agg(F.array_sort(F.collect_set("turn_uid")).alias("relevant_turn_uids")).select(F.col("item_id").alias("example_id"), "query", F.lit(None).cast("string").alias("conversation_id"), "relevant_turn_uids")


def evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text ranking judged at three cut-offs."""
    examples = settled(_examples(spark, sf_dir).withColumn("profile", F.lit("text")))
    turns = _uid_turns(spark, sf_dir)
    found = lexical.search(examples.select(F.col("example_id").alias("query_id"), "query"), turns, lexical.postings(turns), 10)
    ranked = rank.top(found.withColumnRenamed("lexical_raw", "score"), 10).select(F.lit("text").alias("profile"), F.col("query_id").alias("example_id"), "rank", "turn_uid")
    return evaluate.metrics(evaluate.judge(ranked, examples, [1, 5, 10]))


def compare_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranking profiles over the same candidates, against the graph's alone."""
    examples = settled(_examples(spark, sf_dir))
    g, _ = _prepared(spark, sf_dir)
    return evaluate_profiles(examples, g, PROFILES, [1, 5, 10], _now(), "graph_only", GRAPH_WORDS, _length_scores)


def graph_merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns are stored, with their recalls; then all turns come in once more, with another text."""
    turns = _uid_turns(spark, sf_dir).withColumns({"recall_count": F.lit(0).cast("bigint"), "last_recalled_at": F.lit(None).cast("timestamp")})
    old = store.with_recall(turns.where("speaker = 'user'"), store.recall_state(_recalls(spark, sf_dir)))
    merged = graph.merge_turns(old, turns.withColumn("text", F.concat(F.col("text"), F.lit("!"))))
    return merged.select("turn_uid", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"), "recall_count")


def graph_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all stored conversations, found anew."""
    stored = _uid_turns(spark, sf_dir)
    again = rebuild(stored.select("conversation_id"), stored, GRAPH_WORDS, CHUNKS)
    return _edges(again.relations, again.evidence)


def graph_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and turns by id, and which ids exist: asked for are those of the benchmark's names and of the recall log."""
    words = _words(spark, sf_dir)
    entities = settled(graph.build_entities(graph.mention_rows(words, GRAPH_WORDS)))
    names = traverse.query_names(_questions(spark, sf_dir), GRAPH_WORDS).select(X.entity_id(F.col("name")).alias("entity_id"))
    uids = _recalls(spark, sf_dir).select("turn_uid")
    found = graph.entities_by_id(entities, names).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("canonical_name").alias("what"))
    turns = graph.turns_by_uid(words, uids).select(F.lit("turn").alias("kind"), F.col("turn_uid").alias("id"), F.col("speaker").alias("what"))
    there = graph.stored_uids(uids, words).select(F.lit("exists").alias("kind"), F.col("turn_uid").alias("id"), F.lit("").alias("what"))
    return found.unionByName(turns).unionByName(there)


def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    names = spark.createDataFrame([(k,) for k in GRAPH_WORDS.keywords], "name string")
    entities = settled(graph.build_entities(graph.mention_rows(words, GRAPH_WORDS)))
    nodes, _ = graph.subgraph(names, entities, graph.build_relations(graph.relation_rows(words, GRAPH_WORDS)), 100)
    return nodes.select("name", "id", "score", "label", "kind")


def recall_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall counts after all queries have recalled the turns that full text ranks first."""
    turns = _uid_turns(spark, sf_dir)
    ranked = lexical.search(_questions(spark, sf_dir), turns, lexical.postings(turns), 10)
    log = store.recall_log(ranked, _now()).unionByName(_recalls(spark, sf_dir).select("turn_uid", "recalled_at", (-F.col("query_id") - 1).alias("query_id")))
    return store.with_recall(turns.select("turn_uid"), store.recall_state(log)).select("turn_uid", "recall_count", F.unix_micros("last_recalled_at").alias("last_us"))


def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples kept over time: benchmark items are stored, labelled documents' ids take some over with another text and add
    new ones, toxic ones are deleted."""
    at = lambda day: (F.lit(1_770_000_000) + day * 86_400).cast("timestamp")
    old = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), F.col("text").alias("query"), at(F.col("item_id")).alias("created_at"))
    labels = _table(spark, sf_dir, "labels")
    new = labels.select(F.col("doc_id").alias("example_id"), F.concat(F.lit("document "), "doc_id").alias("query"), at(F.col("doc_id") + 1000).alias("created_at"))
    kept = evaluate.delete_examples(evaluate.upsert_examples(old, new), labels.where("toxic = 1").select(F.col("doc_id").alias("example_id")))
    return kept.select("example_id", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.unix_seconds("created_at").alias("created"))


def evaluate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each example's ranking was, beside what is relevant, under its own number of hits: the graph's profile, in which
    every example asks for one hop."""
    examples = settled(_examples(spark, sf_dir).withColumn("request", F.create_map(F.lit("max_hops"), F.lit("1"))))
    g, _ = _prepared(spark, sf_dir)
    profiles = {"graph_only": PROFILES["graph_only"]}
    ranked = run_profiles(examples, g, profiles, [10], _now(), GRAPH_WORDS)
    told = evaluate.ranked_lists(ranked, with_profiles(examples, profiles))
    return told.select("profile", "example_id", F.size("relevant_turn_uids").cast("long").alias("n_relevant"), F.array_join("ranked_turn_uids", ",").alias("ranked"))


def evaluate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example with hops, width, threshold and weights of its own, all in one batch: what was ranked, and what was applied."""
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("example_id") % len(values) + 1).cast("int"))
    request = F.create_map(
        F.lit("max_hops"), of(["1", "2"]), F.lit("beam_width"), of(["4", "8", "24"]), F.lit("prune_threshold"), of(["0.05", "0.3", "0.45", "0.6", "0.1"]),
        F.lit("importance_weight"), of(["0.0", "0.1", "0.2", "0.3"]),
    )
    g, asked = _prepared(spark, sf_dir)
    examples = asked.withColumnRenamed("query_id", "example_id").withColumn("request", request)
    ranked = run_profiles(examples, g, {"graph_only": PROFILES["graph_only"]}, [10], _now(), GRAPH_WORDS)
    shown = [F.element_at("applied", n).cast(kind).alias(n) for n, kind in (("max_hops", "int"), ("beam_width", "int"), ("prune_threshold", "double"), ("importance_weight", "double"))]
    return ranked.select("profile", "example_id", "rank", "turn_uid", *shown)


def text_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search in a stored index that grew in three loads: users' turns, then all others together with a third of the
    users' turns anew, whose first texts were other ones; then it is compacted and takes the first turns of conversations again."""
    return _indexed(spark, sf_dir, lambda index, turns: text_index.search(index, _questions(spark, sf_dir), 200)[0].select("query_id", "turn_uid", F.round("lexical_raw", 6).alias("lexical_raw")))


def text_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All live postings of such an index."""
    return _indexed(spark, sf_dir, lambda index, turns: text_index.live_postings(index).select("term", "turn_uid", F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len")))


def _indexed(spark: SparkSession, sf_dir: str, use: Callable[[text_index.TextIndex, DataFrame], DataFrame]) -> DataFrame:
    turns = settled(_uid_turns(spark, sf_dir))
    index = text_index.TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    third = F.expr("crc32(cast(turn_uid as binary)) % 3 = 0")
    first = settled(turns.where("speaker = 'user'").withColumn("text", F.when(third, F.concat(F.lit("the zebra "), "text")).otherwise(F.col("text"))))
    text_index.add(index, first)
    text_index.add(index, turns.where((F.col("speaker") != "user") | third), first)
    text_index.compact(index)
    text_index.add(index, turns.where("turn_id = 't0'"), turns)
    return use(index, turns)


def retrieve_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retrieve_hybrid`` with full text from a stored index."""
    g, asked = _prepared(spark, sf_dir)
    index = text_index.TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    text_index.add(index, g.turns.select("turn_uid", "text"))
    return _ranked_columns(rank_pool(gather(asked, g, PARAMS, GRAPH_WORDS, index), asked, g, PARAMS, _now()))


def graph_entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of entities after two loads that share turns: sums and counts add up, as weights of edges do."""
    rows = settled(extracted(turns_of(spark, sf_dir), GRAPH_WORDS, CHUNKS))
    half = lambda k: graph.build(rows.where(f"crc32(cast(turn_uid as binary)) % 3 != {k}"), GRAPH_WORDS, entity_vectors=True).entities
    merged = graph.merge_entities(half(0), half(1))
    parts = merged.select("entity_id", F.col("embedding_count").alias("n"), F.posexplode("embedding").alias("dim", "value"))
    return parts.select("entity_id", "n", "dim", (F.round("value", 6) + F.lit(0.0)).alias("value")).where("value != 0")


def _by_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, traverse.Reached]:
    g = graph.build(settled(extracted(turns_of(spark, sf_dir), GRAPH_WORDS, CHUNKS)), GRAPH_WORDS, entity_vectors=True)
    entities = settled(g.entities)
    asked = _questions(spark, sf_dir)
    vectors = settled(Embedder().of_queries(asked, "query", "vector").select("query_id", "vector"))
    start = settled(traverse.seeds(traverse.query_names(asked, GRAPH_WORDS), entities, PARAMS.seed_limit, vectors))
    return start, traverse.traverse(start, settled(graph.adjacency(g.relations, max(40, 2 * PARAMS.beam_width))), PARAMS, vectors, entities)


def seeds_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, chosen also by the likeness of queries to the entities' vectors."""
    return _by_vectors(spark, sf_dir)[0].select("query_id", "entity_id", "canonical_name", F.round("score", 6).alias("score"), "place")


def beam_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal in which the likeness to each target's vector counts."""
    return _paths(_by_vectors(spark, sf_dir)[1])


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def embed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by a model of the user's own, with its prefix: here one that counts letters, which anyone can check."""
    embedder = Embedder.of_model("nlpai-lab/KURE-v1", lambda: _letters)
    return _long_vectors(with_vectors(with_chunks(_uid_turns(spark, sf_dir), CHUNKS), embedder).select("turn_uid", F.col("embedding").alias("v")))


def _json_lines(spark: SparkSession, rows: DataFrame, kind: str) -> str:
    """``rows(value)`` as text files in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    rows.select("value").write.text(path)
    return path


def files_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read back; those of the system lack their text and are rejected."""
    turns = turns_of(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    whole = F.to_json(F.struct("conversation_id", "turn_id", "speaker", "text", "timestamp"))
    value = F.when(F.col("speaker") == "system", F.to_json(F.struct("conversation_id", "turn_id", "speaker", "timestamp"))).otherwise(whole)
    loaded = read_turns(spark, _json_lines(spark, turns.select(value.alias("value")), "turns"))
    valid = loaded.valid.select(F.lit("").alias("reason"), F.concat_ws(":", "conversation_id", "turn_id").alias("turn_uid"), "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.unix_seconds("timestamp").alias("at"))
    rejects = loaded.rejects.groupBy("reason").agg(F.count("*").alias("at")).select("reason", F.lit("").alias("turn_uid"), F.lit("").alias("speaker"), F.lit("").alias("text_md5"), "at")
    return valid.unionByName(rejects)


def files_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as a history of prompts, in one file of many pieces, numbered within their sessions."""
    rows = _table(spark, sf_dir, "conversations").where("role = 'user'").orderBy("conv_id", "turn").coalesce(1)
    value = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text")))
    read = read_session_history(spark, _json_lines(spark, rows.select(value.alias("value")), "sessions"))
    return read.select("conversation_id", "turn_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.unix_seconds("timestamp").alias("at"))


def files_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event logs: an assistant's content is a list of parts, a system's event is of no kind that is read."""
    turns = _table(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("grep").alias("name")))
    common = [F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat_ws("-", F.lit("u"), "conv_id", "turn").alias("uuid")]
    value = F.when(F.col("role") == "assistant", F.to_json(F.struct(*common, F.struct("role", parts.alias("content")).alias("message")))).otherwise(F.to_json(F.struct(*common, F.struct("role", F.col("text").alias("content")).alias("message"))))
    read = read_event_logs(spark, _json_lines(spark, turns.select(value.alias("value")), "events"), _now(), pattern="part-*")
    return read.select("conversation_id", "turn_id", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def files_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation examples written as JSON lines and read back; those without relevant turns are rejected."""
    known = _examples(spark, sf_dir).select("query", "relevant_turn_uids")
    none = _questions(spark, sf_dir).select("query", F.array().cast("array<string>").alias("relevant_turn_uids"))
    loaded = read_examples(spark, _json_lines(spark, known.unionByName(none).select(F.to_json(F.struct("query", F.col("relevant_turn_uids").alias("expected_turn_uids"))).alias("value")), "examples"))
    valid = loaded.valid.select(F.lit("").alias("reason"), F.md5(F.col("query").cast("binary")).alias("query_md5"), F.array_join(F.array_sort("relevant_turn_uids"), ",").alias("relevant"), F.lit(1).cast("long").alias("n"))
    return valid.unionByName(loaded.rejects.groupBy("reason").agg(F.count("*").alias("n")).select("reason", F.lit("").alias("query_md5"), F.lit("").alias("relevant"), "n"))


def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def graph_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph that is written in one load, merged bucket by bucket with a second one, and read back."""
    turns, base = turns_of(spark, sf_dir), _scratch(spark, "graph")
    part = F.crc32(F.concat_ws(":", "conversation_id", "turn_id").cast("binary")) % 3
    for k, chosen in enumerate((part == 0, part != 0)):
        store.commit_merge(spark, base, ingest(turns.where(chosen), GRAPH_WORDS, CHUNKS), k, buckets=8)
    back = store.read_graph(spark, f"{base}/v{store.current_version(spark, base)}")
    return _edges(back.relations, back.evidence)


def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph that grows by micro-batches of files; users' turns come twice, and count once."""
    turns = turns_of(spark, sf_dir).where("text != ''").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = lambda rows: rows.select(F.to_json(F.struct("conversation_id", "turn_id", "speaker", "text", "timestamp")).alias("value"))
    folder, base = _scratch(spark, "arriving"), _scratch(spark, "graph")
    for rows in (turns.where("speaker = 'user'"), turns):
        line(rows).write.mode("append").text(folder)
        stream_ingest(stream_turns(spark, folder), base, f"{base}-offsets", GRAPH_WORDS, CHUNKS).awaitTermination()
    back = store.read_graph(spark, f"{base}/v{store.current_version(spark, base)}")
    return _edges(back.relations, back.evidence)


def stream_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall log as a stream in which every recall comes twice."""
    folder, log = _scratch(spark, "recalls"), _scratch(spark, "log")
    rows = _recalls(spark, sf_dir)
    rows.unionByName(rows).write.parquet(folder)
    stream_recall(spark.readStream.schema(rows.schema).parquet(folder), log, f"{log}-offsets", "100 days").awaitTermination()
    return store.recall_state(spark.read.parquet(log)).select("turn_uid", "recall_count", F.unix_micros("last_recalled_at").alias("last_us"))


def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as a report and read back."""
    measured, path = evaluate_search(spark, sf_dir), _scratch(spark, "report")
    write_report(measured, path)
    return spark.read.schema(measured.schema).json(path)


def files_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of four files of event logs."""
    turns = _table(spark, sf_dir, "conversations").where("role != 'system'").withColumn("k", F.col("conv_id") % 4)
    event = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat_ws("-", F.lit("u"), "conv_id", "turn").alias("uuid"), F.struct("role", F.col("text").alias("content")).alias("message")))
    path = _scratch(spark, "events")
    turns.select(event.alias("value"), "k").repartition(4, "k").write.partitionBy("k").text(path)
    return read_event_logs(spark, path, _now(), max_files=2, pattern="part-*").select("conversation_id", "turn_id", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def files_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as a history of prompts, beside all turns as event logs."""
    rows = _table(spark, sf_dir, "conversations").where("role = 'user'").orderBy("conv_id", "turn").coalesce(1)
    prompt = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text")))
    sessions = read_session_history(spark, _json_lines(spark, rows.select(prompt.alias("value")), "sessions"))
    event = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat_ws("-", F.lit("u"), "conv_id", "turn").alias("uuid"), F.struct("role", F.col("text").alias("content")).alias("message")))
    events = read_event_logs(spark, _json_lines(spark, _table(spark, sf_dir, "conversations").select(event.alias("value")), "events"), _now(), pattern="part-*")
    return union_sources("both", sessions, events).select("conversation_id", "turn_id", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def turns_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns moved into one conversation."""
    return in_conversation(turns_of(spark, sf_dir), "all").groupBy("conversation_id", "turn_id", "speaker").agg(F.count("*").alias("n"))


def eval_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred of the examples that are some, trimmed, each with the number of all of them."""
    blank = F.col("item_id") % 3 == 0
    new = _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("example_id"), F.when(blank, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("query"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" conv-"), F.col("item_id"), F.lit(":t0 ")), F.lit(""))).alias("relevant_turn_uids"),
        (F.lit(1_770_000_000) + F.col("item_id") % 7 * 86_400).cast("timestamp").alias("created_at"),
    )
    valid, _ = evaluate.clean_examples(new)
    listed = evaluate.list_examples(valid, 100).join(evaluate.count_examples(valid))  # a table of one row
    return listed.select("example_id", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.array_join("relevant_turn_uids", ",").alias("relevant"), F.unix_seconds("created_at").alias("created"), "examples")


def retrieve_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that users call, with columns of parameters: how many turns each query gets, and what it says was applied. Every
    third query names nothing that there is, and finds nothing."""
    g, asked = _prepared(spark, sf_dir)
    own = asked.withColumns({"query": F.when(F.col("query_id") % 3 == 0, F.lit("zzqqzz")).otherwise(F.col("query")), "top_k": (F.col("query_id") % 4 + 1).cast("int"), "hybrid": F.lit(True), "max_hops": F.lit(1)})
    told = retrieve(own, g, _now(), PARAMS, GRAPH_WORDS)
    return told.groupBy("query_id").agg(F.count("*").alias("n"), *[F.max(F.element_at("applied", k)).alias(k) for k in ("top_k", "max_hops", "beam_width", "hybrid_enabled", "importance_weight")])


def queries() -> dict[str, Query]:
    found = (
        text_names, text_importance, chunk_documents, embed_turns, embed_turns_builtin, embed_chunk_means, cosine_to_queries, extract_entities, extract_relations, graph_entities, graph_mentions,
        graph_relations, graph_adjacency, graph_merge_relations, graph_merge_entities, skip_stored, ingest_statistics, conversation_turns, query_seeds, beam_traversal, beam_pruned, text_postings,
        text_search, recall_state, candidate_pool, retrieve_hybrid, retrieve_graph_only, retrieve_reranked, retrieve_traced, subgraph_edges, evaluate_search, compare_profiles,
        graph_evidence, graph_merge_turns, graph_rebuild, graph_lookups, subgraph_nodes, recall_feedback, eval_examples, evaluate_details, evaluate_requests,
        text_search_index, text_index_postings, retrieve_indexed, graph_entity_vectors, seeds_by_vectors, beam_by_vectors, embed_model, extract_entities_large, query_seeds_indexed, beam_stored,
        graph_stored, stream_ingested, stream_recalled, report_written, files_first, files_both, turns_moved, eval_listed, retrieve_own, files_turns, files_sessions, files_events, files_examples,
    )
    return {f.__name__: f for f in found}


__all__ = ["oracle_sql", "queries"]
