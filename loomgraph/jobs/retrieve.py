"""Batches of queries against a graph, and their evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import Embedder
from loomgraph.operators import evaluate, lexical, rank, store, text_index
from loomgraph.operators.graph import Graph, adjacency
from loomgraph.operators.name_index import NameIndex
from loomgraph.operators.settings import KINDS, Settings, applied, as_settings, resolved, settings_of
from loomgraph.operators.text_index import TextIndex
from loomgraph.operators.traverse import Reached, query_names, seeds, traverse
from loomgraph.session import settled, shared_dir
from loomgraph.vocabulary import Retrieval, Vocabulary


@dataclass
class Pool:
    """What ranking chooses from: it depends on the traversal's parameters, but on no weight."""

    reached: Reached
    seeds: DataFrame
    candidates: DataFrame
    matched: DataFrame
    vectors: DataFrame
    settings: Settings


def gather(
    queries: DataFrame, graph: Graph, params: Retrieval = Retrieval(), vocabulary: Vocabulary = Vocabulary(), index: DataFrame | TextIndex | None = None, embedder: Embedder = Embedder(),
    entity_vectors: bool = False, names: NameIndex | None = None, adjacent: DataFrame | None = None,
) -> Pool:
    """Candidates of ``queries(query_id, query, conversation_id)``. Columns named as parameters are a query's own; all queries are
    worked on together nevertheless. ``index``: a stored index of the graph's turns, or their postings as a table. With ``entity_vectors``
    the likeness of a query to the entities' vectors counts in seeds and paths. ``names``: a stored index of the entities' names;
    ``adjacent``: the stored adjacency (``store.store_adjacency``), capped at no less than twice the widest beam and 40."""
    settings = settings_of(queries, params)
    vectors = settled(embedder.of_queries(queries.select("query_id", "query"), "query", "vector").select("query_id", "vector"))
    start = settled(seeds(query_names(queries, vocabulary), graph.entities, settings.limit("seed_limit"), vectors if entity_vectors else None, names))
    if adjacent is None:
        adjacent = settled(adjacency(graph.relations, max(40, 2 * settings.highest("beam_width"))))
    reached = traverse(start, adjacent, settings, vectors if entity_vectors else None, graph.entities if entity_vectors else None)
    found = rank.graph_candidates(reached.entities, graph.mentions, queries, graph.turns, settings.limit("top_k", 400, 40))
    texts, asking = None, settings.asked_for(queries, "hybrid")
    if asking is not None:
        most = settings.limit("top_k", 200, 40)
        if index is None:  # made for this batch: still far less than to join all postings of frequent terms with all queries
            spark = queries.sparkSession
            index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
            text_index.add(index, graph.turns.select("turn_uid", "text"))
        hits = text_index.search(index, asking, most)[0] if isinstance(index, TextIndex) else lexical.search(asking, graph.turns, index, most)
        texts = rank.in_conversation(hits, queries, graph.turns)
    candidates, matched = rank.merge_candidates(found, texts, graph.mentions)
    return Pool(reached, start, settled(candidates), settled(matched), vectors, settings)


def rank_pool(pool: Pool, queries: DataFrame, graph: Graph, params: Retrieval | Settings | None, now: Column, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """The ``top_k`` turns of each query, with the parts of their scores; without ``params`` by the settings of the pool."""
    settings = pool.settings if params is None else as_settings(params)
    scored = rank.fuse(pool.candidates, pool.matched, pool.reached.entities, graph.evidence, graph.turns, pool.vectors, settings, now)
    most = settings.limit("top_k")
    if settings.highest("rerank"):
        return rank.top(rank.rerank(scored, queries, graph.turns, settings, scorer), most, F.col("head")).drop("head")
    return rank.top(scored, most)


def retrieve(
    queries: DataFrame, graph: Graph, now: Column, params: Retrieval = Retrieval(), vocabulary: Vocabulary = Vocabulary(), scorer: Callable | None = None, recalls: str | None = None,
    index: DataFrame | TextIndex | None = None, embedder: Embedder = Embedder(), entity_vectors: bool = False, names: NameIndex | None = None, adjacent: DataFrame | None = None,
) -> DataFrame:
    """Ranked turns with their trace, texts and times, which are fetched for ranked turns only, and the parameters ``applied``.
    Queries may bring parameters of their own as columns. With ``recalls`` the ranked turns are appended to the recall log of that
    path. A query that finds nothing has no rows."""
    pool = gather(queries, graph, params, vocabulary, index, embedder, entity_vectors, names, adjacent)
    ranked = settled(rank_pool(pool, queries, graph, None, now, scorer))
    if recalls:
        store.recall_log(ranked, now).write.mode("append").parquet(recalls)
    told = rank.trace(ranked, pool.matched, pool.reached.entities, graph.evidence, graph.entities)
    told = pool.settings.onto(told, *KINDS).withColumn("applied", applied()).drop(*[f"_{n}" for n in KINDS])
    return told.join(graph.turns.select("turn_uid", "conversation_id", "turn_id", "speaker", "text", "timestamp", "chunk_profile", "chunk_count"), "turn_uid")


#: What candidates depend on; profiles that differ in other parameters share them.
SHAPE = ("max_hops", "beam_width", "seed_limit", "prune_threshold", "top_k")


def run_profiles(
    examples: DataFrame, graph: Graph, profiles: dict[str, Retrieval], ks: list[int], now: Column, vocabulary: Vocabulary = Vocabulary(), scorer: Callable | None = None, common: dict | None = None,
    example_last: bool = True, index: DataFrame | TextIndex | None = None, embedder: Embedder = Embedder(), entity_vectors: bool = False,
) -> DataFrame:
    """(profile, example_id, rank, turn_uid, applied) of each profile over ``examples(example_id, query, conversation_id)``, which
    may bring parameters of their own in ``request map<string,string>``, as many different ones as there are examples.

    All profiles and examples are one batch: each of their rows is a query with its parameters as columns. Candidates are looked
    for once for each example and each different shape of search, and shared by the profiles that differ in weights."""
    most = max(evaluate.cutoffs(ks))
    request = F.col("request") if "request" in examples.columns else F.lit(None)
    kind = dict(examples.dtypes)["example_id"]
    rows = examples.select("example_id", "query", "conversation_id", F.coalesce(request.cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("request"))
    wanted = resolved(with_profiles(rows, profiles), profiles, common, example_last).withColumn("top_k", F.lit(most)).drop("request")
    mark = lambda *names: F.to_json(F.struct(*names))
    wanted = settled(wanted.withColumns({"query_id": mark("profile", "example_id"), "shape_id": mark("example_id", *SHAPE)}))
    asked = wanted.groupBy(F.col("shape_id").alias("query_id"), "query", "conversation_id", *SHAPE).agg(F.max("hybrid").alias("hybrid"))
    pool = gather(settled(asked), graph, Retrieval(top_k=most), vocabulary, index, embedder, entity_vectors)

    def own(df: DataFrame) -> DataFrame:
        """Rows of a shape for each row of profile and example that uses it."""
        return df.withColumnRenamed("query_id", "shape_id").join(wanted.select("shape_id", "query_id", "hybrid"), "shape_id")

    # Without full text only what the graph has found counts, by the entities that were reached.
    candidates = own(pool.candidates).where("hybrid or by_graph")
    lexical_raw = F.when(F.col("hybrid"), F.col("lexical_raw"))
    candidates = candidates.select("query_id", "turn_uid", lexical_raw.alias("lexical_raw"))
    matched = own(pool.matched).where("hybrid or from_graph").select("query_id", "turn_uid", "entity_id")
    reached = Reached(own(pool.reached.entities).drop("shape_id", "hybrid"), pool.reached.pruned)
    queries = wanted.select("query_id", "query", "conversation_id", *KINDS)
    settings = settings_of(queries, Retrieval())
    whole = Pool(reached, pool.seeds, settled(candidates), settled(matched), own(pool.vectors).drop("shape_id", "hybrid"), settings)
    ranked = settings.onto(rank_pool(whole, queries, graph, None, now, scorer).select("query_id", "rank", "turn_uid"), *KINDS)
    named = ranked.join(wanted.select("query_id", "profile", F.col("example_id").cast(kind)), "query_id")
    return settled(named.select("profile", "example_id", "rank", "turn_uid", applied().alias("applied")))


def with_profiles(examples: DataFrame, profiles: dict[str, Retrieval]) -> DataFrame:
    """Each example once for each profile."""
    return examples.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))


def evaluate_profiles(
    examples: DataFrame, graph: Graph, profiles: dict[str, Retrieval], ks: list[int], now: Column, baseline: str, vocabulary: Vocabulary = Vocabulary(), scorer: Callable | None = None,
    common: dict | None = None, example_last: bool = True, index: DataFrame | TextIndex | None = None, embedder: Embedder = Embedder(), entity_vectors: bool = False,
) -> DataFrame:
    """Metrics of each profile over ``examples(example_id, query, conversation_id, relevant_turn_uids)``, compared with the
    baseline. Parameters of all examples, and of an example, override a profile's (with ``example_last``)."""
    if baseline not in profiles:
        raise ValueError(f"no such profile: {baseline}")
    ranked = run_profiles(examples, graph, profiles, ks, now, vocabulary, scorer, common, example_last, index, embedder, entity_vectors)
    judged = evaluate.judge(ranked, with_profiles(examples, profiles), evaluate.cutoffs(ks))
    return evaluate.compare(settled(evaluate.metrics(judged)), baseline)


def write_report(measured: DataFrame, path: str) -> None:
    measured.write.mode("overwrite").json(path)
