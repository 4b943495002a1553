"""Ranking: candidates from the graph and from full text, fused scores, a trace of how they came about, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import recency
from loomgraph.functions.vectors import cosine
from loomgraph.operators.graph import EDGE
from loomgraph.operators.settings import Settings, as_settings, first_of_each, weights
from loomgraph.session import settled
from loomgraph.vocabulary import Retrieval

KEYS = ["query_id", "turn_uid"]
TINY = 1e-9


def min_max(value: Column, window: W) -> Column:
    """From 0 to 1 within the window; without a range 1 for values over 0, else 0."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high - low <= TINY, F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))))


def in_conversation(rows: DataFrame, queries: DataFrame, turns: DataFrame) -> DataFrame:
    """Only turns of the conversation that a query is confined to, if it is. Without such a query the turns are not read."""
    if not queries.where("conversation_id is not null").limit(1).count():
        return rows
    asked = queries.select("query_id", F.col("conversation_id").alias("_only"))
    return rows.join(asked, "query_id").join(turns.select("turn_uid", "conversation_id"), "turn_uid").where("_only is null or _only = conversation_id").drop("_only", "conversation_id")


#: Queries that are answered together, mentions of a bucket about, and copies of the reached entities that mentions are joined by.
GROUP, BUCKET, SALTS = 1024, 1 << 20, 16


def best_turns(lists: dict[str, np.ndarray], scores: list[tuple[str, int]], turns: int, allowed: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(turns, sums in 10**-9, how many turns were built) of the ``limit`` turns with the highest sums among ``turns``, numbered in
    the order of their uids. ``lists``: the turns of each entity; ``scores``: entities with their scores in 10**-12.

    Entities are taken from the highest score down. Once the ``limit``-th best sum cannot be reached by all scores that are left, a
    turn that no entity has named so far is out, and is not built: the lists left only add to turns that are there."""
    own = sorted(((score, e) for e, score in scores if e in lists), key=lambda x: (-x[0], x[1]))
    left = np.cumsum([s for s, _ in own][::-1])[::-1] if own else []
    sums, there, closed = np.zeros(turns, np.int64), np.zeros(turns, bool), False
    for i, (score, e) in enumerate(own):
        at = lists[e]
        if not closed and limit and np.count_nonzero(there) >= limit:
            found = sums[there]
            closed = np.partition(found, len(found) - limit)[len(found) - limit] // 1000 > (left[i] + 500) // 1000
        if closed:
            sums[at[there[at]]] += score
        else:
            at = at if allowed is None else at[allowed[at]]
            there[at] = True
            sums[at] += score
    at = np.flatnonzero(there)
    value = (sums[at] + 500) // 1000
    first = np.argsort(-value, kind="stable")[:limit]
    return at[first], value[first], len(at)


def graph_candidates(reached: DataFrame, mentions: DataFrame, queries: DataFrame, turns: DataFrame, limit: int | DataFrame) -> DataFrame:
    """(query_id, turn_uid, entity_id) of the turns that mention reached entities: of each query the ``limit`` turns with the
    greatest sum of path scores (at 9 places; ties by uid).

    Mentions are dealt into buckets by turn, so that an entity of most turns is spread over all of them, and every turn's sum is
    complete in one. A bucket gives each query's best turns; pairs of query and turn never become rows otherwise."""
    spark = reached.sparkSession
    # Whole numbers of 10**-12 add up to the same in any order.
    scored = settled(reached.select("query_id", "entity_id", F.round(F.col("score") * 1e12).cast("long").alias("units")))
    confined = bool(queries.where("conversation_id is not null").limit(1).count())
    kind = dict(reached.dtypes)["query_id"]
    spread = scored.select("entity_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = mentions.withColumn("salt", F.pmod(F.xxhash64("turn_uid"), F.lit(SALTS)).cast("int")).join(spread, ["entity_id", "salt"], "left_semi")
    if confined:
        named = named.join(turns.select("turn_uid", "conversation_id"), "turn_uid")
    named = settled(named.select("turn_uid", "entity_id", (F.col("conversation_id") if confined else F.lit(None).cast("string")).alias("conversation_id")))
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-named.count() // BUCKET))
    groups = max(1, -(-queries.count() // GROUP))
    limits = queries.select("query_id", "conversation_id", F.lit(limit).alias("most")) if isinstance(limit, int) else queries.select("query_id", "conversation_id").join(limit, "query_id")
    asked = scored.groupBy("query_id").agg(F.collect_list(F.struct("entity_id", "units")).alias("reached")).join(limits, "query_id")  # a query reaches some ten entities a hop
    packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")).agg(F.collect_list(F.struct(F.to_json(F.struct("query_id")).alias("key"), "reached", "conversation_id", "most")).alias("asked"))
    sent = packed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "turn_uid"), F.lit(buckets)).cast("int")).withColumn("group", each)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            uids = left.column("turn_uid").to_numpy()
            order, number = np.unique(uids.astype(object), return_inverse=True)
            by_entity = left.column("entity_id").combine_chunks().dictionary_encode()
            codes = by_entity.indices.to_numpy()
            at = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[at], np.arange(len(by_entity.dictionary) + 1))
            lists = {e: np.unique(number[at[cuts[i] : cuts[i + 1]]]) for i, e in enumerate(by_entity.dictionary.to_pylist())}
            conversation = np.empty(len(order), object)
            conversation[number] = left.column("conversation_id").to_numpy()
            for q in right.column("asked")[0].as_py():
                allowed = conversation == q["conversation_id"] if q["conversation_id"] is not None else None
                found, sums, _ = best_turns(lists, [(x["entity_id"], x["units"]) for x in q["reached"]], len(order), allowed, q["most"])
                rows += [(q["key"], order[t], int(s)) for t, s in zip(found, sums, strict=True)]
        kinds = [("key", pa.string()), ("turn_uid", pa.string()), ("sum", pa.int64())]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    near = dealt.groupBy("bucket", "group").cogroup(sent.groupBy("bucket", "group")).applyInArrow(answer, "key string, turn_uid string, sum long")
    near = near.withColumn("query_id", F.from_json("key", f"query_id {kind}")["query_id"])
    best = settled(first_of_each(near, [F.desc("sum"), "turn_uid"], limit).select(*KEYS))
    # What is matched is looked up for the turns that are left.
    return best.join(named.select("turn_uid", "entity_id"), "turn_uid").join(scored.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_semi").select(*KEYS, "entity_id")


def merge_candidates(graph: DataFrame, lexical: DataFrame | None, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All candidates (query_id, turn_uid, lexical_raw, by_graph), and the entities matched in each: those reached for one from the
    graph (from_graph), all that it mentions for one from full text, both for one that is both."""
    turns = graph.select(*KEYS).distinct().withColumn("by_graph", F.lit(True))
    reached = graph.select(*KEYS, "entity_id", F.lit(True).alias("from_graph"))
    if lexical is None:
        return turns.withColumn("lexical_raw", F.lit(None).cast("double")), reached
    said = lexical.select(*KEYS).join(mentions, "turn_uid").select(*KEYS, "entity_id", F.lit(False).alias("from_graph"))
    matched = reached.unionByName(said).groupBy(*KEYS, "entity_id").agg(F.max("from_graph").alias("from_graph"))
    return turns.join(lexical, KEYS, "full").withColumn("by_graph", F.coalesce("by_graph", F.lit(False))), matched


def _edge(step: str) -> list[Column]:
    s = lambda f: F.col(f"{step}.{f}")
    return [F.when(s("forward"), s("from_entity_id")).otherwise(s("to_entity_id")).alias("source_entity_id"), F.when(s("forward"), s("to_entity_id")).otherwise(s("from_entity_id")).alias("target_entity_id"), s("relation_type").alias("relation_type")]


def fuse(candidates: DataFrame, matched: DataFrame, reached: DataFrame, evidence: DataFrame, turns: DataFrame, vectors: DataFrame, params: Retrieval | Settings, now: Column) -> DataFrame:
    """Scores of all candidates, each with its parts. ``turns``: turn_uid, timestamp, embedding, importance_score and
    last_recalled_at; ``vectors``: query_id, vector."""
    paths = matched.select(*KEYS, "entity_id").join(reached, ["query_id", "entity_id"], "left")
    signal = paths.groupBy(*KEYS).agg(F.count("*").alias("n_ids"), F.sort_array(F.collect_list(F.struct("entity_id", F.coalesce("score", F.lit(0.0)).alias("score")))).alias("found"))
    signal = signal.withColumn("entity_score", F.least(F.lit(1.0), F.aggregate("found", F.lit(0.0), lambda a, x: a + x.score) / F.col("n_ids")))
    edges = paths.select(*KEYS, F.explode("steps").alias("step")).select(*KEYS, *_edge("step")).distinct()
    proven = edges.join(evidence, [*EDGE, "turn_uid"], "left_semi").select(*KEYS).distinct().withColumn("bonus", F.lit(0.1))
    narrow = turns.select("turn_uid", "timestamp", "embedding", "importance_score", "last_recalled_at")
    rows = candidates.select(*KEYS, "lexical_raw").join(signal.drop("found", "n_ids"), KEYS, "left").join(proven, KEYS, "left").join(narrow, "turn_uid").join(vectors, "query_id")
    # Full-text scores are set in relation to each other among full-text candidates only.
    lexical = F.when(F.col("lexical_raw").isNotNull(), min_max(F.col("lexical_raw"), W.partitionBy("query_id"))).otherwise(F.lit(0.0))
    g, e, x = weights()
    rows = as_settings(params).onto(rows, "graph_weight", "embedding_weight", "lexical_weight", "importance_weight", "recency_weight", "half_life_hours")
    own = ["g", "e", "x"]
    rows = rows.select(
        *KEYS, F.coalesce("entity_score", F.lit(0.0)).alias("entity_score"), F.coalesce("bonus", F.lit(0.0)).alias("evidence_bonus"), lexical.alias("lexical_signal"),
        F.coalesce("lexical_raw", F.lit(0.0)).alias("lexical_raw_score"), F.greatest(F.lit(0.0), cosine(F.col("vector"), F.col("embedding"))).alias("embedding_signal"),
        (F.col("_importance_weight") * F.coalesce("importance_score", F.lit(0.0))).alias("importance_component"),
        (F.col("_recency_weight") * recency(F.coalesce("last_recalled_at", "timestamp"), now, F.col("_half_life_hours"))).alias("recency_component"), g.alias("g"), e.alias("e"), x.alias("x"),
    )
    rows = rows.withColumn("graph_signal", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("entity_score") + F.col("evidence_bonus"))))
    rows = rows.withColumn("fusion_score", F.col("g") * F.col("graph_signal") + F.col("e") * F.col("embedding_signal") + F.col("x") * F.col("lexical_signal"))
    final = F.col("fusion_score") + F.col("importance_component") + F.col("recency_component")
    rounded = [F.round(c, 6).alias(c) for c in rows.columns if c not in KEYS + own]
    return rows.withColumn("score", F.round(final, 6)).select(*KEYS, *rounded, "score", F.lit(0.0).alias("rerank_component"))


def top(scored: DataFrame, k: int | DataFrame, head: Column | None = None) -> DataFrame:
    """The ``k`` best of each query (a number of its own in (query_id, most)) as ``rank`` 1 and on; turn_uid breaks ties. Rows of
    ``head`` come before others."""
    return first_of_each(scored, [*([head.desc()] if head is not None else []), F.desc("score"), F.col("turn_uid")], k, "rank")


def rerank(scored: DataFrame, queries: DataFrame, turns: DataFrame, params: Retrieval | Settings, score: Callable[[list[str], list[str]], list[float]] | None) -> DataFrame:
    """Add to the ``rerank_top_n`` best of each query what ``score(queries, texts)`` thinks of them, and order them anew; the
    others stay behind. Without a function nothing changes but the column ``head``."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "turn_uid"))
    settings = as_settings(params)
    wanted = F.col("_rerank") | F.lit(settings.rows is None)  # who is asked to rerank with one set for all does
    placed = settings.onto(scored, "rerank", "rerank_top_n", "rerank_weight").withColumn("head", wanted & (place <= F.col("_rerank_top_n"))).drop("_rerank", "_rerank_top_n")
    if score is None:
        return placed.drop("_rerank_weight")
    texts = placed.where("head").select(*KEYS).join(queries.select("query_id", "query"), "query_id").join(turns.select("turn_uid", "text"), "turn_uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[KEYS].assign(raw=pd.Series(score(pdf["query"].tolist(), pdf["text"].tolist()), index=pdf.index, dtype=float))

    kinds = dict(scored.dtypes)
    raw = texts.mapInPandas(run, f"query_id {kinds['query_id']}, turn_uid string, raw double")
    judged = raw.withColumn("share", min_max(F.col("raw"), W.partitionBy("query_id"))).drop("raw")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_rerank_weight")))
    joined = placed.drop("rerank_component").join(judged, KEYS, "left").withColumn("rerank_component", F.coalesce(F.round(weight * F.col("share"), 6), F.lit(0.0))).drop("_rerank_weight", "share")
    return joined.withColumn("score", F.round(F.col("score") + F.col("rerank_component"), 6))


def trace(ranked: DataFrame, matched: DataFrame, reached: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """For each ranked row: matched_entities, path_summary (the first four steps of each path, each edge once, eight at most)
    and evidence_turn_ids (of all steps). Names and evidence are looked up for ranked rows only."""
    here = ranked.select(*KEYS).join(matched.select(*KEYS, "entity_id"), KEYS).join(entities.select("entity_id", "canonical_name"), "entity_id")
    names = here.groupBy(*KEYS).agg(F.sort_array(F.collect_set("canonical_name")).alias("matched_entities"))
    steps = here.join(reached.select("query_id", "entity_id", "steps"), ["query_id", "entity_id"]).select(*KEYS, "entity_id", F.posexplode("steps").alias("place", "step"))
    edges = steps.select(*KEYS, *_edge("step")).distinct().join(evidence.withColumnRenamed("turn_uid", "evidence"), list(EDGE))
    rests = edges.groupBy(*KEYS).agg(F.sort_array(F.collect_set("evidence")).alias("evidence_turn_ids"))
    first = steps.where("place < 4").groupBy(*KEYS, F.col("step.from_entity_id").alias("from_entity_id"), F.col("step.to_entity_id").alias("to_entity_id"), F.col("step.relation_type").alias("relation_type")).agg(F.min(F.struct("entity_id", "place")).alias("at"))
    nth = F.row_number().over(W.partitionBy(*KEYS).orderBy("at", "from_entity_id", "to_entity_id", "relation_type"))
    few = first.withColumn("n", nth).where("n <= 8")
    named = few.join(entities.select(F.col("entity_id").alias("from_entity_id"), F.col("canonical_name").alias("from_entity_name")), "from_entity_id").join(entities.select(F.col("entity_id").alias("to_entity_id"), F.col("canonical_name").alias("to_entity_name")), "to_entity_id")
    step = F.struct("n", "from_entity_id", "from_entity_name", "to_entity_id", "to_entity_name", "relation_type")
    summary = named.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: s.dropFields("n")).alias("path_summary"))
    return ranked.join(names, KEYS, "left").join(summary, KEYS, "left").join(rests, KEYS, "left")
