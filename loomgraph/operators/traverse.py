"""Seeds and beam search over the entity graph, for all queries of a batch at once.

Every table is keyed by query_id. A hop is one join with the adjacency and two windows of a query's own rows; the results of a
hop are settled before the next, so that plans stay short and a lost executor costs nothing that is done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import cosine
from loomgraph.operators.extraction import with_entities
from loomgraph.operators.graph import match_names
from loomgraph.operators.name_index import NameIndex, match
from loomgraph.operators.settings import Settings, as_settings, first_of_each
from loomgraph.session import settled
from loomgraph.vocabulary import Retrieval, Vocabulary

STEPS = "array<struct<from_entity_id:string,to_entity_id:string,relation_type:string,forward:boolean>>"
NAME_LIMIT = 20


def query_names(queries: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(query_id, name): the entities of each query's text, or without any the whole query as one name."""
    found = with_entities(queries.select("query_id", "query"), vocabulary, text="query")
    names = F.transform("entities", lambda e: e.canonical_name)
    whole = F.array(X.canonicalize(F.col("query"), vocabulary))
    return found.select("query_id", F.explode_outer(F.when(F.size("entities") > 0, names).otherwise(whole)).alias("name")).distinct()


def likeness(a: str, b: str) -> Column:
    """The part of 1 that two vectors are alike, at 9 places, so that equal sums in another order are ties."""
    return F.greatest(F.lit(0.0), F.round(cosine(F.col(a), F.col(b)), 9))


def seeds(names: DataFrame, entities: DataFrame, limit: int | DataFrame, vectors: DataFrame | None = None, index: NameIndex | None = None) -> DataFrame:
    """(query_id, entity_id, canonical_name, score) of the ``limit`` best matches of each query's names; a query may have a limit
    of its own, in (query_id, most). With ``vectors`` (query_id, vector) the likeness to the entity's embedding has a part in the
    score. With a stored ``index`` of the entities' names these are looked up there."""
    hits = names.join(match_names(names, entities, NAME_LIMIT) if index is None else match(index, names, NAME_LIMIT), "name")
    base = F.lit(0.85) * F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(0.8))
    if vectors is not None:
        hits = hits.join(vectors, "query_id").join(entities.select("entity_id", "embedding"), "entity_id")
        base = base + F.lit(0.15) * likeness("vector", "embedding")
    best = hits.groupBy("query_id", "entity_id", "canonical_name").agg(F.max(base).alias("score"))
    return first_of_each(best, [F.desc("score"), "entity_id"], limit)


@dataclass
class Reached:
    entities: DataFrame  # query_id, entity_id, score, steps
    pruned: DataFrame  # query_id, pruned


def traverse(start: DataFrame, adjacent: DataFrame, params: Retrieval | Settings = Retrieval(), vectors: DataFrame | None = None, embeddings: DataFrame | None = None) -> Reached:
    """Follow edges from each query's seeds. A hop keeps, of the paths over the threshold, the best one to each entity, if it
    beats the best so far, and of these the ``beam_width`` best: they alone count as reached, and go on. An edge may raise a
    score, so an entity can be reached anew, and better, by a longer path. Width, threshold and hops may be each query's own: they
    go with its rows, and a query that has made its hops has no frontier any more. With ``vectors`` (query_id, vector) and
    ``embeddings`` (entity_id, embedding) the likeness of the target has a part in the score."""
    settings = as_settings(params)
    own = ["_beam_width", "_prune_threshold", "_max_hops"]
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    reached = settled(start.select("query_id", "entity_id", F.greatest(F.lit(0.01), F.col("score")).alias("score"), F.array().cast(STEPS).alias("steps")))
    frontier = settings.onto(reached, "beam_width", "prune_threshold", "max_hops").withColumn("n", F.row_number().over(by_score)).where("n <= _beam_width").drop("n")
    edges = adjacent.select(F.col("source_entity_id").alias("entity_id"), "target_entity_id", "relation_type", "forward", "edge_score", F.col("place").alias("edge_place"))
    dropped: list[DataFrame] = []
    for hop in range(settings.highest("max_hops")):
        paths = frontier.where(F.col("_max_hops") > hop).join(edges, "entity_id").where("edge_place <= greatest(40, 2 * _beam_width)")
        alike = F.lit(0.85)
        if vectors is not None and embeddings is not None:
            target = embeddings.select(F.col("entity_id").alias("target_entity_id"), "embedding")
            paths = paths.join(vectors, "query_id").join(target, "target_entity_id", "left")
            alike = F.lit(0.85) + F.lit(0.15) * likeness("vector", "embedding")
        step = F.struct(F.col("entity_id").alias("from_entity_id"), F.col("target_entity_id").alias("to_entity_id"), "relation_type", "forward")
        paths = paths.select("query_id", "target_entity_id", (F.col("score") * F.col("edge_score") * alike).alias("score"), "steps", step.alias("step"), *own)
        kept = F.col("score") >= F.col("_prune_threshold")
        dropped.append(paths.where(~kept).groupBy("query_id").agg(F.count("*").alias("pruned")))
        one = W.partitionBy("query_id", "target_entity_id").orderBy(F.desc("score"), "step.from_entity_id", "step.relation_type", F.desc("step.forward"))
        best = paths.where(kept).withColumn("n", F.row_number().over(one)).where("n = 1")
        best = best.select("query_id", F.col("target_entity_id").alias("entity_id"), "score", F.concat("steps", F.array("step")).alias("steps"), *own)
        before = reached.select("query_id", "entity_id", F.col("score").alias("before"))
        better = best.join(before, ["query_id", "entity_id"], "left").where("before is null or score > before").drop("before")
        frontier = settled(better.withColumn("n", F.row_number().over(by_score)).where("n <= _beam_width").drop("n"))
        if not frontier.limit(1).count():
            break
        reached = settled(reached.join(frontier.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti").unionByName(frontier.drop(*own)))
    pruned = dropped[0]
    for more in dropped[1:]:
        pruned = pruned.unionByName(more)
    return Reached(reached, pruned.groupBy("query_id").agg(F.sum("pruned").alias("pruned")))
