"""The entity graph: building it from turns with entities and relations, merging it with a stored one, and looking at it.

Tables: ``entities(entity_id, canonical_name, entity_type, description, aliases, embedding)``, ``mentions(turn_uid,
entity_id)``, ``relations(source_entity_id, target_entity_id, relation_type, weight)``, ``evidence(source_entity_id,
target_entity_id, relation_type, turn_uid)`` with a row for each turn that an edge rests on, and the turns. An edge that most
turns name is thus many small rows, never one large one; ``with_evidence`` gathers them for output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import unit
from loomgraph.session import settled
from loomgraph.vocabulary import OTHER_PRIOR, PRIORS, Vocabulary


@dataclass
class Graph:
    turns: DataFrame
    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame
    evidence: DataFrame


def turn_uid() -> Column:
    return F.concat_ws(":", "conversation_id", "turn_id")


def mention_rows(extracted: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """A row for each entity of each turn, with the ordinal that tells which was first: time, turn, place in the turn."""
    # Outer, so that no condition on the array, and with it all of extraction, is evaluated a second time.
    rows = extracted.select("turn_uid", "timestamp", F.posexplode_outer("entities").alias("place", "e")).where("place is not null")
    name = X.canonicalize(F.col("e.canonical_name"), vocabulary)
    named = rows.withColumn("canonical_name", name)
    return named.select(
        "turn_uid", X.entity_id(F.col("canonical_name")).alias("entity_id"), "canonical_name", F.col("e.surface").alias("surface"), F.col("e.entity_type").alias("entity_type"),
        F.struct("timestamp", "turn_uid", "place").alias("ordinal"),
    )


def build_mentions(rows: DataFrame) -> DataFrame:
    return rows.select("turn_uid", "entity_id").distinct()


def build_entities(rows: DataFrame) -> DataFrame:
    """One row for each entity: the type it had first, and its surfaces in the order in which they were first seen. Rows are
    counted down to (entity, surface) first, so that an entity of most turns is small before it is gathered."""
    surfaces = rows.groupBy("entity_id", "surface").agg(F.min(F.struct("ordinal", "canonical_name", "entity_type")).alias("first"))
    gathered = surfaces.groupBy("entity_id").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("first.ordinal").alias("ordinal"), "surface"))).alias("seen"))
    return gathered.select(
        "entity_id", F.col("first.canonical_name").alias("canonical_name"), F.col("first.entity_type").alias("entity_type"), F.lit("").alias("description"),
        F.transform("seen", lambda s: s.surface).alias("aliases"), F.array().cast("array<double>").alias("embedding"),
    )


def relation_rows(extracted: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(turn_uid, source_entity_id, target_entity_id, relation_type), each once for a turn, none from an entity to itself."""
    if vocabulary.large:
        ends = [X.canonical_all(F.transform("relations", lambda r: X.normalize_surface(r[end])), vocabulary) for end in ("source", "target")]  # noqa: B023
        extracted = extracted.select("turn_uid", "relations", ends[0].alias("_s"), ends[1].alias("_t"))
        ids = F.transform("relations", lambda r, i: F.struct(X.entity_id(F.get("_s", i)).alias("s"), X.entity_id(F.get("_t", i)).alias("t"), r.relation_type.alias("relation_type")))
    else:
        ids = F.transform("relations", lambda r: F.struct(X.entity_id(X.canonicalize(r.source, vocabulary)).alias("s"), X.entity_id(X.canonicalize(r.target, vocabulary)).alias("t"), r.relation_type.alias("relation_type")))
    rows = extracted.select("turn_uid", F.explode_outer(F.array_distinct(ids)).alias("r")).where("r.s != r.t")
    return rows.select("turn_uid", F.col("r.s").alias("source_entity_id"), F.col("r.t").alias("target_entity_id"), F.col("r.relation_type").alias("relation_type"))


EDGE = ("source_entity_id", "target_entity_id", "relation_type")


def build_relations(rows: DataFrame) -> DataFrame:
    """Edges: weight is the number of times that turns named them. Counted in part before the shuffle."""
    return rows.groupBy(*EDGE).agg(F.count("*").cast("double").alias("weight"))


def build_evidence(rows: DataFrame) -> DataFrame:
    """The distinct turns that each edge rests on, as rows."""
    return rows.select(*EDGE, "turn_uid").distinct()


def with_evidence(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with their turns as the array ``evidence_turn_ids``, sorted. For output of chosen edges: an array is one row."""
    gathered = evidence.groupBy(*EDGE).agg(F.array_sort(F.collect_list("turn_uid")).alias("evidence_turn_ids"))
    return relations.join(gathered, list(EDGE), "left").withColumn("evidence_turn_ids", F.coalesce("evidence_turn_ids", F.array().cast("array<string>")))


def build(extracted: DataFrame, vocabulary: Vocabulary = Vocabulary(), entity_vectors: bool = False) -> Graph:
    """The graph of turns with entities and relations; with ``entity_vectors`` the entities have vectors."""
    rows, links = mention_rows(extracted, vocabulary), relation_rows(extracted, vocabulary)
    entities, mentions = build_entities(rows), build_mentions(rows)
    if entity_vectors:
        entities = with_entity_vectors(entities, entity_sums(mentions, extracted))
    return Graph(extracted.drop("entities", "relations"), entities, mentions, build_relations(links), build_evidence(links))


#: Entries of vectors are added up as whole numbers of this part of 1, so that sums are the same in any order of turns and loads.
UNITS = 1 << 32


def entity_sums(mentions: DataFrame, turns: DataFrame) -> DataFrame:
    """(entity_id, embedding_sum, embedding_count): the sum of the vectors of the turns that mention an entity. Sums are made in
    part before the shuffle, so that an entity of most turns is no hot row. Where vectors have different lengths, those of the
    commonest count (of two, the longer)."""
    rows = mentions.join(turns.select("turn_uid", "embedding").where(F.size("embedding") > 0), "turn_uid")
    parts = rows.select("entity_id", F.size("embedding").alias("d"), F.posexplode("embedding").alias("dim", "x"))
    sums = parts.groupBy("entity_id", "d", "dim").agg(F.sum(F.round(F.col("x") * UNITS).cast("long")).alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("entity_id", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda p: p.s).alias("embedding_sum"), F.max("n").alias("embedding_count"))
    return whole.groupBy("entity_id").agg(F.max_by(F.struct("embedding_sum", "embedding_count"), F.struct("embedding_count", "d")).alias("v")).select("entity_id", "v.*")


def with_entity_vectors(entities: DataFrame, sums: DataFrame) -> DataFrame:
    """Entities with their sums, and the mean at unit length as ``embedding``."""
    return _vectors_of(entities.drop("embedding").join(sums, "entity_id", "left"))


def _vectors_of(entities: DataFrame) -> DataFrame:
    whole = F.coalesce("embedding_sum", F.array().cast("array<long>"))
    return entities.withColumns({"embedding_sum": whole, "embedding_count": F.coalesce("embedding_count", F.lit(0).cast("long"))}).withColumn("embedding", unit(F.transform("embedding_sum", lambda x: x.cast("double"))))


def skip_stored(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """The turns that are not stored yet. Two of the same uid in one load both stay."""
    return turns.join(stored.select("turn_uid"), "turn_uid", "left_anti")


def stored_uids(uids: DataFrame, stored: DataFrame) -> DataFrame:
    return uids.select("turn_uid").distinct().join(stored.select("turn_uid"), "turn_uid", "left_semi")


def merge_turns(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last writing of a turn counts; how often it was recalled is kept."""
    last = new.withColumn("_n", F.row_number().over(W.partitionBy("turn_uid").orderBy(F.desc("timestamp"), F.desc(F.hash("text"))))).where("_n = 1").drop("_n")
    keep = old.select("turn_uid", F.col("recall_count").alias("_count"), F.col("last_recalled_at").alias("_at"))
    joined = last.drop("recall_count", "last_recalled_at").join(keep, "turn_uid", "left")
    fresh = joined.withColumns({"recall_count": F.coalesce("_count", F.lit(0).cast("bigint")), "last_recalled_at": F.col("_at")}).drop("_count", "_at")
    return old.join(last.select("turn_uid"), "turn_uid", "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases of both, the old ones first; type and name of the old; a description where there was none."""
    n = new.select("entity_id", *[F.col(c).alias(f"n_{c}") for c in new.columns if c != "entity_id"])
    none = F.array().cast("array<string>")
    merged = [
        "entity_id", F.coalesce("canonical_name", "n_canonical_name").alias("canonical_name"), F.coalesce("entity_type", "n_entity_type").alias("entity_type"),
        F.coalesce(F.when(F.col("description") != "", F.col("description")), "n_description", F.lit("")).alias("description"),
        F.array_union(F.coalesce("aliases", none), F.coalesce("n_aliases", none)).alias("aliases"),
    ]
    if "embedding_sum" not in old.columns or "embedding_sum" not in new.columns:
        return old.join(n, "entity_id", "full").select(*merged, F.coalesce("embedding", "n_embedding").alias("embedding"))
    # Sums of one length add up; of two lengths the one of more turns stays.
    a, b, m, k = F.coalesce("embedding_sum", F.array().cast("array<long>")), F.coalesce("n_embedding_sum", F.array().cast("array<long>")), F.coalesce("embedding_count", F.lit(0)), F.coalesce("n_embedding_count", F.lit(0))
    alike = F.size(a) == F.size(b)
    added = F.when(alike, F.zip_with(a, b, lambda x, y: x + y)).when(m >= k, a).otherwise(b)
    counted = F.when(alike, m + k).otherwise(F.greatest(m, k)).cast("long")
    return _vectors_of(old.join(n, "entity_id", "full").select(*merged, added.alias("embedding_sum"), counted.alias("embedding_count")))


def merge_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weights add up: turns that are loaded twice weigh twice."""
    return old.select(*EDGE, "weight").unionByName(new.select(*EDGE, "weight")).groupBy(*EDGE).agg(F.sum("weight").alias("weight"))


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def merge(old: Graph, new: Graph, idempotent: bool = False) -> Graph:
    """Both graphs as one. With ``idempotent`` an edge weighs as many as its distinct turns, however often they were loaded."""
    evidence = merge_evidence(old.evidence, new.evidence)
    relations = build_relations(evidence) if idempotent else merge_relations(old.relations, new.relations)
    return Graph(merge_turns(old.turns, new.turns), merge_entities(old.entities, new.entities), merge_mentions(old.mentions, new.mentions), relations, evidence)


def merge_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def adjacency(relations: DataFrame, cap: int) -> DataFrame:
    """Edges seen from either end, at most ``cap`` of each entity (the heaviest), with the static part of an edge's score."""
    there = relations.select("source_entity_id", "target_entity_id", "relation_type", "weight", F.lit(True).alias("forward"))
    back = relations.select(F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"), "relation_type", "weight", F.lit(False).alias("forward"))
    rank = F.row_number().over(W.partitionBy("source_entity_id").orderBy(F.desc("weight"), "target_entity_id", "relation_type", F.desc("forward")))
    capped = there.unionByName(back).withColumn("place", rank).where(F.col("place") <= cap)
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PRIORS.items() for x in p]), F.col("relation_type")), F.lit(OTHER_PRIOR))
    return capped.withColumn("edge_score", F.least(F.lit(1.2), prior * (F.lit(1.0) + F.lit(0.08) * (F.col("weight") - 1.0))))


def ingest_statistics(extracted: DataFrame, chunked: DataFrame, total: int | None = None) -> DataFrame:
    """One row about a load: turns, mentions, relations (all, and by kind), chunks by profile, average and most chunks."""
    counts = extracted.agg(F.count("*").alias("turns"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("mentions"))
    kinds = relation_rows(extracted).groupBy("relation_type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation_type", "n")))).alias("by_relation"))
    profiles = chunked.groupBy("chunk_profile").agg(F.count("*").alias("n"), F.sum(F.size("chunks")).alias("c"), F.max(F.size("chunks")).alias("m")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_profile", "n")))).alias("by_profile"), F.round(F.sum("c") / F.sum("n"), 3).alias("avg_chunks"), F.max("m").alias("max_chunks")
    )
    out = counts.join(kinds).join(profiles)  # three tables of one row
    return out if total is None else out.withColumn("skipped", F.lit(total) - F.col("turns"))


def entities_by_id(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def turns_by_uid(turns: DataFrame, uids: DataFrame) -> DataFrame:
    return turns.join(uids.select("turn_uid").distinct(), "turn_uid", "left_semi")


def turns_of_conversations(turns: DataFrame, conversations: DataFrame, limit: int = 10_000) -> DataFrame:
    """The first turns of each conversation asked for, in time; turn_id breaks ties."""
    rank = F.row_number().over(W.partitionBy("conversation_id").orderBy("timestamp", "turn_id"))
    return turns.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi").withColumn("place", rank).where(F.col("place") <= limit)


def grams(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def forms_of(entities: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, form): each entity's name and aliases in lower case, each once."""
    return entities.select("entity_id", "canonical_name", F.explode(F.array_union(F.array("canonical_name"), "aliases")).alias("form")).withColumn("form", F.lower("form")).distinct()


def first_matches(hits: DataFrame, limit: int) -> DataFrame:
    """Of ``hits(name, entity_id, canonical_name)`` each name's first ``limit``: exact ones, then the shortest, then by id."""
    exact = hits.withColumn("exact", F.col("name") == F.col("canonical_name"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("exact"), F.char_length("canonical_name"), "entity_id"))
    return exact.withColumn("place", rank).where(F.col("place") <= limit)


def match_names(names: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """(name, entity_id, canonical_name, exact) of the entities of which the name or an alias contains ``name``, in any case;
    for each name the first ``limit``: exact ones, then the shortest, then by id.

    A name is looked up by the rarest three letters in a row that it has (or all of it, if shorter) among those of all aliases,
    and compared in full then; so this is an equi-join, which needs neither side to be small."""
    low = F.lower(F.col("name"))
    own = names.select("name").distinct().withColumn("key", F.explode(F.when(F.char_length(low) > 3, F.array_distinct(grams(low, 3))).otherwise(F.array(low))))
    forms = forms_of(entities)
    keys = F.array_distinct(F.concat(F.array(F.lit("")), grams(F.col("form"), 1), grams(F.col("form"), 2), grams(F.col("form"), 3)))
    found = settled(forms.withColumn("key", F.explode(keys)).join(own.select("key").distinct(), "key", "left_semi"))
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    keyed = own.join(counts, "key", "left").groupBy("name").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return first_matches(found.join(keyed, "key").where(F.contains(F.col("form"), low)).select("name", "entity_id", "canonical_name").distinct(), limit)


def subgraph(names: DataFrame, entities: DataFrame, relations: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """For each name: the entities that match it and their neighbours, as (nodes, edges), ``limit`` edges of a name at most."""
    seeds = match_names(names, entities, 8)
    per_seed = F.greatest(F.lit(12), F.floor(F.lit(limit) / F.count("*").over(W.partitionBy("name"))).cast("int"))
    wanted = seeds.select("name", F.col("place").alias("seed_place"), F.col("entity_id").alias("source"), per_seed.alias("most"))
    near = wanted.join(adjacency(relations, max(12, limit)).withColumnRenamed("source_entity_id", "source"), "source").where("place <= most")
    once = near.groupBy("name", "source", F.col("target_entity_id").alias("target"), F.col("relation_type").alias("label")).agg(F.min(F.struct("seed_place", "place")).alias("place"))
    edges = once.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("place", "target", "label"))).where(F.col("n") <= limit).select("name", "source", "target", "label", "n")
    nodes = seeds.select("name", F.col("entity_id").alias("id"), F.lit(1.0).alias("score")).unionByName(edges.select("name", F.col("target").alias("id"), F.lit(0.6).alias("score")))
    nodes = nodes.groupBy("name", "id").agg(F.max("score").alias("score")).join(entities.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("label"), F.col("entity_type").alias("kind")), "id")
    return nodes, edges
