"""Evaluation of rankings: recall, reciprocal rank, nDCG and hits, and the comparison of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip


def cutoffs(ks: list[int]) -> list[int]:
    found = sorted({k for k in ks if k > 0})
    if not found:
        raise ValueError("no cut-off over 0")
    return found


def judge(ranked: DataFrame, examples: DataFrame, ks: list[int]) -> DataFrame:
    """(profile, example_id, k, recall, rr, ndcg, hit) for each example and cut-off. ``ranked``: profile, example_id, rank,
    turn_uid; ``examples``: profile, example_id, relevant_turn_uids. An example without results counts as 0 throughout."""
    ks = cutoffs(ks)
    base = examples.select("profile", "example_id", F.array_distinct("relevant_turn_uids").alias("relevant"))
    wanted = base.select("profile", "example_id", F.size("relevant").alias("n"), F.explode_outer("relevant").alias("turn_uid"))
    first = ranked.groupBy("profile", "example_id", "turn_uid").agg(F.min("rank").alias("rank"))
    hits = wanted.join(first, ["profile", "example_id", "turn_uid"], "left")
    per_k = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.col("rank") <= F.col("k")
    judged = per_k.groupBy("profile", "example_id", "k").agg(
        F.max("n").alias("n"), F.count_if(inside).alias("found"), F.min("rank").alias("best"), F.sum(F.when(inside, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "k").cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    some = F.col("n") > 0
    return judged.select(
        "profile", "example_id", "k", F.when(some, F.col("found") / F.col("n")).otherwise(F.lit(0.0)).alias("recall"), F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("rr"),
        F.when(some, F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"), F.when(F.col("found") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"),
    )


def metrics(judged: DataFrame) -> DataFrame:
    """(profile, k, examples, mrr, recall, ndcg, hit), means over all examples."""
    return judged.groupBy("profile", "k").agg(F.count("*").alias("examples"), F.round(F.avg("rr"), 6).alias("mrr"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "ndcg", "hit")])


def compare(measured: DataFrame, baseline: str) -> DataFrame:
    """``metrics`` with the differences of mrr and recall to the baseline profile."""
    base = measured.where(F.col("profile") == baseline).select("k", F.col("mrr").alias("_mrr"), F.col("recall").alias("_recall"))
    return measured.join(F.broadcast(base), "k", "left").withColumns({"delta_mrr": F.round(F.col("mrr") - F.col("_mrr"), 6), "delta_recall": F.round(F.col("recall") - F.col("_recall"), 6)}).drop("_mrr", "_recall")


def ranked_lists(ranked: DataFrame, examples: DataFrame) -> DataFrame:
    """For each example: the turns as ranked beside those that are relevant."""
    lists = ranked.groupBy("profile", "example_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "turn_uid"))), lambda x: x.turn_uid).alias("ranked_turn_uids"))
    return examples.select("profile", "example_id", "relevant_turn_uids").join(lists, ["profile", "example_id"], "left").withColumn("ranked_turn_uids", F.coalesce("ranked_turn_uids", F.array().cast("array<string>")))


def clean_examples(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples (example_id, query, relevant_turn_uids, ...) trimmed, and (example_id, reason) of those that are none: without a
    query, or without a relevant turn."""
    uids = F.filter(F.transform("relevant_turn_uids", strip), lambda x: x.isNotNull() & (x != ""))
    trimmed = new.withColumns({"query": strip(F.col("query")), "relevant_turn_uids": F.coalesce(uids, F.array().cast("array<string>"))})
    reason = F.when(F.coalesce("query", F.lit("")) == "", F.lit("no query")).when(F.size("relevant_turn_uids") == 0, F.lit("no relevant turns"))
    judged = trimmed.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("example_id", "reason")


def upsert_examples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Examples by id: a new one replaces an old one, but for the time it was made."""
    made = old.select("example_id", F.col("created_at").alias("_made"))
    fresh = new.join(made, "example_id", "left").withColumn("created_at", F.coalesce("_made", "created_at")).drop("_made")
    return old.join(new.select("example_id"), "example_id", "left_anti").unionByName(fresh)


def delete_examples(examples: DataFrame, ids: DataFrame) -> DataFrame:
    return examples.join(ids.select("example_id"), "example_id", "left_anti")


def list_examples(examples: DataFrame, limit: int) -> DataFrame:
    """The newest examples."""
    return examples.orderBy(F.desc("created_at"), "example_id").limit(max(1, limit))


def count_examples(examples: DataFrame) -> DataFrame:
    return examples.agg(F.count("*").alias("examples"))
