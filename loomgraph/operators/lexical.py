"""Full-text search of many queries at once: an inverted index as a table, and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import search_terms
from loomgraph.operators.settings import first_of_each

K1, B = 1.2, 0.75


def postings(turns: DataFrame) -> DataFrame:
    """(term, turn_uid, tf, len): how often a turn has a term, and how many terms it has."""
    terms = turns.select("turn_uid", search_terms(F.col("text")).alias("terms"))
    return terms.select("turn_uid", F.size("terms").alias("len"), F.explode_outer("terms").alias("term")).where("term is not null").groupBy("term", "turn_uid", "len").agg(F.count("*").alias("tf"))


def search(queries: DataFrame, turns: DataFrame, index: DataFrame, limit: int | DataFrame) -> DataFrame:
    """(query_id, turn_uid, lexical_raw) of the ``limit`` turns with the highest BM25 scores of each ``queries(query_id, query)``;
    a query may have a limit of its own, in (query_id, most).
    A turn needs one of the query's terms; scores are rounded to 9 places, and turn_uid breaks ties. Terms are joined by
    themselves, so only the postings of terms that are asked for move."""
    asked = queries.select("query_id", F.explode(F.array_distinct(search_terms(F.col("query")))).alias("term"))
    size = turns.select(F.size(search_terms(F.col("text"))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    used = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(size)).withColumn("idf", F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "idf", "avg_len")
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = asked.join(idf, "term").join(used, "term").withColumn("w", weight)
    scored = hits.groupBy("query_id", "turn_uid").agg(F.round(F.sum("w"), 9).alias("lexical_raw"))
    return first_of_each(scored, [F.desc("lexical_raw"), "turn_uid"], limit).drop("place")
