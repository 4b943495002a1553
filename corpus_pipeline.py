"""From raw documents to packed training sequences, in five stages, each written as Parquet and read again as the next one's
documents: toxic documents go, documents of no known language go, lines that many documents share go, near duplicates go, and
what is left is packed.

Executors live through all stages, and their heaps stay as large as the largest stage made them, so workers remember fewer words
and take less text at a time than the operators have them do by themselves; results do not depend on that.

Each stage is defined as its operator is: null, empty and very long texts, ties and repeated rows (each is judged like its
equals; near-dedup keeps all rows of the doc_id that stays), extra columns, whatever their names, up to the last stage, and
empty tables, which give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import lang_id, line_dedup, minhash, packing, toxicity
from loomgraph.llm.common import shared_dir, table
from loomgraph.llm.queries import WORD_BPE_PATH


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on the labelled ones, scores under 0.5."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, net, cache_words=100_000)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    return lang_id.filter_known(docs, lang_id.train(docs))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share, but for one occurrence."""
    return line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, packed into sequences."""
    return packing.pack_whole(packing.pieces(docs, WORD_BPE_PATH, cache_words=100_000, group=1 << 20))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: A trained network, a classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each stage's result written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
