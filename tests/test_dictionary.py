"""Large vocabularies: the automaton and the tables against the plain expressions, and against brute force."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.functions.dictionary import canonicals, phrases_in
from loomgraph.jobs.ingest import extracted, ingest
from loomgraph.operators import store
from loomgraph.operators.extraction import with_entities
from loomgraph.operators.traverse import query_names
from loomgraph.vocabulary import Vocabulary


def test_phrases_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 5)))
    phrases = tuple([word() for _ in range(10_000)] + ["", "aa", "aa", "연속 배칭", "😀"])
    texts = [None, "", "aa", "연속 배칭 😀😀", *["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(100)], "ab" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", phrases_in(F.col("text"), phrases).alias("p")).collect()
    for r in rows:
        text = texts[r["n"]]
        assert r["p"] == ([] if text is None else [p for p in reversed(phrases) if p in text])
    assert spark.createDataFrame([("x",)], "text string").select(phrases_in(F.col("text"), ()).alias("p")).first()["p"] == []


def test_synonyms(spark):
    found = spark.createDataFrame([(["a b", "c d", "x", None],), ([],), (None,)], "n array<string>").select(canonicals(F.col("n"), {"a b": "B", "cd": "D"}).alias("c")).collect()
    assert [r["c"] for r in found] == [["B", "D", "x", None], [], None]


TEXTS = [
    "Continuous batching depends on `paged attention` and KV-cache", "what is graph rag vs 그래프 RAG and PagedAttention", "", None, "none", "the RAG cache rag cache \"entity graph\" 'top k'",
    "검색 그래프 rag top-k beam search " * 40, "None" * 3, "query query ranking",
]


def test_tables_equal_literals(spark):
    df = spark.createDataFrame([(f"c{i % 2}", f"t{i}", "user", t, i) for i, t in enumerate(TEXTS)], "conversation_id string, turn_id string, speaker string, text string, i int")
    df = df.withColumn("timestamp", F.timestamp_seconds("i")).drop("i")
    plain = replace(Vocabulary(), tables=False)
    for v in (plain, replace(plain, keywords=()), replace(plain, phrases=()), replace(plain, synonyms={})):
        a, b = (with_entities(df, replace(v, tables=t)).orderBy("turn_id").collect() for t in (False, True))
        assert a == b
    turns = df.where("text is not null")
    g, h = ingest(turns, plain), ingest(turns, replace(plain, tables=True))
    for name in store.NAMES:
        assert sorted(map(str, getattr(g, name).collect())) == sorted(map(str, getattr(h, name).collect())), name
    asked = turns.select(F.col("turn_id").alias("query_id"), F.col("text").alias("query"))
    assert sorted(query_names(asked, plain).collect()) == sorted(query_names(asked, replace(plain, tables=True)).collect())
    assert extracted(turns.limit(0), replace(plain, tables=True)).count() == 0


def test_large_from_its_size_on():
    assert not Vocabulary().large and Vocabulary(phrases=tuple(map(str, range(500)))).large
