"""Text functions on cases with Hangul, quotes and odd white space."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import hash_embedding, hash_embedding_builtin, hash_vectors, mean_vector
from loomgraph.operators.extraction import explode_chunks, with_chunks, with_entities, with_relations
from loomgraph.vocabulary import Chunking, Retrieval, Vocabulary

V = Vocabulary()


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", make(F.col("text")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_canonical_names(spark):
    texts = ["PagedAttention", "GraphRAG", "연속 배칭", "그래프 기반 RAG", "  The “Best”  (one)! "]
    assert column(spark, texts, lambda t: X.canonicalize(t, V)) == ["paged attention", "graph-centric rag", "continuous batching", "graph-centric rag", "the best one"]


def test_entity_id_is_stable(spark):
    import hashlib

    assert column(spark, ["kv-cache"], X.entity_id) == ["ent:" + hashlib.sha1(b"kv-cache").hexdigest()[:16]]


def test_importance(spark):
    some, none = column(spark, ["지침 변경 후 오류를 정정하고 최종 결정으로 확정했다.", "continuous batching은 처리량 향상에 유리하다."], lambda t: X.importance(t, V))
    assert some == 1.0 and none == 0.0


def chunks_of(spark, text, chunking):
    df = spark.createDataFrame([("u", text)], "turn_uid string, text string")
    return [tuple(r) for r in explode_chunks(with_chunks(df, chunking)).orderBy("chunk_no").select("chunk_text", "chunk_profile").collect()]


def test_chunks(spark):
    small = Chunking(default_size=8, default_overlap=2)
    assert chunks_of(spark, "a b c d e f g h i j", small) == [("a b c d e f g h", "default"), ("g h i j", "default")]
    assert chunks_of(spark, " \n ", small) == [("", "default")]
    assert chunks_of(spark, "  a  b ", small) == [("a  b", "default")]
    lines = "# 섹션\n- 항목 1\n- 항목 2\n요약"
    assert chunks_of(spark, lines, Chunking())[0][1] == "structured"
    assert chunks_of(spark, lines, Chunking(profile="default"))[0][1] == "default"
    with pytest.raises(ValueError):
        Chunking(profile="other")


def test_chunks_like_stepping(spark):
    for n in (1, 8, 9, 14, 15, 40):
        words = [str(i) for i in range(n)]
        want, start = [], 0
        while n > 8:
            want.append(" ".join(words[start : start + 8]))
            if start + 8 >= n:
                break
            start += 6
        assert [c for c, _ in chunks_of(spark, " ".join(words), Chunking(default_size=8, default_overlap=2))] == (want or [" ".join(words)])


def names(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    r = with_relations(with_entities(df, V), V).first()
    return {e["canonical_name"]: (e["surface"], e["confidence"]) for e in r["entities"]}, [(x["source"], x["target"], x["relation_type"], x["confidence"]) for x in r["relations"]]


def test_extraction(spark):
    found, _ = names(spark, "continuous batching과 paged attention을 비교해줘")
    assert {"continuous batching", "paged attention"} <= set(found)
    _, links = names(spark, "vector rag vs graph rag 차이를 비교")
    assert links[0][2:] == ("COMPARES", 0.78)
    found, _ = names(spark, 'the "Big Idea" uses GPU and RAG는')
    assert found["big idea"] == ("Big Idea", 0.82) and found["gpu"] == ("GPU", 0.75) and "rag" not in found  # Hangul is part of the word
    assert names(spark, "") == ({}, [])


def test_hash_embedding(spark):
    texts = ["", "rag rag graph", "그래프 기반 RAG / top-k", "x" * 50]
    fast, slow = column(spark, texts, hash_embedding), column(spark, texts, hash_embedding_builtin)
    for a, b in zip(fast, slow):
        assert a == pytest.approx(b, abs=1e-12)
    assert math.isclose(sum(x * x for x in fast[1]), 1.0) and not any(fast[0])
    assert hash_vectors([]).shape == (0, 64)


def test_mean_vector(spark):
    got = spark.range(1).select(mean_vector(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(9.0)))).alias("m")).first()["m"]
    assert got == pytest.approx([math.sqrt(0.5)] * 2)


def test_weights():
    assert Retrieval(graph_weight=-1, embedding_weight=1, lexical_weight=3).weights() == (0.0, 0.25, 0.75)
    assert Retrieval(graph_weight=0, embedding_weight=0, lexical_weight=0).weights() == (0.62, 0.23, 0.15)
    with pytest.raises(ValueError):
        Retrieval(top_k=0).check()
