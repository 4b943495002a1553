"""Graph build, merges, retrieval and evaluation on a handful of turns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.vectors import Embedder
from loomgraph.jobs.ingest import ingest
from loomgraph.jobs.retrieve import retrieve
from loomgraph.operators import evaluate, graph, nearest, rank, store, traverse
from loomgraph.operators.graph import adjacency, entity_sums, merge_entities, with_entity_vectors
from loomgraph.operators.settings import resolved
from loomgraph.session import settled
from loomgraph.vocabulary import Chunking, Retrieval

TURNS = [
    ("conv-1", "t1", "user", "continuous batching depends on paged attention", "2026-02-09 09:00:00"),
    ("conv-1", "t2", "assistant", "what is paged attention and kv-cache", "2026-02-09 09:01:00"),
    ("conv-1", "t3", "user", "no names here", "2026-02-09 09:02:00"),
    ("conv-2", "t1", "user", "compare vector rag vs graph rag", "2026-02-09 10:00:00"),
]


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame(TURNS, "conversation_id string, turn_id string, speaker string, text string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    g = ingest(df, chunking=Chunking(default_size=8, default_overlap=2))
    return graph.Graph(*[getattr(g, n).cache() for n in store.NAMES])


def test_invariants(built):
    mentions = {(r[0], r[1]) for r in built.mentions.collect()}
    for r in graph.with_evidence(built.relations, built.evidence).collect():
        assert r["weight"] == len(r["evidence_turn_ids"]) >= 1
        for uid in r["evidence_turn_ids"]:
            assert (uid, r["source_entity_id"]) in mentions and (uid, r["target_entity_id"]) in mentions
    assert {r["turn_uid"] for r in built.turns.collect()} == {f"{t[0]}:{t[1]}" for t in TURNS}


def test_merge_twice(built):
    again = graph.merge(built, built)
    weights = {(r[0], r[1], r[2]): r["weight"] for r in built.relations.collect()}
    for r in graph.with_evidence(again.relations, again.evidence).collect():
        assert r["weight"] == 2 * weights[r[0], r[1], r[2]] and len(r["evidence_turn_ids"]) == weights[r[0], r[1], r[2]]
    for r in graph.merge(built, built, idempotent=True).relations.collect():
        assert r["weight"] == weights[r[0], r[1], r[2]]
    assert again.entities.count() == built.entities.count() and again.turns.count() == len(TURNS)


def test_store_counts_a_batch_once(spark, built, tmp_path):
    base = str(tmp_path / "g")
    assert store.current_version(spark, base) == 0
    assert store.commit_merge(spark, base, built, batch_id=7) == 1
    assert store.commit_merge(spark, base, built, batch_id=7) == 1
    assert store.read_graph(spark, f"{base}/v1").turns.count() == len(TURNS)


def _rows(df):
    return sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("idempotent", [False, True])
def test_store_merges_touched_buckets_only(spark, built, tmp_path, idempotent):
    base = str(tmp_path / "g")
    uids = F.col("conversation_id") == "conv-1"
    turns = built.turns.where(uids).select("conversation_id", "turn_id", "speaker", "text", "timestamp")
    part = ingest(turns, chunking=Chunking(default_size=8, default_overlap=2))
    store.commit_merge(spark, base, built, 1, buckets=16)
    store.commit_merge(spark, base, part, 2, idempotent)
    stored, whole = store.read_graph(spark, f"{base}/v2"), graph.merge(built, part, idempotent)
    for name in store.NAMES:
        assert _rows(getattr(stored, name)) == _rows(getattr(whole, name)), name
    folders = {(r["name"], r["folder"]) for r in store.manifest(spark, f"{base}/v2") if r["bucket"] >= 0}
    assert ("turns", "v1") in folders and ("turns", "") in folders  # conv-2 stays where it was
    nothing = graph.Graph(*[getattr(built, n).limit(0) for n in store.NAMES])
    assert store.commit_merge(spark, base, nothing, 3) == 3
    assert _rows(store.read_graph(spark, f"{base}/v3").evidence) == _rows(stored.evidence)
    assert store.stored_conversation(spark, f"{base}/v3", "conv-2").count() == 1 and store.stored_conversation(spark, f"{base}/v3", "none").count() == 0


def test_store_of_nothing(spark, built, tmp_path):
    nothing = graph.Graph(*[getattr(built, n).limit(0) for n in store.NAMES])
    store.commit_merge(spark, str(tmp_path / "g"), nothing)
    assert store.read_graph(spark, f"{tmp_path}/g/v1").relations.columns == built.relations.columns


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    vectors[100:200] = vectors[100]  # a third are copies: ties go by id
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0]), (302, [])], "vec_id long, e array<double>")
    asked = rows.where("vec_id % 30 = 0 or vec_id > 299").selectExpr("vec_id query_id", "e q")
    expected = {}
    for q in [*range(0, 300, 30)]:
        likeness = np.concatenate([np.round(vectors @ vectors[q], 6), np.zeros(3)])
        expected[q] = [i for i in np.lexsort([np.arange(303), -likeness]) if i != q][:7]
    expected |= {q: [*range(7)] for q in (300, 301, 302)}
    monkeypatch.setattr(nearest, "VECTORS", 40)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    for small in (nearest.SMALL, 0):  # sent to all tasks, and joined
        monkeypatch.setattr(nearest, "SMALL", small)
        got = {}
        for r in nearest.nearest(asked, rows, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == expected
    assert nearest.nearest(asked.limit(0), rows, 7).count() == nearest.nearest(asked, rows.limit(0), 7).count() == 0


def test_traversal_can_improve_a_seed(spark):
    start = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1)], "query_id int, entity_id string, score double")
    edges = spark.createDataFrame([("a", "b", "EXPLAINS", True, 1, 1.2), ("b", "c", "EXPLAINS", True, 1, 1.0)], "source_entity_id string, target_entity_id string, relation_type string, forward boolean, place int, edge_score double")
    got = {r["entity_id"]: (round(r["score"], 6), len(r["steps"])) for r in traverse.traverse(start, edges, Retrieval(prune_threshold=0.05)).entities.collect()}
    assert got == {"a": (0.9, 0), "b": (0.918, 1), "c": (0.7803, 2)}
    narrow = traverse.traverse(start, edges, Retrieval(prune_threshold=0.99))
    assert {r["entity_id"] for r in narrow.entities.collect()} == {"a", "b"} and narrow.pruned.first()["pruned"] == 2


def test_retrieval(spark, built):
    queries = spark.createDataFrame([(1, "how does paged attention work", None), (2, "vector rag", "conv-1")], "query_id int, query string, conversation_id string")
    rows = retrieve(queries, built, F.lit("2026-02-09 12:00:00").cast("timestamp"), Retrieval(top_k=3)).orderBy("query_id", "rank").collect()
    first = [r for r in rows if r["query_id"] == 1]
    assert {first[0]["turn_uid"], first[1]["turn_uid"]} == {"conv-1:t1", "conv-1:t2"} and "paged attention" in first[0]["matched_entities"]
    assert all(r["conversation_id"] == "conv-1" for r in rows if r["query_id"] == 2)
    assert all(a["score"] >= b["score"] for a, b in zip(first, first[1:]))


def test_rerank_moves_the_head_only(spark):
    scored = spark.createDataFrame([(1, "a", 0.9, 0.0), (1, "b", 0.8, 0.0), (1, "c", 0.7, 0.0)], "query_id int, turn_uid string, score double, rerank_component double")
    queries = spark.createDataFrame([(1, "q")], "query_id int, query string")
    turns = spark.createDataFrame([("a", "x"), ("b", "xxx"), ("c", "xxxxx")], "turn_uid string, text string")
    again = rank.rerank(scored, queries, turns, Retrieval(rerank_top_n=2, rerank_weight=0.5), lambda q, t: [float(len(x)) for x in t])
    assert [r["turn_uid"] for r in rank.top(again, 3, F.col("head")).orderBy("rank").collect()] == ["b", "a", "c"]
    same = rank.rerank(scored, queries, turns, Retrieval(rerank_top_n=2), None)
    assert [r["turn_uid"] for r in rank.top(same, 3, F.col("head")).orderBy("rank").collect()] == ["a", "b", "c"]


def test_metrics(spark):
    ranked = [("p", "1", i + 1, t) for i, t in enumerate(["c1:t3", "c1:t4", "c1:t2"])] + [("p", "2", i + 1, t) for i, t in enumerate(["c2:t1", "c2:t2", "c2:t3"])]
    examples = spark.createDataFrame([("p", "1", ["c1:t4"]), ("p", "2", ["c2:t9"])], "profile string, example_id string, relevant_turn_uids array<string>")
    judged = evaluate.judge(spark.createDataFrame(ranked, "profile string, example_id string, rank int, turn_uid string"), examples, [5, 2, 1, 2])
    got = {r["k"]: r for r in evaluate.metrics(judged).collect()}
    assert got[1]["mrr"] == 0.25 and [got[k]["recall"] for k in (1, 2, 5)] == [0.0, 0.5, 0.5]
    assert got[2]["hit"] == 0.5 and got[2]["ndcg"] == pytest.approx(0.315465, abs=1e-6)
    one = spark.createDataFrame([("p", "1", ["t1", "t2"])], "profile string, example_id string, relevant_turn_uids array<string>")
    rows = spark.createDataFrame([("p", "1", i + 1, t) for i, t in enumerate(["t3", "t1", "t2", "t9"])], "profile string, example_id string, rank int, turn_uid string")
    assert evaluate.judge(rows, one, [3]).first()["ndcg"] == pytest.approx(0.6934264036)
    with pytest.raises(ValueError):
        evaluate.cutoffs([0, -1])


def test_parameters_in_either_order(spark):
    rows = spark.createDataFrame([("p", {"top_k": "3", "hybrid": " True "}), ("q", {})], "profile string, request map<string,string>")
    profiles = {"p": Retrieval(graph_weight=1.0), "q": Retrieval(beam_width=4)}
    found = lambda **k: {r["profile"]: r for r in resolved(rows, profiles, {"graph_weight": 0.5, "hybrid": False}, **k).collect()}
    last, first = found(example_last=True), found(example_last=False)
    assert (last["p"]["graph_weight"], last["p"]["top_k"], last["p"]["hybrid"], last["q"]["hybrid"], last["q"]["beam_width"]) == (0.5, 3, True, False, 4)
    assert (first["p"]["graph_weight"], first["q"]["graph_weight"], first["q"]["top_k"]) == (1.0, 0.5, 10)
    for request in ({"nothing": "1"}, {"top_k": "many"}, {"hybrid": "perhaps"}):
        with pytest.raises(ValueError):
            resolved(spark.createDataFrame([("p", request)], rows.schema), profiles, None, True)


def test_each_query_has_its_own_parameters(spark, built):
    now = F.lit("2026-02-09 12:00:00").cast("timestamp")
    rows = [(1, "how does paged attention work", None, 1, 1), (2, "how does paged attention work", None, 3, None), (3, "vector rag", "conv-1", 2, 2)]
    queries = spark.createDataFrame(rows, "query_id int, query string, conversation_id string, top_k int, max_hops int")
    params = Retrieval(recency_weight=0.2)
    together = {(r["query_id"], r["rank"]): (r["turn_uid"], r["score"], r["applied"]["max_hops"]) for r in retrieve(queries, built, now, params).collect()}
    alone = {}
    for q, text, conversation, k, hops in rows:
        one = spark.createDataFrame([(q, text, conversation)], "query_id int, query string, conversation_id string")
        alone |= {(q, r["rank"]): (r["turn_uid"], r["score"], r["applied"]["max_hops"]) for r in retrieve(one, built, now, params.but(top_k=k, max_hops=hops)).collect()}
    assert together == alone and {q for q, _ in together} == {1, 2}  # the third is confined to a conversation that has nothing
    with pytest.raises(ValueError, match="out of range"):
        retrieve(queries.withColumn("top_k", F.lit(99)), built, now)


def test_hops_read_the_adjacency_as_it_is_stored(spark, built):
    """No hop sorts all relations anew: a settled adjacency is dealt by its entity already."""
    adjacent = settled(adjacency(built.relations, 40))
    start = spark.createDataFrame([(1, "a", 0.9)], "query_id int, entity_id string, score double")
    plan = start.join(adjacent.withColumnRenamed("source_entity_id", "entity_id"), "entity_id")._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]


def test_models_and_entity_vectors(spark, built):
    model = Embedder.of_model("nlpai-lab/KURE-v1", lambda: lambda texts: [[float(t.count("a")), float(t.count("q:")), 1.0] for t in texts])
    df = spark.createDataFrame([(["aa", "b"],), ([],), (None,)], "c array<string>")
    got = [r["v"] for r in model.of_chunks(df, "c", "v").collect()]
    assert len(got[0]) == 3 and sum(x * x for x in got[0]) == pytest.approx(1.0) and got[1] == got[2] == []
    assert model.query_prefix == "query: " and len(model.of_queries(spark.createDataFrame([("a",)], "q string"), "q", "v").first()["v"]) == 3

    def broken():
        raise OSError("no such model")

    assert Embedder.of_model("x", broken, fallback=True).embed is None
    with pytest.raises(RuntimeError):
        Embedder.of_model("x", broken)
    mentions = spark.createDataFrame([("t1", "e"), ("t2", "e"), ("t3", "f"), ("t4", "e")], "turn_uid string, entity_id string")
    turns = spark.createDataFrame([("t1", [1.0, 0.0]), ("t2", [0.0, 1.0]), ("t3", []), ("t4", [1.0, 0.0, 0.0])], "turn_uid string, embedding array<double>")
    sums = {r["entity_id"]: r for r in entity_sums(mentions, turns).collect()}
    assert set(sums) == {"e"} and sums["e"]["embedding_count"] == 2 and sums["e"]["embedding_sum"] == [1 << 32, 1 << 32]
    with_vectors = built.entities.select("entity_id", "canonical_name", "entity_type", "description", "aliases").transform(lambda d: with_entity_vectors(d.withColumn("embedding", F.lit(None)), entity_sums(built.mentions, built.turns)))
    twice = merge_entities(with_vectors, with_vectors)
    once = {r["entity_id"]: (r["embedding"], r["embedding_count"]) for r in with_vectors.collect()}
    for r in twice.collect():
        assert r["embedding"] == pytest.approx(once[r["entity_id"]][0]) and r["embedding_count"] == 2 * once[r["entity_id"]][1]


def test_examples_are_cleaned(spark):
    rows = [(1, " q ", [" a ", "", None]), (2, "  ", ["a"]), (3, None, ["a"]), (4, "q", ["", " "]), (5, "q", None)]
    valid, rejects = evaluate.clean_examples(spark.createDataFrame(rows, "example_id long, query string, relevant_turn_uids array<string>"))
    assert [tuple(r) for r in valid.collect()] == [(1, "q", ["a"])]
    assert {r["example_id"]: r["reason"] for r in rejects.collect()} == {2: "no query", 3: "no query", 4: "no relevant turns", 5: "no relevant turns"}
    assert evaluate.count_examples(valid).first()["examples"] == 1
