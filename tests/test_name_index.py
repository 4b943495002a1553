"""The stored index of names against the lookup without one; the stored adjacency's plan."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import graph, name_index, store, traverse

SCHEMA = "entity_id string, canonical_name string, aliases array<string>"


def _rows(df):
    return sorted((r["name"], r["entity_id"], r["canonical_name"], r["exact"], r["place"]) for r in df.collect())


def _entities(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcA 그é") for _ in range(rng.randint(1, 9)))
    return [(f"e{i}", word(), [word() for _ in range(rng.randint(0, 3))]) for i in range(n)]


def test_same_rows_as_without_index(spark, tmp_path):
    rows = _entities(300, 1)
    rows += [("e900", "same", ["same", "SAME"]), ("e901", "same", []), ("e902", "long " * 500, [])]
    names = [r[1] for r in rows[::7]] + [a[:4] for r in rows[::5] for a in r[2]] + ["", "a", "Ab", "abc", "zz", "zzzzz", "그", "same", "aaaaaaaaaaaa", "long long"]
    asked = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    index = name_index.NameIndex(spark, f"file://{tmp_path}/names", buckets=8)
    assert name_index.match(index, asked, 5).count() == 0  # nothing is stored yet
    part = lambda chosen: spark.createDataFrame(chosen, SCHEMA)
    # Some entities come again, with fewer aliases first; so do equal ones.
    assert name_index.add(index, part([(e, c, a[:1]) for e, c, a in rows[:200]])) == 1
    assert name_index.add(index, part(rows[100:])) == 2
    assert name_index.add(index, part(rows + [(None, "x", []), ("e999", None, [])])) == 3
    expected = _rows(graph.match_names(asked.where("name is not null"), part(rows), 5))
    assert _rows(name_index.match(index, asked, 5)) == expected and len(expected) > 100
    assert name_index.compact(index) == 4 and len(index.segments()) == 1
    assert _rows(name_index.match(index, asked, 5)) == expected
    assert name_index.add(index, part([])) == 5 and name_index.add(index, part(rows)) == 6
    assert index.segments()[2]["form_buckets"] == [] and _rows(name_index.match(index, asked, 5)) == expected
    assert name_index.match(index, asked.limit(0), 5).count() == 0


def test_reads_touched_buckets_only(spark, tmp_path):
    index = name_index.NameIndex(spark, f"file://{tmp_path}/names", buckets=32)
    name_index.add(index, spark.createDataFrame([(f"e{i}", f"name{i:04}", []) for i in range(500)], SCHEMA))
    asked = spark.createDataFrame([("name0123",)], "name string")
    known = index.segments()
    runs = asked.select(F.explode(graph.grams(F.col("name"), 3)).alias("key"))
    touched = {r[0] for r in runs.select(index.in_bucket(known, "key")).distinct().collect()}
    read = index.table(known, "grams", "key string", touched).inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 6
    files = name_index.match(index, asked, 5).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files if "/forms/" in f} and len([f for f in files if "/forms/" in f]) <= 1


def test_stored_adjacency(spark):
    edges = [(f"e{i % 7}", f"e{i % 11}", "RELATED_TO", float(i % 3 + 1)) for i in range(60) if i % 7 != i % 11]
    relations = spark.createDataFrame(edges, "source_entity_id string, target_entity_id string, relation_type string, weight double").distinct()
    plain, stored = graph.adjacency(relations, 40), store.store_adjacency(relations, 40, buckets=4)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, stored.select(plain.columns).collect()))
    frontier = spark.range(100).select(F.concat(F.lit("e"), F.col("id") % 11).alias("source_entity_id"), "id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frontier.join(stored, "source_entity_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan  # the frontier alone is shuffled
    start = spark.createDataFrame([(1, "e1", 0.9), (1, "e2", 0.7), (2, "none", 0.9)], "query_id int, entity_id string, score double")
    a, b = (sorted(map(str, traverse.traverse(start, adj).entities.collect())) for adj in (plain, stored))
    assert a == b and len(a) > 5
