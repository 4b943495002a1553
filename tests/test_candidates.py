import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import rank


def plain(reached, mentions, queries, limit):
    out = set()
    for q, conversation in queries:
        own = {e: round(s * 1e12) for i, e, s in reached if i == q}
        sums = {}
        for turn, e in mentions:
            if e in own and (conversation is None or turn.split(":")[0] == conversation):
                sums[turn] = sums.get(turn, 0) + own[e]
        best = sorted(sums, key=lambda t: (-((sums[t] + 500) // 1000), t))[:limit]
        out |= {(q, t, e) for t in best for u, e in mentions if u == t and e in own}
    return out


def test_same_turns_as_by_sums(spark):
    rng = random.Random(3)
    mentions = sorted({(f"c{i % 5}:t{i:04d}", f"e{int(30 * rng.random() ** 2)}") for i in range(600) for _ in range(rng.randint(1, 4))} | {(f"c{i % 5}:t{i:04d}", "hot") for i in range(0, 600, 3)})
    reached = [(q, e, round(rng.random(), 3)) for q in range(6) for e in [f"e{k}" for k in rng.sample(range(40), 9)] + ["hot"]]
    queries = [(q, "c2" if q == 3 else "none" if q == 4 else None) for q in range(6)]
    dfs = (
        spark.createDataFrame(reached, "query_id long, entity_id string, score double"), spark.createDataFrame(mentions, "turn_uid string, entity_id string"),
        spark.createDataFrame(queries, "query_id long, conversation_id string"), spark.createDataFrame(sorted({(t, t.split(":")[0]) for t, _ in mentions}), "turn_uid string, conversation_id string"),
    )
    for limit in (1, 12, 5000):
        assert {tuple(r) for r in rank.graph_candidates(*dfs, limit).collect()} == plain(reached, mentions, queries, limit)
    own = spark.createDataFrame([(q, q + 1) for q in range(6)], "query_id long, most int")
    assert {tuple(r) for r in rank.graph_candidates(*dfs, own).collect()} == set().union(*[plain(reached, mentions, [x], x[0] + 1) for x in queries])
    assert rank.graph_candidates(dfs[0].limit(0), *dfs[1:], 5).count() == 0 == rank.graph_candidates(dfs[0], dfs[1].limit(0), *dfs[2:], 5).count()


def test_the_bound_leaves_turns_unbuilt():
    rng = np.random.default_rng(1)
    lists = {"a": np.arange(0, 5000, 50), "b": np.arange(0, 5000, 7), "hot": np.arange(5000)}
    scores = [("a", 10**12), ("b", 6 * 10**11), ("hot", 10**11), ("missing", 10**12)]
    at, sums, built = rank.best_turns(lists, scores, 5000, None, 20)
    every = np.zeros(5000, np.int64)
    for e, s in scores[:3]:
        every[lists[e]] += s
    order = sorted(range(5000), key=lambda t: (-every[t], t))[:20]
    assert at.tolist() == order and built < 1000
    allowed = rng.random(5000) < 0.5
    at, _, _ = rank.best_turns(lists, scores, 5000, allowed, 20)
    assert at.tolist() == [t for t in sorted(range(5000), key=lambda t: (-every[t], t)) if allowed[t]][:20]


def test_a_hot_entity_is_spread(spark):
    """One entity in a third of all turns: by turns, no bucket has more than twice the median."""
    turns = spark.range(30_000).select(F.concat(F.lit("c:t"), "id").alias("turn_uid"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id") % 500)).alias("entity_id"))
    sizes = [r["n"] for r in turns.groupBy(F.pmod(F.xxhash64(F.lit(7), "turn_uid"), F.lit(16)).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * median(sizes)
