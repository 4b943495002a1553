import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import lexical, text_index
from loomgraph.operators.text_index import TextIndex


def turns_of(spark, rows):
    return spark.createDataFrame(rows or [], "turn_uid string, text string")


def made(n, seed, first=0, words=60):
    rng = random.Random(seed)
    names = [f"w{int(words * rng.random() ** 3)}" for _ in range(4000)]
    return [(f"c{i % 7}:t{i:05d}", " ".join(rng.choice(names) for _ in range(rng.randint(0, 30)))) for i in range(first, first + n)]


def same(spark, index, turns, asked, limit):
    """The index gives what a search over all postings gives; how many postings were read and how many there are."""
    queries = spark.createDataFrame(asked, "query_id long, query string")
    turns = turns.fillna("", ["text"])
    want = lexical.search(queries, turns, lexical.postings(turns), limit)
    got, reading = text_index.search(index, queries, limit)
    assert got.columns == want.columns
    key = lambda df: sorted((r[0], r[1], round(r[2], 7)) for r in df.collect())
    assert key(got) == key(want)
    return reading.agg(F.sum("read"), F.sum("postings")).first()


def test_search_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SHARD", 300)
    index = TextIndex(spark, str(tmp_path / "index"))
    asked = [(1, "w0 w1 w40"), (2, "w55 w50 nothing"), (3, "w3"), (4, ""), (5, "W2 w2 w7 w9 w30 w31 w32"), (6, None)]
    first = made(900, 1)
    text_index.add(index, turns_of(spark, first))
    same(spark, index, turns_of(spark, first), asked, 10)
    same(spark, index, turns_of(spark, first), asked, 2000)
    # Some turns come again with another text, and some are new; ties of many equal texts.
    second = made(200, 2, 800) + [(f"d:t{i:03d}", "w0 w40 w40") for i in range(150)] + [("e:t1", ""), ("e:t2", None)]
    text_index.add(index, turns_of(spark, second), turns_of(spark, first))
    now = list((dict(first) | dict(second)).items())
    for limit in (1, 7, 100):
        same(spark, index, turns_of(spark, now), asked, limit)
    live = sorted(map(tuple, text_index.live_postings(index).collect()))
    assert live == sorted((r["term"], r["turn_uid"], r["tf"], r["len"]) for r in lexical.postings(turns_of(spark, [(u, t or "") for u, t in now])).collect())
    third = [("d:t001", "w1"), ("c0:t00000", "w40 w40 w40")]
    text_index.add(index, turns_of(spark, third), turns_of(spark, now))
    now = list((dict(now) | dict(third)).items())
    same(spark, index, turns_of(spark, now), asked, 20)
    text_index.compact(index)
    assert len(index.segments()) == 1
    same(spark, index, turns_of(spark, now), asked, 20)


def test_frequent_terms_are_mostly_not_read(spark, tmp_path):
    rows = [(f"c:t{i:05d}", "the " * (1 + i % 3) + "of " * (i % 5) + ("rare " if i % 900 == 7 else "") + "x " * (i % 40)) for i in range(6000)]
    index = TextIndex(spark, str(tmp_path / "index"))
    text_index.add(index, turns_of(spark, rows))
    read, postings = same(spark, index, turns_of(spark, rows), [(1, "the rare"), (2, "the of rare")], 5)
    assert read < 0.4 * postings


def test_empty_index_and_two_writers(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "none"))
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert text_index.search(index, queries, 5)[0].count() == 0
    text_index.add(index, turns_of(spark, []))
    assert text_index.search(index, queries, 5)[0].count() == 0
    row = index.segments()[0]
    spark.createDataFrame([tuple(row)], text_index._SEGMENTS).write.mode("append").parquet(f"{index.path}/segments")
    with pytest.raises(ValueError, match="two writers"):
        index.segments()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    tf, length = rng.integers(1, 20, 1000), rng.integers(1, 200, 1000)
    for average in (3.0, 50.0, 400.0):
        assert (text_index.weight(1.5, tf, length, average) <= text_index.weight(1.5, tf.max(), length.min(), average) + 1e-12).all()
