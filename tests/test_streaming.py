import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import store
from loomgraph.operators.store import current_version, read_graph, recall_state, stored_beside
from loomgraph.streaming.ingest import stream_ingest, stream_recall, stream_turns


def test_incremental_ingest(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "g")
    folder.mkdir()
    turn = {"conversation_id": "c", "turn_id": "t1", "speaker": "user", "text": "vector rag vs graph rag", "timestamp": "2026-02-09T09:00:00Z"}
    (folder / "1.json").write_text(json.dumps(turn))
    stream_ingest(stream_turns(spark, str(folder)), base, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.json").write_text("\n".join(json.dumps(t) for t in (turn, turn | {"turn_id": "t2", "text": "graph rag and vector rag"})))
    stream_ingest(stream_turns(spark, str(folder)), base, str(tmp_path / "cp")).awaitTermination()
    g = read_graph(spark, f"{base}/v{current_version(spark, base)}")
    assert {r["turn_uid"] for r in g.turns.collect()} == {"c:t1", "c:t2"}
    assert max(r["weight"] for r in g.relations.collect()) <= 2.0


def test_only_touched_buckets_are_read(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "g")
    folder.mkdir()
    turn = {"speaker": "user", "text": "vector rag", "timestamp": "2026-02-09T09:00:00Z"}
    (folder / "1.json").write_text("\n".join(json.dumps(turn | {"conversation_id": f"c{i}", "turn_id": "t"}) for i in range(40)))
    stream_ingest(stream_turns(spark, str(folder)), base, str(tmp_path / "cp")).awaitTermination()
    few = stored_beside(spark, base, spark.createDataFrame([("c3",), ("c3",), ("new",)], "conversation_id string"))
    read = {f.split("bucket=")[1].split("/")[0] for f in few.inputFiles()}
    every = {f.split("bucket=")[1].split("/")[0] for f in read_graph(spark, f"{base}/v1").turns.inputFiles()}
    assert len(read) <= 2 < len(every) and "c3:t" in {r["turn_uid"] for r in few.collect()}
    assert stored_beside(spark, str(tmp_path / "none"), few) is None


def test_two_writers_are_noticed(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "version int, batch_id long")
    rows.write.parquet(str(tmp_path / "versions"))
    with pytest.raises(ValueError, match="two writers"):
        current_version(spark, str(tmp_path))


def test_recall_stream_is_the_batch_state(spark, tmp_path):
    at = lambda minutes: datetime(2026, 2, 9, 9) + timedelta(minutes=minutes)
    schema = "turn_uid string, query_id long, recalled_at timestamp"
    first = [("a", 1, at(0)), ("a", 1, at(0)), ("a", 2, at(5)), ("b", 1, at(90))]
    second = [("a", 1, at(70)), ("b", 1, at(95)), ("c", 9, at(60)), ("c", 9, at(61)), ("late", 3, at(-600))]  # repeats, and rows out of order
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_recall(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"), "2 hours").awaitTermination()
    got = {r["turn_uid"]: r["recall_count"] for r in recall_state(spark.read.parquet(str(tmp_path / "log"))).collect()}
    want = {r["turn_uid"]: r["recall_count"] for r in store.recall_state(spark.createDataFrame(first + second[:-1], schema)).collect()}
    assert got == want == {"a": 2, "b": 1, "c": 1}  # what is ten hours late is dropped
    assert spark.read.parquet(str(tmp_path / "log")).where(F.col("turn_uid") == "late").count() == 0
