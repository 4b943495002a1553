import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.turns import EmptyInput, RejectedRows, in_conversation, read_event_logs, read_examples, read_session_history, read_turns, union_sources


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_turns_and_rejects(spark, tmp_path):
    good = {"conversation_id": "c", "turn_id": "t1", "speaker": "user", "text": "안녕", "timestamp": "2026-02-09T09:00:00Z", "more": 1}
    loaded = read_turns(spark, write(tmp_path / "a.jsonl", [good, "", "{nope", {"conversation_id": "c", "turn_id": 5}, good | {"text": ""}, good | {"timestamp": "soon"}]))
    assert [tuple(r) for r in loaded.valid.collect()] == [("c", "t1", "user", "안녕", datetime(2026, 2, 9, 9))]
    reasons = {r["line"]: r["reason"] for r in loaded.rejects.collect()}
    assert reasons == {3: "invalid JSON", 4: "missing turn_id, speaker, text, timestamp", 5: "empty text", 6: "timestamp is not ISO 8601"}
    with pytest.raises(RejectedRows):
        loaded.strict()
    assert in_conversation(loaded.valid, "other").first()["conversation_id"] == "other"


def test_session_history(spark, tmp_path):
    rows = [{"session_id": "s1", "ts": 1, "text": "a"}, {"session_id": "s1", "ts": 2, "text": " "}, {"session_id": "s1", "ts": 3, "text": "b"}, {"session_id": "s2", "ts": 4, "text": "c"}]
    got = read_session_history(spark, write(tmp_path / "h.jsonl", rows)).orderBy("timestamp").collect()
    assert [(r["conversation_id"], r["turn_id"], r["text"]) for r in got] == [("codex:s1", "turn-000001", "a"), ("codex:s1", "turn-000002", "b"), ("codex:s2", "turn-000001", "c")]


def test_event_logs(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s", "uuid": "u1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "[not a list"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": " hi "}, {"type": "tool_use", "name": "grep"}, {"type": "thinking", "text": "x"}, {"type": "tool_result", "content": "done"}]}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "text": "x"}]}},
        {"type": "summary", "message": {"content": "no"}},
    ]
    write(tmp_path / "p" / "q" / "f1.jsonl", rows)
    write(tmp_path / "p" / "z.jsonl", rows[:1])
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    got = sorted((tuple(r) for r in read_event_logs(spark, str(tmp_path / "p"), now).collect()), key=str)
    assert len(got) == 3
    assert ("claude:f1", "line-000002", "assistant", "hi\n[tool_use] grep\ndone", datetime(2026, 3, 1)) in got
    assert ("claude:s", "u1", "user", "[not a list", datetime(2026, 1, 1)) in got
    few = read_event_logs(spark, str(tmp_path / "p"), now, max_files=1)
    assert few.count() == 2
    assert union_sources("both", few, few).count() == 4
    with pytest.raises(ValueError):
        union_sources("none", few, few)


def test_examples(spark, tmp_path):
    rows = [{"query": "q", "relevant_turn_uids": ["a", " a ", ""]}, {"query": "q2", "expected_turn_uids": ["b"], "request": {"top_k": 3}}, {"query": "q3"}, {"query": " ", "relevant_turn_uids": ["a"]}]
    loaded = read_examples(spark, write(tmp_path / "e.jsonl", rows))
    assert [r["relevant_turn_uids"] for r in loaded.valid.orderBy("example_id").collect()] == [["a"], ["b"]]
    assert sorted(r["reason"] for r in loaded.rejects.collect()) == ["no query", "no relevant turns"]


def test_empty_input_is_an_error(spark, tmp_path):
    with pytest.raises(EmptyInput):
        read_examples(spark, write(tmp_path / "none.jsonl", [])).usable("examples")
    with pytest.raises(RejectedRows):
        read_examples(spark, write(tmp_path / "bad.jsonl", [{"query": "q"}])).usable("examples")
    with pytest.raises(EmptyInput):
        in_conversation(spark.createDataFrame([], "conversation_id string, turn_id string"), "c")
