"""Readers of conversation turns. Each gives valid rows and rejected ones; nothing is dropped in silence.

JSON is parsed by Spark's VARIANT functions, which tell a missing field from a null one, and a number from a string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

TURN_FIELDS = ("conversation_id", "turn_id", "speaker", "text", "timestamp")
TURNS = "conversation_id string, turn_id string, speaker string, text string, timestamp timestamp"


class RejectedRows(ValueError):
    """Raised in strict mode when a source holds rows that do not fit."""


class EmptyInput(ValueError):
    """Raised where a source that has to hold something holds nothing."""


def some(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if not df.limit(1).count():
        raise EmptyInput(f"no {what}")
    return df


@dataclass
class Loaded:
    valid: DataFrame
    rejects: DataFrame  # file, line, reason

    def strict(self) -> DataFrame:
        """The valid rows, or an error that names the first rejects."""
        bad = self.rejects.orderBy("file", "line").limit(5).collect()
        if bad:
            raise RejectedRows("; ".join(f"{r['file']}:{r['line']}: {r['reason']}" for r in bad))
        return self.valid

    def usable(self, what: str = "usable rows") -> DataFrame:
        """The valid rows; an error if there are rejects, or nothing at all."""
        return some(self.strict(), what)


def _lines(spark: SparkSession, path: str | list[str], tree: str | None = None) -> DataFrame:
    """(file, line, value): all physical lines, numbered from 1 within their file, blank ones included.

    A file may be read in many pieces: rows are numbered within theirs, and the pieces before it are counted. Only those counts
    are ordered by file, no lines."""
    reader = spark.read
    if tree:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", tree)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    pieces = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(pieces, ["file", "block"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value")


def _string(v: Column, name: str) -> Column:
    return F.when(F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def read_turns(spark: SparkSession, path: str | list[str]) -> Loaded:
    """Turns from JSON lines: five non-empty strings, of which the timestamp is ISO 8601. Blank lines are skipped, further
    fields ignored; anything else is rejected with its reason."""
    judged = judge_turns(_lines(spark, path), ["file", "line"])
    return Loaded(judged.where("reason is null").drop("file", "line", "value", "reason"), judged.where("reason is not null").select("file", "line", "reason"))


def judge_turns(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The turns that ``lines(value, ...)`` hold, with the columns ``keep``, the line's ``value``, and the ``reason`` why a line is
    none. Works on streams as well."""
    lines = lines.withColumn("body", strip(F.col("value"))).where("body != ''").withColumn("v", F.try_parse_json("body"))
    fields = {name: _string(F.col("v"), name) for name in TURN_FIELDS}
    parsed = lines.select(*keep, "value", "v", *[f.alias(n) for n, f in fields.items()]).withColumn("at", F.try_to_timestamp("timestamp"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in TURN_FIELDS]))
    empty = F.array_compact(F.array(*[F.when(F.col(n) == "", F.lit(n)) for n in TURN_FIELDS]))
    reason = (
        F.when(F.col("v").isNull(), F.lit("invalid JSON"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(F.size(empty) > 0, F.concat(F.lit("empty "), F.array_join(empty, ", ")))
        .when(F.col("at").isNull(), F.lit("timestamp is not ISO 8601"))
    )
    return parsed.select(*keep, "value", "conversation_id", "turn_id", "speaker", "text", F.col("at").alias("timestamp"), reason.alias("reason"))


def read_session_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Turns from a history of prompts (session_id, text, ts in epoch seconds): rows without any of them go; what stays is
    numbered within its session, in the order of the file."""
    v = F.try_parse_json("value")
    rows = _lines(spark, path).withColumn("v", v).where("v is not null")
    rows = rows.select("file", "line", strip(F.try_variant_get("v", "$.session_id", "string")).alias("sid"), strip(F.try_variant_get("v", "$.text", "string")).alias("text"), F.try_variant_get("v", "$.ts", "double").alias("ts"))
    rows = rows.where("sid != '' and text != '' and ts is not null")
    nth = F.row_number().over(W.partitionBy("sid").orderBy("file", "line"))
    return rows.select(
        F.concat(F.lit("codex:"), "sid").alias("conversation_id"), F.format_string("turn-%06d", nth).alias("turn_id"), F.lit("user").alias("speaker"), "text",
        F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("timestamp"),
    )


def message_text(content: Column) -> Column:
    """The text of a message's content (VARIANT): a string, or a list of parts of which texts, results of tools and names of
    tools are joined by line ends; null where nothing is left."""
    is_string = F.schema_of_variant(content) == "STRING"
    parts = F.try_variant_get(content, "$", "array<variant>")
    get = lambda p, name: F.try_variant_get(p, f"$.{name}", "string")
    is_text = lambda p, name: F.schema_of_variant(F.variant_get(p, f"$.{name}", "variant")) == "STRING"

    def one(p: Column) -> Column:
        kind = get(p, "type")
        tool = F.concat(F.lit("[tool_use] "), get(p, "name"))
        found = F.when(kind == "text", F.coalesce(get(p, "text"), get(p, "content"))).when((kind == "tool_result") & is_text(p, "content"), get(p, "content")).when(kind == "tool_use", tool)
        return strip(found)

    listed = F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull() & (x != "")), "\n")
    text = F.when(is_string, strip(F.try_variant_get(content, "$", "string"))).otherwise(listed)
    return F.when(text != "", text)


def read_event_logs(spark: SparkSession, root: str, now: Column, max_files: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """Turns from a tree of event logs (files named by ``pattern``, at any depth): user and assistant events with text. A turn is named by the event's
    uuid, or its line; its conversation by the session, or the file; without a timestamp it gets ``now``."""
    rows = _lines(spark, root, tree=pattern)
    if max_files is not None:
        first = rows.select("file").distinct().orderBy("file").limit(max(0, max_files))
        rows = rows.join(F.broadcast(first), "file", "left_semi")  # at most max_files rows
    rows = rows.withColumn("v", F.try_parse_json("value")).where("v is not null")
    get = lambda path: F.try_variant_get("v", path, "string")
    named = lambda c: F.when(strip(c) != "", strip(c))
    rows = rows.withColumn("kind", get("$.type")).where(F.col("kind").isin("user", "assistant")).withColumn("text", message_text(F.variant_get("v", "$.message.content", "variant")))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    role = F.coalesce(named(get("$.message.role")), F.col("kind"))
    return rows.where("text is not null").select(
        F.concat(F.lit("claude:"), F.coalesce(named(get("$.sessionId")), stem)).alias("conversation_id"),
        F.coalesce(named(get("$.uuid")), F.format_string("line-%06d", F.col("line"))).alias("turn_id"),
        F.when(role == "assistant", role).otherwise(F.lit("user")).alias("speaker"),
        "text",
        F.coalesce(F.try_to_timestamp(get("$.timestamp")), now).alias("timestamp"),
    )


def union_sources(source: str, sessions: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """Turns of one kind of history, or of both."""
    chosen = {"codex": [sessions], "claude": [events], "both": [sessions, events]}.get(source)
    if chosen is None or any(c is None for c in chosen):
        raise ValueError(f"no such source: {source}")
    return chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])


def in_conversation(turns: DataFrame, conversation_id: str | None) -> DataFrame:
    """All turns moved into one conversation, if one is given; without any turn an error."""
    some(turns, "turns")
    return turns.withColumn("conversation_id", F.lit(conversation_id)) if conversation_id else turns


def read_examples(spark: SparkSession, path: str | list[str]) -> Loaded:
    """Evaluation examples: a query, the turns that are relevant to it (``relevant_turn_uids``, or where that is null
    ``expected_turn_uids``), perhaps a conversation and parameters of its own."""
    lines = _lines(spark, path).withColumn("body", strip(F.col("value"))).where("body != ''").withColumn("v", F.try_parse_json("body"))
    uids = F.coalesce(F.try_variant_get("v", "$.relevant_turn_uids", "array<string>"), F.try_variant_get("v", "$.expected_turn_uids", "array<string>"))
    conv = strip(F.try_variant_get("v", "$.conversation_id", "string"))
    request = F.variant_get("v", "$.request", "variant")
    parsed = lines.select(
        "file", "line", "v", strip(F.try_variant_get("v", "$.query", "string")).alias("query"), F.when(conv != "", conv).alias("conversation_id"),
        F.array_distinct(F.filter(F.transform(uids, strip), lambda x: x.isNotNull() & (x != ""))).alias("relevant_turn_uids"),
        F.try_variant_get("v", "$.request", "map<string,string>").alias("request"), F.schema_of_variant(request).alias("kind"),
    )
    reason = (
        F.when(F.col("v").isNull(), F.lit("invalid JSON"))
        .when(F.coalesce(F.col("query"), F.lit("")) == "", F.lit("no query"))
        .when(F.coalesce(F.size("relevant_turn_uids"), F.lit(0)) <= 0, F.lit("no relevant turns"))
        .when(F.col("kind").isNotNull() & ~F.startswith(F.col("kind"), F.lit("OBJECT")) & (F.col("kind") != "VOID"), F.lit("request is no object"))
    )
    judged = parsed.withColumn("reason", reason)
    example_id = F.format_string("example-%06d", F.col("line"))
    valid = judged.where("reason is null").select(example_id.alias("example_id"), "query", "conversation_id", "relevant_turn_uids", "request")
    return Loaded(valid, judged.where("reason is not null").select("file", "line", "reason"))
