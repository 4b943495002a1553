"""Ingesting history as it grows, and recall counts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.jobs.ingest import ingest
from loomgraph.operators.store import commit_merge, stored_beside
from loomgraph.session import settled
from loomgraph.sources.turns import judge_turns
from loomgraph.vocabulary import Chunking, Vocabulary


def stream_turns(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Turns from files of JSON lines as they arrive in a folder, judged as ``read_turns`` judges them: file, value, the turn's
    columns, and the ``reason`` where a line is no turn."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return judge_turns(lines.select(F.col("_metadata.file_path").alias("file"), "value"), ["file"])


def stream_ingest(turns: DataFrame, base: str, checkpoint: str, vocabulary: Vocabulary = Vocabulary(), chunking: Chunking = Chunking()) -> StreamingQuery:
    """Merge each micro-batch of ``stream_turns`` into the graph under ``base``: turns that are stored are skipped, lines that are
    no turns go to ``base``/rejects with their reason, and a batch that is tried again after a failure counts once. Of the stored
    turns only the buckets that a batch falls into are read."""

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = settled(batch)
        batch.where("reason is not null").select("file", "value", "reason").write.mode("overwrite").parquet(f"{base}/rejects/batch={batch_id}")
        whole = batch.where("reason is null").select("conversation_id", "turn_id", "speaker", "text", "timestamp")
        commit_merge(spark, base, ingest(whole, vocabulary, chunking, stored_beside(spark, base, whole)), batch_id)

    return turns.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_recall(log: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append a stream of (turn_uid, query_id, recalled_at) to the recall log under ``path``, each turn once for a query. Repeats
    within ``delay`` of each other are dropped by the stream's state, which the watermark keeps bounded; a recall more than
    ``delay`` older than the newest one of the batches before is late, and is dropped. ``recall_state`` of the log, which counts
    repeats beyond the delay once as well, is then the state of all recalls that were not late."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # tried again, it takes its own place

    once = log.select("turn_uid", "query_id", "recalled_at").withWatermark("recalled_at", delay).dropDuplicatesWithinWatermark(["turn_uid", "query_id"])
    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
