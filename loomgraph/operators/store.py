"""The graph as Parquet tables in versions. Each table is dealt into buckets by a key; a version holds the buckets that it
wrote and a manifest that says in which version's folder each bucket of the graph lies. So a merge reads and writes the buckets
that new rows touch, and all others stay where they are: folders of older versions are part of the newer ones."""

from __future__ import annotations

import json
import uuid
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.graph import Graph, adjacency, merge
from loomgraph.session import settled, shared_dir

NAMES = [f.name for f in fields(Graph)]
#: By which column a table is dealt: rows that a merge may bring together are in one bucket; an edge and its evidence are in
#: buckets of one number; a conversation's turns are in one.
DEALT = {"turns": "conversation_id", "entities": "entity_id", "mentions": "turn_uid", "relations": "source_entity_id", "evidence": "source_entity_id"}
#: Buckets of a new graph; a stored one keeps its number. Raise it so that a bucket is some hundred MB.
BUCKETS = 64
MANIFEST = "name string, bucket int, folder string, buckets int, layout string"


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_graph(graph: Graph, path: str, buckets: int = BUCKETS, kept: list[Row] | None = None) -> None:
    """Write the tables' buckets under ``path`` and a manifest of these and of the ``kept`` ones. Spark evens out the writing
    tasks, so that a large bucket is written as many files."""
    spark = graph.turns.sparkSession
    rows = [tuple(r) for r in kept or []]
    for name in NAMES:
        df = getattr(graph, name).drop("bucket")
        df.withColumn("bucket", bucket(DEALT[name], buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        written = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{name}").select("bucket").distinct()
        layout = df.schema.json()
        rows = [r[:4] + (layout,) if r[0] == name else r for r in rows]
        rows += [(name, k, "", buckets, layout) for k in [-1, *sorted(r[0] for r in written.collect())]]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> list[Row]:
    """The buckets of a graph: name, bucket (-1: the table itself, for its columns), folder beside ``path`` (empty: in it)."""
    return spark.read.parquet(f"{path}/manifest").collect()


def read_graph(spark: SparkSession, path: str, chosen: dict[str, set[int]] | None = None) -> Graph:
    """The graph under ``path``; with ``chosen`` only these buckets of its tables."""
    rows = manifest(spark, path)
    beside = path.rstrip("/").rsplit("/", 1)[0]

    def table(name: str) -> DataFrame:
        own = [r for r in rows if r["name"] == name]
        schema = T.StructType.fromJson(json.loads(own[0]["layout"]))
        wanted = [r for r in own if r["bucket"] >= 0 and (chosen is None or r["bucket"] in chosen.get(name, ()))]
        folders = [f"{beside}/{r['folder']}" if r["folder"] else path for r in wanted]
        paths = [f"{f}/{name}/bucket={r['bucket']}" for f, r in zip(folders, wanted, strict=True)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    return Graph(*[table(name) for name in NAMES])


def stored_conversation(spark: SparkSession, path: str, conversation_id: str) -> DataFrame:
    """The turns of one conversation, from its bucket alone."""
    buckets = manifest(spark, path)[0]["buckets"]
    number = spark.range(1).select(F.lit(conversation_id).alias("c")).select(bucket("c", buckets)).first()[0]
    return read_graph(spark, path, {"turns": {number}}).turns.where(F.col("conversation_id") == conversation_id)


def current_version(spark: SparkSession, base: str) -> int:
    """The newest complete version under ``base``; 0 without any."""
    try:
        rows = spark.read.parquet(f"{base}/versions").agg(F.max("version"), F.count("version"), F.count_distinct("version")).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    if rows[1] != rows[2]:
        raise ValueError(f"two writers have made the same version of {base}")
    return rows[0] or 0


def stored_beside(spark: SparkSession, base: str, turns: DataFrame) -> DataFrame | None:
    """The stored turns of the buckets that ``turns(conversation_id)`` fall into: all that can be the same turns. No other bucket
    is read. None without a graph."""
    now = current_version(spark, base)
    if not now:
        return None
    buckets = manifest(spark, f"{base}/v{now}")[0]["buckets"]
    touched = {r[0] for r in turns.select(bucket(DEALT["turns"], buckets)).distinct().collect()}
    return read_graph(spark, f"{base}/v{now}", {"turns": touched}).turns


def commit_merge(spark: SparkSession, base: str, new: Graph, batch_id: int | None = None, idempotent: bool = False, buckets: int = BUCKETS) -> int:
    """Merge ``new`` into the stored graph, bucket by bucket. A batch id that is recorded already changes nothing, so that a
    batch that is tried again after a failure counts once. One writer at a time: a version that two have made is an error."""
    now = current_version(spark, base)
    if now and batch_id is not None and spark.read.parquet(f"{base}/versions").where(F.col("batch_id") == batch_id).limit(1).count():
        return now
    target = f"{base}/v{now + 1}"
    if now:
        before = manifest(spark, f"{base}/v{now}")
        buckets = before[0]["buckets"]
        new = Graph(*[settled(getattr(new, name)) for name in NAMES])
        touched = {name: {r[0] for r in getattr(new, name).select(bucket(DEALT[name], buckets)).distinct().collect()} for name in NAMES}
        kept = [Row(r["name"], r["bucket"], r["folder"] or f"v{now}", buckets, r["layout"]) for r in before if r["bucket"] >= 0 and r["bucket"] not in touched[r["name"]]]
        write_graph(merge(read_graph(spark, f"{base}/v{now}", touched), new, idempotent), target, buckets, kept)
    else:
        write_graph(new, target, buckets)
    spark.createDataFrame([(now + 1, batch_id)], "version int, batch_id long").write.mode("append").parquet(f"{base}/versions")
    return now + 1


def store_adjacency(relations: DataFrame, cap: int, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """``adjacency(relations, cap)`` as a table bucketed by entity, for all batches of queries: where a hop is joined with it, only
    the hop's frontier is shuffled, and no window over relations is left. The table ``name`` (one of its own, if not given) lies in
    the shared folder."""
    spark = relations.sparkSession
    name = name or f"adjacency_{uuid.uuid4().hex}"
    rows = adjacency(relations, cap).repartition(buckets, "source_entity_id")
    rows.write.bucketBy(buckets, "source_entity_id").sortBy("source_entity_id").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def recall_state(log: DataFrame) -> DataFrame:
    """(turn_uid, recall_count, last_recalled_at) from a log of recalls (turn_uid, recalled_at, query_id)."""
    return log.dropDuplicates(["turn_uid", "query_id"]).groupBy("turn_uid").agg(F.count("*").alias("recall_count"), F.max("recalled_at").alias("last_recalled_at"))


def recall_log(ranked: DataFrame, now: Column) -> DataFrame:
    """What a batch of queries recalls: its ranked turns, each once for a query."""
    return ranked.select("turn_uid", "query_id").distinct().withColumn("recalled_at", now)


def with_recall(turns: DataFrame, state: DataFrame) -> DataFrame:
    kept = turns.drop("recall_count", "last_recalled_at")
    return kept.join(state, "turn_uid", "left").withColumn("recall_count", F.coalesce("recall_count", F.lit(0).cast("bigint")))
