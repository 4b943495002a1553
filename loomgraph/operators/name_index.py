"""A stored index of the letters of all names, so that a batch of names reads only what can match, and a load writes only what
is new.

Segments are only added. A segment has the forms (names and aliases in lower case, numbered, dealt by entity), their runs of one to
three letters as postings (dealt by run), and how many forms each run has. A lookup takes a name's ``KEYS`` rarest runs, intersects
their postings, fetches the forms that are left from their buckets and compares those in full; rows are the same as those of
``graph.match_names``. ``compact`` writes all as one segment."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.graph import first_matches, forms_of, grams
from loomgraph.session import settled

#: Buckets of forms and of postings; raise them with the number of names. Runs of a name that are intersected.
BUCKETS, KEYS = 64, 3

_SEGMENTS = "segment int, folder string, base boolean, form_buckets array<int>, gram_buckets array<int>, buckets int"
_FORMS = "entity_id string, canonical_name string, form string, form_no long"
_GRAMS = "key string, form_bucket int, form_no long"
_COUNTS = "key string, n long"


@dataclass(frozen=True)
class NameIndex:
    """An index under ``path``; one writer at a time."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def segments(self) -> list[Row]:
        """The segments that count, oldest first: from the last base on."""
        try:
            rows = sorted(self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments").collect(), key=lambda r: r["segment"])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        if len({r["segment"] for r in rows}) < len(rows):
            raise ValueError(f"two writers have added the same segment to {self.path}")
        return rows[max((i for i, r in enumerate(rows) if r["base"]), default=0) :]

    def table(self, segments: list[Row], name: str, schema: str, chosen: set[int] | None = None) -> DataFrame:
        """Forms, grams or counts of the segments, with ``segment`` and ``bucket``; with ``chosen`` only these buckets are read."""
        parts = []
        for r in segments:
            there = set(r["form_buckets"] if name == "forms" else r["gram_buckets"])
            for k in sorted(there if chosen is None else there & chosen):
                parts.append((r["segment"], k, f"{self.path}/{r['folder']}/{name}/bucket={k}"))
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, segment int, bucket int")
        # The folder tells segment and bucket: one scan for all of them.
        read = self.spark.read.schema(schema).parquet(*[p for _, _, p in parts])
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)-[0-9a-f]{32}/[a-z]+/bucket=(\d+)/[^/]*$", 1)
        bucket = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/[^/]*$", 1)
        return read.select("*", at.cast("int").alias("segment"), bucket.cast("int").alias("bucket"))

    def in_bucket(self, segments: list[Row], key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(segments[0]["buckets"] if segments else self.buckets)).cast("int")


def _touched(df: DataFrame, bucket: Column) -> set[int]:
    """The buckets of some rows: at most as many as an index has."""
    return {r[0] for r in df.select(bucket.alias("b")).distinct().collect()}


def _write_segment(index: NameIndex, known: list[Row], forms: DataFrame, base: bool) -> int:
    segment = known[-1]["segment"] + 1 if known else 1
    folder = f"{segment}-{uuid.uuid4().hex}"
    path = f"{index.path}/{folder}"
    dealt = forms.withColumn("bucket", index.in_bucket(known, "entity_id")).hint("rebalance", "bucket")
    # Numbers are made in the tasks that write, and read back from what they wrote.
    dealt.withColumn("form_no", F.monotonically_increasing_id()).write.partitionBy("bucket").parquet(f"{path}/forms")
    form_buckets = _touched(forms, index.in_bucket(known, "entity_id"))
    written = index.spark.read.schema(_FORMS + ", bucket int").parquet(f"{path}/forms") if form_buckets else forms.withColumns({"form_no": F.lit(0).cast("long"), "bucket": F.lit(0)})
    runs = F.array_distinct(F.concat(grams(F.col("form"), 1), grams(F.col("form"), 2), grams(F.col("form"), 3)))
    rows = written.select(F.explode(runs).alias("key"), F.col("bucket").alias("form_bucket"), "form_no").withColumn("bucket", index.in_bucket(known, "key"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/grams")
    gram_buckets = _touched(rows, F.col("bucket"))
    if gram_buckets:
        counted = index.spark.read.schema(_GRAMS + ", bucket int").parquet(f"{path}/grams").groupBy("bucket", "key").agg(F.count("*").alias("n"))
        counted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/counts")
    buckets = known[0]["buckets"] if known else index.buckets
    row = (segment, folder, base, sorted(form_buckets), sorted(gram_buckets), buckets)
    index.spark.createDataFrame([row], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{index.path}/segments")  # from here on it counts
    return segment


def add(index: NameIndex, entities: DataFrame) -> int:
    """Add the forms of ``entities(entity_id, canonical_name, aliases)`` that are not there yet as a segment, and give its number.
    Only the buckets that these entities fall into are read. An entity keeps the name it had first, as in ``merge_entities``; rows
    without an id or without a name are left out."""
    known = index.segments()
    forms = settled(forms_of(entities.where("entity_id is not null and canonical_name is not null")))
    near = index.table(known, "forms", _FORMS, _touched(forms, index.in_bucket(known, "entity_id")))
    new = forms.join(near.select("entity_id", "form"), ["entity_id", "form"], "left_anti")
    return _write_segment(index, known, settled(new.select("entity_id", "canonical_name", "form")), False)


def compact(index: NameIndex) -> int:
    """Write all forms as one segment, from which on the index counts."""
    known = index.segments()
    return _write_segment(index, known, settled(index.table(known, "forms", _FORMS).select("entity_id", "canonical_name", "form")), True)


def match(index: NameIndex, names: DataFrame, limit: int) -> DataFrame:
    """(name, entity_id, canonical_name, exact, place): what ``graph.match_names`` gives, from the index. A name of at most three
    letters is one run; an empty name is in all forms, which are read for it."""
    known = index.segments()
    own = names.select("name").where("name is not null").distinct().withColumn("low", F.lower("name"))
    runs = settled(own.select("name", "low", F.explode_outer(F.when(F.char_length("low") > 3, F.array_distinct(grams(F.col("low"), 3))).when(F.col("low") != "", F.array("low"))).alias("key")))
    asked = runs.where("key is not null")
    counts = index.table(known, "counts", _COUNTS, _touched(asked, index.in_bucket(known, "key"))).groupBy("key").agg(F.sum("n").alias("n"))
    # A run that no form has rules its name out; else the rarest are chosen.
    counted = asked.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("name").orderBy("n", "key")
    chosen = settled(counted.withColumn("least", F.min("n").over(W.partitionBy("name"))).where("least > 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= KEYS).select("name", "low", "key"))
    of_each = chosen.groupBy("name", "low").agg(F.count("*").alias("wanted"))
    postings = index.table(known, "grams", _GRAMS, _touched(chosen, index.in_bucket(known, "key"))).drop("bucket")
    hits = postings.join(chosen.select("name", "key"), "key").groupBy("name", "segment", "form_bucket", "form_no").agg(F.count("*").alias("got"))
    left = settled(hits.join(of_each, "name").where("got = wanted").select("name", "low", "segment", F.col("form_bucket").alias("bucket"), "form_no"))
    forms = index.table(known, "forms", _FORMS, _touched(left, F.col("bucket")))
    found = [forms.join(left, ["segment", "bucket", "form_no"]).where(F.contains("form", F.col("low"))).select("name", "entity_id", "canonical_name")]
    if runs.where("key is null").limit(1).count():  # one empty name at most
        found.append(index.table(known, "forms", _FORMS).select(F.lit("").alias("name"), "entity_id", "canonical_name"))
    return first_matches(reduce(DataFrame.unionByName, found).distinct(), limit)
