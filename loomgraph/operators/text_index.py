"""A stored full-text index that answers many queries at once and reads only the postings that can matter.

An index is a folder of segments; a load of turns adds one, and nothing that is stored is written again. In a segment, turns are
dealt into shards of bounded size, and numbered within a shard by length: short turns, which weigh more, come first. The postings of
a term in a shard are cut into blocks of ``BLOCK``; as a block's turns are about as long, its highest term frequency and shortest
length bound the weight of all of them closely, whatever the statistics of the whole index have become since.

A search takes each shard by itself. The ends of the blocks of a query's terms cut the shard into ranges, each with the sum of its
blocks' bounds; ranges are worked on from the highest bound down, reading the blocks that cover them, until no range left can reach
the query's limit. A block of a rare term spans many turns that it does not hold; it is read at once, and bounds its own turns
only. The cut is safe: rows are the same as those of ``lexical.search``. Frequent terms have low bounds, so most of their blocks
are never read.

Turns that come again replace the stored ones: their old numbers are recorded as dead, and what they counted is taken off the
statistics. ``compact`` writes all live postings as one segment, which the later ones follow.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import search_terms
from loomgraph.operators.lexical import B, K1
from loomgraph.operators.settings import first_of_each
from loomgraph.session import settled

#: Turns of a shard and postings of a block; buckets that terms are stored in; queries that are answered together.
SHARD, BLOCK, BUCKETS, GROUP = 1 << 16, 128, 64, 1024
#: Copies of the asked terms that the join with blocks is dealt over: one term may have a block in every shard.
SALTS = 16
#: A block is read at once, and bounds its own turns only, if it has fewer than one in so many of the turns that it spans.
SPARSE = 8
#: Scores are compared after rounding to this many places.
PLACES = 9

_SEGMENTS = "segment int, folder string, base boolean, docs long, length long"
_BLOCKS = "shard int, term string, block int, n int, first int, last int, max_tf int, min_len int, places array<int>, tfs array<int>, lens array<int>, bucket int"
_DOCS = "turn_uid string, len int, shard int, place int"
_DEAD = "segment int, shard int, place int"
_COUNTS = "term string, n long, bucket int"


@dataclass(frozen=True)
class TextIndex:
    """An index under ``path``."""

    spark: SparkSession
    path: str

    def segments(self) -> list:
        """The segments that count, oldest first: from the last base on."""
        try:
            rows = sorted(self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments").collect(), key=lambda r: r["segment"])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        if len({r["segment"] for r in rows}) < len(rows):
            raise ValueError(f"two writers have added the same segment to {self.path}")
        base = max((i for i, r in enumerate(rows) if r["base"]), default=0)
        return rows[base:]

    def table(self, name: str, schema: str) -> DataFrame:
        """One of the tables over all segments that count, with the column ``segment`` unless it has it."""
        out = None
        for r in self.segments():
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{r['folder']}/{name}")
            df = df if "segment" in df.columns else df.withColumn("segment", F.lit(r["segment"]))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], schema + ("" if "segment" in schema else ", segment int"))

    def statistics(self) -> tuple[int, float]:
        """How many turns there are, and how many terms one has on average."""
        rows = self.segments()
        docs, length = sum(r["docs"] for r in rows), sum(r["length"] for r in rows)
        return docs, length / docs if docs else 0.0


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write_segment(index: TextIndex, docs: DataFrame, postings: DataFrame, base: bool, replaced: tuple[int, int, DataFrame | None], dead: DataFrame | None) -> int:
    """Write a segment of ``docs(turn_uid, len)`` with ``postings(turn_uid, term, tf)``. ``replaced``: how many turns, how many
    terms and which counts of terms are to be taken off; ``dead``: where the replaced turns are."""
    spark, known = index.spark, index.segments()
    segment = known[-1]["segment"] + 1 if known else 1
    folder = f"{segment}-{uuid.uuid4().hex}"
    path = f"{index.path}/{folder}"
    docs = settled(docs)
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
    shards = max(1, -(-total["n"] // SHARD))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("turn_uid"), F.lit(shards)).cast("int"))
    place = F.row_number().over(W.partitionBy("shard").orderBy("len", "turn_uid")) - 1
    dealt.withColumn("place", place).select("turn_uid", F.col("len").cast("int").alias("len"), "shard", "place").write.parquet(f"{path}/docs")
    numbered = spark.read.schema(_DOCS).parquet(f"{path}/docs")
    rows = postings.join(numbered, "turn_uid").groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("place", F.col("tf").cast("int").alias("tf"), "len"))).alias("all"))
    cut = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int")))).withColumn("p", F.slice("all", F.col("block") * BLOCK + 1, F.lit(BLOCK)))
    field = lambda name: F.transform("p", lambda x: x[name])
    blocks = cut.select(
        "shard", "term", "block", F.size("p").alias("n"), F.element_at("p", 1)["place"].alias("first"), F.element_at("p", -1)["place"].alias("last"), F.array_max(field("tf")).alias("max_tf"),
        F.array_min(field("len")).alias("min_len"), field("place").alias("places"), field("tf").alias("tfs"), field("len").alias("lens"), _bucket("term").alias("bucket"),
    )
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "shard", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    counts = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("n"))
    if replaced[2] is not None:
        counts = counts.unionByName(replaced[2].select("term", (-F.col("n")).alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
    counts.withColumn("bucket", _bucket("term")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
    (dead if dead is not None else spark.createDataFrame([], _DEAD)).write.parquet(f"{path}/dead")
    row = (segment, folder, base, total["n"] - replaced[0], total["length"] - replaced[1])
    spark.createDataFrame([row], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{index.path}/segments")  # from here on it counts
    return segment


def _terms(turns: DataFrame) -> DataFrame:
    return turns.select("turn_uid", search_terms(F.coalesce("text", F.lit(""))).alias("terms"))


def add(index: TextIndex, turns: DataFrame, stored: DataFrame | None = None) -> int:
    """Add ``turns(turn_uid, text)``, one row of each uid, as a segment, and give its number. ``stored``: the turns in the index,
    of which those that come again are replaced."""
    terms = _terms(turns)
    docs = terms.select("turn_uid", F.size("terms").alias("len"))
    postings = terms.select("turn_uid", F.explode("terms").alias("term")).groupBy("turn_uid", "term").agg(F.count("*").alias("tf"))
    replaced, dead = (0, 0, None), None
    if stored is not None and index.segments():
        old = settled(_terms(stored.join(turns.select("turn_uid"), "turn_uid", "left_semi")))
        known = old.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("length")).first()
        counts = old.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        replaced = known["n"], known["length"], counts
        dead = live_docs(index).join(old.select("turn_uid"), "turn_uid", "left_semi").select("segment", "shard", "place")
    return _write_segment(index, docs, postings, False, replaced, dead)


def live_docs(index: TextIndex) -> DataFrame:
    """(turn_uid, len, segment, shard, place) of the turns in the index."""
    return index.table("docs", _DOCS).join(index.table("dead", _DEAD), ["segment", "shard", "place"], "left_anti")


def live_postings(index: TextIndex) -> DataFrame:
    """(term, turn_uid, tf, len), as ``lexical.postings`` of the turns in the index."""
    rows = index.table("blocks", _BLOCKS).select("segment", "shard", "term", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
    return rows.select("segment", "shard", "term", "p.places", "p.tfs").withColumnsRenamed({"places": "place", "tfs": "tf"}).join(live_docs(index), ["segment", "shard", "place"]).select("term", "turn_uid", "tf", "len")


def compact(index: TextIndex) -> int:
    """Write all that is live as one segment, which is the base of those to come."""
    return _write_segment(index, live_docs(index).select("turn_uid", "len"), live_postings(index).select("turn_uid", "term", "tf"), True, (0, 0, None), None)


# -- search -----------------------------------------------------------------------------------------------------------------


def weight(idf, tf, length, average):
    """BM25 of a term in a turn."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class Shard:
    """The blocks of asked terms in one shard."""

    def __init__(self, blocks: pa.Table, average: float):
        self.average = average
        take = lambda c: blocks.column(c).to_numpy()
        self.first, self.last, self.n, self.max_tf, self.min_len = (take(c).astype(np.int64) for c in ("first", "last", "n", "max_tf", "min_len"))
        self.lists = [blocks.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "tfs", "lens")]
        self.ends = np.cumsum(self.n)
        self.rows: dict[str, list[int]] = {}
        for i, term in enumerate(blocks.column("term").to_pylist()):
            self.rows.setdefault(term, []).append(i)
        self.dead = self.lists[0][self.ends[i] - self.n[i] : self.ends[i]] if (i := self.rows.pop(None, [None])[0]) is not None else None
        self.rows = {t: np.array(sorted(own, key=lambda i: self.first[i])) for t, own in self.rows.items()}
        self.size = int(self.last.max(initial=-1)) + 1

    def best(self, terms: list[str], idfs: list[float], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(places, scores) of the ``k`` highest scores, with all that may tie for the last; how many postings were read, and how
        many there are. Among turns of one length, those of lower numbers have the smaller uids."""
        own = [(idf, self.rows[t]) for t, idf in zip(terms, idfs, strict=True) if t in self.rows]
        rows = np.concatenate([rows for _, rows in own]) if own else np.zeros(0, np.int64)
        if not len(rows):
            return rows, np.zeros(0), 0, 0
        idf = np.concatenate([np.full(len(rows), idf) for idf, rows in own])
        postings = int(self.n[rows].sum())
        scores, lengths, seen = np.zeros(self.size), np.zeros(self.size, np.int64), np.zeros(self.size, bool)

        def take(i: int) -> tuple[np.ndarray, np.ndarray]:
            """Read a block, and add its weights to the scores."""
            at = slice(self.ends[rows[i]] - self.n[rows[i]], self.ends[rows[i]])
            places, weights = self.lists[0][at], weight(idf[i], self.lists[1][at], self.lists[2][at], self.average)
            scores[places] += weights
            lengths[places] = self.lists[2][at]
            return places, weights

        sparse = self.last[rows] - self.first[rows] >= SPARSE * self.n[rows]
        known = [take(i) for i in np.flatnonzero(sparse)]
        read = int(self.n[rows[sparse]].sum())
        rows, idf = rows[~sparse], idf[~sparse]
        points = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in known]])
        begin, end = np.append(self.first[rows], points), np.append(self.last[rows], points) + 1
        bounds = np.concatenate([weight(idf, self.max_tf[rows], self.min_len[rows], self.average), *[w for _, w in known]])
        edges = np.unique(np.concatenate([begin, end]))
        change = np.zeros(len(edges))
        np.add.at(change, np.searchsorted(edges, begin), bounds)
        np.add.at(change, np.searchsorted(edges, end), -bounds)
        reach = np.cumsum(change)[:-1]
        begin, end = np.searchsorted(edges, self.first[rows]), np.searchsorted(edges, self.last[rows] + 1)
        order = np.argsort(-reach, kind="stable")
        unread, low, step, done = np.ones(len(rows), bool), -np.inf, 16, 0
        while done < len(order) and reach[order[done]] + 1e-7 >= low:
            now = np.sort(order[done : done + step])
            done, step = done + step, step * 2
            covered = np.zeros(len(edges), np.int64)  # of the ranges up to each, how many are worked on now
            covered[now + 1] = 1
            covered = np.cumsum(covered)
            wanted = np.flatnonzero(unread & (covered[end] > covered[begin]))
            unread[wanted] = False
            read += int(self.n[rows[wanted]].sum())
            for i in wanted:
                take(i)
            width = edges[now + 1] - edges[now]
            seen[np.repeat(edges[now] - (np.cumsum(width) - width), width) + np.arange(width.sum())] = True
            if self.dead is not None:
                seen[self.dead] = False
            found = scores[seen]
            if len(found) > k:
                low = np.partition(found, len(found) - k)[len(found) - k]
        at = np.flatnonzero(seen & (scores > 0))
        value = np.round(scores[at], PLACES)
        if len(at) > k:
            cut = np.partition(value, len(value) - k)[len(value) - k]
            at, value = at[value >= cut], value[value >= cut]
            # Of ties of one length the first k are enough.
            by = np.lexsort((at, lengths[at], value > cut))
            group = lengths[at][by] * 2 + (value[by] > cut)
            head = np.concatenate([[True], group[1:] != group[:-1]])
            nth = np.arange(len(by)) - np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            stay = by[nth < k]
            at, value = at[stay], value[stay]
        return at, value, read, postings


def search(index: TextIndex, queries: DataFrame, limit: int | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, turn_uid, lexical_raw) of the ``limit`` turns with the highest BM25 scores of each ``queries(query_id, query)``,
    and (query_id, read, postings): how many postings were read for it, of how many that its terms have. A query may have a limit
    of its own, in (query_id, most)."""
    spark = index.spark
    highest = limit if isinstance(limit, int) else limit.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    kind = dict(queries.dtypes)["query_id"]
    docs, average = index.statistics()
    asked = settled(queries.select("query_id", F.explode(F.array_distinct(search_terms(F.coalesce("query", F.lit(""))))).alias("term")))
    if not docs or not average:
        return spark.createDataFrame([], f"query_id {kind}, turn_uid string, lexical_raw double"), spark.createDataFrame([], f"query_id {kind}, read long, postings long")
    buckets = [r[0] for r in asked.select(_bucket("term").alias("b")).distinct().collect()]  # BUCKETS at most
    counts = index.table("counts", _COUNTS).where(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = counts.select("term", F.log(F.lit(1.0) + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    groups = max(1, -(-queries.count() // GROUP))
    known = settled(asked.join(idf, "term").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")))
    spread = known.select("term", "group").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = index.table("blocks", _BLOCKS).where(F.col("bucket").isin(buckets)).withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
    keys = ["segment", "shard", "group"]
    columns = ["term", "first", "last", "n", "max_tf", "min_len", "places", "tfs", "lens"]
    there = blocks.join(spread, ["term", "salt"]).select(*keys, *columns)
    dead = index.table("dead", _DEAD).groupBy("segment", "shard").agg(F.sort_array(F.collect_list("place")).alias("places"))  # a shard's at most
    none, zero = F.lit(None).cast("string"), F.lit(0)
    gone = dead.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        *keys, none.alias("term"), zero.alias("first"), F.lit(-1).alias("last"), F.size("places").alias("n"), zero.alias("max_tf"), zero.alias("min_len"), "places",
        F.transform("places", lambda x: F.lit(0)).alias("tfs"), F.transform("places", lambda x: F.lit(0)).alias("lens"),
    )
    shards = index.table("docs", _DOCS).select("segment", "shard").distinct().withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    packed = known.groupBy("group").agg(F.collect_list(F.struct("query_id", "term", "idf")).alias("asked"))  # GROUP queries, about
    sent = shards.join(packed, "group").select(*keys, "asked")
    out = pa.schema([("query_id", pa.int64() if kind == "bigint" else pa.string()), ("segment", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("score", pa.float64()), ("read", pa.int64()), ("postings", pa.int64())])

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            shard = Shard(left, average)
            own: dict[object, list[tuple]] = {}
            for x in sorted(right.column("asked")[0].as_py(), key=lambda x: x["term"]):
                own.setdefault(x["query_id"], []).append((x["term"], x["idf"]))
            segment, number = key[0].as_py(), key[1].as_py()
            for query, terms in own.items():
                places, scores, read, postings = shard.best([t for t, _ in terms], [i for _, i in terms], highest)
                query = query if kind == "bigint" else str(query)
                rows.append((query, segment, number, -1, 0.0, read, postings))
                rows += [(query, segment, number, int(p), float(s), 0, 0) for p, s in zip(places, scores, strict=True)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    kinds = f"query_id {'long' if kind == 'bigint' else 'string'}, segment int, shard int, place int, score double, read long, postings long"
    found = settled(sent.groupBy(*keys).cogroup(there.unionByName(gone).groupBy(*keys)).applyInArrow(lambda key, left, right: answer(key, right, left), kinds).withColumn("query_id", F.col("query_id").cast(kind)))
    reading = found.where("place < 0").groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))
    # The first of every shard by score; what ties for the last place is cut by uid.
    near = found.where("place >= 0").withColumn("_nth", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_nth") <= highest)
    named = near.join(index.table("docs", _DOCS).select("segment", "shard", "place", "turn_uid"), ["segment", "shard", "place"])
    hits = first_of_each(named, [F.desc("score"), "turn_uid"], limit).select("query_id", "turn_uid", F.col("score").alias("lexical_raw"))
    return hits, reading
