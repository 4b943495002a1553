"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, collocations, html_extract, lang_id, line_dedup, lz_fingerprint, media, minhash, packing, top_k, toxicity, warc, whitening
from loomgraph.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]

#: Where the public vocabularies are; every machine that runs tasks has them there.
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE_PATH = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return lang_id.identify(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_extract.extract(pages, html_extract.infer_wrappers(pages))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, net).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS_PATH, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE_PATH, ids=False))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"))
    pair = F.zip_with("times", "codes", lambda t, c: F.concat(F.hex(t), F.lit("."), F.hex(c)))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(pair, ",").alias("feature"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, similar=80)


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, files, folder, payload=False).drop("url")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"), least=100, share=100, most=2000)
    return found.withColumn("rank", F.col("rank").cast("long"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation as long)"))


def queries() -> dict[str, Query]:
    found = (
        op1_language_id, op2_html_extraction, op3_toxicity, op4_byte_bpe, op5_best_fit_packing, op6_line_dedup, op7_media_columns, op8_minhash_dedup, op9_lz_fingerprint, op10_warc,
        op11_exact_top_k, op12_collocations, op13_whitening,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM keyed l LEFT JOIN shared s ON l.k = s.k AND length(l.k) >= 20)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w
        ), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.c + y.c - p.c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
        f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d JOIN f USING (hex)
    """,
    "op11_exact_top_k": """
        WITH v AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CASE WHEN len(c.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place AND len(q.e) = len(c.e))
        SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY place ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op12_collocations": f"""
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM piece),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        g AS ({' UNION ALL '.join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) AS phrase FROM w WHERE len(ws) >= {k}" for k in range(1, 6))}),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        cut AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
        part AS (SELECT *, array_to_string(ws[1:c], ' ') AS lp, array_to_string(ws[c + 1:k], ' ') AS rp FROM cut),
        s AS (SELECT part.lang, part.k, part.phrase, a, c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM part JOIN n USING (lang) JOIN f x ON x.lang = part.lang AND x.phrase = lp JOIN f y ON y.lang = part.lang AND y.phrase = rp),
        low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_ AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT DISTINCT lang, k, phrase, a, ws, unnest(range(2, k)) AS j FROM cut)) GROUP BY ALL)
        SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
        WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
    """.replace("\\\\", "\\"),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
