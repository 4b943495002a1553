"""Every registered query on a small folder of tables: its columns, types and digests against plain computations."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("loomgraph.llm")

import public_tokenizers

from loomgraph.llm import lz_fingerprint, queries
from loomgraph.llm.common import mix64, segment_hashes

WORDS = {"en": "the of and that with this from have been were".split(), "de": "der die und nicht sich eine auch schon über wäre".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    out = str(tmp_path_factory.mktemp("tables"))
    shared = "A line of more than twenty signs that many hold"
    docs, labels = [], []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 60))] + ["moron scum"] * (i % 7 == 0)
        docs.append((i, " ".join(words) + ("\n" + shared.upper() if i % 5 == 0 else ""), lang, "s", 1))
        labels.append((i, 1, int(i % 7 == 0)))
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "\n \n", "en", "s", 3), (103, docs[1][1], "en", "s", 1), (104, "日本語 🙂 " * 50, "en", "s", 1), (105, "one two " * 6000, "en", "s", 1)]
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<html><body><nav>Menu</nav><article><h1>T {i}</h1><p>Text &amp; {i}</p></article></body></html>") for i in range(12)]
    pages += [(20, None, None), (21, "http://h0.example/21", pages[3][2])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out, {r[0]: r[1] or "" for r in docs}, {r[0]: r[2] or "" for r in pages}


def run(spark, folder, name, types):
    df = queries.queries()[name](spark, folder[0])
    found = dict(df.dtypes)
    assert {k: found[k] for k in types} == types
    return [r.asDict() for r in df.collect()]


def test_classifiers(spark, folder):
    for name, n, key, types in (("op1_language_id", 4, 2, {"lang_pred": "string", "score": "double", "held_out": "boolean"}), ("op3_toxicity", 5, 0, {"predicted": "int", "score": "double", "held_out": "boolean"})):
        rows = run(spark, folder, name, types)
        assert {r["doc_id"] for r in rows} == set(folder[1]) and len(rows) == len(folder[1])
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == key) and 0 <= r["score"] <= 1
            if "predicted" in r:
                assert r["predicted"] == int(r["score"] >= 0.5)
            else:
                assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in folder[1][r["doc_id"]]))


def test_tokens(spark, folder):
    import tiktoken
    from tokenizers import Tokenizer

    from loomgraph.llm import byte_bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS_PATH), special_tokens={})
    for r in run(spark, folder, "op4_byte_bpe", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}):
        ids = own.encode_ordinary(folder[1][r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(folder[1][r["doc_id"]].encode()).hexdigest()
    library = Tokenizer.from_file(queries.WORD_BPE_PATH)
    rows = run(spark, folder, "op5_best_fit_packing", {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    bins = defaultdict(list)
    for r in rows:
        ids = library.encode(folder[1][r["doc_id"]], add_special_tokens=False).ids + [1]
        part = ids[r["start"] : r["start"] + 4096]
        assert r["start"] == 4096 * r["piece"] and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in folder[1].values())
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)][:-1]]).tolist() and sum(n for _, n in own) <= 4096


def test_lines_media_and_copies(spark, folder):
    docs = folder[1]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    for r in run(spark, folder, "op6_line_dedup", {"n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}):
        lines = docs[r["doc_id"]].split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    features = {}
    for r in run(spark, folder, "op7_media_columns", {"n_bytes": "bigint", "payload_bytes": "bigint", "media_bytes": "bigint", "feature": "string"}):
        data = docs[r["doc_id"]].encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) and r["feature"]
        assert features.setdefault(data, (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
    rows = {r["doc_id"]: r for r in run(spark, folder, "op8_minhash_dedup", {"n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})}
    assert rows[103]["component_id"] == rows[1]["component_id"] and not rows[103]["kept"] and rows[102]["n_shingles"] == 0 and rows[102]["kept"]


def plain_fingerprint(text):
    """Phrases by a plain parse, each hashed by itself; the 96 smallest."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    if now:
        phrases.add(now)
    h = [int(mix64(segment_hashes(np.array([ord(c) for c in p], np.int64), np.array([0]), np.array([len(p)])))[0]) >> 32 for p in phrases]
    return sorted(set(h))[:96]


def test_fingerprints(spark, folder):
    docs = folder[1]
    order = sorted(docs, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for r in run(spark, folder, "op9_lz_fingerprint", {"n_chars": "bigint", "fingerprint": "string", "near_edited": "double", "near_next": "double"}):
        t, nxt = docs[r["doc_id"]], docs[following[r["doc_id"]]]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, got in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert got == lz_fingerprint.encoded(np.array(plain_fingerprint(text), np.uint32))
        for near, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            a, b = plain_fingerprint(t), plain_fingerprint(other)
            both = sorted(set(a) | set(b))[:96]
            assert near == pytest.approx(sum(x in a and x in b for x in both) / len(both) if both else 1.0)


def test_pages(spark, folder):
    pages = folder[2]
    want = {i: f"T {i}\nText & {i}" if i < 20 else "" for i in pages} | {21: "T 3\nText & 3"}
    for r in run(spark, folder, "op2_html_extraction", {"text": "string", "n_chars": "bigint"}):
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in run(spark, folder, "op10_warc", {"payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}):
        data = pages[r["page_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and re.fullmatch("response|revisit", r["record_type"])
        assert r["refers_to"] == (None if first[pages[r["page_id"]]] == r["page_id"] else first[pages[r["page_id"]]])
