"""Exact search, collocations and whitening against plain computations."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomgraph.llm")

from loomgraph.llm import collocations, queries, top_k, whitening

VECTORS = "vec_id long, embedding array<double>, score string, rank int, uid string, v int, lang string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "u", 1, "x") for i, v in rows], VECTORS)


def plain_top(rows, asked, k, scale):
    """(query_id, rank, vec_id, score), rows told apart by their place."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is None or not asked(i):
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(fine) if a != b and len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, min(max(s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(40)]) for i in range(300)]
    common = rows[7][1]
    rows += [(400 + i, common) for i in range(40)] + [(5, rows[3][1]), (10, rows[10][1]), (None, common), (None, rows[20][1])]
    rows += [(500, None), (505, [None] * 40), (510, [0.1, float("nan")] * 20), (515, [float("inf")] * 40), (520, [1e307] * 40), (525, []), (526, []), (530, [0.5, 1.5]), (531, [-2.0, 0.25]), (535, [1.0])]
    found = top_k.exact_top_k(vectors_of(spark, rows), F.col("vec_id") % 5 == 0, 5, 256)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(rows, lambda i: i % 5 == 0, 5, 256)
    huge = [(i, [10.0 ** rng.randint(0, 30) * rng.choice([-1, 1]) for _ in range(6)]) for i in range(30)]
    assert sorted(map(tuple, top_k.exact_top_k(vectors_of(spark, huge), F.col("vec_id") < 9, 3).collect()), key=str) == plain_top(huge, lambda i: i < 9, 3, 256)
    assert top_k.exact_top_k(vectors_of(spark, []), F.lit(True)).count() == 0
    assert top_k.exact_top_k(vectors_of(spark, rows[:3]), F.lit(False)).count() == 0


def test_branch_and_bound_drops_none():
    rng = np.random.default_rng(2)
    for spread in (3, 100):
        numbers = np.sort(rng.integers(-spread, spread, (64, 5000)).astype(float), axis=0) if spread == 100 else rng.integers(-spread, spread, (64, 5000)).astype(float)
        squares = numbers * numbers
        for own in (-1, 0, 4999, 77):
            query = rng.integers(-spread, spread, 64).astype(float)
            at, total = top_k.best(query, numbers, squares, squares.sum(axis=0), own, 5, -np.inf)
            every = query @ numbers
            order = [i for i in np.argsort(-every, kind="stable") if i != own][:5]
            assert at.tolist() == order and total.tolist() == every[order].tolist()


def plain_collocations(rows, least, share, most):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least}
    out = []
    for lang in totals:
        scored = []
        for (own, p), a in frequent.items():
            if own != lang or len(p) < 2:
                continue
            inside = [n for (o, q), n in frequent.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= share * a for n in inside):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (frequent[lang, p[:c]] * frequent[lang, p[c:]]), c, frequent[lang, p[:c]], frequent[lang, p[c:]]) for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def test_collocations(spark):
    rng = random.Random(4)
    names = ["The", "of", "Ünd", "日本", "x" * 300, "a", "B", "c-d", "e f", "new", "york"]
    texts = []
    for i in range(120):
        words = [rng.choice(names) for _ in range(rng.randint(0, 80))]
        texts.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"]) for w in words) + "New York City", rng.choice(["en", "de", None, "und", ""])))
    texts += [(None, "en"), ("", None), (" \t\n", "en"), ("one", "fr"), (texts[0][0], texts[0][1]), ("Of the " * 3000 + "end", "de"), ("of", "en"), ("the", "en")]
    df = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in texts], "text string, lang string, n int, phrase string, words int")
    for least, share, most in ((5, 100, 2000), (8, 60, 10), (2, 100, 2000)):
        found = collocations.collocations(df, least, share, most, width=1 << 20)
        assert sorted(map(tuple, found.collect())) == plain_collocations(texts, least, share, most)
    assert collocations.collocations(df.limit(0), 2).count() == 0


def test_long_texts_in_segments(monkeypatch):
    """Phrases are the same however texts are cut into segments, and a piece longer than a segment stays whole."""
    text = "aa bb cc, dd ee\nff " * 40 + "x y " * 200
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["one two", None, text, "", "three"]), "lang": pa.array(["a", None, None, "b", "a"])})

    def seen():
        out = Counter()
        for words, names in collocations.segments(batch):
            every = np.full(1 << 18, 255, np.uint8)
            for k, at, n in collocations.survivors(words, every):
                out.update(dict(zip([(names[g], p) for g, p in zip(words.lang[at], words.phrases(at, k).to_pylist())], n.tolist())))
        return out

    whole = seen()
    monkeypatch.setattr(collocations, "SEGMENT", 50)
    assert seen() == whole and whole["a", "one two"] == 1 and whole["und", "x y x y x"] == 198 and ("a", "two three") not in whole


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    hashes = rng.zipf(1.3, 200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = collocations.Sketch(1 << 10, 100), collocations.Sketch(1 << 10, 100)
    a.add(hashes[:90_000])
    b.add(hashes[90_000:])
    cells = np.minimum(a.cells + b.cells, 100)
    bits = np.packbits(cells.reshape(-1) >= 100)
    values, n = np.unique(hashes, return_counts=True)
    assert collocations.passing(values, bits)[n >= 100].all()
    for row in range(collocations.ROWS):
        assert (cells[row, a.places(values, row)] >= np.minimum(n, 100)).all()


def test_exact_scores(spark):
    """Products far beyond 64 bits."""
    rows = [("l", 0, "", 9 * 10**15), ("l", 1, "a", 7 * 10**14 + 1), ("l", 1, "b", 7 * 10**14 + 3), ("l", 2, "a b", 5 * 10**14 + 7)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).first()
    assert got["score"] == 1000 * rows[3][3] * rows[0][3] // (rows[1][3] * rows[2][3])


def plain_whitening(rows):
    length = Counter(len(v) for _, v in rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return length, n, [int(((n * r - s) ** 2).sum()) for r in x], c, e[::-1], u[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) + 3).tolist()) for i in range(200)]
    rows += [(3, rows[3][1]), (None, rows[5][1])]
    odd = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("-inf")] * 12), (904, [1e300] * 12), (905, []), (906, [1.0, 2.0])]
    df = vectors_of(spark, rows + odd)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    _, n, far, c, e, u = plain_whitening(rows)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n} and sorted({r["component"] for r in got}) == list(range(1, 9))
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(far)
    for k in range(8):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        plain = c @ u[:, k] / math.sqrt(e[k])
        own = np.array([mine[i] for i, _ in rows])
        assert min(np.abs(own - plain).max(), np.abs(own + plain).max()) < 1e-6
        assert next(r["explained"] for r in got if r["component"] == k + 1) == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, []), whitening.fit(vectors_of(spark, []))).count() == 0
    one = vectors_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    for r in whitening.whiten(one, whitening.fit(one)).collect():
        assert (int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) == (0, 0.0, 0.0, 0.0)
    rows = [(i, [float(2**50 - i), float(i), -float(i * i)]) for i in range(50)]
    large = vectors_of(spark, rows)
    got = whitening.whiten(large, whitening.fit(large)).collect()
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(plain_whitening(rows)[2])


def test_queries(spark, tmp_path):
    rng = np.random.default_rng(7)
    spark.createDataFrame([(i, rng.normal(size=8).tolist(), 1) for i in range(160)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    text = "The quick fox, the quick fox. " * 30
    spark.createDataFrame([(i, text, "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    made = {n: queries.queries()[n](spark, str(tmp_path)) for n in ("op11_exact_top_k", "op12_collocations", "op13_whitening")}
    assert dict(made["op11_exact_top_k"].dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"} and made["op11_exact_top_k"].count() == 20
    assert [tuple(r) for r in made["op12_collocations"].collect()] == [("en", 1, "the quick fox", 300, 300, 300, 900, 3000)]
    assert dict(made["op13_whitening"].dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"} and made["op13_whitening"].count() == 8 * 160
