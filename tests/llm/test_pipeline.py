"""The pipeline's stages, one after another, on a small table."""

import random

import pytest

pytest.importorskip("loomgraph.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = {k: [a + b for a in s for b in s] for k, s in {"en": ["the", "of", "ing", "at", "re"], "de": ["ung", "sch", "der", "ei", "lich"]}.items()}

    def text(lang, n=100):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        body = text(lang)
        if i % 4 == 0:
            body += " moron idiot scum " + text(lang, 5)
        rows.append((i, body + "\nA line of more than twenty signs in all documents", lang, "s", len(body)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, "!!! ???", "en", "s", 7), (202, None, None, None, None), (203, "Это русский текст о погоде и о море " * 3, None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "best_fit_packing":
            assert docs.columns == columns
    clean = {i for i in range(160) if i % 4}
    assert len(clean - seen[0]) <= 2 and len(seen[0] & {i for i in range(160) if i % 4 == 0}) <= 2  # toxic documents go
    assert 203 in seen[0] and not seen[1] & {201, 202, 203} and len(seen[0] - seen[1] - {201, 202, 203}) <= 1  # of no known language
    assert seen[2] == seen[1]
    assert 200 not in seen[3] and seen[2] - seen[3] == {200}
    assert seen[4] == seen[3]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and columns of clashing names."""
    clash = ["score", "piece", "keep", "bucket", "comp"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    rng = random.Random(2)
    body = lambda words: " ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(60))
    rows = [(i, body(["the", "of", "ing"] if i % 2 else ["ung", "sch", "der"]), "en" if i % 2 else "de", "s", 1, *clash) for i in range(40)]
    rows += rows[-3:] + [(50, None, None, None, None, *clash), (51, "", "en", "s", 0, *clash)]
    for k, own in enumerate(([], rows)):
        folder = str(tmp_path / f"t{k}")
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in own], "doc_id long, quality int, toxic int").limit(0 if k else 100).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if name != "best_fit_packing":
                assert out.schema.names == docs.schema.names
            out.write.parquet(f"{folder}/s{j}")
            docs = spark.read.parquet(f"{folder}/s{j}")
        got = docs.select("doc_id", "ids", "length").collect()
        assert len({r["doc_id"] for r in got}) == (40 if k else 0) and len(got) == (43 if k else 0) and all(len(r["ids"]) == r["length"] for r in got)
