"""The pipeline against its stages done by hand."""

from __future__ import annotations

import corpus_pipeline
import numpy as np

from turnwise.llm import langid, near_dedup, packing


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    _, _, bad = langid.predict_texts([r.text for r in rows], len(rows), model)
    rows = [r for r, b in zip(rows, bad, strict=True) if not b]
    assert len(rows) >= 0.98 * len(bad)
    words = near_dedup.Words()
    number = [words.numbers(r.text) for r in rows]
    kept: list[int] = []
    top = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if rows[i].text == rows[j].text or near_dedup.similar(number[i], number[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    kept = [i for i in range(len(rows)) if top[i] == i]

    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {rows[i].doc_id for i in kept}
    for seq in {r.sequence_id for r in got}:
        places = sorted((r.offset, r.length) for r in got if r.sequence_id == seq)
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places[:-1]]).tolist()
        assert sum(n for _, n in places) <= packing.MAX_TOKENS


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(1, "x token = 0123456789abcdef0123456789abcdef y", "en", "s", 44), (2, "plain", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secret_scans"](spark, docs, "").collect()}
    assert (got[1].text, got[1].n_chars) == ("x [SECRET] y", 12)
    assert (got[2].text, got[2].n_chars) == ("plain", None)


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "some words", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, given, "").count()
