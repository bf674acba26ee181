"""The registered queries that have no SQL, and the pipeline, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lucidgraph.llm import queries as Q

from . import brute as B
from .test_operators import same

FOLDER = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.sql(sql.replace("@", f"{FOLDER}/")).fetchall()


@pytest.fixture(scope="module")
def docs():
    return rows("SELECT doc_id, text FROM '@documents.parquet'")


def test_bpe(spark, docs):
    same(Q.op1_bpe(spark, FOLDER), B.bpe(docs))


def test_nearest(spark):
    vectors = rows("SELECT vec_id, embedding FROM '@embeddings.parquet'")
    same(Q.op3_nearest(spark, FOLDER), B.nearest(vectors))


def test_pii(spark, docs):
    found = Q.op9_pii(spark, FOLDER)
    same(found.drop("spans"), B.pii(docs))
    spans = {r.doc_id: r.spans.split(",") for r in found.collect() if r.spans}
    for doc, text in docs:
        base = {f"{'email ip card phone'.split()[k]}:{a}:{b}" for a, k, b in B.pii_spans(text)}
        assert base <= set(spans.get(doc, ()))


def test_langid(spark):
    truth = dict(rows("SELECT doc_id, lang FROM '@documents.parquet'"))
    found = [r for r in Q.op10_langid(spark, FOLDER).collect() if r.held_out]
    assert len(found) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.98 * len(found)


def test_pipeline(spark, docs):
    items = rows("SELECT item_id, text FROM '@benchmark.parquet'")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, names = dict(docs), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, FOLDER)
        assert out.columns == frame.columns
        frame = out.checkpoint()
        texts = {r.doc_id: r.text for r in frame.collect()}
        if name == "language_id":  # all have words of a known language
            assert set(texts) == {d for d, t in kept.items() if t and any(c.isalpha() for c in t)}
        if name == "near_duplicates":
            assert set(texts) == {d for d, _, c in B.jaccard(list(kept.items())) if d == c}
        if name == "decontamination":
            assert set(texts) == set(kept) - {d for d, *_ in B.leaks(kept.items(), items)}
        if name == "personal_data":
            assert set(texts) == set(kept)
            for doc, text in kept.items():
                assert (texts[doc] == text) or "<" in texts[doc]
                spans = B.pii_spans(text)
                assert all(text[a:b] not in texts[doc] for a, k, b in spans if k != 1)
        kept = texts
    tokens = corpus_pipeline.run(spark, FOLDER)
    assert tokens.where("not round_trip").count() == 0
    same(
        tokens.select("doc_id", "n_tokens", Q.bpe.ids_digest(F.col("ids"))),
        [r[:3] for r in B.bpe(kept.items())],
    )


def test_empty_documents(spark, tmp_path):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, FOLDER)
    assert frame.count() == 0


def test_near_duplicates_of_equal_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    frame = spark.createDataFrame(
        [(1, a), (1, a), (None, b), (None, b), (None, a), (2, c), (1, c + " more"), (3, ""), (4, "")],
        "doc_id long, text string",
    )
    # the second text of id 1 is kept for being the smallest of its component
    want = [(1, a), (None, b), (1, c + " more"), (3, ""), (4, "")]
    same(corpus_pipeline.near_duplicates(spark, frame, FOLDER), want)
