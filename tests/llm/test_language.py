"""Language ID against brute force, and what is no evidence of a language."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lucidgraph.llm import langid, urls

from . import brute as B
from .test_queries import FOLDER

GREEK = "Η γλώσσα αυτή δεν είναι γνωστή εδώ"
CHINESE = "这种语言在这里是未知的"
TEXTS = [
    "the of and unknownish words", "der keit Straße schön", "½ ² ①", "Ⅷ 12", "", None, GREEK, CHINESE,
    "the " + GREEK, "naïve café the", "हिन्दी में लिखा", "á the", "x" * 9000 + " the", "THE OF",
]


def test_predictions_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT text, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    rows += [("हिन्दी में", "hi"), ("हिन्दी में", "hi"), ("the of and", None), (None, "en"), ("", "en")]
    texts = TEXTS + [t for t, _ in rows[::3]] + [t[::-1] for t, _ in rows[:20] if t]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), kept_words=10**6, kept_grams=10**6)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in langid.predict(frame, model, known="known").collect()}
    assert len(found) == len(texts)
    for i, (lang, score, known) in enumerate(B.language(rows, texts)):
        assert (found[i].lang_pred, found[i].score) == (lang, pytest.approx(score, abs=1e-9)), texts[i]
        assert found[i].known == pytest.approx(known)
    assert [found[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4
    assert found[6].known == found[7].known == 0 and found[10].lang_pred == "hi"


def test_training_shares_texts_among_languages(spark):
    rows = [(f"common{i}", "en") for i in range(400)] + [(f"rare{i}", "xx") for i in range(15)]
    rows += [("the same text", "en")] * 3000
    frame = spark.createDataFrame(rows, "text string, lang string")
    shares = langid._shares(frame, 100)
    assert shares["xx"] == 1.0 and shares["en"] == pytest.approx(85 / 401)
    drawn = [(r.text, r.lang) for r in langid._sampled(frame, shares).collect()]
    assert len(drawn) == len(set(drawn)) and sum(x == "xx" for _, x in drawn) == 15
    assert 40 <= sum(x == "en" for _, x in drawn) <= 140
    # the prior is that of all texts, not of those drawn
    model = langid.train(frame, train_docs=100)
    prior = dict(zip(model.languages, langid.np.exp(model.prior)))
    assert prior["en"] > 0.9


def test_items_at_the_edge(spark):
    counts = spark.createDataFrame(
        [("a", f"w{i}", c) for i, c in enumerate([9, 8, 5, 5, 5, 1, 1, 1, 1, 1, 1])], "lang string, item string, count long"
    )
    def kept(n):
        return langid._top(counts, ["lang"], n).count()

    assert [kept(n) for n in (1, 2, 3, 4, 5, 10, 11)] == [1, 2, 5, 5, 5, 11, 11]


def test_pipeline_rejects_unknown_scripts_and_keeps_odd_columns(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    more = spark.createDataFrame(
        [(9001, GREEK), (9002, CHINESE), (9003, "½ ²"), (9004, None)], "doc_id long, text string"
    )
    names = ("_lang", "_score", "lang_pred", "score", "known", "base", "spans", "_base", "_spans", "ids", "row", "best")
    docs = documents.drop("n_chars").unionByName(more, allowMissingColumns=True)
    docs = docs.withColumns({n: F.lit(n) for n in names})
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER).checkpoint()
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"{n} <> '{n}'" for n in names)).count() == 0
        if name == "language_id":
            assert out.where("doc_id > 9000").count() == 0 and out.count() >= 50
    tokens = corpus_pipeline.tokens(spark, out, FOLDER)
    assert len(set(tokens.columns)) == len(tokens.columns)
    assert tokens.where("round_trip").count() == out.count()


def test_urls_keep_a_column_named_best(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "mine")], "page_id long, url string, best string")
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")
    row = urls.judge(pages, rules).head()
    assert (row.best, row.rule, row.verdict) == ("mine", "net/es/", "block")
