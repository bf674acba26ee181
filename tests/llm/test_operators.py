"""The operators on small tables with nulls, ties, repeated rows and odd texts, against brute force."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lucidgraph.llm import ann, bpe, chat, decontaminate, jaccard, langid, pii, suffixes, urls, warc
from lucidgraph.llm import queries as Q

from . import brute as B

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def words(n, step=1, start=0):
    return " ".join(WORDS[(start + i * step + i * i) % len(WORDS)] + str(i % 7) for i in range(n))


LONG = words(3000)
DOCS = [
    (1, words(60)),
    (2, words(60)),
    (3, words(60).replace("beta", "BETA", 1)),
    (4, words(60) + " one more"),
    (5, words(59)),
    (6, words(8)),
    (7, words(9)),
    (8, words(10)),
    (9, "a b c"),
    (10, "A  b\tc"),
    (11, ""),
    (12, None),
    (None, words(60)),
    (None, None),
    (13, " \t\n\x0b"),
    (14, LONG),
    (15, LONG + " tail " + words(60)),
    (15, LONG + " tail " + words(60)),
    (16, "x" * 400),
    (17, "x" * 300 + "y" + "x" * 120),
    (18, "ab" * 100),
    (19, "naïve café — “quotes” \u00a0 ünïcödé 日本語テキスト 😀😀 " * 4),
    (20, "pre " + "naïve café — “quotes” \u00a0 ünïcödé 日本語テキスト 😀😀 " * 2),
    (21, "Wire 4111 1111 1111 1111 to a.b@c.d_e@f.gh from +1 (377) 555-0271 at 10.0.0.256, 10.0.0.255."),
    (22, "9" * 40 + " 1.2.3.4.5.6.7.8 " + "+" * 5 + "12345678901 x@y x@y.z"),
    (23, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and nothing else 0000-0000-0000-0000'),
    (24, "a" * 5000 + "@" + "b" * 100),
    (25, "1 " * 3000),
    (26, words(30) + " " + words(40, 3)),
    (27, words(40, 3) + " between " + words(30)),
    (-5, words(20, 2)),
    (-6, words(20, 2)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


def plain(df):
    def value(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in df.collect()), key=str)


def same(df, rows):
    assert plain(df) == sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str
    )


def with_extra(df):
    """Columns whose names the operators use inside."""
    names = ("grp", "doc", "text_key", "hash", "n", "host_chars", "key", "ids", "score", "url_key", "spans")
    return df.withColumns({c: F.lit("extra") for c in names if c not in df.columns})


# --- 1: byte-level BPE -------------------------------------------------------


def bpe_of(df):
    import public_tokenizers

    pieces = bpe.read_ranks(Q.RANKS)
    out = bpe.encode(df, pieces, public_tokenizers.PATTERN)
    digest = F.sha2(bpe.decoded(F.col("ids"), pieces), 256)
    return out.select("doc_id", F.size("ids"), bpe.ids_digest(F.col("ids")), digest)


def test_bpe(docs):
    same(bpe_of(docs), B.bpe(DOCS))
    same(bpe_of(with_extra(docs)), B.bpe(DOCS))
    assert bpe_of(docs.limit(0)).count() == 0


def test_bpe_long_words():
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(Q.RANKS))}
    for word in (b"abcab" * 40, b"x" * 130, bytes(range(256)), "日本語".encode() * 30):
        short = bpe.merge(word[:60], ranks)
        assert bpe._merge_long(word[:60], ranks) == short or len(short) == 1
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found, default=(math.inf, 0))
            if rank == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe._merge_long(word, ranks) == [ranks[p] for p in parts]


def test_bpe_by_functions(spark):
    pieces = bpe.read_ranks(Q.RANKS)
    ranks = {p: i for i, p in enumerate(pieces)}
    words = ["", " the", "oooooo", " thtionhein", "naïveté", "日本語", "😀😀", "0123456789" * 3, None]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in df.select("word", bpe.word_ids(F.col("word"), pieces).alias("ids")).collect():
        assert r.ids == (None if r.word is None else bpe.merge(r.word.encode(), ranks) if r.word else [])


# --- 2: WARC -----------------------------------------------------------------

PAGES = [
    (1, "http://a.b/c", "<p>x</p>"),
    (2, "http://a.b/d\r\nEvil: 1", "<p>x</p>"),
    (3, None, None),
    (4, "http://e", ""),
    (5, "x", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (None, "http://n", "<p>x</p>"),
    (0, "http://z", "<p>x</p>"),
    (0, "http://z", "<p>x</p>"),
    (6, "http://ü.example", "é" * 70_000),
]


@pytest.mark.parametrize("zip64,size", [(False, 1 << 20), (True, 1)])
def test_warc(spark, tmp_path, zip64, size):
    pages = with_extra(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    packages = warc.write_packages(pages, f"{tmp_path}/w", package_bytes=size, zip64=zip64)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(warc.read_packages(packages).select(*names), B.warc([(p, h) for p, _, h in PAGES]))
    import zipfile

    for row in packages.collect():
        with zipfile.ZipFile(row.path) as package:
            assert package.testzip() is None and warc.INDEX in package.namelist()
    assert warc.read_packages(warc.write_packages(pages.limit(0), f"{tmp_path}/e")).count() == 0


def test_warc_min_bytes(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read_packages(warc.write_packages(pages, f"{tmp_path}/w", min_bytes=100))
    assert {r.record_type for r in rows.collect()} == {"response"}


# --- 3: nearest neighbours ---------------------------------------------------


def test_nearest(spark):
    vectors = [(i, [math.sin(i * j + j) for j in range(1, 9)]) for i in range(120)]
    vectors += [(200 + i, [0.5, -0.25, 0.125, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(20)]
    vectors += [(0, [9.0] * 8), (300, None), (350, []), (400, [0.0] * 8), (450, [math.nan] * 8),
                (500, [1.0, None] * 4), (550, [math.inf] * 8), (None, [1.0] * 8), (600, [1.0] * 3),
                (650, [2.0] * 3), (700, [1e-200] * 8), (750, [1e200] * 8), (7, vectors[7][1])]
    df = with_extra(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, candidate_rows=40, query_rows=2)
    usable = [v for v in vectors if v[0] not in (700, 750)]
    got = [r for r in plain(found) if not {r[0], r[2]} & {700, 750}]
    want = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in B.nearest(usable)]
    near = {(r[0], r[2], r[3]) for r in want}
    # those two are parallel to a vector of ones and crowd some others out of the five
    assert {(r[0], r[2], r[3]) for r in got} <= near and len(got) > 0.8 * len(want)
    alone = ann.nearest(spark.createDataFrame(usable, df.select("vec_id", "embedding").schema),
                        F.col("vec_id") % 50 == 0, candidate_rows=40, query_rows=2)
    same(alone, want)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 4: decontamination ------------------------------------------------------


def test_decontaminate(spark, docs):
    items = [
        (1, words(60)[:200]), (2, words(40, 3)), (3, words(40, 3).upper() + "!"), (4, None), (5, ""),
        (6, "a b c"), (7, words(50, 5)), (None, words(9)), (8, LONG), (8, LONG),
    ]
    table = with_extra(spark.createDataFrame(items, "item_id long, text string"))
    found = decontaminate.search(with_extra(docs), table)
    same(found.select("doc_id", "item_id", "n_shared", "n_item"), B.leaks(DOCS, items))
    bad = {t for d, t in DOCS for r in [list(B.leaks([(d, t)], items))] if r}
    kept = decontaminate.clean(with_extra(docs), table)
    assert kept.columns == with_extra(docs).columns
    same(kept.select("doc_id", "text"), [r for r in DOCS if r[1] not in bad])
    assert decontaminate.search(docs.limit(0), table).count() == 0
    assert decontaminate.clean(docs, table.limit(0)).count() == len(DOCS)


def test_decontaminate_without_broadcast(monkeypatch, spark, docs):
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)
    items = [(1, words(40, 3)), (2, words(9))]
    found = decontaminate.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    same(found.select("doc_id", "item_id", "n_shared", "n_item"), B.leaks(DOCS, items))


# --- 5: chat -----------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\\<|x\\"), (2, 0, "system", "s\n"),
    (2, 1, "user", None), (2, 2, "assistant", "<\\|<"), (3, 0, None, None), (4, 0, "tool\n<|", "x<"),
    (4, 1, "assistant", "é😀"), (4, 1, "assistant", "é😀"), (None, 0, "user", "n"), (5, None, "user", "z"),
    *[(6, i, ("user", "assistant")[i % 2], f"m{i}") for i in range(40)],
]


def test_chat(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(chat.canonical(with_extra(chat.records(rows)), "record")))
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    same(
        back.select("conv_id", F.size("read_turns"), F.sha2(turns, 256), F.length("loss_text"),
                    F.sha2("loss_text", 256)),
        B.chat(TURNS),
    )
    layouts = {r.layout for r in back.collect()}
    assert layouts == {"prompt", "instruction", "messages", "shared"}


def test_chat_layouts(spark):
    records = [
        '{"request": {"text": "q", "id": 1}, "reply": {"text": "a"}, "extra": [1, {"b": 2}]}',
        '{"instruction": "i", "input": "j", "output": "o"}',
        '{"messages": []}', '{"unknown": 1}', "[1]", "no json", None, '{"prompt": "p"}',
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    found = {r.record: r for r in chat.canonical(df, "record").collect()}
    assert [t.text for t in found[records[0]].turns] == ["q", "a"]
    assert [t.role for t in found[records[1]].turns] == ["user", "user", "assistant"]
    assert found[records[2]].turns == []
    assert all(found[r].turns is None for r in records[3:])


# --- 6: suffix arrays --------------------------------------------------------


@pytest.mark.parametrize("group_bytes", [1 << 22, 3000])
def test_suffixes(docs, group_bytes):
    out = suffixes.dedup(with_extra(docs), group_bytes=group_bytes)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same(out.select(*names), B.dedup(DOCS))


def test_suffixes_of_nothing(docs):
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(3)
    for text in (
        rng.integers(97, 99, 3000), np.full(500, 97), np.r_[np.full(200, 98), np.full(200, 97)],
        np.tile([97, 98, 99], 300), rng.integers(0, 256, 2000),
    ):
        text = text.astype(np.uint8)
        wanted = np.arange(len(text)) <= len(text) - suffixes.LENGTH
        wanted &= rng.random(len(text)) < 0.8
        order = suffixes.suffix_order(text, wanted)
        raw = text.tobytes()
        strings = [raw[i : i + suffixes.LENGTH] for i in order]
        assert sorted(order) == np.flatnonzero(wanted).tolist() and strings == sorted(strings)
        alike = suffixes.alike_before(text, order)
        assert alike.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


# --- 7: URLs -----------------------------------------------------------------

URLS = [
    "http://Example.COM/en/a?b", "https://www.example.com/en/", "http://com/", "http://com", "x://a.net/es/1#2",
    "http://a.NET/fr", "http://a.net/fr/", "no scheme", None, "", "://", "http:///en/", "http://notexample.com/en/",
    "a://b://c.com/en/", "http://u@example.com/en/x", "http://example.com./en/", "http://a.com/x\ny", "http://a.com?x/en/",
    "http://Ü.example.com/en/",
]


def test_urls(spark):
    pages = [(i, u) for i, u in enumerate([*URLS, URLS[0]])] + [(0, URLS[0]), (None, URLS[1])]
    df = with_extra(spark.createDataFrame(pages, "page_id long, url string"))
    rules = spark.createDataFrame(list(Q.URL_RULES), "host string, path string, verdict string")
    names = ("page_id", "host", "path", "rule", "verdict")
    same(urls.judge(df, rules).select(*names), B.urls(pages))
    same(urls.judge(df, rules, small_rules=0).select(*names), B.urls(pages))
    same(urls.judge(df, rules.limit(0)).select(*names), B.urls(pages, ()))
    assert urls.judge(df.limit(0), rules).count() == 0


def test_bloom_keeps_all(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = urls.bloom(keys, "key", 64)
    assert urls.possible(keys, "key", bits, 64).count() == 3000
    others = spark.range(3000, 23_000).select(F.concat(F.lit("k"), "id").alias("key"))
    sparse = urls.bloom(keys, "key", 512)
    assert urls.possible(others, "key", sparse, 512).count() < 400


# --- 8: Jaccard --------------------------------------------------------------


@pytest.mark.parametrize("group_bytes", [1 << 22, 3000])
def test_jaccard(docs, group_bytes):
    same(jaccard.join(with_extra(docs), group_bytes=group_bytes), B.jaccard(DOCS))


def test_jaccard_small_and_large(spark):
    import random

    rng = random.Random(5)
    rows = []
    for base in range(25):
        n = rng.randint(5, 60)
        text = [f"w{base}x{i}" for i in range(n)]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(copy[: rng.randint(max(4, n - 4), n)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.join(df), B.jaccard(rows))


def test_jaccard_subsets_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_COST", 1e9)
    rows = [(i, " ".join(f"s{j}" for j in range(i % 3, 12 + i % 5))) for i in range(40)]
    same(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")), B.jaccard(rows))
    monkeypatch.setattr(jaccard, "LIST_COST", 0.0)
    same(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")), B.jaccard(rows))


def test_jaccard_of_nothing(docs):
    assert jaccard.join(docs.limit(0)).count() == 0


# --- 9: PII ------------------------------------------------------------------


def pii_of(df):
    found = pii.find(df, pii.fit(df))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind))

    counts = [count(kind) for kind in range(4)]
    return found, found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256))


def test_pii(docs):
    found, rows = pii_of(with_extra(docs).drop("spans"))
    same(rows, B.pii(DOCS))
    texts = dict(DOCS)
    for r in found.where("size(base) > 0").collect():
        for s in r.base:
            assert texts[r.doc_id][s.start : s.end] == s.value
    masks = {r[0]: r[1] for r in found.select("doc_id", pii.masked(F.col("text"), F.col("spans"))).collect()}
    assert "<phone>" in masks[21] and "555-0271" not in masks[21] and masks[9] == "a b c" and masks[12] is None
    assert pii_of(docs.limit(0))[1].count() == 0


def test_pii_adds_spans(spark):
    text = 'and the token = "24be64439e3e49cf46b2d7c90f36{:04d}3d0b907ff" is here'
    rows = [(i, text.format(i)) for i in range(30)] + [(99, "plain_words_are_not_secret1 at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, _ = pii_of(df)
    assert found.where("size(spans) > size(base)").count() >= 30
    assert found.where("doc_id = 99 and size(spans) > 0").count() == 0


# --- 10: language ------------------------------------------------------------


def test_langid(spark):
    a, b = "the of and ing tion er", "der die und ung keit sch"
    rows = [(i, " ".join((x.split() * 9)[i % 5 :]), lang) for i in range(40) for x, lang in ((a, "en"), (b, "de"))]
    rows += [(100, None, "en"), (101, "12 34 !!", "de"), (102, "the of", None), (103, "", "en"),
             (None, "und die keit", None), (104, "x" * 50_000, None), (104, "x" * 50_000, None)]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.train(df.where(~langid.held_out()))
    found = langid.predict(df, model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect() if r.lang is None}
    assert got[102][0] == "en" and got[None][0] == "de"
    assert all(
        (r.lang_pred == "und") == (r.doc_id in (100, 101, 103)) and 0 <= r.score <= 1 for r in found.collect()
    )
    assert found.where("lang is not null and lang_pred != 'und' and lang_pred != lang").count() == 0
    assert found.count() == len(rows)
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_langid_counts_in_every_language(spark):
    rows = [("ba ba ba da da fa", "a"), ("ga ga ga ga da da da ba", "b"), ("q" * 150 + "z", "c")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), kept_words=1)
    assert set(model.words) == {"ba", "ga", "q" * 150 + "z"}
    # "ba" is cut from the list of b, where it was counted once of eight words
    want = [math.log(3.1 / 7), math.log(1.1 / 9), math.log(0.1 / 2)]
    assert model.mean([model.words["ba"]]).tolist() == pytest.approx(want)
    want = [math.log((x + 0.1) / (y + 1)) for x, y in ((0, 6), (0, 8), (146, 1))]
    assert model.mean([model.grams["qqqqq"]]).tolist() == pytest.approx(want)
    assert {"qqqz ", "z "} <= set(model.grams)


def test_langid_many_languages(spark):
    rows = [(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}", f"l{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string")
    found = langid.predict(df, langid.train(df))
    assert found.where("lang_pred = lang").count() == 600


def test_langid_rows_made_at_once_or_not(monkeypatch):
    model = langid.Model(
        ("a", "b"), {"xy": 0}, {"zz": 1, " z": 2}, langid.np.array([0, 1, 3, 4]),
        langid.np.array([1, 0, 1, 0]), langid.np.array([2.0, 1.0, 3.0, 5.0]),
        langid.np.array([-7.0, -8.0]), langid.np.zeros(2),
    )
    texts = ["xy", "zz", "xy zz", "q"]
    at_once = [langid._Scorer(model).total(t.split()).tolist() for t in texts]
    assert at_once == [[-7, -6], [-4, -6.5], [-11, -12.5], [0, 0]]
    monkeypatch.setattr(langid, "_CACHE_CELLS", 4)
    scorer = langid._Scorer(model)
    assert scorer.dense is None and [scorer.total(t.split()).tolist() for t in texts] == at_once


def test_chat_steps_share_one_worker(spark):
    """Three steps, one Python worker a task; a column in the way is still replaced."""
    rows = spark.createDataFrame([(1, 0, "user", "a<|b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    turned = chat.canonical(chat.records(rows), "record")
    back = chat.read_back(chat.formatted(turned))
    assert back._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    stale = turned.withColumn("formatted", F.lit("old"))
    want = [(r.formatted, r.loss_text, r.read_turns) for r in back.collect()]
    assert [(r.formatted, r.loss_text, r.read_turns) for r in chat.read_back(chat.formatted(stale)).collect()] == want
    assert want[0][1] == "c" and [tuple(t) for t in want[0][2]] == [("user", "a<|b"), ("assistant", "c")]
