"""Ranked search, spelling variants and SimHash against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidgraph.llm import frames, ranked, simhash, spelling
from lucidgraph.llm import queries as Q

from . import brute as B
from .test_operators import DOCS, LONG, plain, same, with_extra
from .test_queries import FOLDER, rows

ITEMS = [
    (1, "Alpha0 BETA1 gamma2, delta3"),
    (2, "naïve CAFÉ テキスト"),
    (3, ""),
    (4, None),
    (5, "no such term here at all"),
    (6, "x@y x " * 3 + "a b c"),
    (None, "omicron1 omicron2 omicron3"),
    (7, "Alpha0 BETA1 gamma2, delta3"),
    (8, LONG),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


# --- ranked search -----------------------------------------------------------


@pytest.mark.parametrize("k, block_terms", [(10, 50_000), (2, 6)])
def test_ranked(docs, items, k, block_terms):
    found = ranked.search(docs, items, k, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    same(found, B.ranked(DOCS, ITEMS, k))


def test_ranked_extra_columns(docs, items):
    more = with_extra(docs).withColumns({c: F.lit(1) for c in ("item", "term", "rank", "block", "n_docs")})
    same(ranked.search(more, with_extra(items).withColumn("term", F.lit(1))), B.ranked(DOCS, ITEMS))


def test_ranked_empty_tables(docs, items):
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        found = ranked.search(a, b)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_trees_are_exact_whatever_their_shape(monkeypatch):
    """Random sparse documents in many small trees; the pruned search equals all scores."""
    random_ = np.random.default_rng(5)
    monkeypatch.setattr(ranked, "LEAF", 2)
    monkeypatch.setattr(ranked, "FANOUT", 3)
    terms = [np.unique(random_.integers(0, 60, 8)) for _ in range(25)]
    items, best = ranked.ItemTree(terms), [[] for _ in terms]
    search = ranked.Search(items, 4, 60, np.zeros(len(terms), np.int64))
    for part in range(6):
        lengths = random_.integers(0, 9, 50)
        own = [np.sort(random_.choice(60, n, replace=False)) for n in lengths]
        values = random_.integers(1, 6, lengths.sum()) ** 3
        doc = np.arange(50) + 50 * part
        tree = ranked.DocTree(doc, lengths, np.concatenate(own), values)
        if part % 2:
            search.first(tree)
        search.all(tree)
        at = 0
        for d, mine in zip(doc, own):
            here = dict(zip(mine.tolist(), values[at : at + len(mine)].tolist()))
            at += len(mine)
            for i, t in enumerate(items.terms):
                best[i].append((-sum(here.get(x, 0) for x in t.tolist()), d))
    for i, wanted in enumerate(best):
        # a tree that is searched twice may repeat a document, so compare the distinct ones
        wanted = [(d, -s) for s, d in sorted(wanted)[:4] if s < 0]
        found = list(dict.fromkeys(zip(search.found[i][0].tolist(), search.found[i][1].tolist())))
        assert found == wanted[: len(found)] and found[:2] == wanted[:2]


def test_ranked_drops_pairs_of_nodes(monkeypatch):
    """With a weakest score known, most leaves of most items are never scored."""
    random_ = np.random.default_rng(7)
    lengths = np.full(4000, 6)
    terms = np.concatenate([np.sort(random_.choice(400, 6, replace=False)) for _ in lengths])
    tree = ranked.DocTree(np.arange(4000), lengths, terms, random_.integers(1, 1000, 24000))
    items = ranked.ItemTree([np.sort(random_.choice(400, 3, replace=False)) for _ in range(20)])
    scored = []
    whole = tree.scores
    monkeypatch.setattr(tree, "scores", lambda leaves, member: scored.append(len(leaves)) or whole(leaves, member))
    search = ranked.Search(items, 3, 400, np.zeros(20, np.int64))
    search.first(tree)
    again = ranked.Search(items, 3, 400, search.least)
    scored.clear()
    again.all(tree)
    assert sum(scored) < 0.5 * 20 * len(tree.levels[0][1])


# --- spelling ----------------------------------------------------------------


def lexicon(n, seed, letters="abcß", low=6, high=9):
    random_ = random.Random(seed)
    out = {}
    while len(out) < n:
        word = "".join(random_.choices(letters, k=random_.randint(low, high)))
        out[word] = random_.choice([5, 6, 30, 31, 200, 1000, 1000, 6000])
    return out


@pytest.mark.parametrize("hot, bucket_rows", [(20_000, 60_000), (3, 100), (50, 20)])
def test_near_words(spark, hot, bucket_rows):
    words = lexicon(400, 1)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.near_words(frame, hot, bucket_rows)
    same(found, [(a, b, words[b]) for a in words for b in words if B.one_edit(a, b)])


def test_near_words_of_one_half(spark):
    """Words that all share a half, many of them with runs of equal letters."""
    words = {"unver" + w: 5 + i for i, w in enumerate(lexicon(150, 2, "ab", 1, 7))}
    words |= {"a" * n: n for n in range(6, 40)} | {"a" * n + "b": n for n in range(6, 40)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.near_words(frame, hot=40, bucket_rows=100)
    same(found, [(a, b, words[b]) for a in words for b in words if B.one_edit(a, b)])


def test_side_narrows_intervals_to_words():
    words = [np.array(w, np.int64) for w in ([1, 2, 1, 2], [1, 2, 1], [2, 2, 2], [1], [2, 1, 1, 1, 1])]
    side = spelling.Side(words)
    whole = side.text.tolist()
    suffixes = sorted(range(side.n), key=lambda i: whole[i:])
    assert side.suffixes.tolist() == suffixes
    for number, word in enumerate(words):
        low, high = np.zeros(1, np.int64), np.full(1, side.n)
        for symbol in [0, *word.tolist(), 0]:
            low, high = side.extend(np.array([symbol]), low, high)
        assert high - low == 1 and side.word(low) == number


def test_spelling_of_documents(spark, docs):
    text = [(i, " ".join(w for w, n in lexicon(60, i % 3, "abé").items() for _ in range(n % 7))) for i in range(40)]
    text += [(i, "Recieve receive RECEIVE received " * 9 + "receiv " * i) for i in range(100, 130)]
    text += [*DOCS, (None, "Straße " * 9)]
    frame = spark.createDataFrame(text, "doc_id long, text string").repartition(3)
    wanted = list(B.spelling(B.spelling_counts(text)))
    assert any(form and root != form for _, form, root, *_ in wanted) or any(form for _, form, *_ in wanted)
    found = spelling.variants(with_extra(frame).withColumn("run", F.lit("clash")))
    same(found.select("word", "form", "root", "n", "n_near", "form_n"), wanted)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("other", "w5")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w37" for w, _ in chain}


def test_spelling_empty(spark, docs):
    for frame in (docs.limit(0), docs.where("text IS NULL")):
        found = spelling.variants(frame)
        assert found.count() == 0 and set(found.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


# --- SimHash -----------------------------------------------------------------


def test_simhash(docs):
    found = simhash.dedup(with_extra(docs).withColumn("print", F.lit(1)))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    same(found, B.simhash(DOCS))


def test_simhash_of_given_documents(spark):
    same(Q.op13_simhash(spark, FOLDER), B.simhash(rows("SELECT doc_id, text FROM '@documents.parquet'")))


@pytest.mark.parametrize("radius, groups", [(4, 1 << 22), (2, 3000), (4, 20_000)])
def test_balls_link_what_is_within_the_radius(spark, monkeypatch, radius, groups):
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", groups)
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", groups)
    random_ = random.Random(radius)
    prints = [random_.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    for center in list(prints):
        for _ in range(12):
            flips = random_.sample(range(64), random_.randint(1, 7))
            prints.append(center ^ sum(1 << b for b in flips))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long").distinct()
    found = {r.doc: r.component for r in simhash.components(simhash.links(frame, radius)).collect()}
    wanted = B.near_prints([(p, "") for p in signed], prints, radius)
    assert [found.get(p, p) for p in signed] == wanted


def test_odd_radius(docs):
    with pytest.raises(ValueError):
        simhash.dedup(docs, radius=3)


def test_simhash_empty(docs):
    found = simhash.dedup(docs.limit(0))
    assert found.count() == 0 and found.columns == ["doc_id", "fingerprint", "component_id"]


# --- helpers -----------------------------------------------------------------


def test_pieces_change_nothing(monkeypatch):
    text = ("one Two\tthree  four\nfive " * 40 + "x" * 50 + " end").encode()
    whole, count = simhash.fingerprint(text), ranked.term_counts(text, {b"one": 0, b"end": 1})
    monkeypatch.setattr(frames, "PIECE_BYTES", 16)
    monkeypatch.setattr(frames.text_pieces, "__defaults__", (16,))
    assert len(list(frames.text_pieces(text, b" "))) > 20
    assert simhash.fingerprint(text) == whole
    assert ranked.term_counts(text, {b"one": 0, b"end": 1}) == count


def test_hot_keys_meet_their_classes_in_place(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT_SHARE", 4)
    data = [(1, i) for i in range(30)] + [(2, 1), (3, 2), (None, 3)]
    frame = spark.createDataFrame(data, "key long, n long")
    classes = spark.createDataFrame([(1, "a"), (2, "b")], "key long, class string")
    found = frames.joined_to_classes(frame, classes, "key")
    assert plain(found) == plain(frame.join(classes, "key", "left"))
