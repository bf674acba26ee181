"""Language identification: known words first, then shorter and shorter n-grams.

``train`` counts words and character n-grams of labelled texts per language in
Spark and keeps those that are among the most frequent ones of any language, each
with its log frequency in every language; ``predict``
scores each word of a text by its own log frequency if it is known, else by
those of its n-grams of the longest length at which any is known.

Words are runs of letters with the marks on them, lower-cased.  A null or empty text, or
one without a letter, is ``und`` with score 0.  A word of which nothing is known, as of a
script that no language has, says nothing; ``known`` is the share of words that are known
themselves or by an n-gram of three characters or more.  Ties go to the language first in
the alphabet.  Texts are read whole, however long; repeated rows count once in training
and are predicted each; extra columns are kept, those named as the results replaced.
Without any labelled text, and for empty tables, every text is ``und``.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import added, map_batches

UNKNOWN = "und"
#: At most about so many different labelled texts are counted, shared among the languages
#: (all of a language that has fewer than its share) and taken by a hash.
TRAIN_DOCS = 40_000
#: About the so many most frequent words, and n-grams of each length, of each language are
#: kept, with their counts in all languages; rarer ones count as never seen in any.
KEPT_WORDS, KEPT_GRAMS = 20_000, 5_000
#: Lengths of n-grams, in the order of the fallback.
LENGTHS = (5, 4, 3, 2, 1)
#: Shorter n-grams are no evidence that a word is of a known language.
LEAST_EVIDENCE = 3
#: N-grams of long words are listed from pieces that begin every so many characters.
PIECE = 64
_WORD, _ASCII_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[a-z]+")
#: Words whose scores a worker keeps, and numbers that these are at most.
_CACHE, _CACHE_CELLS = 300_000, 4_000_000


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4 (false for a null id)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


@dataclass(frozen=True)
class Model:
    """Log frequencies: ``words[w]`` and ``grams[g]`` are positions ``i`` in ``start``.

    ``base`` holds those of an item never seen; entries ``start[i]`` to ``start[i + 1]``
    of ``at`` and ``more`` are the languages that have the item and what they add.
    """

    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    start: np.ndarray
    at: np.ndarray
    more: np.ndarray
    base: np.ndarray
    prior: np.ndarray

    def mean(self, items: list[int]) -> np.ndarray:
        """The mean log frequencies by language of the items at these positions."""
        first = self.start[items]
        sizes = self.start[np.add(items, 1)] - first
        ends = np.cumsum(sizes)
        entries = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])
        more = np.bincount(self.at[entries], self.more[entries], len(self.base))
        return self.base + more / len(items)


def _words_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, found = [], []
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        words = words_of(text)
        found += words
        langs += [lang] * len(words)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(found, pa.string())], names=["lang", "word"]
    )


def _top(counts: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """All counts, in every language, of the items that any language has among its first ones.

    How often an item must occur for that is read from the numbers of items of equal
    count, so no task sees all items of a language.  Items of the count at the edge are
    in if that keeps twice ``kept`` at most, else out.
    """
    sizes = counts.groupBy(*keys, "count").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"))
    reached = sizes.withColumn("reached", F.sum("size").over(order))
    fits = (F.col("reached") <= kept) | ((F.col("reached") - F.col("size") < kept) & (F.col("reached") <= 2 * kept))
    least = reached.where(fits).groupBy(*keys).agg(F.min("count").alias("least"))
    first = counts.join(least, keys).where(F.col("count") >= F.col("least")).select("item").distinct()
    return counts.join(first, "item", "left_semi")


def _grams(counts: DataFrame) -> DataFrame:
    """(lang, item, n, count) of the n-grams of all words, each with a blank on either side."""
    marked = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    # an n-gram belongs to the piece in which it begins
    pieces = F.transform(
        F.sequence(F.lit(1), F.length(marked), F.lit(PIECE)),
        lambda i: F.substring(marked, i, F.lit(PIECE + max(LENGTHS) - 1)),
    )
    size = F.length("piece")

    def of_length(n: int) -> Column:
        last = F.greatest(F.least(size - n + 1, F.lit(PIECE)), F.lit(1))
        # one argument only: Spark gives a second one, with a default or not, the index
        listed = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("piece", i, F.lit(n)))
        return F.when(size >= n, listed).otherwise(F.array().cast("array<string>"))

    n_grams = F.flatten(F.array(*(of_length(n) for n in LENGTHS)))
    return (
        counts.select("lang", F.explode(pieces).alias("piece"), "count")
        .select("lang", F.explode(n_grams).alias("item"), "count")
        .where(F.col("item") != " ")  # every word has it
        .groupBy("lang", "item", F.length("item").alias("n"))
        .agg(F.sum("count").alias("count"))
    )


def _shares(rows: DataFrame, train_docs: int) -> dict[str, float]:
    """The share of the different texts of each language that training reads."""
    texts = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    rest, quota = train_docs, {}
    for i, (language, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quota[language] = min(size, rest / (len(sizes) - i))
        rest -= quota[language]
    return {language: quota[language] / size for language, size in sizes.items()}


def _sampled(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Different texts of each language, by their hash."""
    spark = rows.sparkSession
    limits = [(x, math.ceil(share * (1 << 20))) for x, share in shares.items()]
    limits = spark.createDataFrame(limits, "lang string, below long")  # a row a language
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    drawn = hashed.join(F.broadcast(limits), "lang").where(
        F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < F.col("below")
    )
    return drawn.dropDuplicates(["lang", "hash"]).select("lang", "text")


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    train_docs: int = TRAIN_DOCS,
    kept_words: int = KEPT_WORDS,
    kept_grams: int = KEPT_GRAMS,
) -> Model:
    """A model of the languages in ``lang``; rows with a null there or in ``text`` are left out."""
    rows = labelled.select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    ).dropna()
    shares = _shares(rows, train_docs)
    sample = _sampled(rows, shares)
    counts = (
        map_batches(sample, _words_of, "lang string, word string")
        .groupBy("lang", F.col("word").alias("item"))
        .count()
    )
    counts = materialize(counts)
    totals = {
        r["lang"]: r["total"]
        for r in counts.groupBy("lang")
        .agg(F.sum("count").alias("total"))
        .collect()
    }
    languages = tuple(sorted(totals))
    if not languages:
        none = np.zeros(0)
        return Model((), {}, {}, np.zeros(1, int), np.zeros(0, int), none, none, none)
    place = {language: i for i, language in enumerate(languages)}
    sums = np.array([totals[x] for x in languages], float)
    found, start, at, seen = ({}, {}), [0], [], []
    tops = _top(counts, ["lang"], kept_words), _top(_grams(counts), ["lang", "n"], kept_grams)
    for top, index in zip(tops, found):
        items: dict[str, list[tuple[int, int]]] = {}
        for r in top.select("lang", "item", "count").toLocalIterator():
            items.setdefault(r["item"], []).append((place[r["lang"]], r["count"]))
        for item in sorted(items):
            index[item] = len(start) - 1
            for language, count in items[item]:
                at.append(language)
                seen.append(count)
            start.append(len(at))
    more = np.log((np.array(seen, float) + 0.1) / 0.1)
    base = np.log(0.1 / (sums + 1.0))
    # as many words as the language would have if all of its texts had been read
    whole = sums / np.array([shares[x] for x in languages])
    prior = np.log(whole / whole.sum())
    return Model(languages, *found, np.array(start), np.array(at, np.int32), more, base, prior)


def _longest(grams: dict[str, int], word: str) -> tuple[int, list[int]]:
    """(length, positions) of a word's known n-grams of the longest length at which any is known."""
    marked = f" {word} "
    for n in LENGTHS:
        found = [grams.get(marked[i : i + n]) for i in range(len(marked) - n + 1)]
        known = [at for at in found if at is not None]
        if known:
            return n, known
    return 0, []


class _Scorer(dict):
    """The row of each word in ``rows``, of the words that came up last."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.languages)
        # as many words as the bounds of count and memory allow
        # the last column: whether the word is evidence of a known language
        self.rows = np.zeros((max(1, min(_CACHE, _CACHE_CELLS // max(n, 1))), n + 1))
        self.at = 0
        # few languages: each item's row is made once
        n_items = len(model.start) - 1
        self.dense = None
        if n_items * n <= _CACHE_CELLS:
            self.dense = np.tile(model.base, (n_items, 1))
            self.dense[np.repeat(np.arange(n_items), np.diff(model.start)), model.at] += model.more

    def reset(self) -> None:
        self.clear()
        self.at = 0

    def __missing__(self, word: str) -> int:
        at = self.at
        known = self.model.words.get(word)
        length, items = _longest(self.model.grams, word) if known is None else (LEAST_EVIDENCE, [known])
        if not items:
            self.rows[at, :-1] = 0.0
        elif self.dense is None:
            self.rows[at, :-1] = self.model.mean(items)
        elif len(items) == 1:
            self.rows[at, :-1] = self.dense[items[0]]
        else:
            self.rows[at, :-1] = np.add.reduce(self.dense.take(items, axis=0)) / len(items)
        self.rows[at, -1] = length >= LEAST_EVIDENCE
        self[word] = at
        self.at += 1
        return at

    def sums(self, words: list[str]) -> np.ndarray:
        """The sum of the words' log frequencies by language, then the words that are evidence."""
        if self.at + len(words) > len(self.rows):
            self.reset()
        return self.rows[[self[word] for word in words]].sum(axis=0)

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' log frequencies by language."""
        return self.sums(words)[:-1]


_SCORERS: dict[str, _Scorer] = {}


def _scorer(name: str, shared) -> _Scorer:
    """The scorer of a call, by the call's name, with the words its worker has scored."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = _Scorer(shared.value)
    return _SCORERS[name]


def _predicted(scorer: _Scorer, text: str | None) -> tuple[str, float, float]:
    words = words_of(text) if text else []
    languages = scorer.model.languages
    if not words or not languages:
        return UNKNOWN, 0.0, 0.0
    sums, step = np.append(scorer.model.prior, 0.0), min(4096, len(scorer.rows))
    for start in range(0, len(words), step):
        sums += scorer.sums(words[start : start + step])
    known, sums = sums[-1] / len(words), sums[:-1]
    best = int(np.argmax(sums))
    odds = np.exp(sums - sums[best])
    return languages[best], float(1.0 / odds.sum()), float(known)


def predict(
    df: DataFrame,
    model: Model,
    text: str = "text",
    lang_pred: str = "lang_pred",
    score: str = "score",
    known: str | None = None,
) -> DataFrame:
    """``df`` with the predicted language and its share of the likelihood (0 to 1).

    With ``known``, a column of that name has the share of words that are evidence.
    """
    more = {lang_pred: "string", score: "double"} | ({known: "double"} if known else {})
    kept = df.drop(*more)
    name = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the kept words and n-grams

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(name, shared)
        found = [_predicted(scorer, value) for value in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([x[0] for x in found], pa.string()),
                *(pa.array([x[i] for x in found], pa.float64()) for i in range(1, len(more))),
            ],
            names=[*batch.schema.names, *more],
        )

    return map_batches(kept, predicted, added(kept, **more))
