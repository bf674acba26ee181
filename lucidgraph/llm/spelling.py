"""Spelling variants: words one edit apart, found by searches in FM-indexes.

Words are counted by Spark's functions.  Two words are near if they differ by exactly one
inserted, deleted or replaced code point.  Of such a pair, either half of the one is a
prefix or a suffix of the other, so there are two searches for a word: its first half
exactly, then to the right over the rest, and its second half exactly, then to the left,
both with one error on the way.  A delimited vocabulary (``$word$word$``) and its reversal
are the two sides of the index: a search starts at the delimiter, narrows an interval of
suffix ranks by one symbol at a time and ends at the next delimiter, in the interval of
one word.

No index holds the whole vocabulary.  Words meet by halves: a word stands as a query
under its own two halves, and as an entry under the prefixes and suffixes that a partner
could have for halves (at most four).  Halves are dealt to buckets, each with an index of its
entries.  A half that more than ``HOT_ENTRIES`` entries share is cut into parts, and every
part of its queries meets every part of its entries.

Cases: null and empty texts have no words; very long texts are read whole by Spark's
functions; an empty table gives no rows; every row counts, equal rows too; a null
document id is written as nothing before the colon of the hash; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .frames import joined_to_classes, stored

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: One in so many runs loses a code point, by the hash of its document and itself.
SLIP = 199
#: Rows of queries and entries in a bucket, on average, and entries of one half in a bucket.
BUCKET_ROWS, HOT_ENTRIES = 60_000, 20_000
#: States of a search that are extended at a time.
STATES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slipped(doc: Column, run: Column, slip: int = SLIP) -> Column:
    """``run``, without one code point if the hash of ``doc:run`` is divisible by ``slip``."""
    hash_ = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run))
    at = (hash_ % F.length(run)).cast("int")
    without = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(hash_ % slip == 0, without).otherwise(run)


def counted(
    df: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""
    runs = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0)))
    lower = F.translate("run", UPPER, UPPER.lower())
    words = (
        df.select(F.col(id_).alias("doc"), runs.alias("run"))
        .where(F.length("run") >= least_length)
        .select(slipped(F.col("doc"), lower).alias("word"))
        .where(F.length("word") >= least_length)
    )
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Side:
    """One side of the index: intervals of suffix ranks of the delimited words.

    ``words`` are rows of symbols in reading order of the searches; the text holds
    each of them backwards, so a search extends to the left all the way.
    """

    def __init__(self, words: list[np.ndarray]):
        gap = np.zeros(1, np.int64)
        self.text = np.concatenate([gap, *(x for w in words for x in (w[::-1], gap))])
        self.gaps = np.flatnonzero(self.text == 0)
        self.n = len(self.text)
        self.symbols = int(self.text.max()) + 1
        self.suffixes = self._sorted()
        self.before = self.text[self.suffixes - 1]
        self.keys = np.sort(self.before * (self.n + 1) + np.arange(self.n))

    def _sorted(self) -> np.ndarray:
        """Suffixes in order, by doubling; words are distinct, so a few rounds suffice."""
        ranks, step = self.text, 1
        while True:
            later = np.zeros(self.n, np.int64)
            later[: self.n - step] = ranks[step:] + 1
            key = ranks * (self.n + self.symbols + 2) + later
            order = np.argsort(key, kind="stable")
            ranks = np.empty(self.n, np.int64)
            ranks[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            if ranks[order[-1]] == self.n - 1 or step >= self.n:
                return order
            step *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        at = symbol * (self.n + 1)
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(state, symbol): the symbols, but for the delimiter, that can come next."""
        width = high - low
        cost = np.minimum(width, self.symbols)
        ends = np.cumsum(cost)
        at = 0
        while at < len(low):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STATES, "right")))
            states = np.arange(at, stop)
            wide = states[width[states] > self.symbols]
            narrow = states[width[states] <= self.symbols]
            count = width[narrow]
            place = np.arange(count.sum()) + np.repeat(low[narrow] - (np.cumsum(count) - count), count)
            found = np.unique(np.repeat(narrow, count) * self.symbols + self.before[place])
            some = np.r_[found, (wide[:, None] * self.symbols + np.arange(self.symbols)).ravel()]
            some = some[some % self.symbols != 0]
            yield some // self.symbols, some % self.symbols
            at = stop

    def word(self, low: np.ndarray) -> np.ndarray:
        """The number of the word whose delimited suffix has rank ``low``."""
        return np.searchsorted(self.gaps, self.suffixes[low])


def one_error(side: Side, words: np.ndarray, lengths: np.ndarray, exact: np.ndarray):
    """(query, word) where the first ``exact`` symbols agree and exactly one edit follows.

    ``words`` is a table of symbols, one row a query, -1 for symbols no entry has.
    """
    zero = np.zeros(len(words), np.int64)
    low, high = side.extend(zero, zero, zero + side.n)
    query = np.arange(len(words))

    def matched(query, at, low, high):
        symbol = words[query, at]
        low, high = side.extend(symbol, low, high)
        good = (symbol >= 0) & (low < high)
        return good, low, high

    for at in range(int(exact.max(initial=0))):
        going = exact[query] > at
        good, a, b = matched(query, np.full(len(query), at), low, high)
        low, high = np.where(going, a, low), np.where(going, b, high)
        keep = good | ~going
        query, low, high = query[keep], low[keep], high[keep]
    out = []
    at = exact[query]
    while len(query):
        inside = at < lengths[query]
        # the entry lacks a symbol of the query
        out.append(_finished(side, words, lengths, query[inside], at[inside] + 1, low[inside], high[inside]))
        for state, symbol in side.branches(low, high):
            q, i = query[state], at[state]
            a, b = side.extend(symbol, low[state], high[state])
            # the entry has another symbol, or one more
            other = (i < lengths[q]) & (symbol != words[q, np.minimum(i, words.shape[1] - 1)])
            out.append(_finished(side, words, lengths, q[other], i[other] + 1, a[other], b[other]))
            out.append(_finished(side, words, lengths, q, i, a, b))
        query, at, low, high = query[inside], at[inside], low[inside], high[inside]
        good, low, high = matched(query, at, low, high)
        query, at, low, high = query[good], at[good] + 1, low[good], high[good]
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.unique(pairs, axis=0)


def _finished(side: Side, words, lengths, query, at, low, high) -> np.ndarray:
    """(query, word) of the states whose remaining symbols agree up to the delimiter."""
    out = []
    while len(query):
        end = at == lengths[query]
        symbol = np.where(end, 0, words[query, np.minimum(at, words.shape[1] - 1)])
        low, high = side.extend(symbol, low, high)
        good = (symbol >= 0) & (low < high)
        done = good & end
        out.append(np.stack([query[done], side.word(low[done])], axis=1))
        going = good & ~end
        query, at, low, high = query[going], at[going] + 1, low[going], high[going]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _bucket_pairs(rows: pa.Table) -> pa.Table:
    """(word, near, near_n) of a bucket."""
    H.release()
    left = np.array(rows.column("leftward").to_pylist(), bool)
    asks = np.array(rows.column("asks").to_pylist(), bool)
    texts, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    out = {"word": [], "near": [], "near_n": []}
    for leftward in (False, True):
        entries = dict.fromkeys(texts[i] for i in np.flatnonzero((left == leftward) & ~asks))
        queries = list(dict.fromkeys(texts[i] for i in np.flatnonzero((left == leftward) & asks)))
        if not entries or not queries:
            continue
        n_of = dict(zip(texts, counts))
        entries = list(entries)
        number = {c: i + 1 for i, c in enumerate(sorted(set("".join(entries))))}

        def symbols(word: str) -> np.ndarray:
            return np.array([number.get(c, -1) for c in (word[::-1] if leftward else word)], np.int64)

        side = Side([symbols(w) for w in entries])
        lengths = np.array([len(w) for w in queries], np.int64)
        table = np.full((len(queries), int(lengths.max())), -1, np.int64)
        for row, word in zip(table, queries):
            row[: len(word)] = symbols(word)
        exact = lengths - lengths // 2 if leftward else lengths // 2
        for query, word in one_error(side, table, lengths, exact).tolist():
            out["word"].append(queries[query])
            out["near"].append(entries[word])
            out["near_n"].append(n_of[entries[word]])
    return pa.table(
        {
            "word": pa.array(out["word"], pa.string()),
            "near": pa.array(out["near"], pa.string()),
            "near_n": pa.array(out["near_n"], pa.int64()),
        }
    )


def near_words(words: DataFrame, hot: int = HOT_ENTRIES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) one edit apart, both ways."""
    length, word = F.length("word"), F.col("word")

    def half(size: Column, leftward: Column) -> Column:
        rest = size - F.floor(size / 2)
        return F.when(leftward, rest).otherwise(F.floor(size / 2)).cast("int")

    def under(sizes: Column, asks: bool) -> DataFrame:
        rows = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("leftward"))
        own = F.array_distinct(F.transform(sizes, lambda s: half(s, F.col("leftward"))))
        rows = rows.select("word", "n", "leftward", F.explode(own).alias("size"))
        end = F.when(F.col("leftward"), F.right("word", F.col("size"))).otherwise(
            F.left("word", F.col("size"))
        )
        return rows.select("word", "n", "leftward", end.alias("half"), F.lit(asks).alias("asks"))

    entries = under(F.array(length - 1, length, length + 1), False)
    rows = under(F.array(length), True).unionByName(entries)
    shared = entries.groupBy("leftward", "half").count().where(F.col("count") > hot)
    parts = shared.select("leftward", "half", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    if parts.isEmpty():
        rows = rows.withColumns({"own": F.lit(0), "other": F.lit(0)})
    else:
        cut = rows.join(parts, ["leftward", "half"], "left").fillna(1, ["parts"])
        cut = cut.withColumn("own", F.pmod(F.xxhash64(word, F.lit(7)), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = cut.withColumn("other", every)
    # a part of the queries meets a part of the entries in one place
    pair = F.when(F.col("asks"), F.struct("own", "other")).otherwise(
        F.struct(F.col("other").alias("own"), F.col("own").alias("other"))
    )
    rows = rows.withColumn("pair", pair)
    buckets = max(1, math.ceil(6 * words.count() / bucket_rows))
    bucket = F.pmod(F.xxhash64("leftward", "half", "pair"), F.lit(buckets))
    pairs = (
        rows.select(bucket.cast("int").alias("bucket"), "leftward", "asks", "word", "n")
        .groupBy("bucket")
        .applyInArrow(_bucket_pairs, "word string, near string, near_n long")
    )
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain that ``forms`` (word, form) begins; doubled until still."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = joined_to_classes(state, next_, "root")
        moved = stored(
            step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(
    df: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    hot: int = HOT_ENTRIES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    ``form`` is the near word of largest count (ties: the smallest) if it occurs
    ``FORM_RATIO`` times as often at least; ``root`` is the last of the forms of forms.
    """
    words = stored(counted(df, id_, text), "words")
    near = near_words(words, hot, bucket_rows).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.max("near_n").alias("best_n"),
        F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("best"),
    )
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
