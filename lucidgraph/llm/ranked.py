"""Ranked lexical search: the best documents of every item, by a dual-tree search.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII;
only A-Z are lower-cased.  A document's coordinate of a term is

    weight * ((10**9 * tf) div (1000 * tf + 8 * m)),  m = 10 + (90 * n * N) div L

with ``n`` its terms, ``N`` the documents that have a term and ``L`` all their terms; the weight
is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``.  A score is the sum of a document's
coordinates over the item's distinct terms.

Both sides are trees whose nodes hold the largest coordinates below them.  For a node of
items that is the union of their terms, and each task builds trees over its documents.
The sum of a document node's maxima over an item node's terms bounds every score of the
two, so the pair is dropped as a whole if the bound is below the weakest k-th score of
the node's items.  Otherwise both sides are opened, and a single item with a leaf is scored.
A first, greedy descent looks only at the most promising leaf of each item; the k-th of
all its scores is what the full search starts from.  Results are exact.

Items are searched in blocks of a bounded number of terms, each against all documents; no rows
of documents are shuffled, and a task gives out ``k`` rows an item at most.

Cases: null and empty texts have no terms and are never found; very long texts are read in pieces;
rows of one item id are one item with the terms of all of them, those of a null id too;
each row of a document is ranked by itself, so repeated rows tie; a null document id comes
after all others and is returned as null; empty tables and items without terms give no
rows; other columns are not looked at.  All terms of one item come to the driver at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .frames import map_batches, stored, text_pieces

K = 10
#: Terms of the items that are searched at once, each counted once an item.
BLOCK_TERMS = 50_000
#: Documents of a leaf, children of a node, and cells of the table of a level's maxima.
LEAF, FANOUT, CELLS = 16, 8, 4 << 20
#: A node of items is halved as it stands if no term leaves both parts one in so many items.
SMALLEST_PART = 8
#: Term occurrences of the documents of one tree.
TREE_ENTRIES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_GAP = bytes(32 if b in _GAPS else b for b in range(256))


def item_terms(items: DataFrame, id_: str, text: str) -> DataFrame:
    """(item, term), each once."""
    whole = F.translate(F.col(text).cast("string"), UPPER, UPPER.lower())
    terms = F.explode(F.regexp_extract_all(whole, F.lit(TERM), F.lit(0)))
    return items.select(F.col(id_).alias("item"), terms.alias("term")).distinct()


def term_counts(text: bytes, number: dict[bytes, int]) -> tuple[int, Counter]:
    """(terms of a UTF-8 text, occurrences by the numbers of those in ``number``)."""
    n, counts = 0, Counter()
    for piece in text_pieces(text, _GAPS):
        found = piece.translate(_TO_GAP).lower().split()
        n += len(found)
        counts.update([x for x in map(number.get, found) if x is not None])
    return n, counts


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): how often a document has each numbered term."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [term_counts((t.as_py() or "").encode(), number) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([list(c) for _, c in found], pa.list_(pa.int32())),
                pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64())),
            ],
            names=["doc", "n", "terms", "tfs"],
        )

    return map_batches(docs, count, "doc long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemTree:
    """Items in an order in which each node is a range, split where a term parts it best."""

    def __init__(self, terms: list[np.ndarray]):
        self.order = np.arange(len(terms))
        self.root = self._node(terms, 0, len(terms)) if terms else None
        self.terms = [terms[i] for i in self.order]

    def _node(self, terms, low: int, high: int) -> tuple:
        own = [terms[i] for i in self.order[low:high]]
        union, counts = np.unique(np.concatenate(own), return_counts=True)
        if high - low == 1:
            return (low, high, union, ())
        best = np.argmin(np.abs(2 * counts - (high - low)))
        has = np.array([union[best] in t for t in own])
        if not 1 <= SMALLEST_PART * counts[best] / (high - low) <= SMALLEST_PART - 1:
            has = np.arange(high - low) < (high - low) // 2
        self.order[low:high] = np.r_[self.order[low:high][has], self.order[low:high][~has]]
        cut = low + int(has.sum())
        return (low, high, union, (self._node(terms, low, cut), self._node(terms, cut, high)))


class DocTree:
    """Some documents as sparse rows, and per level the maxima of ranges of them.

    ``levels`` goes from the leaves to the root; a level is (first row of each
    node, maxima by node and term of this tree).
    """

    def __init__(self, doc, lengths, terms, values):
        starts = np.r_[0, np.cumsum(lengths)]
        # documents whose heaviest term is the same one stand together
        row = np.repeat(np.arange(len(lengths)), lengths)
        by_weight = np.lexsort((terms, -values, row))
        heaviest = np.full(len(lengths), -1, np.int64)
        heaviest[lengths > 0] = terms[by_weight][starts[:-1][lengths > 0]]
        order = np.lexsort((lengths, heaviest))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entries = np.argsort(place[row], kind="stable")
        self.doc, self.terms, self.values = doc[order], terms[entries], values[entries]
        self.starts = np.r_[0, np.cumsum(lengths[order])]
        self.known, local = np.unique(self.terms, return_inverse=True)
        size = max(LEAF, -(-len(order) * max(1, len(self.known)) // CELLS))
        self.levels, row = [], np.sort(place[row])
        while True:
            nodes = -(-len(order) // size)
            table = np.zeros((nodes, len(self.known)), np.int64)
            if self.levels:
                below = self.levels[-1][1]
                np.maximum.at(table, np.arange(len(below)) // FANOUT, below)
            else:
                np.maximum.at(table, (row // size, local), self.values)
            self.levels.append((np.minimum(np.arange(nodes + 1) * size, len(order)), table))
            if nodes == 1:
                break
            size *= FANOUT

    def scores(self, leaves: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the documents of some leaves for the item whose terms ``member`` marks."""
        bounds = self.levels[0][0]
        rows = np.concatenate([np.arange(bounds[a], bounds[a + 1]) for a in leaves])
        lengths = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - lengths), lengths)
        sums = np.r_[0, np.cumsum(self.values[at] * member[self.terms[at]])]
        return rows, sums[ends] - sums[ends - lengths]


class Search:
    """The best ``k`` documents of every item among the trees it has met."""

    def __init__(self, items: ItemTree, k: int, n_terms: int, least: np.ndarray):
        self.items, self.k, self.n_terms = items, k, n_terms
        self.least = least.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.terms]

    def keep(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.least[item])
        if not good.any():
            return
        docs = np.r_[self.found[item][0], docs[good]]
        scores = np.r_[self.found[item][1], scores[good]]
        best = np.lexsort((docs, -scores))[: self.k]
        self.found[item] = docs[best], scores[best]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], scores[best[-1]])

    def _score(self, item: int, tree: DocTree, leaves: np.ndarray) -> None:
        member = np.zeros(self.n_terms, np.int64)
        member[self.items.terms[item]] = 1
        rows, scores = tree.scores(leaves, member)
        self.keep(item, tree.doc[rows], scores)

    def _bounds(self, tree: DocTree, level: int, nodes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        if not len(tree.known):
            return np.zeros(len(nodes), np.int64)
        at = np.minimum(np.searchsorted(tree.known, terms), len(tree.known) - 1)
        columns = at[tree.known[at] == terms]
        return tree.levels[level][1][np.ix_(nodes, columns)].sum(axis=1)

    def _below(self, tree: DocTree, level: int, nodes: np.ndarray) -> np.ndarray:
        children = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return children[children < len(tree.levels[level - 1][1])]

    def all(self, tree: DocTree) -> None:
        """Every pair of nodes that can still change a result."""
        todo = [(self.items.root, len(tree.levels) - 1, np.zeros(1, np.int64))]
        while todo:
            (low, high, terms, parts), level, nodes = todo.pop()
            weakest = max(1, self.least[low:high].min())
            nodes = nodes[self._bounds(tree, level, nodes, terms) >= weakest]
            if not len(nodes):
                continue
            if not parts and level == 0:
                self._score(low, tree, nodes)
                continue
            below = self._below(tree, level, nodes) if level else nodes
            for part in parts or [(low, high, terms, parts)]:
                todo.append((part, max(level - 1, 0), below))

    def first(self, tree: DocTree) -> None:
        """The most promising leaf of each item."""
        for item, terms in enumerate(self.items.terms):
            node = np.zeros(1, np.int64)
            for level in range(len(tree.levels) - 1, -1, -1):
                bounds = self._bounds(tree, level, node, terms)
                node = node[[int(np.argmax(bounds))]]
                if level:
                    node = self._below(tree, level, node)
            self._score(item, tree, node)


def _column(table: pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _trees(batches: Iterator[pa.RecordBatch], n_docs: int, length: int, weights) -> Iterator[DocTree]:
    """Trees of a task's documents, of a bounded number of entries each (one document at least)."""
    parts, size = [], 0

    def tree() -> DocTree:
        doc, n, lengths, terms, tfs = (np.concatenate(x) for x in zip(*parts))
        # whole numbers of any size: 90 n N may pass 64 bits
        m = np.array([10 + (90 * int(x) * n_docs) // length for x in n], np.int64)
        tf = tfs.astype(np.int64)
        values = weights[terms] * ((10**9 * tf) // (1000 * tf + 8 * np.repeat(m, lengths)))
        return DocTree(doc, lengths, terms.astype(np.int64), values)

    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + TREE_ENTRIES - size, side="right")))
            cut = batch.slice(at, stop - at)
            parts.append(
                (
                    _column(cut, "doc"),
                    _column(cut, "n"),
                    np.diff(np.r_[before, ends[at:stop]]),
                    cut.column("terms").flatten().to_numpy(zero_copy_only=False),
                    cut.column("tfs").flatten().to_numpy(zero_copy_only=False),
                )
            )
            size += int(ends[stop - 1] - before)
            at = stop
            if size >= TREE_ENTRIES:
                yield tree()
                parts, size = [], 0
    if parts:
        yield tree()


_FOUND = "item int, doc long, score long"


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(sparse, tree: ItemTree, weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    def searched(least: np.ndarray, full: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(tree, k, len(weights), least)
            for documents in _trees(batches, n_docs, length, weights):
                (search.all if full else search.first)(documents)
            sizes = [len(docs) for docs, _ in search.found]
            docs, scores = (np.concatenate(x) for x in zip(*search.found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
                    pa.array(docs, pa.int64()),
                    pa.array(scores, pa.int64()),
                ],
                names=["item", "doc", "score"],
            )

        return sparse.mapInArrow(run, _FOUND)

    least = np.zeros(len(tree.terms), np.int64)
    weakest = _top(searched(least, False), k).where(F.col("rank") == k)
    for row in weakest.collect():  # one row an item of the block
        least[row["item"]] = row["score"]
    return _top(searched(least, True), k)


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = K,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    spark = documents.sparkSession
    doc = F.coalesce(F.col(id_).cast("long"), F.lit(H.NO_ID)).alias("doc")
    docs = documents.select(doc, F.col(text).cast("string").alias("text"))
    pairs = stored(item_terms(items, item_id, item_text), "terms")
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "item"), F.lit(blocks)))
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for block in range(blocks):
        rows = pairs.where(F.col("block") == block).select("item", "term").collect()
        number: dict[bytes, int] = {}
        of: dict = {}
        for item, term in rows:
            of.setdefault(item, []).append(number.setdefault(term.encode(), len(number)))
        if not of:
            continue
        sparse = stored(counted(docs, number), "counted").where("n > 0")
        n_docs, length = sparse.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        frequency = sparse.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(len(number), np.int64)
        for term, df in frequency.collect():  # terms of the block
            weights[term] = weight(n_docs, df)
        ids = list(of)
        tree = ItemTree([np.unique(np.array(of[i], np.int64)) for i in ids])
        found = _search_block(sparse, tree, weights, n_docs, length, k)
        names = spark.createDataFrame(
            [(at, ids[i]) for at, i in enumerate(tree.order.tolist())],
            f"item int, item_id {kind}",
        )
        found = found.join(F.broadcast(names), "item").select(
            "item_id",
            "rank",
            F.when(F.col("doc") != H.NO_ID, F.col("doc")).alias("doc_id"),
            "score",
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out

