"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike, as components.

Texts are lower-cased in A-Z and cut at ``[\\x20\\x09-\\x0D]``.  A set holds the
distinct 5-word shingles; with fewer words the whole sequence is one shingle,
without words it is empty and links with nothing.  Two documents link when
``100 * intersection >= 80 * union``.

Equal sets count once.  The rest is size-aware:

* Small sets enumerate subsets of as many shingles as two sets of their sizes must
  share.  Sets with a subset in common link, with no further look.
* Large sets put the shingles that may not all be missing, the rarest first, into
  inverted lists.  A list is scanned twice.  First each document is compared
  with the smallest id of its size only; then, of what is still in different
  components, every pair whose sizes and positions allow a link; the largest
  component of a list is not compared with itself.  So a list of near copies costs
  about its length, and no pair is lost.

The boundary between small and large is the one of least estimated cost, from the
numbers of sets of each size.  How many documents have a shingle is counted over
all documents and only settles the order.

Rows with a null id keep their set but get no component and link with nothing;
rows of one id are one document.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import components
from .frames import map_batches, stored, utf8

WORDS, PERCENT = 5, 80
#: Sets beyond this size never count as small.
LARGEST_SMALL = 16
#: Estimated cost of an entry of an inverted list, in subsets.
LIST_COST = 12.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Words that are hashed at a time.
_AT_ONCE = 100_000


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, text of each word)."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACE[data]
    begins = ~gap[:-1]
    begins[1:] &= gap[:-2] if len(data) > 1 else True
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = ~gap[first]
    ends = ~gap[:-1] & gap[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = ~gap[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), _AT_ONCE):
        b = min(a + _AT_ONCE, len(starts))
        low, high = starts[a], stops[b - 1]
        ranges = H.Ranges(_LOWER[data[low:high]])
        hashes[a:b] = ranges(starts[a:b] - low, stops[a:b] - low)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The set of each text: ascending distinct shingle hashes."""
    words, text = word_hashes(data, offsets)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    at = np.r_[0, np.cumsum(counts)]
    weights = H.mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - WORDS + 1)
    five = np.zeros(n, np.uint64)
    for i in range(WORDS if n else 0):
        five += words[i : i + n] * weights[i]
    five = H.mix(five)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(H.mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = H.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = H.mix(tokens + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _identified(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = sets_of(*utf8(batch.column("text")))
    ids = [_identity(s) for s in sets]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("grp"),
            batch.column("doc"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([a for a, _ in ids], pa.int64()),
            pa.array([b for _, b in ids], pa.int64()),
        ],
        names=["grp", "doc", "n", "k1", "k2"],
    )


# --- sizes -------------------------------------------------------------------


def needed(a: int, b: int, percent: int) -> int:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partners(n: int, largest: int, percent: int) -> list[int]:
    return [
        b
        for b in range(-(-percent * n // 100), min(largest, 100 * n // percent) + 1)
        if needed(n, b, percent) <= min(n, b)
    ]


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest size that counts as small, by estimated cost."""

    def cost(limit: int) -> float:
        subsets = sum(
            count * math.comb(n, needed(n, b, percent))
            for n, count in sizes.items()
            if n <= limit
            for b in partners(n, limit, percent)
        )
        least = -(-percent * (limit + 1) // 100)
        lists = sum(c * prefix(n, percent) for n, c in sizes.items() if n >= least)
        return subsets + LIST_COST * lists

    return min(range(LARGEST_SMALL + 1), key=lambda limit: (cost(limit), limit))


@lru_cache(maxsize=256)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def subset_keys(tokens: np.ndarray, limit: int, percent: int) -> list[dict]:
    """A key for each subset that a set of some partner size must have in common.

    ``least`` is the smaller one of the two sizes: only with a set of that size in
    it does a key prove that the others link.
    """
    n, out = len(tokens), []
    for b in partners(n, limit, percent):
        c = needed(n, b, percent)
        weights = H.mix(np.arange(1, c + 1, dtype=np.uint64)) | np.uint64(1)
        sizes = np.uint64(min(n, b) * 1000 + max(n, b))
        keys = H.mix((tokens[_choices(n, c)] * weights).sum(axis=1, dtype=np.uint64) + sizes)
        out += [{"key": k, "least": min(n, b)} for k in keys.view(np.int64).tolist()]
    return out


# --- groups ------------------------------------------------------------------


def _wanted(docs: pa.Table, side: pa.Table):
    """(id, set) of the documents of a group that stand for their sets, each once."""
    doc, k1 = side.column("doc").to_pylist(), side.column("k1").to_pylist()
    wanted = {(d, k) for d, k in zip(doc, k1) if d is not None}
    ids = docs.column("doc").to_pylist()
    at, texts = 0, docs.column("text").combine_chunks() if docs.num_rows else None
    while at < len(ids):
        stop, size = at, 0
        while stop < len(ids) and (stop == at or size < 1 << 20):
            size += len(texts[stop].as_py())
            stop += 1
        for d, tokens in zip(ids[at:stop], sets_of(*utf8(texts.slice(at, stop - at)))):
            key = (d, _identity(tokens)[0])
            if key in wanted:
                wanted.remove(key)
                yield d, tokens
        at = stop


ACTIVE = (
    "doc long, n long, tokens array<long>, list array<struct<token:long,pos:int>>, "
    "subsets array<struct<key:long,least:int>>"
)
_SUBSETS = pa.list_(pa.struct([("key", pa.int64()), ("least", pa.int32())]))
_LIST = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))


def _entries(docs, side, groups: int, limit: int, percent: int) -> pa.Table:
    """Rows ``ACTIVE`` of the sets that may link: list entries or subsets."""
    H.release()
    keys, counts = H.known(side)
    least = -(-percent * (limit + 1) // 100)
    out = {"doc": [], "n": [], "tokens": [], "list": [], "subsets": []}
    for doc, tokens in _wanted(docs, side):
        n, entries = len(tokens), []
        if n >= least:
            have = H.look_up(H.keys_of(tokens, groups), keys, counts)
            alone = int((have == 1).sum())
            p = prefix(n, percent)
            if alone < p:
                order = np.lexsort((tokens, have))[alone:p]
                entries = [
                    {"token": int(t), "pos": alone + i}
                    for i, t in enumerate(tokens[order].view(np.int64))
                ]
        subsets = subset_keys(tokens, limit, percent) if n <= limit else []
        if entries or subsets:
            out["doc"].append(doc)
            out["n"].append(n)
            out["tokens"].append(tokens.view(np.int64))
            out["list"].append(entries)
            out["subsets"].append(subsets)
    return pa.table(
        {
            "doc": pa.array(out["doc"], pa.int64()),
            "n": pa.array(out["n"], pa.int64()),
            "tokens": pa.array(out["tokens"], pa.list_(pa.int64())),
            "list": pa.array(out["list"], _LIST),
            "subsets": pa.array(out["subsets"], _SUBSETS),
        }
    )


# --- links -------------------------------------------------------------------


def _verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link."""
    sets = active.select("doc", "n", "tokens")
    a = sets.toDF("u", "un", "ut")
    b = sets.toDF("v", "vn", "vt")
    small, large = F.least("un", "vn"), F.greatest("un", "vn")
    both = pairs.join(a, "u").join(b, "v").where(100 * small >= percent * large)
    inter = F.size(F.array_intersect("ut", "vt"))
    linked = both.where(100 * inter >= percent * (F.col("un") + F.col("vn") - inter))
    return linked.select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where("u != v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _subset_links(active: DataFrame) -> DataFrame:
    """Of the sets with a subset in common, all of one size with the first of the other."""
    rows = active.select("doc", "n", F.inline("subsets"))
    ends = rows.groupBy("key", "least").agg(
        F.min("n").alias("small"),
        F.min_by("doc", F.struct("n", "doc")).alias("first"),
        F.min_by("doc", F.struct(-F.col("n"), "doc")).alias("last"),
        F.count("*").alias("rows"),
    ).where("rows > 1 and small = least")
    # a key is of one pair of sizes, so other sizes than these two do not have it
    other = F.when(F.col("n") == F.col("least"), F.col("last")).otherwise(F.col("first"))
    return _ordered(rows.join(ends, ["key", "least"]).select(F.col("doc").alias("u"), other.alias("v")))


def _list_links(active: DataFrame, percent: int) -> list[DataFrame]:
    rows = active.select("doc", "n", F.explode("list").alias("e"))
    rows = rows.select("doc", "n", "e.token", "e.pos")
    band = F.floor(F.log("n") / math.log(1.1)).cast("int")
    banded = rows.withColumn("band", band)
    pivots = banded.groupBy("token", "band").agg(F.min("doc").alias("pivot"))
    near = banded.select(
        F.col("doc").alias("u"), "token", F.explode(F.array("band", F.col("band") + 1)).alias("band")
    )
    stars = near.join(pivots, ["token", "band"]).select("u", F.col("pivot").alias("v"))
    stars = stored(_ordered(stars), "stars")
    first = stored(_verified(stars, active, percent), "links")
    found = components(first)
    # shingles before the first common one cannot be shared, so a partner is no larger
    reach = F.floor((100 * F.col("n") - (100 + percent) * F.col("pos")) / percent)
    placed = rows.join(found, "doc", "left").select(
        "token", "doc", "n", reach.alias("reach"), F.coalesce("component", "doc").alias("c")
    )
    lists = placed.groupBy("token").agg(
        F.min("n").alias("least"), F.max("reach").alias("most"),
        F.min("c").alias("one"), F.max("c").alias("other"),
    ).where("one != other")
    open_ = placed.join(lists, "token").where("reach >= least and n <= most")
    open_ = stored(open_.select(*placed.columns), "open")
    # what is not in the largest component of its list meets the whole list; that
    # component does not meet itself
    cells = open_.groupBy("token", "c").count()
    largest = cells.groupBy("token").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    marked = open_.join(largest, "token").withColumn("main", F.col("c") == F.col("main"))
    a = marked.where("not main").select(
        "token", F.col("doc").alias("u"), F.col("n").alias("un"), F.col("reach").alias("ur"),
        F.col("c").alias("uc"),
    )
    b = marked.select(
        "token", F.col("doc").alias("v"), F.col("n").alias("vn"), F.col("reach").alias("vr"),
        F.col("c").alias("vc"), "main",
    )
    pairs = a.join(b.hint("merge"), "token").where(
        "uc != vc and vn <= ur and un <= vr and (main or u < v)"
    )
    pairs = _ordered(pairs.select("u", "v")).join(stars, ["u", "v"], "left_anti")
    return [first, _verified(pairs, active, percent)]


def join(
    df: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    group_bytes: int = H.GROUP_BYTES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; a row for each."""
    groups = H.n_groups(df, text, group_bytes)
    docs = H.dealt(df, id_, text, groups)
    sets = stored(
        map_batches(docs, _identified, "grp int, doc long, n long, k1 long, k2 long"), "sets"
    )
    has_set = sets.where((F.col("n") > 0) & (F.col("doc") != H.NO_ID))
    one = has_set.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "grp")).alias("one"))
    one = stored(one.select("k1", "k2", "n", "one.doc", "one.grp"), "classes")
    sizes = {
        r["n"]: r["count"] for r in one.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").count().collect()
    }
    limit = boundary(sizes, percent)
    stand = one.select("grp", "doc", "k1")

    def fingerprints(key, left: pa.Table, right: pa.Table) -> pa.Table:
        H.release()
        found = [tokens for _, tokens in _wanted(left, right)]
        prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return H.send(prints, np.ones(len(prints)), key[0].as_py(), groups)

    grouped = docs.groupBy("grp")
    sent = grouped.cogroup(stand.groupBy("grp")).applyInArrow(fingerprints, H.SENT)
    told = sent.groupBy("bucket").applyInArrow(H.shared, H.KNOWN)
    side = stand.select("*", F.lit(None).cast("binary").alias("prints"), F.lit(None).cast("binary").alias("docs"))
    none = F.lit(None).cast("long")
    side = side.unionByName(told.select("grp", none.alias("doc"), none.alias("k1"), "prints", "docs"))
    active = grouped.cogroup(side.groupBy("grp")).applyInArrow(
        lambda left, right: _entries(left, right, groups, limit, percent), ACTIVE
    )
    active = stored(active, "active")
    links = _subset_links(active)
    for more in _list_links(active, percent):
        links = links.unionByName(more)
    found = components(links)
    classes = one.join(found, "doc", "left").select(
        "k1", "k2", "n", F.coalesce("component", "doc").alias("component_id")
    )
    rows = sets.join(classes, ["k1", "k2", "n"], "left")
    known = F.col("doc") != H.NO_ID
    return rows.select(
        F.when(known, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component_id", "doc")).alias("component_id"),
    )
