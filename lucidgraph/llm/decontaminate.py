"""Benchmark decontamination: short test items found inside long documents.

In DataFrame operations only.  Words are runs of letters and digits, lower-cased;
a set is the distinct 5-word shingles of a text (a shorter text is one shingle).
A document is contaminated by an item if it holds at least ``percent`` of the
item's shingles.

Items are partitioned by the size of their sets, in powers of two.  The MinHash
signature of an item is its smallest shingle hashes, just so many that a document
with ``percent`` of the shingles cannot miss them all; the number follows from the
upper size of the partition, and the lower size tells how large a document's own
set must be.  So every document that shares no hash with the signatures is
settled after one look, and none is lost.  The rest is verified by the exact
containment of the shingles themselves.

An item of one to four words is one shingle of that length.  It matches only a
document that consists of just these words; inside longer documents, whose
shingles all have five words, such items are not searched.

Null and empty texts have no shingles and match nothing.  Rows of equal text are
judged alike; each item_id and doc_id that has the text gets its row.  Null ids
are kept as null.  Extra columns are ignored by ``search`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_name, stored
from .urls import MAX_BLOCKS, bloom, possible

WORDS, PERCENT = 5, 80
#: Tables counted to have no more rows than this are broadcast; others are shuffled.
SMALL_ROWS = 500_000


def words_of(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _each_shingle(words: Column, of) -> Column:
    last = F.greatest(F.size(words) - WORDS, F.lit(0))

    def shingle(i):  # the words past the end of a short text are null and left out
        return F.concat_ws(" ", *(F.get(words, i + j) for j in range(WORDS)))

    shingles = F.transform(F.sequence(F.lit(0), last), lambda i: of(shingle(i)))
    return F.when(F.size(words) > 0, shingles)


def _once(value: Column, of) -> Column:
    """``of(value)``, with the value computed once however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def shingles_of(text: Column) -> Column:
    """The distinct shingles; null without words."""
    return _once(words_of(text), lambda w: F.array_distinct(_each_shingle(w, lambda s: s)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def item_sets(items: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(item_key, shingles, n, signature, least): a row for each distinct item text.

    ``least``: no document with fewer shingles can hold enough of the partition's items.
    """
    rows = items.select(F.col(text).cast("string").alias("text")).dropna().distinct()
    rows = rows.select(
        F.md5(F.col("text").cast("binary")).alias("item_key"),
        shingles_of(F.col("text")).alias("shingles"),
    )
    rows = rows.where(F.col("shingles").isNotNull()).withColumn("n", F.size("shingles"))
    lower = F.pow(F.lit(2), F.floor(F.log2("n"))).cast("int")
    upper = 2 * lower - 1
    needed = lambda n: F.ceil(n * percent / 100)
    hashes = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s)))
    return rows.select(
        "item_key",
        "shingles",
        "n",
        F.slice(hashes, F.lit(1), (upper - needed(upper) + 1).cast("int")).alias("signature"),
        needed(lower).cast("int").alias("least"),
    )


def search(
    documents: DataFrame,
    items: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, text_key): items that documents hold."""
    sets = stored(item_sets(items, item_text, percent), "items")
    signatures = sets.select(F.explode("signature").alias("hash"), "item_key", "least")
    n_signatures = sets.agg(F.sum(F.size("signature"))).first()[0] or 0
    # md5 and not the text itself, so that only candidates' texts are ever moved
    rows = documents.select(
        F.col(id_).alias("doc_id"), F.col(text).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    rows = rows.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    hashes = _once(
        words_of(F.col("text")),
        lambda w: _each_shingle(
            w, lambda s: F.struct(F.xxhash64(s).alias("hash"), F.size(w).alias("n_words"))
        ),
    )
    probes = rows.select("text_key", F.inline(hashes))
    if n_signatures > SMALL_ROWS:
        blocks = 1
        while blocks < min(MAX_BLOCKS, n_signatures / 16):
            blocks *= 2
        probes = possible(probes, "hash", bloom(signatures, "hash", blocks), blocks)
    # a set has no more shingles than the text has words
    found = probes.join(_small(signatures, n_signatures), "hash").where("n_words >= least")
    candidates = stored(found.select("text_key", "item_key").distinct(), "candidates")
    n_candidates = candidates.count()
    near = rows.join(_small(candidates, n_candidates), "text_key")
    both = near.join(_small(sets.select("item_key", "shingles", "n"), n_signatures), "item_key")
    shared = F.size(
        F.array_intersect(shingles_of(F.col("text")), F.col("shingles"))
    ).alias("n_shared")
    exact = both.select("doc_id", "text_key", "item_key", F.col("n").alias("n_item"), shared)
    exact = exact.where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    named = items.select(
        F.col(item_id).alias("item_id"),
        F.md5(F.col(item_text).cast("string").cast("binary")).alias("item_key"),
    )
    return exact.join(named, "item_key").select(
        "doc_id", "item_id", "n_shared", "n_item", "text_key"
    )


def clean(
    documents: DataFrame, items: DataFrame, text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``documents`` whose text holds no item."""
    key = free_name(documents, "text_key")
    numbered = documents.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    unnamed = items.select(F.lit(None).cast("long").alias("item_id"), F.col("text"))
    bad = search(numbered, unnamed, percent=percent).select(F.col("text_key").alias(key)).distinct()
    bad = stored(bad, "contaminated")
    keyed = documents.withColumn(key, F.md5(F.col(text).cast("string").cast("binary")))
    return keyed.join(_small(bad, bad.count()), key, "left_anti").drop(key)
