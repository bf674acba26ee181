"""SimHash near-dedup by ball hashing: texts whose 64-bit fingerprints differ in few bits.

Texts are lower-cased in A-Z and cut at ``[\\x20\\x09-\\x0D]``.  A text's features are
its 4-word shingles, repeats included (fewer words: the whole sequence is one), hashed
by XXH64 with seed 42.  A bit of the fingerprint is 1 if over half the hashes have it.
A text without words has fingerprint zero and is linked like any other.

Fingerprints link at ``radius`` or fewer differing bits.  Each distinct fingerprint
emits all variants within half the radius, so two that link meet in the middle in
at least one variant, and two that meet in a variant are at most twice half the
radius apart.  Hence the fingerprints of a variant need not be paired: each links with
the smallest of them, and a variant that thousands share costs thousands of links.  The
radius has to be even.

Variants travel twice.  First as ``LOW_BITS`` bits of a hash within their bucket, sorted and
compressed, a row for each group of fingerprints and bucket of variants; a bucket answers
which of them came up more than once (a chance meeting costs a look, not a result).  Then
only those, in full, with their fingerprints.

Cases: a null text is empty; very long texts are read in pieces; an empty table gives no
rows; equal rows stay separate rows of one component; a row with a null id keeps its
fingerprint and links like any other, and its component is the smallest id that is not
null (null if there is none); other columns are not looked at.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import components
from .frames import joined_to_classes, map_batches, stored, text_pieces

WORDS, RADIUS, SEED = 4, 4, 42
#: Variants of the fingerprints that are one group, and of those that are one bucket.
GROUP_VARIANTS = BUCKET_VARIANTS = 4 << 20
#: Bits that tell the variants of a bucket apart: one in 4,000 meets another by chance.
LOW_BITS = 34
_SPACES = bytes([9, 10, 11, 12, 13, 32])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    hash_ = xxhash.xxh64_intdigest
    for piece in text_pieces(text, _SPACES):
        found = tail + piece.lower().split()
        if len(found) >= words:
            line = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
            hashes = np.array([hash_(line[a:b], seed) for a, b in spans], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
            tail = found[len(found) - words + 1 :]
        else:
            tail = found
    if not n and tail:
        return hash_(b" ".join(tail), seed)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text")
    prints = np.array([fingerprint((t.as_py() or "").encode()) for t in texts], np.uint64)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), pa.array(prints.view(np.int64))], names=["doc", "print"]
    )


def masks(radius: int, bits: int = 64) -> np.ndarray:
    """What changes a fingerprint into each variant within ``radius``, itself first."""
    out = [
        sum(1 << b for b in places)
        for r in range(radius + 1)
        for places in combinations(range(bits), r)
    ]
    return np.array(out, np.uint64)


def _variants(prints: np.ndarray, change: np.ndarray) -> np.ndarray:
    return prints.view(np.uint64)[:, None] ^ change[None, :]


def _keys(variants: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low bits of the hash of each variant, in one word."""
    hashes, shift = H.mix(variants), np.uint64(LOW_BITS)
    bucket = (hashes >> shift) % np.uint64(buckets)
    return (bucket << shift) | (hashes & ((np.uint64(1) << shift) - np.uint64(1)))


def _bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(LOW_BITS)).astype(np.int64)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _sent(rows: pa.Table, grp: int, change: np.ndarray, buckets: int) -> pa.Table:
    """(bucket, grp, prints): the variants of a group; one that came up again, twice."""
    keys = _keys(_variants(_numbers(rows, "print"), change).ravel(), buckets)
    keys.sort()
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    keys = keys[keep]
    bucket = _bucket_of(keys)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    return pa.table(
        {
            "bucket": pa.array(bucket[starts], pa.int32()),
            "grp": pa.array([grp] * len(starts), pa.int32()),
            "prints": pa.array([H.pack(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        }
    )


def _told(rows: pa.Table) -> pa.Table:
    """(grp, prints): for each group, those of its variants that came up more than once."""
    H.release()
    sent = [H.unpack(x) for x in rows.column("prints").to_pylist()]
    keys = np.sort(np.concatenate(sent))
    again = np.unique(keys[1:][keys[1:] == keys[:-1]])
    del keys
    out = {"grp": [], "prints": []}
    for grp, own in zip(rows.column("grp").to_pylist(), sent):
        own = own[np.isin(own, again)]
        if len(own):
            out["grp"].append(grp)
            out["prints"].append(H.pack(np.unique(own)))
    return pa.table(
        {"grp": pa.array(out["grp"], pa.int32()), "prints": pa.array(out["prints"], pa.binary())}
    )


def _meeting(rows: pa.Table, side: pa.Table, change: np.ndarray, buckets: int) -> pa.Table:
    """(bucket, variants, owners): the variants of a group that came up more than once, in full."""
    H.release()
    told = [H.unpack(x) for x in side.column("prints").to_pylist()]
    out = {"bucket": [], "variants": [], "owners": []}
    prints = _numbers(rows, "print")
    if told and len(prints):
        again = np.sort(np.concatenate(told))
        variants = _variants(prints, change).ravel()
        keys = _keys(variants, buckets)
        place = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        meets = np.flatnonzero(again[place] == keys)
        bucket = _bucket_of(keys[meets])
        order = np.argsort(bucket, kind="stable")
        meets, bucket = meets[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for a, b in zip(starts, np.r_[starts[1:], len(bucket)] if len(bucket) else []):
            out["bucket"].append(bucket[a])
            out["variants"].append(H.pack_any(variants[meets[a:b]].view(np.int64)))
            out["owners"].append(H.pack_any(prints[meets[a:b] // len(change)]))
    return pa.table(
        {
            "bucket": pa.array(out["bucket"], pa.int32()),
            "variants": pa.array(out["variants"], pa.binary()),
            "owners": pa.array(out["owners"], pa.binary()),
        }
    )


def _links(rows: pa.Table, radius: int) -> pa.Table:
    """(u, v): the distinct links of a bucket's variants, each to the smallest of its variant."""
    H.release()
    variants = np.concatenate([H.unpack_any(x) for x in rows.column("variants").to_pylist()])
    owners = np.concatenate([H.unpack_any(x) for x in rows.column("owners").to_pylist()])
    order = np.lexsort((owners, variants))
    variants, owners = variants[order], owners[order]
    first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
    least = np.repeat(owners[first], np.diff(np.r_[first, len(variants)]))
    pairs = np.unique(np.stack([least, owners], axis=1), axis=0)
    apart = np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64))
    pairs = pairs[(apart > 0) & (apart <= radius)]
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) that connect the distinct fingerprints ``print`` at most ``radius`` bits apart.

    Their connected components are those of all pairs within the radius.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    change = masks(radius // 2)
    total = prints.count() * len(change)
    groups = max(1, math.ceil(total / GROUP_VARIANTS))
    buckets = max(1, math.ceil(total / BUCKET_VARIANTS))
    grp = F.pmod(F.xxhash64("print"), F.lit(groups)).cast("int")
    # few small rows in, many large ones out: a number of partitions that stays
    rows = prints.select(grp.alias("grp"), "print").repartition(groups, "grp")
    grouped = rows.groupBy("grp")

    def send(key, rows):
        H.release()
        return _sent(rows, key[0].as_py(), change, buckets)

    sent = grouped.applyInArrow(send, "bucket int, grp int, prints binary")
    told = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_told, "grp int, prints binary")
    meeting = grouped.cogroup(told.repartition(groups, "grp").groupBy("grp")).applyInArrow(
        lambda rows, side: _meeting(rows, side, change, buckets),
        "bucket int, variants binary, owners binary",
    )
    return meeting.groupBy("bucket").applyInArrow(
        lambda rows: _links(rows, radius), "u long, v long"
    )


def dedup(
    df: DataFrame, id_: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = df.select(
        F.col(id_).cast("long").alias("doc"), F.col(text).cast("string").alias("text")
    )
    rows = stored(map_batches(rows, _fingerprinted, "doc long, print long"), "fingerprints")
    one = stored(
        rows.groupBy("print").agg(F.min("doc").alias("doc")), "classes"
    )
    found = components(links(one.select("print"), radius))
    found = found.withColumnRenamed("doc", "print")
    rooted = one.join(found, "print", "left").select(
        "print", "doc", F.coalesce("component", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    classes = joined_to_classes(rooted.select("print", "root"), least, "root")
    classes = stored(classes.select("print", "component_id"), "classes")
    return joined_to_classes(rows, classes, "print").select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
