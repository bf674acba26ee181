"""64-bit hashes of byte ranges, and packed sets of them that travel between groups.

Documents are dealt to groups of a few megabytes.  A group sends the fingerprints
of its documents to buckets (one compressed row for each group and bucket), and a
bucket tells each group which of them other documents have as well.  Fingerprints
are 40 bits within a bucket there; a chance meeting costs a look, not a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a group of documents, on average.
GROUP_BYTES = 4 << 20
#: Rows without an id stand behind all others.
NO_ID = (1 << 63) - 1
LOW = np.uint64((1 << 40) - 1)
_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Ranges:
    """Hashes of any ranges of a byte array from one pass over it."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit words as planes of bytes of their differences, compressed."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """Whole numbers in their own order."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_any(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def n_groups(df: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> int:
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(1, math.ceil(total / group_bytes))


def dealt(df: DataFrame, id_: str, text: str, groups: int) -> DataFrame:
    """(grp, doc, text): rows by group; a null id is ``NO_ID``, a null text empty."""
    doc = F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias("doc")
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = df.select(doc, whole)
    grp = F.pmod(F.xxhash64("doc", F.md5(F.col("text").cast("binary"))), F.lit(groups)).cast("int")
    return rows.select(grp.alias("grp"), "doc", "text")


def buckets_of(prints: np.ndarray, groups: int) -> np.ndarray:
    return ((prints >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)


def keys_of(prints: np.ndarray, groups: int) -> np.ndarray:
    """Bucket and low bits in one word: what a group and a bucket say of a fingerprint."""
    return (buckets_of(prints, groups).astype(np.uint64) << np.uint64(40)) | (prints & LOW)


SENT = "bucket int, grp int, prints binary, docs binary"
KNOWN = "grp int, prints binary, docs binary"


def send(prints: np.ndarray, docs: np.ndarray, grp: int, groups: int) -> pa.Table:
    """Rows ``SENT`` of a group: its distinct fingerprints with the documents that have each."""
    keys, place = np.unique(keys_of(prints, groups), return_inverse=True)
    counts = np.bincount(place, weights=docs, minlength=len(keys)).astype(np.int64)
    bucket = (keys >> np.uint64(40)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
    ends = np.r_[starts[1:], len(keys)] if len(keys) else []
    return pa.table(
        {
            "bucket": pa.array(bucket[starts] if len(keys) else [], pa.int32()),
            "grp": pa.array([grp] * len(starts), pa.int32()),
            "prints": pa.array([pack(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
            "docs": pa.array([pack_any(counts[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        }
    )


def shared(rows: pa.Table) -> pa.Table:
    """Rows ``KNOWN`` of a bucket: for each group its fingerprints that two documents have."""
    groups = rows.column("grp").to_pylist()
    prints = [unpack(x) for x in rows.column("prints").to_pylist()]
    docs = [unpack_any(x) for x in rows.column("docs").to_pylist()]
    keys, place = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(docs), minlength=len(keys)).astype(np.int64)
    out, at = {"grp": [], "prints": [], "docs": []}, 0
    for grp, own in zip(groups, prints):
        counts = total[place[at : at + len(own)]]
        at += len(own)
        if (counts >= 2).any():
            out["grp"].append(grp)
            out["prints"].append(pack(own[counts >= 2]))
            out["docs"].append(pack_any(counts[counts >= 2]))
    return pa.table(
        {
            "grp": pa.array(out["grp"], pa.int32()),
            "prints": pa.array(out["prints"], pa.binary()),
            "docs": pa.array(out["docs"], pa.binary()),
        }
    )


def release() -> None:
    """Gives memory that Arrow keeps for later back to the machine, between groups."""
    pa.default_memory_pool().release_unused()


def known(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, documents) of what the buckets told a group."""
    rows = [
        (unpack(a), unpack_any(b))
        for a, b in zip(side.column("prints").to_pylist(), side.column("docs").to_pylist())
        if a is not None
    ]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, docs = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(keys)
    return keys[order], docs[order]


def look_up(keys: np.ndarray, known_keys: np.ndarray, known_docs: np.ndarray) -> np.ndarray:
    """Documents that have each key; 1 where the buckets told nothing."""
    if not len(known_keys):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known_keys, keys), len(known_keys) - 1)
    return np.where(known_keys[at] == keys, known_docs[at], 1)
