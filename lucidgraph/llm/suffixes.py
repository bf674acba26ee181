"""Suffix-array dedup: bytes covered by 50-byte strings that an earlier document has.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with
a smaller id.  Strings are judged on the input, whole texts as UTF-8, and never
cross documents.

Sorting the suffixes of everything would move every text fifty times over.  So
candidates come first: each string belongs to the 24-byte gram of least hash in
it, and equal strings belong to equal grams.  Grams are counted over all
documents; only the stretches of text around grams that two documents have are
sent to buckets.  There their suffixes are sorted in two stages: those smaller
than their successor are sorted directly, the others follow from them by one scan
over the buckets of first bytes.  Neighbours with a common prefix of ``LENGTH``
bytes are the same string, and the smallest id of each run of neighbours keeps it.
Equal stretches of a group of documents travel once, and so do equal texts.

Null and empty texts lose nothing.  Rows of one id never remove anything from each
other; a null id counts as larger than all others.  A row for each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .frames import utf8

LENGTH = 50
_GRAM = 24
_WINDOW = LENGTH - _GRAM + 1
#: Bytes that are hashed at a time; their positions fit the low bits of a hash.
_CHUNK_BITS = 19
_CHUNK = 1 << _CHUNK_BITS


# --- suffix sorting -----------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)]).astype(np.uint64)
    out = padded[: len(text) + LENGTH + 8].copy()
    for i in range(1, 8):
        out = (out << np.uint64(8)) | padded[i : i + len(out)]
    return out


def _run_ends(text: np.ndarray) -> np.ndarray:
    """The last position of the run of equal bytes that each position is in."""
    n = len(text)
    at = np.where(np.r_[text[1:] != text[:-1], True], np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def falls(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than its successor (so is the last, but for a zero byte)."""
    if not len(text):
        return np.zeros(0, bool)
    at = _run_ends(text)
    return text[at] > np.r_[text, np.uint8(0)][at + 1]


def _direct(positions: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``positions`` by the ``depth`` bytes from each, four more at a time among ties."""
    order = np.argsort(words[positions], kind="stable")
    positions = positions[order]
    key = words[positions]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    at = 8
    while at < depth:
        same = np.r_[group[1:] == group[:-1], False]
        tied = same | np.r_[False, same[:-1]]
        if not tied.any():
            break
        rows = np.flatnonzero(tied)
        own = positions[rows]
        packed = (group[rows].astype(np.uint64) << np.uint64(32)) | (words[own + at] >> np.uint64(32))
        order = np.argsort(packed, kind="stable")
        positions[rows] = own[order]
        packed = packed[order]
        # groups keep their places; a new number starts where the next bytes change
        new = np.zeros(len(positions), bool)
        new[rows] = np.r_[False, packed[1:] != packed[:-1]]
        group = np.cumsum(np.r_[False, group[1:] != group[:-1]] | new)
        at += 4
    return positions


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The ``wanted`` suffixes (a mask) by at least ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    falling = falls(text)
    needed, long_runs = wanted.copy(), np.zeros(0, np.int64)
    if n:
        # a falling suffix is induced from its successor, so that one is needed as well
        last = np.where(wanted, np.arange(n), -1)
        last = np.maximum.accumulate(last)
        rising_before = np.where(~falling, np.arange(n), -1)
        rising_before = np.maximum.accumulate(np.r_[-1, rising_before[:-1]])
        # i is needed if a wanted suffix lies before it with nothing but falling ones from there
        needed |= (last > rising_before) & (last >= 0)
        run = _run_ends(text) - np.arange(n) + 1
        long_runs = np.flatnonzero(needed & falling & (run > depth))
    words = _words(text)
    direct = _direct(np.flatnonzero(needed & ~falling), words, depth)
    firsts = text[direct]
    cuts = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix is followed by the empty one, the smallest of all
    if n and needed[n - 1] and falling[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        parts = []
        for _ in range(depth):
            if not len(level):
                break
            parts.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == byte) & needed[before] & falling[before]]
        # longer runs of one byte are all alike up to ``depth``
        parts.append(long_runs[text[long_runs] == byte])
        whole = np.concatenate([*parts, direct[cuts[byte] : cuts[byte + 1]]])
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > byte) & needed[before] & falling[before]]
        if len(before):
            heads = text[before]
            before = before[np.argsort(heads, kind="stable")]
            heads = np.sort(heads)
            for part in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def alike_before(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix of ``order`` has ``depth`` bytes in common with the one before."""
    words, same = _words(text), np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, depth - 7, 8), depth - 8]:
        here = words[order + at]
        same &= here[1:] == here[:-1]
    return np.r_[False, same] if len(order) else same


# --- stretches ----------------------------------------------------------------


def stretches(data: np.ndarray, text: np.ndarray):
    """(gram hash, content hash, first string, strings) of all texts in a row.

    ``text`` numbers the text of each byte; strings of texts below 0 are left out.
    A stretch is a run of strings that belong to the same gram.
    """
    out = []
    mask = np.uint64(_CHUNK - 1)
    for low in range(0, len(data) - LENGTH + 1, _CHUNK - LENGTH):
        high = min(low + _CHUNK - 1, len(data))
        own = text[low:high]
        whole = np.flatnonzero((own[: high - low - LENGTH + 1] == own[LENGTH - 1 :]) & (own[LENGTH - 1 :] >= 0))
        if not len(whole):
            continue
        ranges = H.Ranges(data[low:high])
        grams = ranges.grams(_GRAM)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= _WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = _WINDOW - size
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        owner = (least[whole] & mask).astype(np.int64)
        new = np.r_[True, (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1] + 1)]
        first = whole[new]
        last = whole[np.r_[np.flatnonzero(new)[1:], len(whole)] - 1]
        gram = grams[owner[new]]
        out.append((gram, ranges(first, last + LENGTH), first + low, last - first + 1))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Group:
    """The documents of a group, of which those that stand for their texts are cut into stretches."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        # places are positions in the group, so the order must not depend on how rows arrive
        docs = docs.sort_by([("doc", "ascending"), ("text", "ascending")])
        self.data, self.offsets = utf8(docs.column("text"))
        self.docs, sizes = docs.column("doc").to_numpy(), np.diff(self.offsets)
        keys = zip(side.column("doc").to_pylist(), side.column("n").to_pylist())
        stand = {key for key in keys if key[0] is not None}
        names = list(zip(self.docs.tolist(), sizes.tolist()))
        self.kept = np.array([name in stand for name in names], bool)
        cut = self.kept.copy()
        for i in range(1, len(names)):
            if cut[i] and names[i] == names[i - 1] and self.text(i) == self.text(i - 1):
                cut[i] = False  # a repeated row: its strings are there already
        number = np.where(cut, np.arange(len(cut)), -1)
        self.gram, self.content, self.start, self.strings = stretches(
            self.data, np.repeat(number, sizes)
        )
        self.doc = self.docs[np.searchsorted(self.offsets, self.start, side="right") - 1]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams with the numbers of documents that have them."""
        order = np.lexsort((self.doc, self.gram))
        gram, doc = self.gram[order], self.doc[order]
        new = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
        both = new | np.r_[False, doc[1:] != doc[:-1]] if len(gram) else new
        first = np.flatnonzero(new)
        counts = np.add.reduceat(both.astype(np.int64), first) if len(first) else first
        return gram[new], counts

    def fold(self, side: pa.Table, groups: int) -> None:
        """Keeps the stretches whose gram two documents have; ``lead``: the first equal one.

        Of equal stretches the one of the smallest id leads.
        """
        keys, counts = H.known(side)
        some = H.look_up(H.keys_of(self.gram, groups), keys, counts) >= 2
        for name in ("gram", "content", "start", "strings", "doc"):
            setattr(self, name, getattr(self, name)[some])
        order = np.lexsort((self.start, self.doc, self.content))
        content = self.content[order]
        new = np.r_[True, content[1:] != content[:-1]] if len(content) else np.zeros(0, bool)
        self.lead = np.zeros(len(content), np.int64)
        if len(content):
            self.lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        self.leads = np.flatnonzero(self.lead == np.arange(len(content)))


STRETCHES = "bucket int, grp int, text binary, sizes binary, docs binary, places binary"
SPANS = "grp int, places binary, firsts binary, lasts binary"


def _sent(group: Group, grp: int, groups: int) -> pa.Table:
    """Rows ``STRETCHES``: the leading stretches of a group by bucket."""
    at = group.leads
    bucket = H.buckets_of(group.gram[at], groups)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    out = {k: [] for k in ("bucket", "grp", "text", "sizes", "docs", "places")}
    compressor = zstandard.ZstdCompressor(level=1)
    for part in np.split(np.arange(len(at)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
        if not len(part):
            continue
        own = at[part]
        sizes = group.strings[own] + LENGTH - 1
        pieces = [group.data[a : a + n] for a, n in zip(group.start[own], sizes)]
        out["bucket"].append(int(bucket[part[0]]))
        out["grp"].append(grp)
        out["text"].append(compressor.compress(np.concatenate(pieces).tobytes()))
        out["sizes"].append(H.pack_any(sizes))
        out["docs"].append(H.pack_any(group.doc[own]))
        out["places"].append(H.pack_any(group.start[own]))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def _judged(rows: pa.Table) -> pa.Table:
    """Rows ``SPANS`` of a bucket: the strings of each stretch that a smaller id has."""
    unzip = zstandard.ZstdDecompressor().decompress
    text = np.frombuffer(b"".join(map(unzip, rows.column("text").to_pylist())), np.uint8)
    sizes, docs, places = (
        np.concatenate([H.unpack_any(x) for x in rows.column(c).to_pylist()])
        for c in ("sizes", "docs", "places")
    )
    counts = [len(H.unpack_any(x)) for x in rows.column("sizes").to_pylist()]
    grp = np.repeat(rows.column("grp").to_numpy(), counts)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    piece = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.arange(len(text)) - start[piece] <= sizes[piece] - LENGTH
    order = suffix_order(text, wanted)
    same = alike_before(text, order)
    first = np.flatnonzero(~same)
    owner = docs[piece[order]]
    least = np.minimum.reduceat(owner, first) if len(first) else owner
    taken = np.zeros(len(text), bool)
    taken[order] = owner > least[np.cumsum(~same) - 1]
    at = np.flatnonzero(taken)
    # runs of strings within a stretch
    cut = np.r_[True, (np.diff(at) != 1) | (np.diff(piece[at]) != 0)] if len(at) else np.zeros(0, bool)
    a, b = at[cut], at[np.r_[np.flatnonzero(cut)[1:], len(at)] - 1] if len(at) else at
    own = piece[a]
    out = {k: [] for k in ("grp", "places", "firsts", "lasts")}
    by_group = np.argsort(grp[own], kind="stable")
    for part in np.split(by_group, np.flatnonzero(np.diff(grp[own][by_group])) + 1):
        if len(part):
            out["grp"].append(int(grp[own[part[0]]]))
            out["places"].append(H.pack_any(places[own[part]]))
            out["firsts"].append(H.pack_any(a[part] - start[own[part]]))
            out["lasts"].append(H.pack_any(b[part] - start[own[part]]))
    kinds = [pa.int32(), *[pa.binary()] * 3]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def _removed(group: Group, side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the removed ranges in the group's bytes."""
    # stretches that a smaller id of this group has as a whole
    behind = np.flatnonzero(group.doc > group.doc[group.lead]) if len(group.doc) else np.zeros(0, np.int64)
    firsts = [group.start[behind]]
    ends = [group.start[behind] + group.strings[behind] + LENGTH - 1]
    told = [
        tuple(H.unpack_any(side.column(c)[i].as_py()) for c in ("places", "firsts", "lasts"))
        for i in range(side.num_rows)
        if side.column("places")[i].is_valid
    ]
    if told:
        places, a, b = (np.concatenate(x) for x in zip(*told))
        # what holds for a leading stretch holds for its equals in the same document
        own = np.flatnonzero(group.doc == group.doc[group.lead])
        own = own[np.argsort(group.start[group.lead[own]], kind="stable")]
        heads = group.start[group.lead[own]]
        low, high = np.searchsorted(heads, places), np.searchsorted(heads, places, side="right")
        n = high - low
        which = np.repeat(np.arange(len(places)), n)
        equal = own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]]
        firsts.append(group.start[equal] + a[which])
        ends.append(group.start[equal] + b[which] + LENGTH)
    return np.concatenate(firsts), np.concatenate(ends)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _results(docs: pa.Table, side: pa.Table, groups: int):
    group = Group(docs, side)
    group.fold(side, groups)
    first, end = _removed(group, side)
    order = np.argsort(first, kind="stable")
    first, end = first[order], end[order]
    last: tuple = (None, None, None)
    for i, doc in enumerate(group.docs):
        low, high = group.offsets[i], group.offsets[i + 1]
        text, n = group.text(i), int(high - low)
        if not group.kept[i]:
            yield int(doc), n, n if n >= LENGTH else 0, int(n >= LENGTH), b"" if n >= LENGTH else text
            continue
        if last[:2] != (doc, text):  # a repeated row is like the one before
            a, b = np.searchsorted(first, [low, high])
            parts, at, runs, removed = [], 0, 0, 0
            for s, e in zip((first[a:b] - low).tolist(), (end[a:b] - low).tolist()):
                if s > at or not runs:
                    parts.append(text[at:s])
                    runs += 1
                    removed += e - s
                    at = e
                elif e > at:
                    removed += e - at
                    at = e
            last = (doc, text, (n, removed, runs, b"".join([*parts, text[at:]])))
        yield int(doc), *last[2]


def dedup(
    df: DataFrame, id_: str = "doc_id", text: str = "text", group_bytes: int = H.GROUP_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every text, in bytes."""
    groups = H.n_groups(df, text, group_bytes)
    docs = H.dealt(df, id_, text, groups)
    md5 = F.md5(F.col("text").cast("binary"))
    texts = docs.where(F.octet_length("text") >= LENGTH)
    stand = texts.groupBy(md5.alias("key"), F.octet_length("text").cast("long").alias("n")).agg(
        F.min(F.struct("doc", "grp")).alias("one")
    )
    stand = stand.select("one.grp", "one.doc", "n")
    grouped = docs.groupBy("grp")

    def fingerprints(key, left: pa.Table, right: pa.Table) -> pa.Table:
        prints, counts = Group(left, right).prints()
        return H.send(prints, counts, key[0].as_py(), groups)

    def pieces(key, left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, right)
        group.fold(right, groups)
        return _sent(group, key[0].as_py(), groups)

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(zip(*_results(left, right, groups))) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept"]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, rows, kinds)})

    sent = grouped.cogroup(stand.groupBy("grp")).applyInArrow(fingerprints, H.SENT)
    told = sent.groupBy("bucket").applyInArrow(H.shared, H.KNOWN)
    side = stand.unionByName(told, allowMissingColumns=True)
    found = grouped.cogroup(side.groupBy("grp")).applyInArrow(pieces, STRETCHES)
    spans = found.groupBy("bucket").applyInArrow(_judged, SPANS)
    side = side.unionByName(spans, allowMissingColumns=True)
    out = grouped.cogroup(side.groupBy("grp")).applyInArrow(results, RESULT)
    known = F.col("doc") != H.NO_ID
    return out.select(
        F.when(known, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept"
    )
