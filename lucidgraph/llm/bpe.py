"""Byte-level BPE: texts to token ids and back.

``encode`` cuts a text by a pattern and encodes each match by itself: every
distinct word of a worker is merged once, always the adjacent pair of least rank
first, and its ids are kept for the next time it comes up.  ``decode`` stays in
Spark: the binary pieces of the ids are looked up in a literal array and
concatenated.

Nulls and empty texts have no tokens.  Texts are encoded whole, however long;
a word of n bytes takes n log n steps.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Recent, added, map_batches

#: Words whose ids a worker keeps; when there are more, it starts anew.
KEPT_WORDS = 600_000


def read_ranks(path: str) -> tuple[bytes, ...]:
    """The pieces of a vocabulary file (base64 and rank a line) by rank."""
    with open(path, "rb") as lines:
        ranked = [line.split() for line in lines if line.strip()]
    pieces = {int(rank): base64.b64decode(piece) for piece, rank in ranked}
    if sorted(pieces) != list(range(len(pieces))):
        raise ValueError(f"ranks of {path} have gaps")
    return tuple(pieces[i] for i in range(len(pieces)))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the adjacent pair of least rank, the first on ties."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    found = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        known = [rank for rank in found if rank is not None]
        if not known:
            return [ranks[part] for part in parts]
        i = found.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list of parts."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        (ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks
    ]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # a part that was merged has end 0; an entry is out of date if its parts changed
        if middle == 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i:
            rank = ranks.get(word[before[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


@functools.lru_cache(maxsize=2)
def _words(pieces) -> Recent:
    """Ids by word, filled as words come up."""
    ranks = {piece: rank for rank, piece in enumerate(pieces)}
    return Recent(lambda word: tuple(merge(word.encode(), ranks)), KEPT_WORDS // 2)


#: What the classes of a pattern are in ASCII.
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20", r"\S": r"\x00-\x08\x0e-\x1f!-\x7f"}


def ascii_pattern(pattern: str) -> str | None:
    """A pattern with the same matches in ASCII texts for the faster ``re``; None if unsure."""
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part.startswith("\\"):
            if part not in _ASCII:
                return None
            out.append(_ASCII[part] if inside else f"[{_ASCII[part]}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


@functools.lru_cache(maxsize=4)
def finder(pattern: str):
    """A function that gives the matches of a text."""
    plain = ascii_pattern(pattern)
    any_text = regex.compile(pattern).findall
    ascii_text = any_text if plain is None else re.compile(plain).findall
    return lambda text: ascii_text(text) if text.isascii() else any_text(text)


def encode(
    df: DataFrame, pieces: tuple[bytes, ...], pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``df`` with a column ``ids`` (replaced if there) of the texts' token ids."""
    kept = df.drop(ids)
    shared = df.sparkSession.sparkContext.broadcast(pieces)  # of the vocabulary's size

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, find = _words(shared.value), finder(pattern)
        offsets, out = [0], []
        for value in batch.column(text).to_pylist():
            if value:
                for word in find(value):
                    out += words[word]
            offsets.append(len(out))
        lists = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(out, pa.int32())
        )
        return pa.RecordBatch.from_arrays(
            [*batch.columns, lists], names=[*batch.schema.names, ids]
        )

    return map_batches(kept, encoded, added(kept, **{ids: "array<int>"}))


def _rank_table(pieces: tuple[bytes, ...]) -> Column:
    """The literal rank map: maps of hex pieces to ranks, one for each value of a hash."""
    maps: list[dict[str, int]] = [{} for _ in range(_HASHES)]
    for rank, piece in enumerate(pieces):
        maps[zlib.crc32(piece) % _HASHES][piece.hex()] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


_HASHES = 1 << 16


def word_ids(word: Column, pieces: tuple[bytes, ...]) -> Column:
    """Ids of one word, folded by Spark's functions; null for null.

    For dictionaries of distinct words.  About 1 ms a word, some 70 times ``merge``:
    ``encode`` does not use it (figures in the README).
    """
    table = _rank_table(pieces)

    def rank(piece: Column) -> Column:
        at = (F.crc32(F.unhex(piece)) % _HASHES).cast("int")
        return F.try_element_at(F.get(table, at), piece)

    def once(value: Column, of) -> Column:
        return F.get(F.transform(F.array(value), of), F.lit(0))

    code = F.lower(F.hex(word.cast("binary")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1)), F.lit(2))
    single = F.transform(starts, lambda i: F.substring(code, i, F.lit(2)))

    def join(parts: Column, i: Column) -> Column:
        both = F.array(F.concat(F.get(parts, i), F.get(parts, i + 1)))
        return F.concat(F.slice(parts, F.lit(1), i), both, F.slice(parts, i + 3, F.size(parts)))

    def step(parts: Column, _) -> Column:
        pairs = F.zip_with(
            parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: rank(F.concat(a, b))
        )
        # the pair of least rank, the first on ties; none is left when all are null
        place = lambda r: F.array_position(r, F.array_min(r)).cast("int") - 1
        merged = lambda i: F.when(i >= 0, join(parts, i)).otherwise(parts)
        return once(pairs, lambda r: once(F.coalesce(place(r), F.lit(-1)), merged))

    steps = F.sequence(F.lit(1), F.greatest(F.length(code) / 2 - 1, F.lit(1)).cast("int"))
    parts = F.aggregate(steps, single, step)
    ids = F.when(word == "", F.array().cast("array<int>")).otherwise(F.transform(parts, rank))
    return F.when(word.isNotNull(), ids)


def decoded(ids: Column, pieces: tuple[bytes, ...]) -> Column:
    """Binary of the ids' pieces in a row; null for null, and for ids out of range."""
    table = F.split(F.lit(" ".join(piece.hex() for piece in pieces)), " ")
    known = F.forall(ids, lambda i: i.between(0, len(pieces) - 1))
    return F.when(known, F.unhex(F.array_join(F.transform(ids, lambda i: table[i]), "")))


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids with single spaces between them."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
