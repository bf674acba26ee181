"""Inverted pairs of rows under two orders, counted per key at any key size.

Counting crossings in a strip is counting inversions between the order of the
segments on its left and on its right border.  Keys of bounded size are counted
one per group.  When a key is larger than that, rows are cut into chunks twice,
by a range partitioning along either order; a pair then has

* one chunk in the first order: counted inside that chunk,
* one chunk in the second order only: counted inside that one, or
* different chunks in both: counted from the table of chunk intersections,
  which is the same problem again on far fewer, weighted rows.

A chunk holds about the larger of ``CHUNK_ROWS`` and 4 sqrt(rows) rows however the
keys are distributed, because equal rows fold into one weighted row before the
cut: up to 4e9 rows in all, ``CHUNK_ROWS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inversions import inverted_pairs
from ..session import materialize

# rows of one key that one task may hold, and the size chunks are cut to
MAX_GROUP_ROWS = 1_000_000
CHUNK_ROWS = 250_000


def key_fields(df: DataFrame, key: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)


def _numpy(table: pa.Table, names: Sequence[str]) -> tuple:
    return tuple(table.column(c).to_numpy() for c in names)


def columns_of(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> dict:
    """The named columns of a group; its batches go as they are read."""
    held = {c: [] for c in names}
    for batch in batches:
        for c in names:
            held[c].append(np.array(batch.column(c)))
    return {c: np.concatenate(held.pop(c)) for c in names}


def _totals(table: pa.Table, first, second, sums: bool, lead=(), group=None, groups=1):
    attributes = ["wa", "wb", "sa", "sb"] if sums else ["wa", "wb"]
    # one array per column: inverted_pairs tells shared columns by identity
    keys = {c: table.column(c).to_numpy() for c in dict.fromkeys([*first, *second])}
    return inverted_pairs(
        [*lead, *(keys[c] for c in first)],
        [*lead, *(keys[c] for c in second)],
        *_numpy(table, attributes),
        **({} if sums else {"sa": None, "sb": None}),
        group=group,
        groups=groups,
    )


def one_row(key, schema_names, values) -> pa.Table:
    """A result row: the group's key followed by plain numbers."""
    arrays = [pa.array([k.as_py()], type=k.type) for k in key]
    arrays += [pa.array([v]) for v in values]
    return pa.Table.from_arrays(arrays, names=schema_names)


def _grouped(rows, key, first, second, sums) -> DataFrame:
    names = [*key, "pairs", "sum_a", "sum_b"]

    weights = ["wa", "wb", "sa", "sb"] if sums else ["wa", "wb"]
    needed = list(dict.fromkeys([*first, *second, *weights]))

    def count(
        group_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        held = columns_of(batches, needed)
        n, a, b = inverted_pairs(
            [held[c] for c in first], [held[c] for c in second], *(held[c] for c in weights)
        )
        yield from one_row(group_key, names, (int(n[0]), float(a[0]), float(b[0]))).to_batches()

    schema = f"{key_fields(rows, key)}, pairs bigint, sum_a double, sum_b double"
    return rows.groupBy(*key).applyInArrow(count, schema)


def _per_partition(rows, key, first, second, sums) -> DataFrame:
    """Count inside each partition; a partition may hold many keys."""
    names = [*key, "pairs", "sum_a", "sum_b"]

    def count(batches):
        batches = list(batches)
        if not batches or not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        codes = [
            table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in key
        ]
        _, where, group = np.unique(
            np.stack(codes), axis=1, return_index=True, return_inverse=True
        )
        group = group.reshape(-1)
        n, a, b = _totals(table, first, second, sums, (group,), group, len(where))
        keys = table.select(list(key)).take(pa.array(where)).combine_chunks()
        out = [*keys.columns, pa.array(n.astype(np.int64)), pa.array(a), pa.array(b)]
        yield from pa.Table.from_arrays(out, names=names).to_batches()

    schema = f"{key_fields(rows, key)}, pairs bigint, sum_a double, sum_b double"
    return rows.mapInArrow(count, schema)


def _chunked(rows, key, first, second, sums, total, max_rows, chunk_rows) -> DataFrame:
    weights = ["wa", "wb", "sa", "sb"] if sums else ["wa", "wb"]
    folded = [F.sum(c).alias(c) for c in weights]
    order = list(dict.fromkeys([*first, *second]))
    # chunk numbers may be the order of this call already, one level up
    one, two = f"{first[0]}_chunk", f"{second[0]}_chunk"
    # few enough that their intersections are far fewer than the rows
    chunks = max(2, min(-(-total // chunk_rows), math.isqrt(total) // 4))
    # both cuts are written down: the counts below must agree on the chunks
    by_first = materialize(
        rows.groupBy(*key, *order)
        .agg(*folded)
        .repartitionByRange(chunks, *key, *first)
        .withColumn(one, F.spark_partition_id())
    )
    by_second = materialize(
        by_first.repartitionByRange(chunks, *key, *second).withColumn(
            two, F.spark_partition_id()
        )
    )
    crossings = by_second.groupBy(*key, one, two).agg(*folded)
    parts = [
        _per_partition(by_first, key, first, second, sums),
        _per_partition(by_second, key, [one], second, sums),
        inverted_totals(
            materialize(crossings),
            key,
            [one],
            [two],
            sums,
            max_rows=max_rows,
            chunk_rows=chunk_rows,
        ),
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .groupBy(*key)
        .agg(*[F.sum(c).alias(c) for c in ("pairs", "sum_a", "sum_b")])
    )


def largest_group(rows: DataFrame, key: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all): map-side counts, one number each."""
    largest, total = (
        rows.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)))
        .head()
    )
    return largest, total


def inverted_totals(
    rows: DataFrame,
    key: Sequence[str],
    first: Sequence[str],
    second: Sequence[str],
    sums: bool = False,
    row_bound: int | None = None,
    max_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``key, pairs, sum_a, sum_b`` over pairs (a, b) of rows with equal key,
    a strictly before b by ``first`` and strictly after b by ``second``:
    the sums of wa*wb, sa*wb and wa*sb.

    ``row_bound`` is a known upper bound for the rows of a key, which saves
    counting them.
    """
    key, first, second = list(key), list(first), list(second)
    if row_bound is not None and row_bound <= max_rows:
        return _grouped(rows, key, first, second, sums)
    largest, total = largest_group(rows, key)
    if largest <= max_rows:
        return _grouped(rows, key, first, second, sums)
    return _chunked(rows, key, first, second, sums, total, max_rows, chunk_rows)
