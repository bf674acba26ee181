"""Small helpers that the operators share: Arrow columns with nulls, and column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import scratch_path

#: A long text is read in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: Keys of more than one in so many rows are joined apart from the others.
HOT_SHARE = 1000
#: Texts of one Arrow batch are handled in slices of about so many bytes.
SLICE_BYTES = 8 << 20


class Recent(dict):
    """What ``make(key)`` gives, kept for the last keys that came up.

    Keys in use stay: when ``limit`` new ones have come, those not asked for since
    the time before go.
    """

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema
) -> DataFrame:
    """``function`` on every Arrow batch, cut so that no slice holds many large values.

    Calls that follow each other directly run one after the other in one Python worker.
    """
    source, steps = vars(df).get("_mapped", (df, ()))
    steps = (*steps, function)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                for step in steps:
                    part = step(part)
                yield part

    out = source.mapInArrow(run, schema)
    out._mapped = (source, steps)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without these columns; ``df`` itself if it has none of them."""
    gone = {name.lower() for name in names}
    return df.drop(*names) if any(c.lower() in gone for c in df.columns) else df


def added(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` and then ``columns`` (names and types)."""
    return StructType(
        [*df.schema.fields]
        + [StructField(name, _parse_datatype_string(kind)) for name, kind in columns.items()]
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_pieces(text: bytes, gaps: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``text`` in pieces that end where a byte of ``gaps`` stands, so no word is cut."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in gaps:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def joined_to_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``classes`` (one row a key), however common a key is.

    Keys of more than one row in ``HOT_SHARE``, fewer than that many, meet their
    class in place; only the others are shuffled.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    share = rows.count() // HOT_SHARE
    hot = classes.join(F.broadcast(counts.where(F.col("count") > share).select(key)), key).collect()
    if not share or not hot:
        return rows.join(classes, key, "left")
    hot = spark.createDataFrame(hot, T.StructType([classes.schema[c] for c in hot[0].__fields__]))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)
