"""Nearest neighbours by cosine: a block matrix join with int8 tiles and error bounds.

Vectors are scaled to unit length and rounded to int8 once, with one scale each; what
the rounding takes away is known exactly.  Only these codes travel: every block of
queries meets every block of candidates, and the product of their int8 rows gives all
cosines of a tile, each within a known bound.  A pair leaves its tile if its upper bound
reaches the k-th best lower bound of its query there, and stays if it reaches that of all
tiles; only those meet the original vectors, in double precision, and the best are merged.
No candidate is lost.

Of equal vectors the k + 1 smallest ids are candidates: more can never be among the
nearest.  Rows of one id count once, with the smallest vector.  Null, empty and zero
vectors and those with null or non-finite components take no part, nor do rows
with a null id; vectors of another length than the query's are no candidates.
Equal scores go to the smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

#: Bytes of codes of a block of candidates, and of a block of queries.
CANDIDATE_BYTES, QUERY_BYTES = 4 << 20, 1 << 20
#: Cosines that a task holds at a time.
TILE_CELLS = 1 << 22
_PAIRS = "query_id long, vec_id long, low double, high double"


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, one for each id."""
    vec = F.col(vector).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    rows = df.select(F.col(id_).cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(good & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a table."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, norm of what rounding took away) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, lost


def _unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    scaled = vectors / top
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _coded(batches):
    """(vec_id, dims, codes, scale, lost) of vectors, those of one length at a time."""
    for batch in batches:
        sizes = batch.column("dims").to_numpy()
        for dims in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == dims))
            codes, scale, lost = quantised(_unit(_rows_of(rows.column("vec"))))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("vec_id"),
                    rows.column("dims"),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale),
                    pa.array(lost),
                ],
                names=["vec_id", "dims", "codes", "scale", "lost"],
            )


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """The rows of the k + 1 smallest ids of each vector."""
    # strings of all digits, so that only equal vectors are equal here
    key = F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), 256)
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    keyed = rows.select("vec_id", key.alias("key")).withColumn("place", place)
    return rows.join(keyed.where(F.col("place") <= k + 1).select("vec_id"), "vec_id", "left_semi")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 rows of a times those of b; whole numbers that the float type holds exactly."""
    exact = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    return a.astype(exact) @ b.astype(exact).T


def _codes(table: pa.Table) -> tuple[np.ndarray, ...]:
    data = b"".join(table.column("codes").to_pylist())
    codes = np.frombuffer(data, np.int8).reshape(table.num_rows, -1)
    return (codes, *(table.column(c).to_numpy() for c in ("vec_id", "scale", "lost")))


def tile(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Rows ``_PAIRS`` of the pairs of two blocks that may be among the query's k nearest."""
    out = [np.zeros((0, 2))]
    ids = [np.zeros((2, 0), np.int64)]
    if queries.num_rows and candidates.num_rows:
        q_codes, q_ids, q_scale, q_lost = _codes(queries)
        c_codes, c_ids, c_scale, c_lost = _codes(candidates)
        step = max(1, TILE_CELLS // len(c_ids))
        for at in range(0, len(q_ids), step):
            rows = slice(at, at + step)
            near = _products(q_codes[rows], c_codes) * q_scale[rows, None] * c_scale
            # |a.b - a'.b'| <= |a - a'| |b| + |a'| |b - b'|, where |b| = 1 and |a'| <= 1 + |a - a'|
            lost = q_lost[rows, None]
            bound = lost + (1 + lost) * c_lost + 1e-9
            own = q_ids[rows, None] == c_ids
            low = np.where(own, -np.inf, near - bound)
            place = max(0, low.shape[1] - k)
            least = np.partition(low, place, axis=1)[:, place]
            i, j = np.nonzero(((near + bound) >= least[:, None]) & ~own)
            ids.append(np.stack([q_ids[rows][i], c_ids[j]]))
            out.append(np.stack([near[i, j], bound[i, j]], axis=1))
    query, found = np.concatenate(ids, axis=1)
    near, bound = np.concatenate(out).T
    return pa.table({"query_id": query, "vec_id": found, "low": near - bound, "high": near + bound})


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values."""
    with np.errstate(over="ignore", under="ignore"):
        down = np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1))
        plain = (rows * query).sum(axis=1) / down
    if np.isfinite(plain).all() and down.min(initial=1) > 1e-290:
        return plain
    return (_unit(rows) * _unit(query[None])).sum(axis=1)


def _scored(batches):
    """(query_id, vec_id, score) of pairs with both vectors."""
    for batch in batches:
        scores = []
        for a, b in zip(batch.column("asked"), batch.column("vec")):
            a, b = (np.asarray(x.values) for x in (a, b))
            scores.append(cosines(a, b[None])[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("query_id"), batch.column("vec_id"), pa.array(scores, pa.float64())],
            names=["query_id", "vec_id", "score"],
        )


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 5,
    id_: str = "vec_id",
    vector: str = "embedding",
    candidate_rows: int | None = None,
    query_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row that ``queries`` picks.

    ``queries`` is a condition on ``vec_id``.  Blocks have ``candidate_rows`` and
    ``query_rows`` on average, or so many as ``CANDIDATE_BYTES`` and ``QUERY_BYTES`` hold.
    """
    rows = stored(usable(df, id_, vector).withColumn("dims", F.size("vec")), "vectors")
    coded = stored(
        rows.mapInArrow(_coded, "vec_id long, dims int, codes binary, scale double, lost double"), "codes"
    )
    asked = coded.where(queries)
    others = coded.join(_distinct(rows, k).select("vec_id"), "vec_id", "left_semi")
    asks = F.when(queries, F.col("dims"))
    sizes = coded.agg(F.sum("dims"), F.sum(asks), F.count("dims"), F.count(asks)).first()

    def blocks(size: int | None, rows: int, in_block: int | None, bytes_: int) -> int:
        return max(1, math.ceil(rows / in_block if in_block else (size or 0) / bytes_))

    n_blocks = blocks(sizes[0], sizes[2], candidate_rows, CANDIDATE_BYTES)
    q_blocks = blocks(sizes[1], sizes[3], query_rows, QUERY_BYTES)
    # a tile is a block of queries with a block of candidates
    place, names = F.xxhash64("vec_id"), ("vec_id", "dims", "codes", "scale", "lost")
    keys = ("q", "c", "dims")

    def dealt(side: DataFrame, own: str, blocks: int, other: str, every: int) -> DataFrame:
        return side.select(
            *names,
            F.pmod(place, F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias(other),
        ).repartition(n_blocks * q_blocks, *keys)

    left, right = dealt(asked, "q", q_blocks, "c", n_blocks), dealt(others, "c", n_blocks, "q", q_blocks)

    def best(a, b):
        return tile(a, b, k)

    grouped = left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys))
    pairs = stored(grouped.applyInArrow(best, _PAIRS), "pairs")
    # the k-th best lower bound over all tiles
    first = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    kth = pairs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    kth = kth.groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    open_ = pairs.join(kth, "query_id").where((F.col("n") < k) | (F.col("high") >= F.col("least")))
    vectors = rows.select("vec_id", "vec")
    both = (
        open_.select("query_id", "vec_id")
        .join(vectors, "vec_id")
        .join(vectors.toDF("query_id", "asked"), "query_id")
        .select("query_id", "vec_id", "asked", "vec")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        both.mapInArrow(_scored, "query_id long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
