"""Exact top-k search by inner product with a vector-approximation file.

Each vector is stored twice: exactly, and as an approximation that gives the cell of each component on a
grid of :data:`CELLS` steps between the table's smallest and greatest value of that component. A cell
bounds its component from both sides, so an approximation bounds a score from both sides.

Queries and approximations meet in blocks, each pair of blocks in one task, twice: first each task tells a
query's k greatest lower bounds, whose k-th greatest overall every result reaches; then tasks keep the
candidates whose upper bound reaches it too. Exact vectors are read in rounds, in the order of upper bounds: the
next candidates of each query that is not certain yet, twice as many each round, until its k-th score found is above
the next bound. So exact vectors of most candidates are never joined. Results are exact: bounds only save reading.

Components become ``floor(scale * x)`` first. Vectors that are null, empty or hold null or non-finite
components take no part. Every other row does, as a row of its own: repeated ids are candidates
of each other, and each is a query if its id is one. Vectors of different lengths have no product, so each length is
searched by itself, one pass each. Scores are 64-bit integers. Ties go to the smaller id, null ids come last. Further
columns are ignored, whatever their names, and an empty table has an empty result. A very long vector is one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultfold.llm.common import bounded_batches, dropped, written

CELLS = 64
#: Rows of a block of queries and of candidates.
QUERY_BLOCK, BLOCK = 1024, 4096


def grid(vectors: DataFrame, scale: int) -> DataFrame:
    """``row, vec_id, v``: each usable vector as an array of integers, with a number of its own."""
    scaled = F.transform(
        F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    )
    finite = F.forall(
        F.col("embedding"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    usable = vectors.where(F.col("embedding").isNotNull()).where(
        F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)
    )
    rows = usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), scaled.alias("v"))
    return written(rows, "vectors")


def _borders(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and greatest value of each component; one row a component reaches the driver."""
    rows = (
        vectors.where(F.size("v") == width)
        .select(F.posexplode("v").alias("k", "x"))
        .groupBy("k")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("k")
        .collect()
    )
    return np.array([r.low for r in rows], np.int64), np.array([r.high for r in rows], np.int64)


def _step(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(high - low + 1) // CELLS))


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _approximations(low, high):
    """Exact vectors as bytes, and their cells."""
    step = _step(low, high)

    def run(batches):
        for batch in batches:
            values = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, len(low))
            cells = ((values - low) // step).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r.tobytes() for r in values], pa.binary()),
                    pa.array([r.tobytes() for r in cells], pa.binary()),
                ],
                ["row", "vec_id", "exact", "cells"],
            )

    return run


def _greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k greatest values, or all if it has fewer."""
    if values.shape[1] <= k:
        return values
    return -np.partition(-values, k - 1, axis=1)[:, :k]


class Bounds:
    """Bounds of the scores of a block of queries with a block of approximations.

    They are exact in double precision while scores stay below 2**53, and widened for greater ones.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high, self.step = low, high, _step(low, high)

    def __call__(self, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the queries and of the candidates, and lower and upper bounds, minus infinity for a query's own row."""
        width = len(self.low)
        rows, queries = left.column("query").to_numpy(), _matrix(left.column("exact"), np.int64, width).astype(float)
        found, cells = right.column("row").to_numpy(), _matrix(right.column("cells"), np.uint8, width)
        bottom = self.low + cells.astype(np.int64) * self.step
        top = np.minimum(bottom + self.step - 1, self.high).astype(float)
        bottom = bottom.astype(float)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        lower = plus @ bottom.T + minus @ top.T
        upper = plus @ top.T + minus @ bottom.T
        slack = np.abs(queries) @ np.maximum(np.abs(bottom), np.abs(top)).max(0) * (width * 2.0**-52)
        lower -= slack[:, None]
        upper += slack[:, None]
        own = rows[:, None] == found[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        return rows, found, lower, upper


_LOWER = pa.schema([("query", pa.int64()), ("lower", pa.float64())])
_CANDIDATES = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("upper", pa.float64())])


def _told(bounds: Bounds, k: int):
    """The k greatest lower bounds of each query of a block."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _LOWER.empty_table()
        rows, _, lower, _ = bounds(left, right)
        best = _greatest(lower, k)
        query, value = np.repeat(rows, best.shape[1]), best.ravel()
        kept = np.isfinite(value)
        return pa.table([pa.array(query[kept]), pa.array(value[kept])], schema=_LOWER)

    return run


def _reaching(bounds: Bounds):
    """The candidates whose upper bound reaches what a query's results are known to reach."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _CANDIDATES.empty_table()
        rows, found, _, upper = bounds(left, right)
        least = left.column("least").fill_null(-np.finfo(float).max).to_numpy()
        q, c = np.nonzero((upper >= least[:, None]) & np.isfinite(upper))
        return pa.table([pa.array(rows[q]), pa.array(found[c]), pa.array(upper[q, c])], schema=_CANDIDATES)

    return run


def _scored(width: int):
    """Exact scores."""

    def run(batches):
        for batch in batches:
            left, right = (_matrix(batch.column(c), np.int64, width) for c in (3, 4))
            score = np.einsum("ij,ij->i", left, right)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], ["query", "row", "vec_id", "score"])

    return run


def _candidates(file: DataFrame, queries: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """``query, row, upper`` of what may be among a query's k best."""
    blocks, query_blocks = max(1, -(-file.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))

    # Both sides number blocks as int: a cogroup compares hashes of keys as they are, without casts.
    def block(column, count):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # Of equal vectors only the k + 1 smallest ids can be among the k best of a query that is not its own candidate.
    equal = Window.partitionBy("exact").orderBy(F.asc_nulls_last("vec_id"), "row")
    first = file.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1)
    right = written(first.select("row", "cells", block("row", blocks).alias("c")), "cells")
    right = right.withColumn("q", every(query_blocks))
    left = queries.withColumns({"q": block("query", query_blocks), "c": every(blocks)})

    def met(rows):
        return rows.groupBy("q", "c").cogroup(right.groupBy("q", "c"))

    told = met(left).applyInArrow(_told(bounds, k), "query long, lower double")
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    certain = told.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    certain = certain.groupBy("query").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    certain = written(certain.where(F.col("n") == k).select("query", "least"), "certain")
    reached = left.join(certain, "query", "left")
    out = written(met(reached).applyInArrow(_reaching(bounds), "query long, row long, upper double"), "candidates")
    dropped(certain)
    dropped(right)
    return out


def _search(integers: DataFrame, width: int, is_query: Column, k: int) -> DataFrame:
    """``query, vec_id, score, place`` of the vectors of one length."""
    low, high = _borders(integers, width)
    file = written(
        integers.where(F.size("v") == width).mapInArrow(
            _approximations(low, high), "row long, vec_id long, exact binary, cells binary"
        ),
        "approximations",
    )
    queries = file.where(is_query).select(F.col("row").alias("query"), "exact")
    found = _candidates(file, queries, Bounds(low, high), k)
    by_bound = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    ordered = written(found.withColumn("turn", F.row_number().over(by_bound)), "ordered")
    dropped(found)
    asked = queries.withColumnRenamed("exact", "asked")
    exact = file.select("row", "vec_id", "exact")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best, active, done, size = None, None, 0, 2 * k
    while True:
        turn = ordered.where((F.col("turn") > done) & (F.col("turn") <= done + size)).select("query", "row")
        if active is not None:
            turn = turn.join(active, "query", "left_semi")
        read = turn.join(asked, "query").join(exact, "row").select("query", "row", "vec_id", "asked", "exact")
        scored = read.mapInArrow(_scored(width), "query long, row long, vec_id long, score long")
        both = scored if best is None else scored.unionByName(best.select(scored.columns))
        ranked = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        after = written(ranked, "best")
        done, size = done + size, 2 * size
        following = ordered.where(F.col("turn") == done + 1).select("query", "upper")
        reached = after.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        open_ = following.join(reached, "query", "left")
        active = written(open_.where(F.expr(f"n is null or n < {k} or upper >= least")).select("query"), "active")
        if best is not None:
            dropped(best)
        best = after
        if active.isEmpty():
            names = file.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
            return best.join(names, "query")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows where ``is_query`` holds, against all rows but their own."""
    bounded_batches(vectors.sparkSession, 4096)
    integers = grid(vectors.select("vec_id", "embedding"), scale)
    widths = sorted(r.n for r in integers.select(F.size("v").alias("n")).distinct().collect())
    empty = vectors.sparkSession.createDataFrame([], "query_id long, place int, vec_id long, score long")
    parts = [_search(integers, width, is_query, k).select(empty.columns) for width in widths]
    return reduce(DataFrame.unionByName, parts or [empty]).withColumnRenamed("place", "rank")
