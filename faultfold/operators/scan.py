"""Running values over a long sequence without ever putting a whole group into one task.

``row_number`` and friends over ``partitionBy(key)`` send every row of a key to one task, and
a single hot key may hold a third of all rows. Here the sequence number is cut into blocks:

* rows are ranked inside (key, block), and a block of 2^18 distinct numbers holds at most
  2^18 rows whatever the key distribution is;
* each block is summarised by partial aggregation, and the summaries are scanned inside
  (key, super-block) of at most 2^22 blocks and then over at most 2^23 super-blocks.

Together that is 63 bits and the sign, so the bounds hold for every bigint sequence. The
sequence should be unique within a key: rows that share a number share a block.

The summaries are written to the shared folder once, when one of these functions is called: the
input is read for them and for the rows, and not again for every level of the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultfold.session import materialize

BLOCK_BITS = 18
SUPER_BITS = 22

BLOCK = "_block"
SUPER = "_super"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_block(df: DataFrame, seq: str) -> DataFrame:
    return df.withColumn(BLOCK, F.shiftright(F.col(seq).cast("bigint"), BLOCK_BITS))


def _before(keys: list[str], order: str) -> Window:
    """Rows of the group that come strictly earlier."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _prefix(blocks: DataFrame, keys: list[str], value: str, combine, scan) -> DataFrame:
    """Per block, the combination of ``value`` over all earlier blocks of the key.

    ``scan`` folds earlier rows in a window, ``combine`` folds a super-block to one value.
    """
    by_super = blocks.withColumn(SUPER, F.shiftright(F.col(BLOCK), SUPER_BITS))
    inner = by_super.withColumn(
        "_inner", scan(F.col(value)).over(_before([*keys, SUPER], BLOCK))
    )
    outer = (
        by_super.groupBy(*keys, SUPER)
        .agg(combine(F.col(value), F.col(BLOCK)).alias("_total"))
        .withColumn("_outer", scan(F.col("_total")).over(_before(keys, SUPER)))
        .drop("_total")
    )
    return join_null_safe(inner, outer, [*keys, SUPER]).drop(SUPER)


def block_counts(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per (key, block), the number of rows in earlier blocks as ``_offset``."""
    counts = with_block(df, seq).groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    counts = materialize(counts, "block-counts")
    zero = F.lit(0).cast("bigint")
    scanned = _prefix(counts, keys, "_n", lambda v, _: F.sum(v), F.sum)
    return scanned.select(
        *keys,
        BLOCK,
        (F.coalesce("_inner", zero) + F.coalesce("_outer", zero)).alias("_offset"),
    )


def rank_in_blocks(
    df: DataFrame,
    offsets: DataFrame,
    keys: list[str],
    seq: str,
    out: str,
    ties: list[str] | None = None,
) -> DataFrame:
    """Rank rows by their block's offset; other columns of ``offsets`` come along.

    Rows with one sequence number are ranked by ``ties``.
    """
    within = Window.partitionBy(*keys, BLOCK).orderBy(seq, *(ties or []))
    ranked = with_block(df, seq).withColumn("_rn", F.row_number().over(within).cast("bigint"))
    return (
        join_null_safe(ranked, offsets, [*keys, BLOCK])
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop(BLOCK, "_rn", "_offset")
    )


def running_rank(
    df: DataFrame, keys: list[str], seq: str, out: str, ties: list[str] | None = None
) -> DataFrame:
    """1-based position by ``seq`` within ``keys`` (or overall), exact and without gaps."""
    return rank_in_blocks(df, block_counts(df, keys, seq), keys, seq, out, ties)


def carry_forward(
    df: DataFrame, keys: list[str], seq: str, value: str, out: str, ties: list[str] | None = None
) -> DataFrame:
    """Latest non-null ``value`` at or before each row; rows of one number are ordered by ``ties``."""
    blocked = with_block(df, seq)
    present = F.when(F.col(value).isNotNull(), F.col(seq))
    latest_first = F.struct(present, *ties) if ties else present
    last = F.max_by(value, F.when(present.isNotNull(), latest_first))
    lasts = blocked.groupBy(*keys, BLOCK).agg(last.alias("_last"))
    lasts = materialize(lasts, "block-lasts")

    def latest(v: Column) -> Column:
        return F.last(v, ignorenulls=True)

    def newest(v: Column, block: Column) -> Column:
        return F.max_by(v, F.when(v.isNotNull(), block))

    scanned = _prefix(lasts, keys, "_last", newest, latest)
    prefix = scanned.select(*keys, BLOCK, F.coalesce("_inner", "_outer").alias("_prefix"))
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(seq, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.withColumn("_here", F.last(value, ignorenulls=True).over(within))
        .transform(join_null_safe, prefix, [*keys, BLOCK])
        .withColumn(out, F.coalesce("_here", "_prefix"))
        .drop(BLOCK, "_here", "_prefix")
    )


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    value: str,
    out: str,
    fold: Callable[[Column], Column],
    strict: bool = False,
) -> DataFrame:
    """``fold`` (``F.sum``, ``F.min`` or ``F.max``) of ``value`` over all rows up to each one.

    ``strict`` leaves the row itself out; null where there is no value yet. ``seq`` should be
    unique within a key.
    """
    blocked = with_block(df, seq)
    totals = blocked.groupBy(*keys, BLOCK).agg(fold(F.col(value)).alias("_total_here"))
    totals = materialize(totals, "block-totals")
    scanned = _prefix(totals, keys, "_total_here", lambda v, _: fold(v), fold)
    within = Window.partitionBy(*keys, BLOCK).orderBy(seq)
    within = within.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    names = ["_here", "_inner", "_outer"]
    if fold is F.sum:
        some = F.coalesce(*names).isNotNull()
        both = F.when(some, reduce(add, [F.coalesce(c, F.lit(0).cast("bigint")) for c in names]))
    else:
        both = {F.min: F.least, F.max: F.greatest}[fold](*names)
    return (
        blocked.withColumn("_here", fold(F.col(value)).over(within))
        .transform(join_null_safe, scanned.drop("_total_here"), [*keys, BLOCK])
        .withColumn(out, both)
        .drop(BLOCK, "_here", "_inner", "_outer")
    )
