"""The list of recent tickets as a sequence of updates leaves it, with tickets that return after eviction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.operators.scan import BLOCK_BITS, running, running_rank
from faultfold.operators.views import TICKET_LIMIT
from faultfold.session import materialize


def _decided(n: int):
    """The rows of a block but those found to be listed already, each with ``shown`` if that is known by now.

    The block's rows are followed in order with what is known about earlier blocks. A ticket is listed
    until ``n`` tickets were put in after it. It was put in after its last sure entry, so it is listed still if
    fewer than ``n`` rows since then may be entries; it was listed at its last row, so it is gone if ``n``
    rows after that are entries for sure. A row found listed changes nothing and is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        names = ("ticket_id", "shown", "sure", "sure_before", "possible_at")
        columns = [table.column(c).to_pylist() for c in names]
        sure_at, possible_at, keep, shown = {}, {}, [], []
        # Running numbers of the rows before the block.
        sure = possible = 0
        if table.num_rows:
            sure = columns[2][0] - (columns[1][0] is True)
            possible = table.column("rank")[0].as_py() - 1
        for at, (ticket, entry, _, before, last) in enumerate(zip(*columns)):
            before, last = sure_at.get(ticket, before), possible_at.get(ticket, last)
            if not entry and sure - before >= n:
                entry = True
            if not entry and possible - last < n:
                continue
            possible += 1
            if entry:
                sure += 1
                possible_at[ticket] = possible
            sure_at[ticket] = sure
            keep.append(at)
            shown.append(entry or None)
        kept = table.select(["ticket_id", "seq"]).take(pa.array(keep, pa.int64()))
        return kept.append_column("shown", pa.array(shown, pa.bool_()))

    return run


def listed_tickets(updates: DataFrame, n: int = TICKET_LIMIT, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``ticket_id, seq`` of the ``n`` tickets listed after all ``updates``, with the update that put each in.

    ``updates`` has a ``ticket_id`` and a unique ``seq`` a row. An update of a listed ticket does not move it; any
    other puts its ticket in at the front and the last of more than ``n`` out. Id 0 and null ids are no tickets.

    Whether an update puts its ticket in depends on all updates before it, so this is found by rounds.
    A ticket's first update is an entry for sure. Each round counts sure and possible entries by running sums,
    which bound how many came in since a ticket did, and follows the rows of each block of
    2 ** ``block_bits`` rows in order; blocks run side by side. Rows found to change nothing are gone in the next
    round. The first block with an open row is decided whole by each round, and later ones as far as the bounds tell,
    so there are at most as many rounds as blocks; where each ticket comes once to each round trip of ``n`` + 1
    others it takes that many, where many tickets are new a few do. A task holds one block, however often
    a ticket is updated.
    """
    rows = updates.select("ticket_id", "seq").where("ticket_id <> 0")
    first = running_rank(rows, ["ticket_id"], "seq", "_no")
    rows = materialize(first.select("ticket_id", "seq", F.expr("if(_no = 1, true, null)").alias("shown")), "updates")
    while True:
        counted = running_rank(rows, [], "seq", "rank").withColumn("_sure", F.col("shown").isNotNull().cast("bigint"))
        counted = running(counted, [], "rank", "_sure", "sure", F.sum).drop("_sure")
        counted = counted.withColumn("_entry", F.expr("if(shown, rank, null)"))
        counted = running(counted, ["ticket_id"], "rank", "sure", "sure_before", F.max, strict=True)
        counted = running(counted, ["ticket_id"], "rank", "_entry", "possible_at", F.max, strict=True)
        blocks = counted.groupBy(F.shiftright(F.col("rank") - 1, block_bits).alias("block"))
        rows = materialize(blocks.applyInArrow(_decided(n), "ticket_id bigint, seq bigint, shown boolean"), "listed")
        if rows.where("shown is null").isEmpty():
            return rows.select("ticket_id", "seq").orderBy(F.desc("seq")).limit(n)
