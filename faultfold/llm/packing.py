"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of its documents' tokens. A window (sequence) takes its tokens from the queues in
turn; queue s is owed ``length * T_s / T`` tokens a window, where T_s is its share of all T tokens, and
what it got too little or too much is its deficit, carried to the next window. With P_s tokens in the
queues up to s and x_s = length * P_s / T, the visit to queue s in window w ends at
floor((w + 1) * x_s) - floor(w * x_s). So deficits stay below one token at every window, whatever came
before, and the state of all queues at any window is known without replaying the windows before it: each
document finds its own windows in the task that holds it, and deficits cross partitions by themselves.

A queue must be owed a token a window for its visits never to be negative. Sources owed less are served
one after the other in a queue they share, and that joins the largest queue if it is owed less still.
There are thus at most ``length`` queues, however many sources there are.

T is rounded up to whole windows by a last queue of padding, under ``length`` tokens in all. Null
text counts as empty and has the end token only. Rows with a null source form a queue of their own. Rows
are packed one by one: repeated rows and null ids too. A source's documents are taken in the
order of reading. A very long text is encoded in one task, whole, and cut into as many pieces as windows
need. An empty table has no pieces. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultfold.llm.bpe import Memory, byte_characters
from faultfold.llm.common import bounded_batches, written

LENGTH, END = 4096, 2
#: Words remembered by a worker in each of two generations, and the longest of them.
MEMORY, LONG = 250_000, 48


#: The file's pattern for texts in lower case whose characters all lie below 256, where composing changes
#: nothing and lower case is a matter of single characters. Other texts go to the library whole.
_below_256 = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\t-\\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+").findall


class WordTokenizer:
    """The tokenizers library on a file that drops white space, with recent pieces remembered.

    Pieces are what the file's pattern cuts out; the library's model encodes each on its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.characters = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in enumerate(byte_characters())})
        self.memory = Memory(MEMORY)

    def encode(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        if "<|" in text and self.special.search(text):
            return self._whole(text)
        memory, out = self.memory, []
        new, old = memory.new, memory.old
        for piece in _below_256(text.lower()):
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece) or self._piece(piece)
                if len(piece) <= LONG:
                    memory.put(piece, ids)
                    new, old = memory.new, memory.old
            out.extend(ids)
        return out

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        spelled = piece.encode().decode("latin-1").translate(self.characters)
        return tuple([token.id for token in self.model.tokenize(spelled)])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized(documents: DataFrame, path: str, end: int = END) -> DataFrame:
    """``doc_id, queue, ids, n_tokens, before``, with two bytes an id; ``before`` counts the queue's earlier
    tokens in the same partition, whose number is in ``part``."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        tokenizer, served = loaded(path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw, lengths, before = [], [], []
                for text, queue in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    ids = tokenizer.encode(text or "")
                    ids.append(end)
                    raw.append(np.array(ids, "<u2").tobytes())
                    lengths.append(len(ids))
                    before.append(served.get(queue, 0))
                    served[queue] = before[-1] + len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        part.column(3),
                        pa.array(raw, pa.binary()),
                        pa.array(lengths, pa.int64()),
                        pa.array(before, pa.int64()),
                    ],
                    ["doc_id", "source", "part", "ids", "n_tokens", "before"],
                )

    rows = documents.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        F.spark_partition_id().alias("part"),
    )
    return rows.mapInArrow(run, "doc_id long, source string, part int, ids binary, n_tokens long, before long")


def queues(sources: DataFrame, length: int) -> DataFrame:
    """``source, start, queue, low, high, total``: where a source begins in its queue, and the queue's place
    among all tokens. ``sources`` has each source's ``tokens``.

    Numbering runs over queues, at most ``length`` of them; sources of the shared queue are summed by hash
    blocks, so that no window function sees more than the queues or one block of small sources.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    padded = -(-max(total, 1) // length) * length
    owed = F.col("tokens") * F.lit(length) >= F.lit(padded)
    shared = sources.where(~owed).agg(F.sum("tokens")).first()[0] or 0
    top = sources.orderBy(F.desc("tokens"), "source").limit(1).first()
    own = sources.where(owed).orderBy("source").collect()  # at most ``length`` rows: each has that share
    alone = shared * length >= padded or not own
    rows, low = [], 0
    for row in own:
        joined = row.source == top.source and not alone
        high = low + row.tokens + (shared if joined else 0)
        rows.append((row.source, low, high, row.tokens if joined else -1))
        low = high
    table = spark.createDataFrame(rows, "source string, low long, high long, joined long")
    out = sources.where(owed).join(table, "source").select(
        "source", F.lit(0).cast("long").alias("start"), "low", "high"
    )
    if shared:
        place = (low, low + shared, 0) if alone else next((r[1], r[2], r[3]) for r in rows if r[3] >= 0)
        small = sources.where(~owed).withColumn("block", F.pmod(F.xxhash64("source"), F.lit(1024)))
        sums = small.groupBy("block").agg(F.sum("tokens").alias("n"))
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        inside = Window.partitionBy("block").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
        small = small.join(sums, "block").select(
            "source",
            (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.lit(place[2])).alias("start"),
            F.lit(place[0]).cast("long").alias("low"),
            F.lit(place[1]).cast("long").alias("high"),
        )
        out = out.union(small)
    return out.withColumn("total", F.lit(padded).cast("long"))


def cuts(first: int, n: int, low: int, high: int, total: int, length: int):
    """``(window, offset, start, length)`` of the pieces of n tokens that begin at ``first`` in the queue
    between ``low`` and ``high`` of ``total``."""
    windows, size = total // length, high - low

    def served(w):  # tokens of this queue before window w
        return w * high // windows - w * low // windows

    # served(w) is within one of w * size / windows, so the first window is one of three.
    w = max(0, (first - 1) * windows // size - 1)
    while served(w + 1) <= first:
        w += 1
    at = first
    while at < first + n:
        stop = min(served(w + 1), first + n)
        if stop > at:
            offset = (w + 1) * low // windows - w * low // windows + at - served(w)
            yield w, offset, at - first, stop - at
        at = max(at, stop)
        w += 1


def _pieces(length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, ids, n, first, low, high, total in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for w, offset, start, size in cuts(first, n, low, high, total, length):
                    out.append((doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, w, offset))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(documents: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    tokens = written(tokenized(documents, path, end), "tokens")
    parts = written(
        tokens.groupBy("source", "part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("tokens")), "parts"
    )
    sources = written(parts.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("source", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    placed = written(
        bases.join(queues(sources, length), "source").select(
            "source", "part", (F.col("start") + F.col("base")).alias("base"), "low", "high", "total"
        ),
        "queues",
    )
    rows = tokens.join(placed, ["source", "part"]).select(
        "doc_id", "ids", "n_tokens", (F.col("base") + F.col("before")).alias("first"), "low", "high", "total"
    )
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return rows.mapInArrow(_pieces(length), schema)
