"""Near-duplicate groups by MinHash with sequential Bayesian verification.

A document's set holds its distinct shingles of ``words`` consecutive words, A-Z in lower case; a text
with fewer words has one shingle, a text without words none. Two documents are linked when
``100 * |intersection| >= percent * |union|``. The steps, each a Spark job over all documents:

1. Sketch: the set's fingerprint, a signature of ``HASHES`` minima and a hash of each band of ``BAND`` minima.
2. Documents with equal sets collapse to the smallest id among them.
3. Candidates share a band bucket. A bucket never emits all its pairs: each member meets the bucket's
   smallest member. What a bucket then still holds of several components is compared across components
   in blocks of ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles inside tasks, each pair in the first band it shares
   by the bands' own hashes, and only the links that join components leave the task.
4. A candidate's signatures are compared batch by batch; it is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below ``miss``. The prior is uniform.
5. Survivors are verified on full sets, recomputed from the texts of the documents that occur in them.
6. Verified links are joined to components by alternating large-star and small-star steps.

Null text counts as empty. Rows with a null id take no part in links, and keep a null component. Ids
are taken to be unique; of repeated rows with one id all get the same answer. Other columns are ignored, whatever their
names; ties do not occur, and an empty table has an empty result. A very long text is one set of 8 bytes a shingle in a task.
Words and sets are known by 64-bit hashes that no bytes cancel out in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches, dropped, written
from faultfold.llm.words import Words, mixed, word_chunks

HASHES, BAND, BATCH, BLOCK = 150, 5, 30, 512
#: Shingles of a block's documents, about: 8 bytes each.
BLOCK_SHINGLES = 1 << 20
MISS = 1e-6
#: Slots of ids that are broadcast to pick the texts to verify: 4 bytes each, and their hash table.
SLOTS = 1 << 19

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


# -- sets and sketches -------------------------------------------------------------------------


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = words.hashes(lower=True), words.first()
    n = len(hashes)
    if n >= size:
        grams = hashes[: n - size + 1].copy()
        for k in range(1, size):
            grams = grams * _STEP + hashes[k : n - size + 1 + k]
        grams = mixed(grams)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = hashes[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = whole * _STEP + hashes[k]
            sets.append(mixed(whole + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` minima of each set, as unsigned 32-bit values. All sets must hold something."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), first)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), HASHES // BAND, BAND).astype(np.uint64)
    out = np.arange(1, HASHES // BAND + 1, dtype=np.uint64) * _STEP + np.zeros((len(signature), 1), np.uint64)
    for k in range(BAND):
        out = mixed(out * _STEP + bands[:, :, k])
    return out.view(np.int64)


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in word_chunks(batch.column(1)):
                sets = shingle_sets(words, size)
                lengths = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(lengths)
                high, low = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                raw, bands, packed = ([None] * (hi - lo) for _ in range(3))
                if len(full):
                    kept = [sets[i] for i in full]
                    made = signatures(kept)
                    keys, short = band_hashes(made), made.astype(np.uint16)
                    for k, i in enumerate(full.tolist()):
                        raw[i], bands[i], packed[i] = short[k].tobytes(), keys[k], keys[k].tobytes()
                        high[i] = np.add.reduce(kept[k]).view(np.int64)
                        low[i] = np.bitwise_xor.reduce(mixed(kept[k] + _STEP)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(lengths),
                        pa.array(high),
                        pa.array(low),
                        pa.array(raw, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "high", "low", "signature", "bands", "keys"],
                )

    return run


def _set_rows(size: int):
    """Sets as sorted 64-bit values."""

    def run(batches):
        for batch in batches:
            for lo, hi, words in word_chunks(batch.column(1)):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(words, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["doc_id", "shingles"]
                )

    return run


def _read_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


# -- sequential Bayesian pruning ---------------------------------------------------------------


@lru_cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest equal minima at which the similarity may still reach the threshold.

    With m of n equal and a uniform prior, the similarity has density x**m * (1-x)**(n-m); a candidate
    goes on while its mass above the threshold is at least ``miss``.
    """
    x = (np.arange(20000) + 0.5) / 20000
    above = x >= percent / 100
    bounds = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            mass = np.exp(log - log.max())
            if mass[above].sum() / mass.sum() >= miss:
                break
        bounds.append(m)
    return tuple(bounds)


def plausible(left: np.ndarray, right: np.ndarray, bounds: tuple[int, ...]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, bound in enumerate(bounds):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        keep = matches >= bound
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _pruned(bounds):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
                yield batch.select([0, 1]).take(pa.array(keep))

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = [
                i
                for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3)))
                if _linked(_read_set(a.as_py()), _read_set(b.as_py()), percent)
            ]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


# -- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b): the smallest node it is connected with.

    Large-star and small-star steps alternate until every node points at one centre that points nowhere;
    each step is a grouped minimum and a join, so a node with very many edges is only ever summarised.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = written(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large"
        )
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(lower).where("u <> v").distinct(), "edges")
        for old in (now, large, lower):
            dropped(old)
        now = after
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or none and only edges from greater ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return nodes.where("up > 1 or (up = 1 and n > 1)").isEmpty()


# -- candidates --------------------------------------------------------------------------------


def _unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with their component and the bucket's largest one, of buckets that hold several."""
    named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.withColumn("component", F.coalesce("component", "rep")), "named")
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    main = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("main"),
        F.count("*").alias("parts"),
        F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    main = written(main.where("parts > 1").select("bucket", "main", "blocks"), "main")
    return named.join(main, "bucket").select("bucket", "band", "rep", "component", "main", "blocks")


def _blocks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of each pair of blocks of a bucket: outsiders of one block, marked ``out``, and members of the other."""
    signed = members.join(sketches, "rep")
    signed = signed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    inside = signed.withColumns({"outer": F.explode(every), "inner": F.col("block"), "out": F.lit(False)})
    outside = signed.where("component <> main").withColumns(
        {"outer": F.col("block"), "inner": F.explode(every), "out": F.lit(True)}
    )
    return inside.unionByName(outside).select(
        F.xxhash64("bucket", "outer", "inner").alias("key"), "band", "out", "rep", "component", "signature", "keys"
    )


def _grouped(batches):
    """Rows of consecutive equal keys; one group is held at a time, about twice ``BLOCK`` rows."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != key:
                yield held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield held


def _crossing(rows, bounds):
    """Plausible pairs of a block's outsiders and members of other components, in the first band they share."""
    outside, inside = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if not outside or not inside:
        return
    left = np.frombuffer(b"".join(r[5] for r in outside), np.uint16).reshape(-1, HASHES)
    right = np.frombuffer(b"".join(r[5] for r in inside), np.uint16).reshape(-1, HASHES)
    keys_left, keys_right = (
        np.frombuffer(b"".join(r[6] for r in part), np.int64).reshape(-1, HASHES // BAND) for part in (outside, inside)
    )
    component, band = np.array([r[4] for r in inside]), rows[0][1]
    for i, row in enumerate(outside):
        away = np.flatnonzero(component != row[4])
        away = away[plausible(np.broadcast_to(left[i], (len(away), HASHES)), right[away], bounds)]
        if len(away):
            away = away[(keys_right[away] == keys_left[i]).argmax(1) == band]
        for j in away.tolist():
            yield row, inside[j]


_ROWS = pa.schema(
    [
        ("key", pa.int64()),
        ("band", pa.int32()),
        ("out", pa.bool_()),
        ("rep", pa.int64()),
        ("component", pa.int64()),
        ("signature", pa.binary()),
        ("keys", pa.binary()),
    ]
)


def _table(rows, schema):
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _paired(bounds):
    """Of each block, the rows that are in a plausible pair."""

    def run(batches):
        out = []
        for rows in _grouped(batches):
            found = {}
            for pair in _crossing(rows, bounds):
                for row in pair:
                    found[row[2], row[3]] = row
            out.extend(found.values())
            if len(out) >= BLOCK:
                yield _table(out, _ROWS)
                out = []
        yield _table(out, _ROWS)

    return run


def _joining(bounds, percent: int):
    """Of each block, verified links that join components it had apart."""

    def run(batches):
        for rows in _grouped(batches):
            sets = {r[3]: _read_set(r[7]) for r in rows}
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            links = []
            for one, other in _crossing(rows, bounds):
                here, there = root(one[4]), root(other[4])
                if here == there:
                    continue
                if _linked(sets[one[3]], sets[other[3]], percent):
                    parent[here] = there
                    links.append((one[3], other[3]))
            yield _table(links, _LINKS)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(documents: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles`` of at least the documents ``used``.

    Only texts whose id falls into a slot that is used are cut into shingles. There are :data:`SLOTS` slots
    at most, whatever the input, so they can be broadcast and no text is shuffled.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    slots = used.select(slot).distinct()
    texts = documents.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").select("doc_id", "text")
    return texts.mapInArrow(_set_rows(size), "doc_id long, shingles binary")


def verify(documents: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    used = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = written(_sets(documents, used, size), "sets")
    with_a = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "set_a"}), "a")
    both = with_a.join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "set_b"}), "b")
    checked = both.select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a long, b long")
    links = written(checked.distinct(), "links")
    dropped(sets)
    return links


def joining_links(
    documents: DataFrame, members: DataFrame, sketches: DataFrame, bounds, percent: int, size: int
) -> DataFrame:
    """Verified links between components that share a bucket."""
    blocks = _blocks(members, sketches).repartition("key").sortWithinPartitions("key")
    paired = written(
        blocks.mapInArrow(
            _paired(bounds),
            "key long, band int, out boolean, rep long, component long, signature binary, keys binary",
        ),
        "paired",
    )
    if paired.isEmpty():
        return paired.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = _sets(documents, paired.select(F.col("rep").alias("doc_id")), size).withColumnRenamed("doc_id", "rep")
    rows = paired.join(sets, "rep").select(*_ROWS.names, "shingles")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_joining(bounds, percent), "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 80, words: int = 5, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``; a component's smallest ``doc_id`` is kept."""
    bounded_batches(documents.sparkSession)
    bounds = least_matches(percent, miss)
    documents = documents.select("doc_id", "text")
    known = documents.where("doc_id is not null")
    sketches = written(
        documents.mapInArrow(
            _sketches(words),
            "doc_id long, n_shingles long, high long, low long, signature binary, bands array<long>, keys binary",
        ),
        "sketches",
    )
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    fingerprint = ["n_shingles", "high", "low"]
    # Documents of a class have equal sets and so equal signatures; the smallest id stands for them.
    classes = full.groupBy(*fingerprint).agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("signature", "bands", "keys")]
    )
    reps = written(classes, "classes")
    named = written(full.join(reps.select(*fingerprint, "rep"), fingerprint).select("doc_id", "rep"), "members")
    exploded = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = exploded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = written(exploded.join(crowded.select("bucket", "pivot"), "bucket"), "buckets")
    small = reps.select("rep", "signature")
    keyed = reps.select("rep", "signature", "keys")

    pairs = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(small.withColumnsRenamed({"rep": "a", "signature": "sig_a"}), "a")
    pairs = pairs.join(small.withColumnsRenamed({"rep": "b", "signature": "sig_b"}), "b")
    pairs = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruned(bounds), "a long, b long")
    candidates = written(pairs, "candidates")
    links = verify(known, candidates, percent, words)
    labels = written(components(links), "labels")
    members = _unresolved(buckets, labels)
    more = written(joining_links(known, members, keyed, bounds, percent, words), "links")
    if not more.isEmpty():
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = written(components(stars.where("a <> b").union(more)), "labels")

    for old in (buckets, candidates, links, reps):
        dropped(old)
    out = named.join(labels.withColumnsRenamed({"node": "rep", "component": "joined"}), "rep", "left").select(
        "doc_id", F.coalesce("joined", "rep").alias("linked")
    )
    # Ids are unique but for repeated rows, which have one class only if their texts are equal.
    out = out.groupBy("doc_id").agg(F.min("linked").alias("linked"))
    return (
        sketches.select("doc_id", "n_shingles")
        .join(out, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("linked", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )
