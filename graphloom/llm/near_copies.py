"""Near-copies by true shingle similarity: SimHash classes and MinHash bands find candidates, whole shingle sets decide.

A text is its set of five-word shingles. Candidates of each other are the texts of one class
of ball hashing (``simhash.near_links``), which are all but equal, and those that share one
of the BANDS keys of ROWS minima each, for at a likeness of LEAST fingerprints differ in more
bits than balls can reach. Two texts whose sets have a Jaccard likeness of LEAST or more share
a key with a probability of 0.9996 or more; every pair that could decide is then compared, by
size and sketch and at last by its whole sets, so that no document goes without a kept one
that is LEAST or more like it.

Documents are settled in order of id, in rounds. All that share a key are compared to the
smallest ones with that key that are left, its hubs: to one of them in the first round, two in
the next, four, and so on. A document that has met all smaller ones stays unless one of them that
stays is like it. So the rounds grow with the logarithm of the unlike documents that share a key,
and alike ones, however many, meet few others. As soon as the keys' pairs are PAIRS a row at most
after a round, all that are left are compared at once.

Sketches are compared where the rows of a key lie, and then whole sets too, which are sent to the
places that need them; a pair that meets under several keys is compared under one. So only alike
pairs ever are rows, and of all others a place holds a row a document. A key of more than BLOCK rows
is dealt over blocks, and its hubs are sent to each of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, shield, text_or_empty
from .components import connected_components
from .simhash import _signed, fingerprint, near_links

SHINGLE = 5
#: The least Jaccard likeness of near-copies.
LEAST = 0.8
BANDS, ROWS = 20, 5
#: Of BANDS * ROWS minima, pairs must share so many for their sets to be compared; at LEAST they have fewer twice in a million.
SKETCHED = 60
#: Shingles whose minima are taken at once; bounds memory for long texts.
_BLOCK = 1 << 12
#: Once bands have no more than so many pairs a row, all pairs that are left are compared at once.
PAIRS = 32
#: Rows of a key that are compared to its hubs in one place, about.
BLOCK = 1024
#: Pairs whose sketches are compared at a time; bounds memory.
_PAIRS_AT_ONCE = 1 << 15


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all n-word shingles of UTF-8 text, ascending; fewer words are one shingle, no words none."""
    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), dtype=np.uint64))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minima(hashes: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of BANDS * ROWS hashes of the set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), _BLOCK):
        # the high halves of a multiplication are well mixed
        mixed = ((hashes[at : at + _BLOCK] ^ by[1][:, None]) * by[0][:, None]) >> np.uint64(32)
        np.minimum(least, mixed.min(axis=1).astype(np.uint32), out=least)
    return least


def band_keys(sketch: np.ndarray) -> list[int]:
    """A signed 64-bit key a band; equal where the band's part of the sketch is. Sets without shingles share theirs."""
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(sketch.reshape(BANDS, ROWS))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = _multipliers()
    for batch in batches:
        whole, fps, bands, sizes, sketches = [], [], [], [], []
        for cell in batch.column(2):
            text = cell.as_py()
            hashes = shingle_set(text)
            fps.append(_signed(fingerprint(text, SHINGLE)))
            whole.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sketch = minima(hashes, by).astype("<u2")
            bands.append(band_keys(sketch))
            sizes.append(len(hashes))
            sketches.append(sketch.tobytes())
        columns = [batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "whole", "fp", "bands", "size", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "shingles"])


def _by_place(of: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]):
    """``of`` whole places, and for each row the first one of its place. Rows (band, block, ...) are sorted by place, a block of a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
            # the last place may go on in the next batch
            if not held or batch is not None and all(held[0].column(i)[0] == held[-1].column(i)[-1] for i in (0, 1)):
                continue
            rows = pa.concat_batches(held)
            place = [rows.column(i).to_numpy() for i in (0, 1)]
            first = np.r_[True, (place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1])]
            start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            end = len(rows) if batch is None else int(start[-1])
            yield from of(rows.slice(0, end), start[:end])
            held = [rows.slice(end)]

    return run


def _near(rows: pa.RecordBatch, start: np.ndarray, least: float, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows that ask and the hubs before them in their place whose sketches have SKETCHED minima in common."""
    hub, asks, size = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
    sketch = np.frombuffer(b"".join(rows.column(6).to_pylist()), dtype="<u2").reshape(len(rows), -1)
    hubs, before = np.flatnonzero(hub), np.cumsum(hub) - hub
    most = np.where(asks, before - before[start], 0)
    ends = np.cumsum(most)
    for at in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS_AT_ONCE):
        nth = np.arange(at, min(at + _PAIRS_AT_ONCE, int(ends[-1])))
        a = np.searchsorted(ends, nth, "right")
        b = hubs[before[start[a]] + nth - (ends[a] - most[a])]
        # sets of sizes too unlike can't be alike
        near = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
        a, b = a[near], b[near]
        same = sketch[a] == sketch[b]
        near = same.sum(axis=1) >= SKETCHED
        if once:
            mine, hub_in = (rows.column(i).to_numpy() for i in (7, 8))
            # the bands that both share and the second is a hub of, and at last the class
            meet = same.reshape(-1, BANDS, ROWS).all(axis=2) & (hub_in[b][:, None] >> np.arange(BANDS) & 1).astype(bool)
            near &= np.c_[meet, np.ones(len(meet), bool)].argmax(axis=1) == mine[a]
        yield a[near], b[near]


def _sketched(least: float):
    """(id, hub) of each row that asks and each hub before it in its place whose sketches have SKETCHED minima in common.

    Rows (band, block, id, hub, asks, size, sketch) are sorted by place and id.
    """

    def pairs(rows: pa.RecordBatch, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found in _near(rows, start, least, False):
            yield pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(x)) for x in found], names=["id", "hub"])

    return _by_place(pairs)


def _asked(least: float):
    """The pairs of ``_sketched``, as a row (band, block, id, hubs) of each id that asks, and one without hubs of each other hub.

    Rows have two more columns: the number of the band, and a bit for each band in which the id is a hub. A pair is found
    in the first band only where it meets, and in the class only if it meets in no band.
    """

    def asked(rows: pa.RecordBatch, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        said, named = np.zeros(len(rows), bool), np.zeros(len(rows), bool)

        def made(at: np.ndarray, ends: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column(2).take(pa.array(hubs, pa.int64())))
            return pa.RecordBatch.from_arrays([*(rows.column(i).take(pa.array(at)) for i in range(3)), lists], names=["band", "block", "id", "hubs"])

        for a, b in _near(rows, start, least, True):
            at, first = np.unique(a, return_index=True)
            said[at] = named[b] = True
            yield made(at, np.r_[first, len(a)], b)
        others = np.flatnonzero(named & ~said)
        yield made(others, np.zeros(len(others) + 1, int), others[:0])

    return _by_place(asked)


def _alike(least: float):
    """The pairs (id, hub) of rows (band, block, id, hubs, shingles), sorted by place, whose sets are ``least`` or more alike."""

    def alike(rows: pa.RecordBatch, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, hubs, sets = rows.column(2).to_pylist(), rows.column(3).to_pylist(), rows.column(4)
        out, at, of = [], -1, {}
        for i, first in enumerate(start):
            if first != at:
                end = int(np.searchsorted(start, first, "right"))
                at, of = first, {ids[j]: np.frombuffer(sets[j].as_buffer(), dtype=np.uint64) for j in range(first, end)}
            a = of[ids[i]]
            for hub in hubs[i]:
                b = of[hub]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= least * (len(a) + len(b) - shared):
                    out.append((ids[i], hub))
        yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in out], rows.schema.field(2).type) for i in range(2)], names=["id", "hub"])

    return _by_place(alike)


def dedup(docs: DataFrame, key: str = "doc_id", least: float = LEAST, most_pairs: int = PAIRS, block_rows: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that are ``least`` or more like a row with a smaller key that stays.

    Of texts with equal shingle sets the smallest key stands for all; null and empty texts
    have the same, empty one. Rows that repeat a key are kept once, if at all. Rows with a null
    key have no identity to compare by and stay. Columns stay as they are.
    """
    docs, restored = shield(docs, key, "text")
    kind = docs.schema[key].dataType.simpleString()
    named = docs.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(text_or_empty()))
    made = named.select(F.col(key).alias("id"), F.col("_h").alias("h"), F.encode(text_or_empty(), "UTF-8").alias("_text"))
    rows = made.mapInArrow(_signatures, f"id {kind}, h long, whole binary, fp long, bands array<long>, size long, sketch binary")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("h"))
    rows = shared_table(rows.withColumn("_n", nth).where("_n = 1").drop("_n"), "signatures")
    # Spark takes the first row of a set in each partition before it shuffles, so copies don't meet in one place
    nth = F.row_number().over(Window.partitionBy("whole").orderBy("id"))
    firsts = shared_table(rows.withColumn("_n", nth).where("_n = 1").select("id", "h", "fp", "bands", "size", "sketch"), "firsts")

    # a class is named by its smallest fingerprint; one without a link is a class of its own
    labels = connected_components(near_links(shared_table(rows.select("fp").distinct(), "distinct")), "fp", "hub")
    classes = firsts.select("id", "fp").join(labels, F.col("fp") == F.col("node"), "left")
    classes = classes.select("id", F.xxhash64(F.lit("class"), F.coalesce("component", "fp")).alias("band"), F.lit(BANDS).alias("nth"))
    spread = firsts.select("id", F.posexplode("bands").alias("nth", "band")).select("id", "band", "nth").unionByName(classes)
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    left = shared_table(spread.hint("merge").join(shared, "band", "left_semi"), "bands")
    waiting = left.select("id").distinct()
    chosen = named.join(firsts.join(waiting, "id", "left_semi").select(F.col("id").alias("_id"), F.col("h").alias("_fh")), (F.col(key) == F.col("_id")) & (F.col("_h") == F.col("_fh")))
    # rows of one key and hash lie together after the join
    chosen = chosen.select(F.col(key).alias("id"), "_h", F.encode(text_or_empty(), "UTF-8").alias("_text")).dropDuplicates(["id", "_h"])
    sets = shared_table(chosen.select("id", "_text").mapInArrow(_sets, f"id {kind}, shingles binary"), "sets")

    def compared(ranked: DataFrame) -> DataFrame:
        """(id, hub) of the rows (id, band, nth, blocks, hub, hub_in) and the smaller hubs of their bands that are alike."""
        # a band that is dealt has its hubs in each block, and besides them the rows that ask
        own = ranked.select("band", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", (F.col("hub") & (F.col("blocks") == 1)).alias("hub"), F.lit(True).alias("asks"), "nth", "hub_in")
        sent = ranked.where("hub and blocks > 1").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", F.lit(True).alias("hub"), F.lit(False).alias("asks"), "nth", "hub_in")
        met = own.unionAll(sent).hint("merge").join(firsts.select("id", "size", "sketch"), "id").repartition("band", "block").sortWithinPartitions("band", "block", "id", F.desc("asks"))
        found = met.select("band", "block", "id", "hub", "asks", "size", "sketch", "nth", "hub_in")
        some = shared_table(found.mapInArrow(_asked(least), f"band long, block long, id {kind}, hubs array<{kind}>"), "sketched")
        whole = some.join(sets, "id").repartition("band", "block").sortWithinPartitions("band", "block")
        return whole.select("band", "block", "id", "hubs", "shingles").mapInArrow(_alike(least), f"id {kind}, hub {kind}")

    gone, most = rows.select("id").limit(0), 1
    while not left.isEmpty():
        n = F.col("n")
        rows_left, pairs_left, largest = left.groupBy("band").agg(F.count("*").alias("n")).agg(F.sum(n), F.sum(n * (n - 1) / 2), F.max(n)).head()
        # the first hubs alone are like most of the copies
        if most > 1 and pairs_left <= most_pairs * rows_left:
            most = largest
        in_band, of_id = Window.partitionBy("band").orderBy("id"), Window.partitionBy("id")
        every = in_band.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranks = {"_n": F.row_number().over(in_band), "blocks": F.ceil(F.count("*").over(every) / block_rows)}
        left = left.withColumns(ranks).select("id", "band", "nth", "blocks", (F.col("_n") <= most).alias("hub"))
        hub_in = F.bit_or(F.when(F.col("hub"), F.expr("shiftleft(1L, nth)")).otherwise(F.lit(0).cast("long")))
        # a row of each of those that have met all smaller ones with their keys, and that all larger ones have met
        full = F.bool_and("hub").over(of_id) & (F.col("nth") == F.min("nth").over(of_id))
        left = shared_table(left.withColumns({"hub_in": hub_in.over(of_id), "full": full}), "ranked")
        links = shared_table(compared(left), "links")
        full = shared_table(left.where("full").select("id"), "full")
        left = left.select("id", "band", "nth")
        while True:
            stays = full.join(links.select("id").distinct(), "id", "left_anti")
            drop = shared_table(links.join(stays.select(F.col("id").alias("hub")), "hub", "left_semi").select("id").distinct(), "gone")
            if drop.isEmpty():
                break
            gone = gone.unionAll(drop)
            links = shared_table(links.join(drop, "id", "left_anti").join(drop.select(F.col("id").alias("hub")), "hub", "left_anti"), "links")
            full, left = full.join(drop, "id", "left_anti"), left.join(drop, "id", "left_anti")
        left, most = shared_table(left.join(stays, "id", "left_anti"), "bands"), 2 * most

    kept = firsts.select("id", F.col("h").alias("_fh"))
    kept = kept.join(gone, "id", "left_anti").withColumnRenamed("id", "_kept")
    rows = named.join(kept, F.col(key) == F.col("_kept")).where("_h = _fh").drop("_kept", "_fh", "_h")
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("text"))).where("_nth = 1").drop("_nth")
    return once.unionByName(docs.where(F.col(key).isNull())).select(*restored)
