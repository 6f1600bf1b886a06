"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a point between them that is one flip
from one and at most two from the other, so each fingerprint emits the variants around
it, and equal variants bring the linked ones together:

* distances up to 2 meet where both are at most one flip away;
* at distance 3 parities differ: the even one emits its two-flip variants, the odd one
  its one-flip variants. Of three differing bits two lie in one 32-bit half, so only
  two-flip variants within a half are needed: 992 instead of 2,016.

A variant names its smallest near fingerprint as a hub, and all others met there link
to the hub alone. That is enough for connected components and is linear in the number
of variants, however many fingerprints share one. Every link is verified by its bits.

Before the balls are emitted, fingerprints that can have no partner are set aside: a
partner differs in at most one bit in one 32-bit half, so it shares that half, or one of
its 32 one-flip variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table, table, text_or_empty
from .components import connected_components

SHINGLE = 3
RADIUS = 3
#: Fingerprints at most that are common enough to be broadcast.
MOST_COMMON = 1000
#: Hashes whose bits are counted at once; bounds memory for long texts.
_BLOCK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of all n-word shingles of UTF-8 text, repeats counted; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    hash_of = xxhash.xxh64_intdigest
    total, ones = 0, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((hash_of(s, seed) for s in shingles), dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            made = pa.array([_signed(fingerprint(t.as_py(), shingle)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "fp"])

    return run


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp`` (long, the fingerprint's 64 bits) over shingles of so many words; null text counts as empty."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.encode(text_or_empty(), "UTF-8").alias("_text")).mapInArrow(_fingerprints(shingle), f"{schema}, fp long")


def _masks(*values: int) -> Column:
    return F.lit(np.array([_signed(v) for v in values], dtype=np.int64))


_ONE = [1 << i for i in range(64)]
_TWO = [_ONE[i] | _ONE[j] for i in range(64) for j in range(i) if i // 32 == j // 32]


def _possible(fps: DataFrame) -> DataFrame:
    """Fingerprints that share a half, or a one-flip variant of it, with another one."""
    halves = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("half"), h.alias("value")) for i, h in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)))])).alias("h"))
    key = (F.col("h.value") * 2 + F.col("h.half")).alias("key")
    exact = halves.select("fp", key)
    # one-flip variants that exist as another fingerprint's half; counts come first, so a common half is one row
    present = exact.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    shared = present.where("n > 1").select("key")
    alike = exact.join(shared, "key", "left_semi").select("fp")
    moved = exact.select("fp", "key", F.explode(_masks(*(1 << (i + 1) for i in range(32)))).alias("m")).select("fp", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    near = moved.hint("merge").join(present.select("key"), "key", "left_semi").select("fp")
    # the relation is symmetric: the partner finds this one through the same flip
    return alike.unionAll(near).distinct()


def near_links(fps: DataFrame) -> DataFrame:
    """(fp, hub): verified links between distinct fingerprints that join exactly those RADIUS or fewer bits apart.

    Two fingerprints within the radius are linked directly or through one hub that both
    are linked to; no link is longer than the radius.
    """
    some = shared_table(_possible(fps), "possible")
    even = F.bit_count("fp") % 2 == 0
    point = F.col("fp").bitwiseXOR(F.col("m")).alias("point")
    near = some.select("fp", F.explode(F.when(even, _masks(0, *_ONE)).otherwise(_masks(*_ONE))).alias("m")).select("fp", point)
    far = some.where(even).select("fp", F.explode(_masks(*_TWO)).alias("m")).select("fp", point)
    hubs = near.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("most"))
    # among near fingerprints of a point only those that share it matter; far ones need any hub there;
    # sizes before the explodes say nothing about these sides, so a broadcast is ruled out
    met = near.hint("merge").join(hubs.where("hub != most"), "point").select("fp", "hub")
    met = met.unionAll(far.hint("merge").join(hubs, "point").select("fp", "hub"))
    return met.where("fp != hub").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS).distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id): every row with the smallest key it reaches over near fingerprints.

    Null text counts as empty; all empty texts share fingerprint 0 and are linked like any
    other. Rows with equal fingerprints are reduced to one before anything is paired, so
    groups of copies cost a partial aggregate. Repeated rows each get their row; null keys
    are never the smallest unless alone. Other columns are ignored. No rows give no rows.
    """
    rows = shared_table(with_fingerprints(docs, [key], shingle), "fingerprints")
    fps = shared_table(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "distinct")
    labels = connected_components(near_links(fps.select("fp")), "fp", "hub")
    named = labels.join(fps, F.col("node") == F.col("fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(least, "component").select("fp", F.col("component_id").alias("_c"))
    classes = fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("_c", "first").alias("component_id"))
    classes = shared_table(classes, "classes")
    # a fingerprint of a thousandth of all rows or more is one of a thousand at most; those are broadcast, so that
    # their many rows stay where they are, and the others are joined
    total = fps.agg(F.sum("n")).head()[0] or 0
    common = classes.where(F.col("n") * MOST_COMMON >= total).select("fp", "component_id", F.lit(True).alias("_common"))
    marked = rows.join(F.broadcast(common), "fp", "left")
    others = marked.where("_common is null").select(key, "fp").join(classes.select("fp", "component_id"), "fp")
    return marked.where("_common").select(key, "fp", "component_id").unionByName(others.select(key, "fp", "component_id"))


def op9_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_ball_hashing": op9_ball_hashing}
ORACLES: dict[str, str] = {}
