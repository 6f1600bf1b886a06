"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns the arcs of its virtual nodes. A row lands on the arc of its key's
hash; a shard takes what its arcs offer, arc by arc, up to its capacity, and what it
can't take continues clockwise to the next virtual node of a shard with room. Only
the arcs' row counts (a fixed number of them) reach the driver; rows are placed by
their rank within an arc, computed in bounded sub-bins.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import how_many, shared_table, shield, table, text_or_empty

SHARDS = 40
#: Virtual nodes a shard has.
VNODES = 64
#: Parts of an arc that are ranked apart, and parts into which rows are dealt that are equal in key and tie and make up more
#: than one in HOT_SHARE of all rows (and HOT_ROWS at least).
SUB_BINS, SALTS, HOT_SHARE, HOT_ROWS = 64, 64, 1000, 4096
_RING = 2**32


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, by position; a shard's nodes don't depend on the others."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=4).digest(), "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may hold: without slack they add up to ``total`` and differ by one at most."""
    if slack > 0:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def place_arcs(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc of the ring: (first rank, shard, first slot) of its runs of rows.

    All arcs offer their rows to their owner; rows that find it full move on to the next
    virtual node, round after round. Needs as much room as there are rows.
    """
    arcs, room, used = len(counts), list(room), [0] * len(room)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(arcs)]
    offers = deque((a, a, 0, n) for a, n in enumerate(counts) if n)  # arc, node reached, first rank, rows
    while offers:
        arc, node, first, n = offers.popleft()
        shard = owners[node]
        take = min(n, room[shard] - used[shard])
        if take:
            runs[arc].append((first, shard, used[shard]))
            used[shard] += take
        if n > take:
            offers.append((arc, (node + 1) % arcs, first + take, n - take))
    return runs


def assign_shards(rows: DataFrame, key: Sequence[str], shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, tie: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    key: columns that give a row's place on the ring; nulls hash like any value. tie:
    further columns that order rows with one key, so that a hot key's rows are ranked in
    several bins and spread over shards with room. Rows equal in key and tie are placed in
    any order, very many of them in parts. Rows are written once, so keep payload columns few. With slack 0 row counts differ by one at most; with more, shards hold up to
    (1 + slack) times the mean and fewer rows move when shards are added. Input columns
    named shard or slot are replaced. Empty input gives no rows.
    """
    nodes = ring(shards, vnodes)
    rows, restored = shield(rows.select(*[c for c in rows.columns if c not in ("shard", "slot")]), *key, *tie)
    bounds = F.array(*[F.lit(p) for p, _ in nodes])
    # an arc ends at its virtual node: the first one at or after the position, clockwise
    arc = how_many(lambda i: F.get(bounds, i) < F.col("_position"), len(nodes)) % len(nodes)
    sub = F.pmod(F.xxhash64(*key, *tie, F.lit(7)), F.lit(SUB_BINS)).cast("int")
    binned = rows.withColumns({"_position": F.pmod(F.xxhash64(*key), F.lit(_RING)), "_sub": sub, "_tie": F.xxhash64(*key, *tie, F.lit(11)), "_id": F.monotonically_increasing_id()})
    binned = shared_table(binned.withColumn("_arc", arc.cast("int")).drop("_position"), "binned")
    # equal rows in great number, HOT_SHARE different ones at most, are told apart by where they lie
    alike = binned.groupBy("_arc", "_sub", "_tie").agg(F.count("*").alias("_n"))
    hot = alike.where(F.col("_n") > max(HOT_ROWS, binned.count() // HOT_SHARE)).select("_arc", "_sub", "_tie", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)) + 1).otherwise(0)
    binned = binned.join(F.broadcast(hot), ["_arc", "_sub", "_tie"], "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    # (shards x vnodes x SUB_BINS) + (HOT_SHARE x SALTS) counts at most, whatever the input; only the arcs' sums come to the driver
    bins = ["_arc", "_sub", "_salt"]
    counted = binned.groupBy(*bins).agg(F.count("*").alias("_n"))
    counts = [0] * len(nodes)
    for a, n in counted.groupBy("_arc").agg(F.sum("_n")).collect():
        counts[a] = n
    runs = place_arcs(counts, [s for _, s in nodes], capacities(sum(counts), shards, slack))
    run = pa.list_(pa.struct([("first", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64())]))
    plan = {"_arc": pa.array(range(len(nodes)), pa.int32()), "_runs": pa.array([[dict(zip(("first", "shard", "slot"), r)) for r in x] for x in runs], run)}
    # an Arrow table stays in the JVM; rows would go through Python workers of the executors
    placed = F.broadcast(rows.sparkSession.createDataFrame(pa.table(plan)))
    before = F.sum("_n").over(Window.partitionBy("_arc").orderBy("_sub", "_salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counted.select(*bins, F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = binned.withColumn("_rank", F.row_number().over(Window.partitionBy(*bins).orderBy("_tie", "_id")) - 1)
    # dealt and sorted by bins already
    ranked = ranked.hint("merge").join(before, bins).join(placed, "_arc")
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    mine = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_run", mine)
    return ranked.select(*restored, F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_rank") - F.col("_run.first")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; null text counts as empty."""
    text = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(rows, ["doc_id"], shards, tie=["size", "text_crc32"])


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_bounded_ring": op4_bounded_ring}
ORACLES: dict[str, str] = {}
