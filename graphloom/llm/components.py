"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import shared_table

#: So many edges between whole numbers, a megabyte, are finished in one task; a round over them costs six shuffles.
FEW = 1 << 16


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of the edges that isn't its component's smallest, and that one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted(map(root, pair))
            parent[high] = low
    found = [(x, root(x)) for x in list(parent) if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in found], kind) for i in range(2)], names=["u", "v"])


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and u's neighbours; two-phase, so a hub's edges are never in one group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    """A count and checksum of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())


def connected_components(edges: DataFrame, left: str, right: str, few: int = FEW) -> DataFrame:
    """Rows (node, component): each node that has an edge with the smallest node it can reach.

    Nodes may be of any ordered type. Null ends and self-loops are ignored; repeated
    edges count once; an empty edge list gives no rows. Each round of large-star and
    small-star ends in a table in the shared folder; the number of rounds grows with
    the logarithm of the longest path. Each step holds at most one row per edge and
    node, whatever the degree of a hub. As soon as no more than ``few`` edges between whole
    numbers are left, one task walks them instead; the result is the same.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    e = e.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = shared_table(e, "edges")
    before = _state(e)
    whole = isinstance(e.schema["u"].dataType, IntegralType)
    while before[0]:
        if whole and before[0] <= few:
            kind = e.schema["u"].dataType.simpleString()
            e = shared_table(e.coalesce(1).mapInArrow(_stars, f"u {kind}, v {kind}"), "edges")
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _with_min(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        small = small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u != v").distinct()
        e = shared_table(small, "edges")
        # a fixed point is a forest of stars: no parent is anyone's child, and the edge set is unchanged
        state = _state(e)
        if state == before:
            break
        before = state
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
