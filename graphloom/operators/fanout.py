"""Equi-joins whose output is much larger than their input.

A join is dealt over tasks by what it reads. If keys repeat on both sides, what it makes
grows with the square of that: a few small files, which are one task, or a few keys, which
are a few, can make billions of rows. So a join's output is estimated first, from its
keys only. Where that is out of proportion, a key's pairs are cut in cells of about SIDE x
SIDE rows, and cells are dealt over as many tasks as the output needs. Each pair of rows
lies in one cell whatever the counts are, so counts that are off cost time only.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task makes, as a mean; the output of joins below that, or below so many times their input, is left to Spark.
TASK_ROWS, GROWTH = 2_000_000, 4
#: Rows of a side in a cell, at a mean. A row is sent to as many cells as the other side of its key has blocks.
SIDE = 512
#: Counters of the estimate, which reach the driver; its standard error is sqrt(2 / COUNTERS) of the geometric mean of both sides' self-joins.
COUNTERS = 1 << 12
#: Keys that are cut at most, those of most pairs first; any other has fewer than one in KEYS of all pairs, and is one cell.
KEYS = 1 << 16
#: Beyond so many tasks, tasks get longer.
TASKS = 20_000

#: A frame and the key's columns in it.
Side = tuple[DataFrame, list[Column]]


def _binary(df: DataFrame, names: tuple[str, ...]) -> bool:
    """Whether equal values of these columns have equal bytes; text with a collation needn't."""
    return all(df.schema[x].dataType.simpleString().count("collate") == 0 for x in names)


def _matching(side: Side) -> DataFrame:
    """Rows without a null in the key."""
    return side[0].where(reduce(and_, [k.isNotNull() for k in side[1]]))


def _hashed(side: Side) -> DataFrame:
    """The keys' hashes. Equal keys have equal hashes; others seldom do, and then are cut alike."""
    return _matching(side).select(F.xxhash64(*side[1]).alias("h"))


def estimate(left: Side, right: Side) -> tuple[int, int]:
    """Rows of the join, estimated without bias, and rows of both sides: sums of random signs by key, in COUNTERS buckets."""
    l_df, r_df = (_hashed(x).select("h", F.lit(i).alias("side")) for i, x in enumerate((left, right)))
    sign = F.shiftright("h", 40).bitwiseAND(F.lit(1)) * 2 - 1
    of = lambda i: F.sum(F.when(F.col("side") == i, sign).otherwise(0))
    buckets = l_df.unionByName(r_df).groupBy(F.pmod("h", F.lit(COUNTERS)).alias("b")).agg(of(0), of(1), F.count("*")).collect()
    return sum(x * y for _, x, y, _ in buckets), sum(n for *_, n in buckets)


def _pairs(left: Side, right: Side) -> DataFrame:
    """h, l, r and pairs: the rows on the left, the rows on the right and their product, by key."""
    l_df, r_df = (_hashed(x).groupBy("h").agg(F.count("*").alias(n)) for x, n in ((left, "l"), (right, "r")))
    return l_df.join(r_df, "h").withColumn("pairs", F.col("l").cast("double") * F.col("r"))


def _cells(side: Side, text: list[Column], on: list[str], blocks: DataFrame, own: str, other: str, rows: int) -> DataFrame:
    """Each row in one block of its own side, once for each block of the other side; cell has the key and both blocks, i (left) and j (right)."""
    df = _matching(side).select(*text, F.xxhash64(*side[1]).alias("h"))
    names = df.columns[:-1]
    # sorted, so that a task that runs again numbers its rows alike; equal rows may change places
    df = df.repartition(rows // TASK_ROWS + 1).sortWithinPartitions(*df.columns).withColumn("id", F.monotonically_increasing_id())
    n = lambda x: F.coalesce(F.col(f"n_{x}"), F.lit(1))
    df = df.join(F.broadcast(blocks), "h", "left")
    df = df.select(*names, F.pmod(F.xxhash64("id"), n(own)).alias(own), F.explode(F.sequence(F.lit(0), n(other) - 1)).alias(other))
    # one column, which stays whole if a key is constant: the join then needs no other shuffle, which would be dealt by size again
    parts = [x for k in on for x in (F.lit(","), F.length(k), F.lit(":"), F.col(k))]
    return df.select(*names, F.concat("i", F.lit(","), "j", *parts).alias("cell"))


def join(left: Side, right: Side, text: tuple[list[Column], list[Column]], on: list[tuple[str, str]]) -> DataFrame | None:
    """The inner join of ``text``, named string columns of each side, where those paired in ``on`` are equal; None if Spark's own join will do."""
    if left[0].isStreaming or right[0].isStreaming or not all(_binary(df, names) for df, names in zip((left[0], right[0]), zip(*on, strict=True), strict=True)):
        return None
    made, rows = estimate(left, right)
    least = max(TASK_ROWS, GROWTH * rows)
    # the estimate may be too large, so keys are counted where it is large
    if made <= least or (made := (by_key := _pairs(left, right)).agg(F.sum("pairs")).first()[0] or 0) <= least:
        return None
    tasks = min(TASKS, math.ceil(made / TASK_ROWS))
    large = by_key.where(F.col("pairs") > SIDE * SIDE).orderBy(F.desc("pairs"), "h").limit(KEYS).select("h", "l", "r").collect()
    cut = [(h, math.ceil(x / SIDE), math.ceil(y / SIDE)) for h, x, y in large]
    blocks = left[0].sparkSession.createDataFrame(cut, "h long, n_i int, n_j int")
    # rows that are sent to cells, of all keys
    l_rows, r_rows = (rows + sum(n[s + 1] * b[2 - s] for n, b in zip(large, cut, strict=True)) for s in (0, 1))
    l_df = _cells(left, text[0], [a for a, _ in on], blocks, "i", "j", l_rows).withColumnRenamed("cell", "l_cell").repartition(tasks, "l_cell")
    r_df = _cells(right, text[1], [b for _, b in on], blocks, "j", "i", r_rows).withColumnRenamed("cell", "r_cell").repartition(tasks, "r_cell")
    return l_df.join(r_df.hint("merge"), F.col("l_cell") == F.col("r_cell"), "inner").drop("l_cell", "r_cell")
