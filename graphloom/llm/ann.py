"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a
unit vector, and its hash is the signed axis nearest to it; a bucket is an axis of each of
several rotations. Every table has rotations of its own. A query probes the likeliest
buckets in each table, a share of them that falls as the table grows, and the vectors found
there are ranked by their exact Euclidean distance, in blocks, where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_table, table

TABLES = 16
#: Rotations in a key at the least, and rows in a bucket, on the average, beyond which there is one more.
AXES, BUCKET_ROWS = 2, 4096
#: Share of a table's buckets that a query probes among FEW rows, and the powers of the rows by which it rises below and
#: falls beyond. On random 64-dimensional unit vectors, the hardest case, these find over 0.9 of the true neighbours.
SHARE, FEW, RISE, FALL = 0.016, 2000, 0.5, 0.3
#: Vectors that one task ranks at once, about; buckets that are larger are split.
BLOCK_ROWS = 8192


def plan_probes(n: int, width: int, axes_per_hash: int | None = None, probes: int | None = None) -> tuple[int, int]:
    """(axes_per_hash, probes) for n rows of ``width`` components, where they aren't given."""
    signed = 2 << max(0, width - 1).bit_length()
    if axes_per_hash is None:
        axes_per_hash = AXES
        while n > BUCKET_ROWS * signed**axes_per_hash:
            axes_per_hash += 1
    if probes is None:
        probes = math.ceil(SHARE * (FEW / max(n, 1)) ** (RISE if n < FEW else FALL) * signed**axes_per_hash)
        probes = max(probes, min(signed, 8))
    return axes_per_hash, min(probes, signed**axes_per_hash)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(unit: np.ndarray, which: int, seed: int) -> np.ndarray:
    """The pseudo-rotation of table ``which``, on vectors padded to a power of two."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width), dtype=np.float32)
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([seed, which]).choice(np.array([-1, 1], dtype=np.float32), (3, width))
    for s in signs:
        x = _hadamard(x * s)
    return x


def axes(rotated: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row, nearest first (2 i for +i, 2 i + 1 for -i), and how far each is."""
    far = np.empty((len(rotated), 2 * rotated.shape[1]), dtype=np.float32)
    far[:, 0::2], far[:, 1::2] = -rotated, rotated
    found = np.argsort(far, axis=1, kind="stable")[:, :count]
    return found, np.take_along_axis(far, found, axis=1)


def buckets(unit: np.ndarray, which: int, count: int, per_key: int, seed: int) -> np.ndarray:
    """The ``count`` likeliest buckets of each row in table ``which``; a bucket is one axis of each of ``per_key`` rotations."""
    keys, far = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1), dtype=np.float32)
    for j in range(per_key):
        rotated = rotate(unit, which * per_key + j, seed)
        found, away = axes(rotated, count)
        # the i-th of one and the j-th of the other have (i + 1) (j + 1) - 1 pairs before them
        a, b = np.nonzero(np.outer(np.arange(1, keys.shape[1] + 1), np.arange(1, found.shape[1] + 1)) <= count)
        keys = keys[:, a] * (2 * rotated.shape[1]) + found[:, b]
        far = far[:, a] + away[:, b]
        best = np.argsort(far, axis=1, kind="stable")[:, :count]
        keys, far = np.take_along_axis(keys, best, axis=1), np.take_along_axis(far, best, axis=1)
    return keys


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that squares of huge or tiny components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raws: list[bytes], dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the raw vectors, for each length that occurs."""
    sizes = np.array([len(r) for r in raws])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(raws[i] for i in at), dtype=dtype).reshape(len(at), -1)


def _hasher(dtype: str, tables: int, plans: dict[int, tuple[int, int]], seed: int, query: bool):
    """Adds ``buckets``, of all tables one after the other; plans: by length, axes and probes. Queries get all that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(batch)
            for at, x in _by_length(batch.column(batch.num_columns - 1).to_pylist(), dtype):
                per_key, probes = plans[x.shape[1]]
                unit = _unit(x)
                found = np.stack([buckets(unit, t, probes if query else 1, per_key, seed) for t in range(tables)], axis=1).reshape(len(unit), -1)
                for i, row in zip(at, found):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    return run


def _packer(dtype: str):
    """Arrays of numbers as raw bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, dtype=dtype).tobytes() for v in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "raw"])

    return run


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares would overflow or vanish, by way of a power of two."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = np.sqrt(np.square(rows - one).sum(axis=1))
        odd = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
        if len(odd):
            some = rows[odd]
            most = np.maximum(np.abs(some).max(axis=1), np.abs(one).max())
            power = np.frexp(most)[1] + 1
            gap = np.ldexp(some, -power[:, None]) - np.ldexp(one[None, :], -power[:, None])
            # gaps much smaller than the vectors are scaled by themselves
            own = np.frexp(np.abs(gap).max(axis=1))[1]
            d[odd] = np.ldexp(np.sqrt(np.square(np.ldexp(gap, -own[:, None])).sum(axis=1)), own + power)
    return d


def _ranker(dtype: str, keep: int):
    """For a block of vectors and the queries that probe buckets there (null: all), each query's nearest vectors."""
    names = ["query", "vid", "score", "ids"]

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame([], columns=names)
        index = index.sort_values(["b", "vid"], kind="stable")
        v = np.frombuffer(b"".join(index["raw"]), dtype=dtype).reshape(len(index), -1).astype(np.float64)
        of, vid, ids, out = index["b"].to_numpy(), index["vid"].to_numpy(), index["ids"].tolist(), []
        least = np.array([x[0]["id"] for x in ids])
        for q, raw, probed in zip(queries["vid"], queries["raw"], queries["probed"]):
            if probed is None:
                some = np.arange(len(v))
            else:
                probed = np.unique(probed)
                first, past = np.searchsorted(of, probed, "left"), np.searchsorted(of, probed, "right")
                some = np.concatenate([np.arange(a, b) for a, b in zip(first, past) if b > a] or [np.empty(0, dtype=np.int64)])
            d = distances(v[some], np.frombuffer(raw, dtype=dtype).astype(np.float64))
            if len(d) > 4 * keep:
                near = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
                some, d = some[near], d[near]
            best = np.lexsort((vid[some], least[some], d))[:keep]
            out += [(q, vid[some[i]], d[i], ids[some[i]]) for i in best]
        return pd.DataFrame(out, columns=names)

    return run


_IDS = "array<struct<id:bigint,uid:bigint>>"


def _ranked(pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query row from pairs of distinct vectors."""
    once = pairs.groupBy("query", "vid").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    near = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]["id"], "vid"))
    once = once.withColumn("_n", near).where(F.col("_n") <= k + 1).drop("_n")
    rows = once.select("query", "score", F.explode("ids").alias("found")).join(queries, "query").where("found.uid != query_uid")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy("score", "found.id", "found.uid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_uid", "query_id", "rank", F.col("found.id").alias("vec_id"), "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, tables: int = TABLES, probes: int | None = None, axes_per_hash: int | None = None, seed: int = 0, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``: their k nearest other rows found.

    Nearest first by exact Euclidean distance in double precision, ties to the smaller id;
    all other rows where there are fewer than k. Vectors that are null, zero or empty or hold
    null or non-finite components take no part, and neither do null ids. Vectors of another
    length than the query's have no distance from it and aren't found. A repeated id is as
    many rows, each with its own vector; each is a candidate of the others, and each a query
    if the id is one. Other columns are ignored. No rows give no rows.

    axes_per_hash and probes follow from the rows of each length (``plan_probes``), unless
    they are given: with more axes there are more and smaller buckets, (2 d) to that power.

    Equal vectors are searched once: of each only the k + 1 rows of smallest id can be in a
    result, and those are found before the shuffle. Buckets are dealt over blocks of about
    ``block_rows`` rows by hash, and larger buckets are split. A query whose probes find fewer
    than it could have is ranked against all blocks.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    dtype, cast = ("float32", "array<float>") if kind == "float" else ("float64", "array<double>")
    v = F.col(embedding).cast(cast)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(sound).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    # row numbers are fixed by being written
    rows = shared_table(rows.withColumns({"h": F.xxhash64("v"), "uid": F.monotonically_increasing_id()}), "rows")
    # one row for each length of vectors
    lengths = {r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plans = {d: plan_probes(n, d, axes_per_hash, probes) for d, n in lengths.items()}
    blocks = -(-sum(lengths.values()) // block_rows)

    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id", "uid"))
    least = rows.withColumn("_n", nth).where(F.col("_n") <= k + 1)
    distinct = least.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("id", "uid"))).alias("ids")).withColumn("vid", F.col("ids")[0]["uid"])
    queries = rows.where(F.col("id") % every == 0).join(distinct.select("h", "v", "vid"), ["h", "v"])
    queries = shared_table(queries.select(F.col("vid").alias("query"), F.col("id").alias("query_id"), F.col("uid").alias("query_uid"), F.size("v").alias("d")), "queries")
    packed = distinct.select("vid", "ids", F.size("v").alias("d"), "v").mapInArrow(_packer(dtype), f"vid long, ids {_IDS}, d int, raw binary")
    hashed = shared_table(packed.mapInArrow(_hasher(dtype, tables, plans, seed, False), f"vid long, ids {_IDS}, d int, raw binary, buckets array<bigint>"), "hashed")

    spread = hashed.select("vid", "ids", "d", "raw", F.posexplode("buckets").alias("t", "b"))
    # buckets that are too large for a block; as many as blocks and tables at most
    heavy = shared_table(spread.groupBy("d", "t", "b").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).where("parts > 1"), "heavy")
    block = lambda part: F.pmod(F.xxhash64("b", part), F.lit(blocks)).cast("int")
    parts = F.coalesce("parts", F.lit(1))
    index = spread.join(heavy, ["d", "t", "b"], "left").withColumn("block", block(F.pmod(F.xxhash64("vid"), parts).cast("int")))
    asked = hashed.join(queries.select(F.col("query").alias("vid")).distinct(), "vid", "left_semi").select("vid", "d", "raw")
    probe = asked.mapInArrow(_hasher(dtype, tables, plans, seed, True), "vid long, d int, raw binary, buckets array<bigint>")
    probe = probe.select("vid", "d", F.posexplode("buckets").alias("_i", "b")).withColumn("t", _table_of(plans))
    probe = probe.join(heavy, ["d", "t", "b"], "left").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), block)))
    # vectors are joined to what a query probes in a block, not to each probe
    probe = probe.groupBy("vid", "d", "t", "block").agg(F.collect_list("b").alias("probed")).join(asked.select("vid", "raw"), "vid")
    pairs = f"query long, vid long, score double, ids {_IDS}"
    key = ["d", "t", "block"]
    found = index.select(*key, "b", "vid", "ids", "raw").groupBy(*key).cogroup(probe.select(*key, "vid", "raw", "probed").groupBy(*key)).applyInPandas(_ranker(dtype, k + 1), pairs)
    result = shared_table(_ranked(found, queries, k), "found")
    columns = ["query_id", "rank", "vec_id", "score"]

    could = F.create_map(*[F.lit(x) for d, n in lengths.items() for x in (d, min(k, n - 1))])
    counts = result.groupBy("query_uid").agg(F.count("*").alias("_n"))
    short = queries.join(counts, "query_uid", "left").where(F.coalesce("_n", F.lit(0)) < could[F.col("d")]).select(*queries.columns)
    short = shared_table(short, "short")
    if short.isEmpty():
        return result.select(*columns)
    everything = hashed.select("vid", "ids", "d", "raw", F.lit(0).cast("long").alias("b"), F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block"))
    again = hashed.join(short.select(F.col("query").alias("vid")).distinct(), "vid", "left_semi").select("vid", "d", "raw", F.lit(None).cast("array<long>").alias("probed"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    again = again.toDF(*again.columns)  # both sides come from one table
    whole = everything.groupBy("d", "block").cogroup(again.groupBy("d", "block")).applyInPandas(_ranker(dtype, k + 1), pairs)
    return result.join(short, "query_uid", "left_anti").select(*columns).unionByName(_ranked(whole, short, k).select(*columns))


def _table_of(plans: dict[int, tuple[int, int]]) -> Column:
    """The table of the ``_i``-th bucket that a query of length ``d`` probes."""
    probes = F.create_map(*[F.lit(x) for d, (_, n) in plans.items() for x in (d, n)])
    return F.floor(F.col("_i") / probes[F.col("d")]).cast("int")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_cross_polytope": op3_cross_polytope}
ORACLES: dict[str, str] = {}
