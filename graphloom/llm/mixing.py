"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source wants ``p = target / source size`` copies. The whole part is
certain; the fractional parts are rounded together: two rows exchange mass, so that
their expected sizes add up to the same, until one of them has a whole number. What
is left of a chunk of rows is one row with a fraction; these meet in the next level
of a reduction tree, until one row per source is rounded by a coin. So a source's
taken size differs from its target by less than one row's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, numbered, shared_table, shield, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Rows that one task rounds in sequence; a level of the tree shrinks the rows by about this factor.
CHUNK = 4096


def words_in(text: Column) -> Column:
    """The number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_place(totals: DataFrame) -> DataFrame:
    """``totals`` with ``_place``: the rank of ``source`` by code points from 0, null last. Sorted in parts; each part's size tells where the next begins."""
    by = F.col("source").asc_nulls_last()
    at = shared_table(totals.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # a row per partition
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    starts = totals.sparkSession.createDataFrame(starts, "_part long, _before long")
    return at.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", index + F.col("_before")).drop("_at", "_part", "_before")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in the order of their code points, null last, take the weights in turn and
    share ``share`` times all sizes; a target stops at ``most`` times its source's size
    and the excess is shared anew by weight, in rounds, until none is above. A round is one
    aggregate over a row per source; sources may be any number.
    """
    totals = _with_place(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights)).cast("int"))
    out = shared_table(totals.select("source", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")), "targets")
    whole, level, full_before = share * (out.agg(F.sum("source_size")).head()[0] or 0), 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_w") * level
        capped, weighed, n = out.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).head()
        if not weighed or n == full_before:
            break
        level, full_before = max(level, (whole - (capped or 0.0)) / weighed), n
    return out.select("source", "source_size", F.least("_cap", F.col("_w") * level).alias("target"))


def _coin(seed: int, level: int, key: object) -> float:
    got = hashlib.blake2b(f"{seed}:{level}:{key}".encode(), digest_size=8).digest()
    return int.from_bytes(got, "big") / 2**64


def _rounder(seed: int, last: bool, names: list[str]):
    return lambda pdf: _round_chunk(pdf, seed, last)[names]


def _round_chunk(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Sequential pivotal rounding, large rows first; ``last``: a coin settles the row that is left."""
    pdf = pdf.sort_values(["size", "_key"], ascending=[False, True], kind="stable")
    p, size, key, level = pdf["_p"].tolist(), pdf["size"].tolist(), pdf["_key"].tolist(), int(pdf["_level"].iloc[0])
    open_at, eps = -1, 1e-9
    for j in range(len(p)):
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = float(p[j] > 0.5)
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        a, b = size[i] * 1.0, size[j] * 1.0
        up = min((1 - p[i]) * a, p[j] * b)  # mass that j can give to i
        down = min(p[i] * a, (1 - p[j]) * b)  # mass that i can give to j
        gives = up if _coin(seed, level, f"{key[i]}:{key[j]}") * (up + down) < down else -down
        p[i], p[j] = p[i] + gives / a, p[j] - gives / b
        for x in (i, j):
            if p[x] <= eps or p[x] >= 1 - eps:
                p[x] = float(p[x] > 0.5)
        open_at = next((x for x in (j, i) if 0 < p[x] < 1), -1)
    if last and open_at >= 0:
        p[open_at] = float(_coin(seed, level, key[open_at]) < p[open_at])
    return pdf.assign(_p=p)


def pivotal_copies(rows: DataFrame, group: str, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``copies`` (long), a dependent rounding of the column ``want`` within each ``group``.

    rows has ``_key`` (any string; distinct keys get distinct coins), ``size`` (long) and
    ``want`` (double, not negative). Rows of size 0 take their whole part only. A group of
    any size is dealt over chunks of about ``chunk`` rows by a hash of the key, so no task
    holds more, whatever share of the rows a group has.
    """
    whole = F.floor("want")
    rows = shared_table(rows.withColumns({"_p": F.col("want") - whole, "_whole": whole}), "wanted")
    schema = rows.select(*rows.columns, F.lit(0).alias("_level")).schema
    todo, done, level = rows.where("_p > 0 and size > 0").withColumn("_level", F.lit(0)), [rows.where("not (_p > 0 and size > 0)").withColumn("_level", F.lit(0))], 0
    while True:
        counts = todo.groupBy(group).agg(F.ceil(F.count("*") / chunk).alias("_chunks"))
        most = counts.agg(F.max("_chunks")).head()[0]
        if most is None:
            break
        dealt = todo.join(counts.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
        dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_key", F.lit(level)), F.col("_chunks"))).withColumn("_level", F.lit(level))
        last = most == 1
        rounded = dealt.drop("_chunks").groupBy(group, "_chunk").applyInPandas(_rounder(seed, last, schema.names), schema)
        rounded = shared_table(rounded, f"level{level}")
        done.append(rounded.where("_p in (0, 1)") if not last else rounded)
        if last:
            break
        todo, level = rounded.where("_p not in (0, 1)"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    kept = [c for c in rows.columns if c not in ("_p", "_whole")]
    return out.select(*kept, (F.col("_whole") + F.when(F.col("size") > 0, F.col("_p")).otherwise(0)).cast("long").alias("copies"))


def _wanted(groups: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(group columns, source_size, target, want, _key) for each row that the groups of equal rows (doc_id, source, size, ..., n) stand for."""
    targets = source_targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most).withColumnRenamed("source", "_s")
    # the sources are sized at run time before they are broadcast; a large list of them is a skew-handled join
    wanted = groups.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    # equal rows are numbered by counting, in two steps, so that no array has a number for each of very many
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    wanted = wanted.withColumn("_first", first).withColumn("_nth", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + CHUNK, F.col("n")) - 1)))
    own = [c for c in groups.columns if c != "n"]
    # nulls are told from any text by the length before it
    said = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in own]
    return wanted.select(*own, "source_size", "target", ratio.alias("want"), F.concat_ws(":", *said, F.col("_nth").cast("string")).alias("_key"), "_nth")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row of ``docs``.

    Null text has size 0; a null source is a source of its own, last in order. Rows of
    size 0 are taken 0 words. Rows equal in doc_id, source and size are rounded one by one,
    each with a coin of its own, whatever their number; null ids are equal to each other.
    Other columns of ``docs`` are ignored, so clashing names do no harm. Equal input gives
    equal output, whatever the partitions. An empty table gives no rows.
    """
    groups = docs.select("doc_id", "source", words_in(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    copies = pivotal_copies(_wanted(shared_table(groups, "sizes"), weights, share, most), "source", seed)
    return copies.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 0) -> DataFrame:
    """Whole rows of ``docs``, each as often as the mix takes it; columns stay.

    Rows of size 0 stay once, since they weigh nothing. Rows equal in doc_id, source, size
    and text's hash share what the mix takes of them in any order. Rows are numbered and
    written once; their texts are shuffled once, to their number of copies.
    """
    docs, restored = shield(docs, "doc_id", "source", "text")
    rows = shared_table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    light = shared_table(rows.select("_row", "doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tag")), "sizes")
    own = ["doc_id", "source", "size", "tag"]
    groups = shared_table(light.groupBy(*own).agg(F.count("*").alias("n")), "groups")
    copies = pivotal_copies(_wanted(groups, weights, share, most), "source", seed)
    copies = copies.select(F.struct(*own, F.col("_nth").alias("nth")).alias("_of"), F.greatest("copies", (F.col("size") == 0).cast("long")).alias("_copies")).where("_copies > 0")
    nth = numbered(light, own, "_row", "_nth").select("_row", F.struct(*own, (F.col("_nth") - 1).alias("nth")).alias("_of"))
    # a struct of nulls equals another one, so null ids and sources find their rows
    taken = nth.join(copies, "_of").select(F.col("_row").alias("_taken"), "_copies")
    out = rows.join(taken.hint("merge"), F.col("_row") == F.col("_taken"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*restored)


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_pivotal_mixing": op7_pivotal_mixing}
ORACLES: dict[str, str] = {}
