"""Document fingerprints from closed syncmers over words, in DataFrame operations only.

A window of K words is an anchor if, of the hashes of its S-word pieces, the least
stands first or last. Whether a window is an anchor depends on its own words alone, so
an edit elsewhere never moves it. A document's fingerprint is all its anchors with their
positions, however long it is; whole anchor sets are compared, and the anchors' positions
align matching passages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import how_many, let, shared_table, table, text_or_empty

K, S = 3, 1
#: Different rows in a run of neighbours in doc_id order.
RUN_ROWS = 256
#: The first keys of so many runs at most, and those of as many parts of each of them, are known to every task (24 MB at most):
#: there are a million runs at most, which grow longer beyond RUN_ROWS times so many rows.
FAN = 1 << 10


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (hash, pos) of the closed syncmers, by position in words.

    Fewer words than k are one anchor, the whole sequence; no words have none, and so has
    null. The hash is that of the whole window.
    """
    pieces = k - s + 1

    def of_pieces(h: Column, m: Column) -> Column:
        """h: hashes of words; m: of s-word pieces."""
        edge = lambda i: F.least(*[F.get(m, i + j) for j in range(pieces)]).isin(F.get(m, i), F.get(m, i + (pieces - 1)))
        at = F.filter(F.sequence(F.lit(0), F.size(m) - pieces), edge)
        # pieces that cover the window: every s-th one, and the last
        cover = sorted({*range(0, pieces, s), pieces - 1})
        return F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(m, i + j) for j in cover]).alias("hash"), i.alias("pos")))

    def of_words(h: Column) -> Column:
        piece = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)])
        many = let(F.transform(F.sequence(F.lit(0), F.size(h) - s), piece), lambda m: of_pieces(h, m))
        one = F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("pos")))
        return F.when(F.size(h) >= k, many).when(F.size(h) > 0, one).otherwise(F.slice(one, 1, 0))

    return let(_word_hashes(F.coalesce(text, F.lit(""))), of_words)


def as_text(anchor: Column) -> Column:
    """Anchors as a string, in order of position: ``hash@pos``, 16 hex digits and a decimal number, parted by spaces."""
    return F.array_join(F.transform(anchor, lambda a: F.concat(F.lower(F.lpad(F.hex(a["hash"]), 16, "0")), F.lit("@"), a["pos"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of the sets of hashes of two arrays of anchors: 1 for two empty ones, 0 if just one is."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda y: y["hash"]))

    def of_sets(x: Column) -> Column:
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        every = F.size(x["a"]) + F.size(x["b"]) - shared
        return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)

    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), of_sets)


def best_shift(a: Column, b: Column) -> Column:
    """The most common difference of positions (b minus a) of anchors that both arrays hold, ties to the least; null without any.

    Meant for a pair of documents that is to be aligned: the work is the product of the
    arrays' lengths.
    """
    moves = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: y["pos"] - x["pos"])))
    return let(moves, lambda m: F.get(F.array_sort(F.transform(F.array_distinct(m), lambda v: F.struct((-F.size(F.filter(m, lambda w: w == v))).alias("n"), v.alias("by")))), F.lit(0))["by"])


def _how_many(starts: tuple[Column, ...], most: int, key: tuple[Column, ...]) -> Column:
    """How many of the ascending ``starts`` (an array for each part of a key, of ``most`` values at most) aren't greater than ``key``."""

    def at_most(i: Column) -> Column:
        out = F.get(starts[-1], i) <= key[-1]
        for array, part in zip(starts[-2::-1], key[-2::-1]):
            out = (F.get(array, i) < part) | ((F.get(array, i) == part) & out)
        return out

    return how_many(at_most, most)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with ``next_text``: the text of the next row by descending key; after the last, the first.

    key: an integer column, of any range; nulls come last. Ties are ordered by the texts'
    hashes. Texts aren't null. Keys and hashes alone are put in order first, by a range
    partitioning, and every run_rows-th of them starts a run: whatever the keys, a run has
    so many different rows at most, and a run's first row also goes to the run before it
    and closes that, so whole rows are shuffled once. Of rows that repeat more than
    run_rows times, equal in key and text, all but some are followed by their own text
    wherever they are; they are dealt out apart from their run.
    """
    # descending keys ascend when their bits are flipped, which can't overflow; nulls are told apart by a flag
    flipped = F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))
    placed = docs.withColumns({"_k": flipped, "_f": F.col(key).isNull().cast("int"), "_h": F.xxhash64(text)})
    order = ["_k", "_f", "_h"]
    counted = placed.groupBy(*order).agg(F.count("*").alias("_n"))
    index = F.col("_at").bitwiseAND((1 << 33) - 1)
    ordered = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = shared_table(ordered, "ordered")
    run_rows = max(run_rows, -(-ordered.count() // (FAN * FAN - FAN)))
    starts = sorted(tuple(r) for r in ordered.where(index % run_rows == 0).select(*order).collect())
    # rows that repeat so often are of as many kinds as there are runs at most
    hot = ordered.where(F.col("_n") > run_rows).select(*order, F.ceil(F.col("_n") / run_rows).alias("_parts"))
    fine = [(i // FAN, *(list(x) for x in zip(*starts[i : i + FAN]))) for i in range(0, len(starts), FAN)]
    fine = docs.sparkSession.createDataFrame(fine, "_coarse int, _ks array<long>, _fs array<int>, _hs array<long>")
    own_key = tuple(F.col(c) for c in order)
    coarse = tuple(F.lit(np.array([s[i] for s in starts[::FAN]], dtype=np.int64)) for i in range(3))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("_parts")))
    dealt = placed.withColumns({"_id": F.monotonically_increasing_id(), "_coarse": _how_many(coarse, FAN, own_key) - 1})
    dealt = dealt.join(F.broadcast(hot), order, "left").join(F.broadcast(fine), "_coarse")
    within = _how_many((F.col("_ks"), F.col("_fs"), F.col("_hs")), FAN, own_key) - 1
    dealt = dealt.withColumns({"_part": part, "_within": within})
    is_first = (F.col("_part") == 0) & (F.struct(*(F.get(c, F.col("_within")) for c in ("_ks", "_fs", "_hs"))) == F.struct(*order))
    dealt = dealt.withColumn("_run", F.col("_coarse") * FAN + F.col("_within"))
    to = lambda run, part, closes: F.struct(run.alias("run"), part.cast("long").alias("part"), F.lit(closes).alias("closes"))
    own, closing = to(F.col("_run"), F.col("_part"), False), to(F.pmod(F.col("_run") - 1, F.lit(max(1, len(starts)))), F.lit(0), True)
    both = dealt.withColumn("_to", F.explode(F.when(is_first, F.array(own, closing)).otherwise(F.array(own))))
    w = Window.partitionBy("_to.run", "_to.part").orderBy("_to.closes", *order)
    following = F.when(F.col("_to.part") > 0, F.col(text)).otherwise(F.lead(text).over(w))
    return both.withColumn("next_text", following).where("not _to.closes").select(*docs.columns, "next_text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last half (rounded down, in code points) replaced by as many
    first code points of the next document, by descending doc_id. Null text counts as
    empty; empty texts have an empty fingerprint. Equal texts have equal fingerprints.
    Repeated rows are documents of their own. Other columns are ignored; no rows give none.
    """
    # anchors of the next text are found anew after the shuffle; they would be as large as the text
    both = with_next(docs.select("doc_id", text_or_empty().alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), anchors(F.col("text")).alias("own"), anchors(F.col("next_text")).alias("next"), edited.alias("edited"))
    both = both.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_own": anchors(F.col("edited"))})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_closed_syncmers": op6_closed_syncmers}
ORACLES: dict[str, str] = {}
