"""Related-document packing.

Documents are tokenised and given a small content vector: tokens weighed by their rarity
in the corpus, without the few directions that all documents share. Of documents with equal
tokens one stands for all, and the others are laid beside it, so that links always lead to
different texts. The nearest-neighbour graph is built over all of these: in each of several layouts, sorted by the keys of
independent rotations, every stretch is compared exactly, and a document's nearest over
all layouts are its links. Linked documents are then laid side by side and cut into
regions, in which the graph is walked: each path starts at the unvisited document of
lowest degree and goes on to the most similar unvisited neighbour. Windows are filled
along the paths; a document runs over into the next window, and the rest of a region is
laid in windows of powers of two, so that no window is padded.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, shared_table, table, text_or_empty
from .components import connected_components

WINDOW = 1024
#: The special tokens of the 50k vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
#: Documents in a region or a stretch of a layout, and in a partition of them, about.
REGION_ROWS, PARTITION_ROWS = 2048, 16384
#: Links of a document; documents less alike than this aren't linked. Unlike documents reach 0.5.
NEIGHBOURS, LEAST_LIKENESS = 8, 0.6
#: Layouts in which neighbours are sought, and axes in a layout's key.
LAYOUTS, KEY_AXES = 6, 4
#: Features that tokens are dealt over, and components of a vector.
FEATURES, DIMS = 1 << 16, 64
#: Vectors that the shared directions are found from, at most (those with the smallest hashes), and how many are left out.
FIT_ROWS, SHARED = 4096, 8
#: Vectors are held as signed bytes of so much.
_STEP = 1 / 254
#: Pairs a row that are sorted without looking for each row's nearest first.
_PAIRS_A_ROW = 64
#: A vocabulary's pattern, and one that cuts every text into the same pieces in less time: all that needs no look ahead is one group.
FASTER = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"(?:'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+$)|\s+(?!\S)|\s",
}


def load_encoder(ranks: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, arrays: bool = False):
    """Text to ids of the byte-level BPE whose ranks lie in the file ``ranks``; strings of ``special`` tokens are those tokens.

    The default is the 50k vocabulary with its one special token. Ids are those that
    ``tokenizers`` gives for the same vocabulary without adding any; the ranks file is read
    by a library several times as fast. Ids are a list, or an unsigned 32-bit array (``arrays``).
    """
    import public_tokenizers
    import tiktoken

    special = SPECIAL if special is None else special
    lines = open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    table = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines if line)}
    pattern = pattern or public_tokenizers.PATTERN
    made = tiktoken.Encoding("ranks", pat_str=FASTER.get(pattern, pattern), mergeable_ranks=table, special_tokens=special)
    if arrays:
        return lambda text: made.encode_to_numpy(text, allowed_special="all" if any(t in text for t in special) else set(), disallowed_special=())
    if not special:
        return made.encode_ordinary
    return lambda text: made.encode(text, allowed_special="all") if any(t in text for t in special) else made.encode_ordinary(text)


def _tokeniser(ranks: str | None, pattern: str | None, special: dict[str, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, n, made = None, None, 0, b""
        for batch in batches:
            encode = encode or load_encoder(ranks, pattern, special, arrays=True)
            size, raw = [], []
            for cell in batch.column(1):
                # a mix lays copies side by side
                if (text := cell.as_py()) != last:
                    ids, last = encode(text), text
                    wide = ids.max(initial=0) >= 65536
                    n, made = len(ids) + 1, ids.astype("<u4" if wide else "<u2").tobytes() + bytes(4 if wide else 2)
                size.append(n)
                raw.append(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "doc_tokens", "raw"])

    return run


def _features(n: int, raw: bytes) -> np.ndarray:
    """The features of a document's ids, but for its last id."""
    ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")[:-1]
    return ids if ids.dtype == np.uint16 else ids % FEATURES


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, docs) of a task's documents."""
    docs, place = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=np.int64)
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            features = _features(n, raw)
            # of a feature's places one is left, and counts
            features, nth = features.astype(np.int64), np.arange(len(features))
            place[features] = nth
            docs[features[place[features] == nth]] += 1
    some = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(docs[some], pa.int64())], names=["feature", "docs"])


def _vectors(rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = np.random.default_rng(7).standard_normal((FEATURES, DIMS), dtype=np.float32)
        last, made = None, b""
        for batch in batches:
            out = []
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (n, raw) != last:
                    feature, count = np.unique(_features(n, raw), return_counts=True)
                    v = (np.sqrt(count) * rarity[feature]).astype(np.float32) @ axes[feature]
                    last, made = (n, raw), (v / max(float(np.linalg.norm(v)), 1e-9)).astype("<f2").tobytes()
                out.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["uid", "doc_tokens", "vec"])

    return run


def _floats(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype="<f2").reshape(len(vecs), DIMS).astype(np.float32)


def shared_directions(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the rows and the SHARED directions in which they differ most; fewer rows have no more directions than half of them."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(DIMS, dtype=np.float32)
    most = min(SHARED, len(sample) // 2)
    found = np.linalg.svd(sample - mean, full_matrices=False)[2][:most] if most else np.zeros((0, DIMS), dtype=np.float32)
    return mean.astype(np.float32), found.astype(np.float32)


def own_part(x: np.ndarray, mean: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Unit vectors of what is left of x; rows that are all shared become zero."""
    x = x - mean
    x = x - (x @ shared.T) @ shared
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-3, x / np.maximum(size, 1e-9), 0).astype(np.float32)


def layout_keys(x: np.ndarray, layout: int) -> np.ndarray:
    """A key for each row: the signed axes nearest to it in KEY_AXES random frames of the layout."""
    key = np.zeros(len(x), dtype=np.int64)
    frames = np.random.default_rng([3, layout]).standard_normal((KEY_AXES, DIMS, DIMS), dtype=np.float32)
    for frame in frames:
        turned = x @ frame
        axis = np.argmax(np.abs(turned), axis=1)
        key = key * (2 * DIMS) + 2 * axis + (np.take_along_axis(turned, axis[:, None], axis=1)[:, 0] < 0)
    return key


def _layouts(mean: np.ndarray, shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = own_part(_floats(batch.column(2).to_pylist()), mean, shared)
            small = pa.array([r.tobytes() for r in np.clip(np.round(x / _STEP), -127, 127).astype(np.int8)], pa.binary())
            for layout in range(LAYOUTS):
                columns = [pa.array([layout] * len(batch), pa.int32()), pa.array(layout_keys(x, layout)), *batch.columns[:2], small]
                yield pa.RecordBatch.from_arrays(columns, names=["layout", "key", "uid", "doc_tokens", "vec"])

    return run


def near_rows(x: np.ndarray, neighbours: int = NEIGHBOURS, least: float = LEAST_LIKENESS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, likeness) of the ``neighbours`` nearest other rows of each, as far as they are ``least`` alike; x: unit or zero vectors."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(neighbours, len(x) - 1)
    at = np.flatnonzero(sims >= least)
    if len(at) > _PAIRS_A_ROW * len(x):
        many = np.flatnonzero(np.bincount(at // len(x), minlength=len(x)) > k)
        cut = -np.partition(-sims[many], k - 1, axis=1)[:, k - 1 : k]
        sims[many] = np.where(sims[many] >= cut, sims[many], -2)
        at = np.flatnonzero(sims >= least)
    a, b = at // max(1, len(x)), at % max(1, len(x))
    # of equals at the cut the first ones count
    nth = np.arange(len(a)) - np.searchsorted(a, a, "left")
    order = np.lexsort((b, -sims[a, b], a))
    a, b = a[order][nth < k], b[order][nth < k]
    return a, b, sims[a, b]


def _linker(region_rows: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        a, b, s = near_rows(x)
        uid = pdf["uid"].to_numpy()
        return pd.DataFrame({"uid": uid[a], "other": uid[b], "likeness": s})

    return _stretches(region_rows, links, "layout")


def _stretches(region_rows: int, made, group: str, spare: int = 1):
    """Applies ``made`` to stretches of sorted rows: of region_rows, or as far beyond as a group goes, up to (1 + spare) times that; ``layout`` never mixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in _with_end(batches):
            held = pdf if held is None else held if pdf is None else pd.concat([held, pdf], ignore_index=True)
            while held is not None and len(held) and (pdf is None or len(held) > (1 + spare) * region_rows):
                changes = np.flatnonzero(held[group].to_numpy()[1:] != held[group].to_numpy()[:-1]) + 1
                if group == "layout":
                    end = min(region_rows, int(changes[0]) if len(changes) else len(held))
                else:
                    after = changes[changes >= region_rows]
                    end = min((1 + spare) * region_rows, int(after[0]) if len(after) else len(held))
                yield made(held.iloc[:end].reset_index(drop=True))
                held = held.iloc[end:].reset_index(drop=True)

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def token_copies(made: DataFrame) -> DataFrame:
    """(uid, first, doc_tokens): each row of made's (uid, doc_tokens, tag) whose tokens another one with a smaller uid has, and the smallest."""
    firsts = made.groupBy("tag", "doc_tokens").agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return shared_table(made.select("uid", "tag", "doc_tokens").join(firsts, ["tag", "doc_tokens"]).where("uid != first").select("uid", "first", "doc_tokens"), "copies")


def content_vectors(made: DataFrame, copies: DataFrame | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(uid, doc_tokens, vec) of made's (uid, doc_tokens, raw) but for ``copies``, and the mean and the directions that ``own_part`` takes away.

    Rarity is counted over all documents and every document but a copy has its vector; only the shared
    directions are fitted on a bounded sample, of different vectors, however often one of them occurs.
    """
    # a row per feature, FEATURES at most
    counts = made.select("doc_tokens", "raw").mapInArrow(_spread, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect()
    n = made.count()
    rarity = np.full(FEATURES, np.log(n + 1.0), dtype=np.float32)
    for r in counts:
        rarity[r["feature"]] = np.log((n + 1.0) / r["docs"])
    vectors = made.select("uid", "doc_tokens", "raw").mapInArrow(_vectors(rarity), "uid long, doc_tokens long, vec binary")
    if copies is not None:
        vectors = vectors.join(copies.select("uid"), "uid", "left_anti")
    vectors = shared_table(vectors, "vectors")
    # about eight times as many as are taken, so that few are sorted
    some = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, n // (8 * FIT_ROWS)))) == 0).select("vec").distinct()
    sample = some.orderBy(F.xxhash64(F.lit("fit"), "vec"), "vec").limit(FIT_ROWS).collect()
    return vectors, *shared_directions(_floats([bytes(r["vec"]) for r in sample]))


def neighbour_links(made: DataFrame, region_rows: int = REGION_ROWS, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_tokens, key): every document but ``copies`` and its key in the first layout; (uid, other, likeness): its links.

    made: (uid, doc_tokens, raw). A document has NEIGHBOURS links at most of its own, none
    of them to a copy, and every document is compared to a stretch of region_rows others
    in each layout.
    """
    vectors, mean, shared = content_vectors(made, copies)
    laid = shared_table(vectors.mapInArrow(_layouts(mean, shared), "layout int, key long, uid long, doc_tokens long, vec binary"), "layouts")
    parts = max(1, -(-laid.count() // PARTITION_ROWS))
    sorted_rows = laid.drop("doc_tokens").repartitionByRange(parts, "layout", "key", "uid").sortWithinPartitions("layout", "key", "uid")
    found = sorted_rows.mapInPandas(_linker(region_rows), "uid long, other long, likeness double")
    # a few a layout for each document
    best = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("likeness"), "other"))
    links = found.groupBy("uid", "other").agg(F.max("likeness").alias("likeness")).withColumn("_n", best).where(F.col("_n") <= NEIGHBOURS).drop("_n")
    return laid.where("layout = 0").select("uid", "doc_tokens", "key"), shared_table(links, "links")


def walk(links: list[dict[int, float]]) -> list[int]:
    """The order in which greedy low-degree-first paths visit the nodes of a graph; links: by node {neighbour: likeness}, both ways."""
    n = len(links)
    order, seen = [], [False] * n
    for start in sorted(range(n), key=lambda i: (len(links[i]), i)):
        at = start
        while at is not None and not seen[at]:
            seen[at] = True
            order.append(at)
            at = max((j for j in links[at] if not seen[j]), key=lambda j: (links[at][j], -j), default=None)
    return order


def _walker(region_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = itertools.count(TaskContext.get().partitionId() << 18)

        def region(pdf: pd.DataFrame) -> pd.DataFrame:
            place = {u: i for i, u in enumerate(pdf["uid"].tolist())}
            links: list[dict[int, float]] = [{} for _ in place]
            for i, near in enumerate(pdf["near"]):
                for x in [] if near is None else near:
                    if (j := place.get(x["other"])) is not None:
                        links[i][j] = links[j][i] = x["likeness"]
            pdf = pdf.iloc[walk(links)]
            # copies follow their document
            size = pdf["doc_tokens"] * (1 + pdf["copies"])
            ends = size.cumsum()
            return pd.DataFrame({"uid": pdf["uid"], "region": next(count), "place": ends - size, "total": int(ends.iloc[-1])})

        # documents without a group are told apart by their uids
        yield from _stretches(region_rows, region, "group")(pdf.assign(group=pdf["component"].fillna(-1 - pdf["uid"])) for pdf in batches)

    return run


def cuts(start: int, end: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the tokens from start to end of a region with ``total`` tokens.

    Whole windows come first; the rest of the region is laid in windows of falling powers of two.
    """
    whole = total // window
    out = []
    while start < end:
        if (nth := start // window) < whole:
            offset, room = start % window, window
        else:
            rest, offset = total % window, start - whole * window
            for power in range(rest.bit_length() - 1, -1, -1):
                if rest >> power & 1:
                    room = 1 << power
                    if offset < room:
                        break
                    offset, nth = offset - room, nth + 1
        length = min(end - start, room - offset)
        out.append((nth, offset, length))
        start += length
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(window: int, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], []
            for doc_id, n, raw, region, place, total in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                for nth, offset, length in cuts(place, place + n, total, window):
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, (region << 28) + nth, offset))
                    if tokens:
                        held.append(np.frombuffer(piece, dtype="<u4"))
                    start += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if tokens:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int64()))], [*names, "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokens: bool = False, ranks: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, region_rows: int = REGION_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and tokens, if asked for).

    A document is its ids followed by id 0; every id lies in exactly one piece. Sequences
    are gapless and ``window`` long, but for the last of a region, which are powers of two.
    ids_crc32 is that of the piece's ids as little-endian unsigned 32-bit numbers. Null text
    counts as empty and is the single id 0; repeated rows are packed each for itself; null
    ids stay null. Other columns are ignored. No rows give no rows. The window is a power
    of two. Sequence numbers differ between runs with other partitions; what is packed
    doesn't.

    Groups of linked documents lie together in a region; only those of more than two
    regions' size are cut. Rows of equal tokens lie beside each other, however many.
    """
    text = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    made = text.mapInArrow(_tokeniser(ranks, pattern, special), "doc_id long, doc_tokens long, raw binary")
    # the row number is fixed by being written
    made = shared_table(made.withColumns({"uid": F.monotonically_increasing_id(), "tag": F.xxhash64("raw")}), "tokens")
    copies = token_copies(made)
    keys, links = neighbour_links(made, region_rows, copies)
    # likeness goes both ways, so whoever is linked to has links of its own
    near = links.groupBy("uid").agg(F.collect_list(F.struct("other", "likeness")).alias("near"))
    groups = connected_components(links, "uid", "other").select(F.col("node").alias("uid"), "component")
    number = copies.groupBy(F.col("first").alias("uid")).agg(F.count("*").alias("copies"))
    laid = keys.join(near.join(groups, "uid"), "uid", "left").join(number, "uid", "left").fillna(0, ["copies"])
    laid = shared_table(laid, "laid")
    # documents without a link are groups of their own, laid out by their keys
    order = [F.col("component").isNotNull(), F.coalesce("component", F.lit(0)), F.col("key"), F.col("uid")]
    laid = laid.repartitionByRange(max(1, -(-laid.count() // PARTITION_ROWS)), *order).sortWithinPartitions(*order)
    plan = shared_table(laid.mapInPandas(_walker(region_rows), "uid long, region long, place long, total long"), "plan")
    nth = numbered(copies, ["first"], "uid", "nth").join(plan.withColumnRenamed("uid", "first"), "first")
    plan = plan.unionByName(nth.select("uid", "region", (F.col("place") + F.col("nth") * F.col("doc_tokens")).alias("place"), "total"))
    # the plan grows with the rows, and is small only where they are few
    placed = made.select("uid", "doc_id", "doc_tokens", "raw").hint("merge").join(plan, "uid").select("doc_id", "doc_tokens", "raw", "region", "place", "total")
    return placed.mapInArrow(_cutter(window, tokens), _PIECES + (", tokens array<long>" if tokens else ""))


def op2_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_related_packing": op2_related_packing}
ORACLES: dict[str, str] = {}
