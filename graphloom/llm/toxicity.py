"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its words, and
the document's score is their noisy-or: one minus the chance that no sentence offends.
Only documents are labelled; the gradient of the noisy-or hands the blame to the
sentences, so that afterwards offending sentences can be located.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Labelled documents that the model is fitted on, at most; those with the smallest hashes of doc_id.
FIT_ROWS = 3000
#: Word buckets.
BUCKETS = 1 << 20
#: Documents of the sample that a word must be in.
LEAST_DOCS = 4
#: Lengths of a word's beginnings that are features too.
PREFIXES = (3, 4, 5)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings, which inflected and compound forms share."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n))]


def sentence_features(sentence: str) -> list[int]:
    return [i for w in _WORD.findall(sentence.lower()) for i in word_features(w)]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are for evaluation only; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """Word weights, a bias and the scores they give."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._of_word: dict[str, float] = {}

    def word(self, word: str) -> float:
        """A lower-case word's weight; common words are looked up once per task."""
        found = self._of_word.get(word)
        if found is None:
            if len(self._of_word) >= 200_000:
                self._of_word.clear()
            found = self._of_word[word] = sum(self.weights.get(i, 0.0) for i in word_features(word))
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with a word; a text without any is one empty sentence."""
        out = []
        for m in _SENTENCE.finditer(text):
            if words := _WORD.findall(m[0].lower()):
                out.append((m.start(), m.end(), self.bias + sum(map(self.word, words))))
        return out or [(0, len(text), self.bias)]

    def score(self, logits: list[float]) -> float:
        """The noisy-or."""
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's features and the end of each sentence among them, as 32-bit numbers."""
    for batch in batches:
        ids, ends = [], []
        for cell in batch.column(1):
            flat, at = [], []
            for m in _SENTENCE.finditer(cell.as_py()):
                if got := sentence_features(m[0]):
                    flat += got
                    at.append(len(flat))
            ids.append(np.array(flat, dtype="<i4").tobytes())
            ends.append(np.array(at, dtype="<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names=["toxic", "ids", "ends"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, text) of labelled documents that aren't held out: at most ``rows`` ids, by their hash.

    Only labels 0 and 1 count; a document labelled twice is toxic if either says so. The
    bounded list of ids is broadcast, so the texts are scanned and not shuffled.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("_toxic").alias("toxic"), "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, steps: int = 120, l1: float = 1e-4) -> Model:
    """Adam on the whole sample at once; without two classes the model is a constant.

    The sample meets in one task of an executor, and only the weights come to the driver.
    """
    bags = labelled_sample(docs, labels, rows).mapInArrow(_bags, "toxic int, ids binary, ends binary")
    found = bags.repartition(1).mapInArrow(_fitter(steps, l1), "bias double, features binary, weights binary").collect()
    if not found:
        return Model({}, 0.0)
    features, weights = np.frombuffer(found[0]["features"], dtype="<i4"), np.frombuffer(found[0]["weights"], dtype="<f8")
    return Model(dict(zip(features.tolist(), weights.tolist())), found[0]["bias"])


def _fitter(steps: int, l1: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive in any order; the same order each time makes reruns agree
        bags = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda x: (zlib.crc32(x[1]), x[0]))
        y = np.array([x[0] for x in bags], dtype=np.float64)
        prior = (y.sum() + 1) / (len(y) + 2)
        if len(y) == 0 or y.min() == y.max():
            features, weights, bias = np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
        else:
            features, weights, bias = _train(bags, y, prior, steps, l1)
        columns = [pa.array([bias], pa.float64()), pa.array([features.astype("<i4").tobytes()], pa.binary()), pa.array([weights.astype("<f8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bias", "features", "weights"])

    return run


def _train(bags: list[tuple[int, bytes, bytes]], y: np.ndarray, prior: float, steps: int, l1: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The features with a weight, their weights, and the bias; ``bags`` is emptied."""
    # one document at a time, so that no array is much larger than the features that are kept
    counts = np.array([max(1, len(e) // 4) for _, _, e in bags])
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), counts)
    docs_with = np.zeros(BUCKETS, dtype=np.int32)
    for _, x, _ in bags:
        docs_with[np.unique(np.frombuffer(x, dtype="<i4"))] += 1
    words = np.flatnonzero(docs_with >= LEAST_DOCS)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[words] = np.arange(len(words))
    cols, sentences = [], []
    for d, (_, x, e) in enumerate(bags):
        x, e = np.frombuffer(x, dtype="<i4"), np.frombuffer(e, dtype="<i4")
        at = np.repeat(np.arange(first[d], first[d] + len(e), dtype=np.int32), np.diff(e, prepend=0))
        col = place[x]
        cols.append(col[col >= 0])
        sentences.append(at[col >= 0])
    col, sentence = np.concatenate(cols), np.concatenate(sentences)
    del cols, sentences
    bags.clear()
    n_sentences, n_docs = len(doc), len(y)
    w, b = np.zeros(len(words)), float(np.log(prior / max(1.0, n_sentences / n_docs)))
    m1, m2, rate = np.zeros(len(words) + 1), np.zeros(len(words) + 1), 0.1
    for t in range(1, steps + 1):
        z = b + np.bincount(sentence, weights=w[col], minlength=n_sentences)
        p = np.exp(-np.logaddexp(0, -z))
        none = -np.bincount(doc, weights=np.logaddexp(0, z), minlength=n_docs)
        blame = np.where(y > 0, -np.exp(none) / np.maximum(-np.expm1(none), 1e-12), 1.0)
        g = p * blame[doc] / n_docs
        grad = np.append(np.bincount(col, weights=g[sentence], minlength=len(words)), g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        pace = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        step = pace * m1 / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * l1, 0)
    some = np.abs(w) > 1e-3
    return words[some], w[some], float(b)


def _scorer(model: Model, least: float, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.log(least / (1 - least))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for cell in batch.column(batch.num_columns - 1):
                got = model.sentences(cell.as_py() or "")
                scores.append(model.score([z for _, _, z in got]))
                spans.append([{"start": a, "end": b, "score": float(1 / (1 + np.exp(-z)))} for a, b, z in got if z >= cut])
            n = batch.num_columns - (not with_text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*batch.schema.names[:n], "score", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], sentence_threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``offending``: (start, end, score) of sentences at or over the threshold.

    Whole texts are scored; null counts as empty, and a text without words gets the score
    of one empty sentence. Offsets are code points. Equal texts have equal scores. Columns
    of ``keep`` must not be named score or offending.
    """
    rest = [c for c in keep if c != "text"]
    given = [*rest, "text"] if "text" in keep else rest
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in given)
    scored = docs.select(*rest, "text").mapInArrow(_scorer(model, sentence_threshold, "text" in keep), f"{schema}score double, offending array<struct<start:bigint,end:bigint,score:double>>")
    return scored.select(*keep, "score", "offending")


def op5_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


QUERIES = {"op5_noisy_or": op5_noisy_or}
ORACLES: dict[str, str] = {}
