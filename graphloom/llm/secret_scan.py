"""Secret scan by grammar inference.

Three base patterns find credentials by context or prefix. The values they find are the
labelled examples: for each kind a prefix tree of their character classes is reduced by
ALERGIA (states whose continuation and stopping frequencies agree within a Hoeffding
bound are merged) to a probabilistic automaton. Two more are inferred in the same way from
the ordinary tokens of all texts, one of those with a letter and one of the others, whose
prefix trees are counted where the texts lie. Every token of six characters or more, base values included, is then scored by
the likelihood of the best credential format over that of ordinary text, and a token that
a format explains far better is reported as ``format``.

Texts are read twice, once to count and once to score; nothing as large as they are is
written or shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table, shield, table, text_or_empty

KINDS = ("assign", "access", "hex", "format")
#: Kinds of ordinary tokens: with a letter, and without.
PLAIN = ("words", "numbers")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token is scored from this length on: that of the shortest value a base pattern takes.
SHORTEST = 6
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_LETTERS = re.compile(r"[fFzZ]")
_HINTS = ("passw", "secret", "token", "api")

#: Labelled values that a format is inferred from, at most; those with the smallest hashes.
FIT_ROWS = 1500
#: Depth of the prefix trees; longer values are scored whole, by the merged states.
DEPTH = 64
#: The ordinary tokens of a kind weigh as if there were so many at most, so that automata are alike at every size of the corpus.
PLAIN_WEIGHT = 20_000
#: States of ordinary text that fewer than one token in so many visits aren't told apart; at most so many a level reach the driver.
PLAIN_STATES = 4000
#: Nats by which a credential format must beat ordinary text: a fixed part and a part per character.
MARGIN, MARGIN_PER_CHAR = 6.0, 0.25
#: Tokens and shapes that a task remembers at once.
_REMEMBERED = 100_000

_CLASS = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "f" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "F" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}})
_SYMBOLS = 5 + len("+/_.=-")


def shape(value: str) -> str:
    """The value's character classes: digit, hex and other letters by case, signs as they are."""
    return value.translate(_CLASS)


class Automaton:
    """A deterministic probabilistic automaton: per state [visits, stops, {symbol: (next, count)}]."""

    def __init__(self, states: list):
        self.states = states

    def log_likelihood(self, value: str) -> float:
        """Of the value's class string, with add-one-half smoothing; classes never seen in a state are uniform from there on."""
        at, total = 0, 0.0
        for c in shape(value):
            if at is None:
                total -= math.log(_SYMBOLS + 1)
                continue
            visits, _, moves = self.states[at]
            to, n = moves.get(c, (None, 0))
            total += math.log((n + 0.5) / (visits + 0.5 * (_SYMBOLS + 1)))
            at = to
        visits, stops, _ = self.states[at] if at is not None else (0, 0, {})
        return total + math.log((stops + 0.5) / (visits + 0.5 * (_SYMBOLS + 1)))


def infer(values: Iterable[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA over the class strings of the values, to the depth DEPTH."""
    return infer_counted(prefix_counts(Counter(map(shape, values))), alpha)


def prefix_counts(shapes: dict[str, float]) -> dict[str, list[float]]:
    """{prefix: [visits, stops]} of counted class strings: the prefix tree, to the depth DEPTH."""
    out: dict[str, list[float]] = {"": [0, 0]}
    for said, n in shapes.items():
        for depth in range(min(len(said), DEPTH) + 1):
            at = out.setdefault(said[:depth], [0, 0])
            at[0] += n
        if len(said) <= DEPTH:
            at[1] += n
    return out


def infer_counted(tree: dict[str, list[float]], alpha: float = 0.05) -> Automaton:
    """ALERGIA over a counted prefix tree; a prefix whose parent is missing is left out."""
    prefixes = sorted(tree, key=lambda x: (len(x), x))
    at_of = {x: i for i, x in enumerate(prefixes)}
    visits, stops = [tree[x][0] for x in prefixes], [tree[x][1] for x in prefixes]
    moves: list[dict[str, int]] = [{} for _ in prefixes]
    for i, x in enumerate(prefixes[1:], 1):
        if (up := at_of.get(x[:-1])) is not None:
            moves[up][x[-1]] = i
    count: dict[tuple[int, str], float] = {(q, c): visits[t] for q, m in enumerate(moves) for c, t in m.items()}
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo, seen = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if (p, q) in seen or p == q:
                continue
            seen.add((p, q))
            if differ(stops[p], visits[p], stops[q], visits[q]):
                return False
            for c in moves[p].keys() | moves[q].keys():
                if differ(count.get((p, c), 0), visits[p], count.get((q, c), 0), visits[q]):
                    return False
                if c in moves[p] and c in moves[q]:
                    todo.append((moves[p][c], moves[q][c]))
        return True

    def fold(p: int, q: int) -> None:
        """Adds q, the root of a tree, to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            visits[p] += visits[q]
            stops[p] += stops[q]
            for c, t in moves[q].items():
                count[p, c] = count.get((p, c), 0) + count[q, c]
                if c in moves[p]:
                    todo.append((moves[p][c], t))
                else:
                    moves[p][c] = t

    red, order = [0], {0}
    blue = deque((0, c) for c in sorted(moves[0]))
    while blue:
        q, c = blue.popleft()
        t = moves[q][c]
        if t in order:
            continue
        into = next((r for r in red if compatible(r, t)), None)
        if into is None:
            red.append(t)
            order.add(t)
            blue.extend((t, d) for d in sorted(moves[t]))
        else:
            moves[q][c] = into
            fold(into, t)
            blue.extend((r, d) for r in red for d in sorted(moves[r]) if moves[r][d] not in order)
    number = {r: i for i, r in enumerate(red)}
    return Automaton([[visits[r], stops[r], {c: (number[t], count[r, c]) for c, t in moves[r].items()}] for r in red])


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of every base match, in order of start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text, *run.span())]
        found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text, *run.span())]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def base_and_tokens(text: str) -> tuple[list[tuple[int, int, str, str]], str, list[str]]:
    """Base spans, the text with them blanked out at the same length, and its remaining runs of token characters."""
    tokens, low = _TOKEN.findall(text), text.lower()
    # access and hex values are parts of tokens of 20 characters or more
    if not (any(h in low for h in _HINTS) or any(len(t) >= 20 for t in tokens)) or not (base := base_spans(text)):
        return [], text, tokens
    parts, at = [], 0
    for start, end, _, _ in base:
        if end > at:
            parts += (text[at:start], "\0" * (end - max(start, at)))
            at = end
    blank = "".join(parts) + text[at:]
    return base, blank, _TOKEN.findall(blank)


def core(token: str) -> str:
    """The token without marks of a sentence around it."""
    return token.lstrip("=.-").rstrip(".-")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, visits, stops): labelled values, and the prefix trees of the task's ordinary tokens by kind."""

    def counted() -> pa.RecordBatch:
        rows = [(kind, value, 1, 1) for kind, value in sorted(labelled)]
        for kind in PLAIN:
            rows += [(kind, x, *n) for x, n in prefix_counts({x: n for x, n in shapes.items() if plain_kind(x) == kind}).items()]
        labelled.clear()
        shapes.clear()
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "value", "visits", "stops"])

    labelled: set[tuple[str, str]] = set()
    shapes: Counter = Counter()
    for batch in batches:
        said: Counter = Counter()
        for cell in batch.column(0):
            base, _, tokens = base_and_tokens(cell.as_py())
            labelled.update((kind, value[: DEPTH + 1]) for _, _, kind, value in base)
            said.update(tokens)
        for token, n in said.items():
            if len(token := core(token)) >= SHORTEST:
                shapes[shape(token[: DEPTH + 1])] += n
        if len(shapes) + len(labelled) > _REMEMBERED:
            yield counted()
    if shapes or labelled:
        yield counted()


def plain_kind(shaped: str) -> str:
    return "words" if _LETTERS.search(shaped) else "numbers"


def infer_formats(docs: DataFrame) -> dict[str, Automaton]:
    """Automata of the base kinds that occur, and of the kinds of ordinary tokens.

    Formats are inferred from a bounded sample of the labelled values; ordinary text from
    the prefix trees of all tokens outside base spans, whose rare states are taken for
    never seen.
    """
    made = docs.select(text_or_empty().alias("_text")).where("_text != ''").mapInArrow(_counter, "kind string, value string, visits long, stops long")
    counted = shared_table(made.groupBy("kind", "value").agg(F.sum("visits").alias("visits"), F.sum("stops").alias("stops")), "counted")
    out = {}
    for kind in KINDS[:3]:
        chosen = counted.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(FIT_ROWS)
        if values := [r["value"] for r in chosen.select("value").collect()]:
            out[kind] = infer(values)
    for kind in PLAIN:
        plain = counted.where(F.col("kind") == kind)
        root = plain.where("value = ''").head()
        n = root["visits"] if root else 0
        weight = min(1.0, PLAIN_WEIGHT / max(n, 1))
        rows = plain.where(F.col("visits") * PLAIN_STATES >= n).collect() if n else []
        out[kind] = infer_counted({"": [0, 0]} | {r["value"]: [r["visits"] * weight, r["stops"] * weight] for r in rows})
    return out


class Judge:
    """Scores of tokens; what was judged before in the task is remembered, up to a bound."""

    def __init__(self, formats: dict[str, Automaton]):
        self.plain = [a for k, a in formats.items() if k in PLAIN]
        self.formats = [a for k, a in formats.items() if k not in PLAIN]
        self._of_shape: dict[str, float] = {}
        self._of_token: dict[str, bool] = {}

    def score(self, value: str) -> float:
        """Nats by which the best format explains the value better than ordinary text does; without formats minus infinity."""
        said = shape(value)
        found = self._of_shape.get(said)
        if found is None:
            if len(self._of_shape) >= _REMEMBERED:
                self._of_shape.clear()
            best = lambda automata: max((a.log_likelihood(value) for a in automata), default=-math.inf)
            found = self._of_shape[said] = best(self.formats) - best(self.plain) if self.formats else -math.inf
        return found

    def is_credential(self, token: str) -> bool:
        found = self._of_token.get(token)
        if found is None:
            if len(self._of_token) >= _REMEMBERED:
                self._of_token.clear()
            value = core(token)
            found = self._of_token[token] = len(value) >= SHORTEST and self.score(value) > MARGIN + MARGIN_PER_CHAR * len(value)
        return found

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, value) of all secrets of the text, by start, then kind."""
        base, blank, tokens = base_and_tokens(text)
        if any(map(self.is_credential, set(tokens))):
            for m in _TOKEN.finditer(blank):
                if self.is_credential(m[0]):
                    start = m.end() - len(m[0].lstrip("=.-"))
                    base.append((start, start + len(core(m[0])), "format", core(m[0])))
            base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        return base


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("score", pa.float64())]))
_FOUND_SQL = "array<struct<start:bigint,end:bigint,kind:string,value:string,score:double>>"


def _finder(formats: dict[str, Automaton]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(formats)
        names = [f.name for f in _FOUND.value_type]
        for batch in batches:
            out = [[dict(zip(names, (*s, judge.score(s[3])))) for s in judge.spans(cell.as_py())] for cell in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _FOUND)], names=[*batch.schema.names[:-1], "secrets"])

    return run


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (not named secrets) and ``secrets``: array of (start, end, kind, value, score) by start, then kind.

    Offsets are code points, end exclusive; value is what the format is judged by, and
    score is the logarithm of its best format's likelihood over that of ordinary text.
    Null and empty texts have an empty array; whole texts are scanned. Where no base
    pattern occurs anywhere there is nothing to learn from and nothing is added. Repeated
    rows each get their own result; equal texts have equal results.
    """
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    texts = docs.select(*keep, text_or_empty().alias("_text"))
    return texts.mapInArrow(_finder(infer_formats(docs)), f"{schema}secrets {_FOUND_SQL}")


def mask(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with spans, in order of start, replaced; overlapping ones are one."""
    parts, at = [], 0
    for start, end in spans:
        if end > at:
            if start >= at:
                parts += (text[at:start], mark)
            at = end
    return "".join(parts) + text[at:]


def _masker(formats: dict[str, Automaton], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(formats)
        for batch in batches:
            out = []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                out.append(mask(text, [x[:2] for x in judge.spans(text)], mark) if text else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=batch.schema.names)

    return run


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars``, if there, counted anew; all rows and columns stay.

    Texts are scanned once to infer the formats and again to mask, and are never written.
    """
    docs, restored = shield(docs, "text", "n_chars")
    formats = infer_formats(docs)
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    out = docs.select(*rest, "text").mapInArrow(_masker(formats, mark), f"{schema + ', ' if rest else ''}text string")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*restored)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sha, spans, scores = {k: [] for k in KINDS}, [], [], []
        for cell in batch.column(1):
            got = cell.as_py()
            for k, n in counts.items():
                n.append(sum(s["kind"] == k for s in got))
            said = lambda xs: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in xs)
            sha.append(hashlib.sha256(said([s for s in got if s["kind"] != "format"]).encode()).hexdigest())
            spans.append(said(got))
            scores.append(",".join(f"{s['score']:.2f}" for s in got))
        columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), *(pa.array(x, pa.string()) for x in (sha, spans, scores)), pa.array(counts["format"], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_format"])


def op8_grammar_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract's columns: each span's score (nats, in the order of spans) and the number of added spans."""
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string, n_format long")


QUERIES = {"op8_grammar_inference": op8_grammar_inference}
ORACLES: dict[str, str] = {}
