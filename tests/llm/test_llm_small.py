"""Pure-Python parts of the operators."""

import math
import random
import time
from collections import Counter
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import ann, chat_format, packing, secret_scan, sharding, simhash, toxicity

PIECES = st.lists(st.sampled_from(["### ", "###", "</turn>", "\\", ":", "\n", "Assistant", "assistant", "=", " ", "é", "x"]), max_size=8).map("".join)


@settings(max_examples=300)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), st.one_of(PIECES, st.text())), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.format_turns(turns)
    assert chat_format.read_turns(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_rejects_other_text():
    with pytest.raises(ValueError):
        chat_format.read_turns("### User: x")


@given(st.integers(0, 5000), st.integers(1, 3000), st.integers(0, 3000))
def test_cuts_fill_windows(start, length, after):
    total = start + length + after
    pieces = packing.cuts(start, start + length, total, 1024)
    assert sum(n for _, _, n in pieces) == length
    whole = packing.cuts(0, total, total, 1024)
    sizes = {s: n for s, o, n in whole}
    assert all(o == 0 for _, o, _ in whole) and sum(sizes.values()) == total
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes.values())
    at = start
    for s, o, n in pieces:
        assert at == sum(m for t, m in sizes.items() if t < s) + o and o + n <= sizes[s]
        at += n


def test_walk_visits_all_once_and_follows_likeness():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 32))
    x = np.repeat(centres, 20, axis=0) + 0.1 * rng.standard_normal((120, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    links = [{} for _ in x]
    for a, b, s in zip(*packing.near_rows(x, 8, 0.5)):
        links[a][b] = links[b][a] = float(s)
    order = packing.walk(links)
    assert sorted(order) == list(range(120))
    group = [i // 20 for i in order]
    assert sum(a == b for a, b in zip(group, group[1:])) > 100
    assert packing.walk([{}]) == [0] and packing.walk([]) == []


def test_near_rows_are_the_nearest():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((40, 6)), np.ones((20, 6)), np.zeros((2, 6))])
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    a, b, s = packing.near_rows(x.copy(), 8, 0.3)
    for i in range(len(x)):
        sims = x @ x[i]
        sims[i] = -2
        want = sorted((v for v in sims.tolist() if v >= 0.3), reverse=True)[:8]
        assert sorted(s[a == i].tolist(), reverse=True) == pytest.approx(want, abs=1e-5) and len(set(b[a == i])) == len(want)
        assert sims[b[a == i]].tolist() == pytest.approx(s[a == i].tolist(), abs=1e-5)
    assert all(len(v) == 0 for v in packing.near_rows(x[:1].copy()))


def test_encoder_gives_lists_and_arrays_of_the_same_ids():
    for special in (None, {}):
        one, other = packing.load_encoder(special=special), packing.load_encoder(special=special, arrays=True)
        for text in ("", "a", "<|endoftext|> a<|endoftext|>", "naïve  \n\t 漢字 🙂 it's 12345 " * 50):
            assert list(one(text)) == other(text).tolist()


def test_encoder_equals_the_tokenizers_vocabulary():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing.load_encoder()
    texts = ["", " ", "a  b\n\n c\t", "Ünïcode 日本語 😀👍🏽", "don't I'LL", "x" * 3000, "１２３ ½ é́", "\x00\x01", "<|endoftext|> a", "a <|endoftext|>b<|endoftext|><|endoftext|> ", "<|endoftext", "foo\r\nbar  baz"]
    for s in texts:
        assert encode(s) == t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    # the vocabulary's own pattern, in a group, is no key of FASTER
    P = pytest.importorskip("public_tokenizers")
    assert P.PATTERN in packing.FASTER
    return packing.load_encoder(), packing.load_encoder(pattern=f"(?:{P.PATTERN})")


@settings(max_examples=500)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "'", "'s", "'re", "'LL", "a", "é", "é", "漢", "7", "½", "_", "-", ".", "\u200b", "🙂"]), st.characters(exclude_categories=["Cs"])), max_size=14).map("".join))
def test_faster_pattern_gives_the_same_ids(encoders, text):
    faster, plain = encoders
    assert faster(text) == plain(text)


def test_counting_a_document_costs_no_pass_over_all_features(monkeypatch):
    monkeypatch.setattr(packing, "FEATURES", 1 << 22)
    docs = [[i % 7, i % 7, 40_000 + i, 5, 0] for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([len(d) for d in docs], pa.int64()), pa.array([np.array(d, dtype="<u2").tobytes() for d in docs], pa.binary())], names=["doc_tokens", "raw"])
    began = time.process_time()
    (got,) = packing._spread([batch])
    took = time.process_time() - began
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == Counter(f for d in docs for f in set(d[:-1]))
    assert took < 0.3


def brute_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60)
@given(st.lists(st.sampled_from(["a", "B", "É", "c d", " ", "x"]), max_size=12), st.sampled_from([" ", "\t", "\n", "\x0b", "\x1c", "\x85", "  "]))
def test_fingerprint(words, sep):
    text = sep.join(words)
    assert simhash.fingerprint(text.encode()) == brute_simhash(text)


def test_axes_are_nearest():
    r = np.array([[0.1, -0.9, 0.3, 0.2]], dtype=np.float32)
    assert ann.axes(r, 3)[0].tolist() == [[3, 4, 6]]
    x = np.random.default_rng(1).standard_normal((50, 24))
    y = ann.rotate(x, 0, 0)
    assert y.shape == (50, 32) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_buckets_of_several_axes_are_the_likeliest():
    x = np.random.default_rng(2).standard_normal((20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.buckets(x, 3, 5, 2, 0)
    a, b = ann.rotate(x, 6, 0), ann.rotate(x, 7, 0)
    for i in range(20):
        side = lambda r: {2 * j + (s < 0): s * r[i, j] for j in range(8) for s in (1, -1)}
        both = sorted(((-p - q, 16 * k + m) for k, p in side(a).items() for m, q in side(b).items()))
        assert set(got[i]) == {k for _, k in both[:5]} and got[i][0] == both[0][1]


def test_arcs_are_placed_clockwise():
    runs = sharding.place_arcs([5, 0, 2], [0, 1, 0], [4, 3])
    assert runs == [[(0, 0, 0), (4, 1, 0)], [], [(0, 1, 1)]]


@given(st.lists(st.integers(0, 30), min_size=1, max_size=20), st.integers(1, 6))
def test_arcs_fill_all_shards(counts, shards):
    owners = [random.Random(i).randrange(shards) for i in range(len(counts))]
    owners = [*range(shards), *owners][: max(len(counts), shards)]
    counts = counts + [0] * (len(owners) - len(counts))
    room = sharding.capacities(sum(counts), shards)
    runs = sharding.place_arcs(counts, owners, room)
    got = [[] for _ in range(shards)]
    for n, arc in zip(counts, runs):
        ends = [r[0] for r in arc[1:]] + [n]
        for (first, shard, slot), end in zip(arc, ends):
            got[shard] += range(slot, slot + end - first)
    assert [sorted(g) for g in got] == [list(range(r)) for r in room]
    assert max(room) - min(room) <= 1


def test_growing_the_ring_moves_few_keys():
    before, after = sharding.ring(40), sharding.ring(41)
    assert [x for x in after if x[1] != 40] == before


def test_automaton_learns_a_format():
    rng = random.Random(1)
    keys = ["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) for _ in range(300)]
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(6, 20))) + rng.choice(["", "", "1", "_x"]) for _ in range(300)]
    formats = {"access": secret_scan.infer(keys), "words": secret_scan.infer(words), "numbers": secret_scan.infer([])}
    assert len(formats["access"].states) < 60
    judge = secret_scan.Judge(formats)
    fresh = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    assert judge.is_credential(fresh) and judge.is_credential(f"{fresh}.")
    assert not judge.is_credential("internationalisation_x") and not judge.is_credential("") and not judge.is_credential("A0...")
    assert not secret_scan.Judge({"words": formats["words"], "numbers": formats["numbers"]}).is_credential(fresh)
    assert secret_scan.infer([]).log_likelihood("a") < 0


def brute_alergia(values, alpha):
    """States and moves by the definition: after each merge the whole sample is run anew through the tree that is left."""
    values = sorted(map(secret_scan.shape, values))
    moves = {"": {}}
    for v in values:
        for i in range(len(v)):
            moves[v[: i + 1]] = moves.get(v[: i + 1], {})
            moves[v[:i]][v[i]] = v[: i + 1]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def counts():
        seen, stop, gone = Counter(), Counter(), Counter()
        for v in values:
            at = ""
            seen[at] += 1
            for c in v:
                gone[at, c] += 1
                at = moves[at][c]
                seen[at] += 1
            stop[at] += 1
        return seen, stop, gone

    def alike(p, q, done=()):
        seen, stop, gone = counts()
        todo, done = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in done:
                continue
            done.add((p, q))
            n, m = seen[p], seen[q]
            pairs = [(stop[p], stop[q])] + [(gone[p, c], gone[q, c]) for c in {*moves[p], *moves[q]}]
            if n and m and any(abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) for a, b in pairs):
                return False
            todo += [(moves[p][c], moves[q][c]) for c in {*moves[p]} & {*moves[q]}]
        return True

    def fold(p, q):
        for c, t in list(moves[q].items()):
            if c in moves[p]:
                fold(moves[p][c], t)
            else:
                moves[p][c] = t

    red, blue = [""], [("", c) for c in sorted(moves[""])]
    while blue:
        q, c = blue.pop(0)
        t = moves[q][c]
        if t in red:
            continue
        into = next((r for r in red if alike(r, t)), None)
        if into is None:
            red.append(t)
            blue += [(t, d) for d in sorted(moves[t])]
        else:
            moves[q][c] = into
            fold(into, t)
            blue += [(r, d) for r in red for d in sorted(moves[r]) if moves[r][d] not in red]
    seen, stop, gone = counts()
    number = {r: i for i, r in enumerate(red)}
    return [[seen[r], stop[r], {c: (number[t], gone[r, c]) for c, t in moves[r].items()}] for r in red]


@pytest.mark.parametrize("seed", range(6))
def test_alergia_matches_its_definition(seed):
    rng = random.Random(seed)
    values = ["".join(rng.choices("0g", k=rng.randint(1, 4))) * rng.choice([1, 1, 2]) + rng.choice(["", "-Z"]) for _ in range(rng.choice([12, 80, 400]))]
    got = secret_scan.infer(values, 0.3).states
    assert got == brute_alergia(values, 0.3) and (seed < 2 or len(got) > 1)


def brute_base(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["token", "Api_Key", "apikey", "PASSWD", "passſwd", "secret", " = ", ":", '"', "'", "AKIA", "ABCD1234ABCD1234", "0123456789abcdef", "deadbeef", "x", " ", "-", ".", "é", "\n", "g"]), max_size=12).map("".join))
def test_base_spans(text):
    assert [x[:3] for x in secret_scan.base_spans(text)] == brute_base(text)


def test_noisy_or_and_spans():
    w = {i: 9.0 for i in toxicity.word_features("idiot")[:1]}
    m = toxicity.Model(w, -6.0)
    text = "Fine words. You IDIOT!\nMore."
    spans = m.sentences(text)
    assert [text[a:b] for a, b, z in spans if z > 0] == [" You IDIOT"]
    p = [1 / (1 + np.exp(-z)) for _, _, z in spans]
    assert m.score([z for _, _, z in spans]) == pytest.approx(1 - np.prod([1 - x for x in p]))
    assert 0 < m.score([z for _, _, z in m.sentences("")]) < 0.01
