"""Lattice scores, prefix trie and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from channel_signals.llm import lattice_lm as lm
from channel_signals.llm import prefix_trie as trie
from channel_signals.llm import vector_codes as codes
from channel_signals.llm.queries import QUERIES, tokenizer_path

VOCABULARY = tokenizer_path("piece_bpe_32k.model")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), lm.END]


def marginal(word, shares):
    """Sum over all segmentations of the led word, one after another."""
    def ways(left):
        if not left:
            return 1.0
        return sum(shares[left[:k]] * ways(left[k:]) for k in range(1, len(left) + 1) if left[:k] in shares)
    return ways(b" " + word)


@pytest.fixture(scope="module")
def pieces():
    return lm.read_vocabulary(VOCABULARY)


def test_vocabulary(pieces):
    names, weights = pieces
    assert len(set(names)) == len(names) == len(weights) and abs(weights.sum() - 1) < 1e-9
    assert {bytes([b]) for b in range(256) if not (65 <= b <= 90 or 9 <= b <= 13)} <= set(names)


@pytest.mark.parametrize("word", ["a", "hello", "été", "世界", "\x00z", "zz9:é"])
def test_forward_is_the_sum_over_segmentations(pieces, word):
    names, weights = pieces
    lattice = lm.Lattice(names, np.log(weights))
    _, text, length = next(lm._padded(pa.array([word.encode()])))
    want = marginal(word.encode(), dict(zip(names, weights)))
    assert lattice.forward(text)[length[0], 0] == pytest.approx(math.log(want), rel=1e-12)


def test_expected_uses_of_pieces():
    names = [b" ", b"a", b"b", b"ab", b" a"]
    shares = np.array([0.2, 0.3, 0.2, 0.1, 0.2])
    lattice = lm.Lattice(names, np.log(shares))
    _, text, length = next(lm._padded(pa.array([b"ab"])))
    # " |a|b" 0.012, " |ab" 0.02, " a|b" 0.04
    got = lattice.counts(text, length, np.array([1000])) / lm.STEP / 1000
    whole = 0.012 + 0.02 + 0.04
    want = [0.032 / whole, 0.012 / whole, 0.052 / whole, 0.02 / whole, 0.04 / whole]
    assert np.allclose(got, want, atol=1e-4)


def test_blocks_of_cells_change_nothing(pieces, monkeypatch):
    names, weights = pieces
    lattice = lm.Lattice(names, np.log(weights))
    words = [b"internationalisation" * 9, b"x" * 150]

    def run():
        out = []
        for own, text, length in lm._padded(pa.array(words)):
            out.append((own.tolist(), lattice.forward(text)[length, np.arange(len(own))].tolist(),
                        lattice.counts(text, length, np.ones(len(own), np.int64))))
        return sorted(out, key=lambda x: x[0])

    whole = run()
    monkeypatch.setattr(lm, "CELLS", 3000)
    parts = run()
    assert len(parts) >= len(whole)
    assert np.array_equal(sum(x[2] for x in whole), sum(x[2] for x in parts))
    assert sorted(v for x in whole for v in x[1]) == pytest.approx(sorted(v for x in parts for v in x[1]))


DOCS = "doc_id long, text string, word string, n int, head string, SCORE int, lattice int, id long"


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [None, "", " \n\t ", "One", "one ONE\tone", "x" * 700, "a b\x0bc\x00d", "été ÉTÉ \x85 世界 "]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(None, "no id"), (None, None), rows[20], rows[20], (-5, "negative id")]
    return [(i, t, "w", 1, "h", 2, 3, 4) for i, t in rows]


def base_scores(rows):
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    count = collections.Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, kinds = sum(count.values()), len(count)
    out = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (kinds + 1))) for t in own)
        out.append((r[0], held(r[0]), len(own), sum(count[t] > 0 for t in own), n, round(base, 6)))
    return out, count


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("share", [lm.FREQUENT, 0.01, 2.0])
def test_scores(spark, monkeypatch, share):
    """All words looked up, some, or none."""
    monkeypatch.setattr(lm, "FREQUENT", share)
    rows = corpus()
    got = lm.lattice_scores(spark.createDataFrame(rows, DOCS).repartition(3), VOCABULARY, rounds=0).collect()
    want, _ = base_scores(rows)
    assert sorted([(*r[:5], round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    # without rounds the pieces keep the vocabulary's weights
    names, weights = lm.read_vocabulary(VOCABULARY)
    prior = lm.PRIOR / (lm.PRIOR + 1)
    lattice = lm.Lattice(names, np.log(weights * prior))
    end = -math.log10(lm.PRIOR + 1)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id and len(tokens(t)) == r.n_tokens)
        own = [t.encode() for t in tokens(text)[:-1]]
        whole = end
        for _, cells, length in lm._padded(pa.array(own, pa.binary())):
            whole += lattice.forward(cells)[length, np.arange(len(length))].sum() / lm.LN10
        assert r.score == pytest.approx(whole, rel=1e-9)


def test_learning_helps_and_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    before = {r.doc_id: r.score for r in lm.lattice_scores(docs, VOCABULARY, rounds=0).collect()}
    one = {(r.doc_id, r.n_tokens): round(r.score, 9) for r in lm.lattice_scores(docs.repartition(1), VOCABULARY).collect()}
    many = {(r.doc_id, r.n_tokens): round(r.score, 9) for r in lm.lattice_scores(docs.repartition(7), VOCABULARY).collect()}
    assert one == many
    assert sum(v for (i, _), v in one.items() if i and i > 9) > sum(v for i, v in before.items() if i and i > 9)


def test_no_documents_and_a_very_long_text(spark):
    none = spark.createDataFrame([], DOCS)
    assert lm.lattice_scores(none, VOCABULARY).collect() == []
    rows = [(1, "word another " * 100_000 + "y" * 3000, *corpus()[0][2:]), (2, "word", *corpus()[0][2:])]
    got = {r.doc_id: r for r in lm.lattice_scores(spark.createDataFrame(rows, DOCS), VOCABULARY, rounds=1).collect()}
    want, _ = base_scores(rows)
    assert sorted((*r[:5], round(r.base_score, 3)) for r in got.values()) == sorted((*w[:5], round(w[5], 3)) for w in want)


TURNS = "conv_id long, turn long, role string, text string, names string, LEAD int, first int, depth string"


def turns():
    rng = random.Random(11)
    openers = ["hi", "hello there", "été", ""]
    rows = []
    for c in range(90):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 17])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t > 2 else "user", rng.choice(openers)))
    rows += [(200 + i, 0, "user", "hi") for i in range(300)]  # a large group of copies
    rows += [(901, None, None, None), (901, 3, "user", None), (901, 1, None, "x"), (None, 1, "user", "lost")]
    rows += [(902, 0, "user", "same")] * 3  # repeated rows are turns of their own
    rows += [(903, 0, "a:", "b"), (906, 0, "a", ":b")]
    rows += [(911, t, "user", "long" + "g" * 50_000) for t in range(40)]
    return [(*r, "n", 1, 2, "d") for r in rows]


def nodes_of(rows):
    orig = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            orig[c].append((t is not None, t or 0, role or "", text or ""))
    rebuilt = {}
    for c, own in orig.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = sorted(orig.get(c - c % 5, []))[:h]
        rebuilt[c] = [x[2:] for x in head + sorted(own)[h:]]
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[:d - 1])].add(tuple(seq[:d]))
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = sum(totals[k][0] for k in kids[p]) or 1, own + sum(totals[k][1] for k in kids[p])
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), *totals[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 7)
    rows = turns()
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == nodes_of(rows)


def test_trie_of_turnless_and_of_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(none).collect() == []
    # conversation 7 has no leading conversation and loses its one turn
    lost = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(lost, 0, "user", "hi", *turns()[0][4:])]
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert [tuple(-1 if x is None else x for x in r) for r in got] == nodes_of(rows) and len(got) == 1


def lloyd(rows, parts=8, k=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, lab, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v) and v]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(kept[0][2]) // parts
    x = [[v[p * dim:(p + 1) * dim] for p in range(parts)] for _, _, v in kept]
    books = [[x[i][p] for i in range(min(k, len(x)))] for p in range(parts)]

    def nearest(p, v):
        return min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, books[p][e])), e))

    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for v in x:
                held[nearest(p, v[p])].append(v[p])
            for e, vs in held.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by = [], collections.Counter()
    for (i, lab, _), v in zip(kept, x):
        code = [nearest(p, v[p]) for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(v[p], books[p][code[p]]))
        by[lab] += error
        out.append((i, bytes(code).hex(), error, lab))
    return sorted(((i, c, e, by[lab], digest) for i, c, e, lab in out), key=key)


VECTORS = "vec_id long, embedding array<float>, label int, code string, of int, ERROR int"


def vectors(n=700, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * 3, [x + rng.gauss(0, 0.1) for x in c], rng.choice([1, 2, None])))
    rows += [(5001, None, 1), (5002, [], 1), (5003, [1.0] * 15 + [None], 1), (5004, [float("nan")] * 16, 1),
             (5005, [float("inf")] + [0.0] * 15, None), (None, [0.0] * 16, 7)]
    rows += [rows[3], rows[3]] + [(6000 + i, [0.5, -0.5] * 8, 3) for i in range(60)]  # repeated rows, ties
    return [(*r, "c", 1, 2) for r in rows]


@pytest.mark.parametrize("block", [codes.BLOCK_ROWS, 40])
def test_codes(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    rows = vectors()
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=key) == lloyd(rows)


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_codes_of_few_vectors(spark, n):
    rows = vectors()[:n]
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=key) == lloyd(rows)


def test_codes_of_no_vectors(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.vector_codes(spark.createDataFrame(vectors()[700:705], VECTORS)).collect() == []


def test_whole_nodes_are_assigned_from_stored_sums():
    """In tight groups most nodes are settled without a look at their parts."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (16, 8))
    points = np.concatenate([c + rng.integers(-20, 20, (256, 8)) for c in centres])
    tree = codes.PartTree(points)
    want = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    got, sums, counts = codes.assigned(tree, centres)
    assert np.array_equal(got[tree.weight], want[tree.place[tree.weight]])
    tree.points = np.zeros_like(tree.points)  # the parts themselves are not needed for these sums
    _, again, _ = codes.assigned(tree, centres)
    assert (again == sums).all() and counts.sum() == len(points)


def test_queries_are_registered():
    assert {"op11_lattice_lm", "op12_prefix_trie", "op13_vector_codes"} <= set(QUERIES)
