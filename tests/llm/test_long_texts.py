"""Texts beyond a chunk, empty tables and ties, which the other tests leave out."""

import hashlib
import random
import re

import numpy as np
import pytest

from channel_signals.llm.common import CHUNK_BYTES
from channel_signals.llm.merkle import fingerprints
from channel_signals.llm.metric_join import metric_join
from channel_signals.llm.mixing import mix
from channel_signals.llm.ngram_join import ngram_join
from channel_signals.llm.packing import CAPACITY, pack, pieces
from channel_signals.llm.quality import quality
from channel_signals.llm.queries import tokenizer_path
from channel_signals.llm.repeats import remove_repeats
from channel_signals.llm.secrets import base_spans, find_secrets, joined

DOCS = "doc_id long, text string, source string"
RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = ". ".join(prose(12) for _ in range(19_000))
ROWS = [(1, LONG, "a"), (2, LONG + ". " + prose(20), "a"), (3, prose(60), "b"), (4, "x" * 1_200_000, "b"),
        (5, prose(50) + ' token = "' + "0123456789abcdef" * 3 + '" ' + prose(200_000), "b"), (6, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > CHUNK_BYTES
    return spark.createDataFrame(ROWS, DOCS).repartition(2).cache()


def by_id(df):
    rows = {r["doc_id"]: r for r in df.collect()}
    assert set(rows) == {i for i, *_ in ROWS}
    return rows


def test_repeats(docs, spark):
    got = by_id(remove_repeats(docs))
    n = len(LONG.encode())
    assert (got[1]["n_bytes"], got[1]["n_removed"]) == (n, n)
    left = ROWS[1][1].encode()[n:]
    assert got[2]["n_removed"] in range(n, n + 2) and got[2]["n_bytes"] == n + len(left)
    assert (got[4]["n_removed"], got[4]["n_spans"]) == (1_200_000, 1)
    assert got[3]["kept_sha256"] == hashlib.sha256(ROWS[2][1].encode()).hexdigest()
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_quality(docs):
    got = by_id(quality(docs))
    assert got[1]["score"] > 0 and got[6]["score"] == 0


def test_secrets(docs):
    got = by_id(find_secrets(docs))
    assert got[5]["spans"] == joined(base_spans(ROWS[4][1])) and got[5]["n_assign"] == got[5]["n_hex"] == 1
    assert len(got[5]["clean_text"]) < len(ROWS[4][1]) and got[1]["clean_text"] == LONG


def test_fingerprints(docs):
    got = by_id(fingerprints(docs))
    assert got[4]["n_chars"] == 1_200_000 and got[1]["fingerprint"] != got[2]["fingerprint"]
    assert got[2]["near_next"] > 0.9  # the next document is the first, but for its last words


def test_mix_and_packing(docs):
    got = by_id(mix(docs))
    assert got[1]["size"] == len(re.findall(r"\S+", LONG))
    rows = pack(pieces(docs, tokenizer_path())).collect()
    whole = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 1)
    assert all(a[1] + a[2] == b[1] for a, b in zip(whole, whole[1:])) and {x[2] for x in whole[1:]} == {CAPACITY}


def test_near_copies(docs):
    got = by_id(ngram_join(docs))
    assert got[1]["n_links"] == got[2]["n_links"] == 1 and got[3]["n_links"] == 0


def test_links_at_the_line(spark):
    """Cosine just at, just below and just above the line, as double precision gives it."""
    rows, want = [], {}
    base = np.zeros(4)
    base[0] = 1.0
    for i, c in enumerate((0.98, 0.97999, 0.98001, 0.9800000001)):
        v = np.zeros(4)
        v[0], v[1 + i % 3] = c, np.sqrt(1 - c * c)
        a, b = base, v
        cosine = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        rows += [(10 * i, a.tolist(), i), (10 * i + 1, b.tolist(), i)]
        want[i] = cosine >= 0.98
    got = metric_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = {r["vec_id"]: r["n_links"] for r in got}
    for i in (1, 2, 3):
        assert (found[10 * i] == found[10 * i + 1] == 1) == want[i]
    assert found[0] == found[1]
