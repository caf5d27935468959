import itertools
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from channel_signals.functions import text as X
from channel_signals.operators.similarity import avg_title_similarity
from channel_signals.operators.titles import (
    language, pick_vocabulary, temporal_clickbait, title_style, vocabulary,
)


def titles(spark, by_channel):
    rows = [(c, i, t) for c, ts in by_channel.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "channel_id string, pos int, title string")


def brute_similarity(texts):
    texts = [t.strip() for t in texts if t.strip()][:10]
    if len(texts) < 2:
        return 0.0
    docs = []
    for t in texts:
        w = re.findall(r"\w\w+", t.lower())
        docs.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vectors = []
    for d in docs:
        v = {t: d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(d)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()} if norm else {})
    sims = [sum(a[t] * b.get(t, 0.0) for t in a) for a, b in itertools.combinations(vectors, 2)]
    return sum(sims) / len(sims)


TITLES = {
    "same": ["a red fox", "a red fox"], "none": ["***", "!!"], "one": ["alone here"],
    "mixed": ["Red fox runs", "red FOX sleeps", "blue whale", "***", " ", "x y z"],
    "long": [f"part {i} of the story about foxes" for i in range(14)],
}


def similarity(df, **kw):
    return {r[0]: r[1] for r in avg_title_similarity(df, **kw).collect()}


def test_similarity_equals_all_pairs(spark):
    got = similarity(titles(spark, TITLES))
    for c, ts in TITLES.items():
        assert got[c] == pytest.approx(brute_similarity(ts), abs=1e-12), c


def test_similarity_ignores_title_order(spark):
    turned = {c: ts[::-1] for c, ts in TITLES.items() if c != "long"}
    got = similarity(titles(spark, turned))
    for c, ts in turned.items():
        assert got[c] == pytest.approx(brute_similarity(ts), abs=1e-12), c


def test_similarity_term_cap_keeps_the_most_used(spark):
    got = similarity(titles(spark, {"c": ["aa bb", "aa cc"]}), max_terms=1)
    assert got["c"] == pytest.approx(1.0)


def test_style(spark):
    got = {r["channel_id"]: r for r in title_style(titles(spark, {
        "dash": ["a---b — c", "d – e"], "symbols": ["***", "12"], "vi": ["Sự thật"],
        "click": ["Why?", "plain", "Top 10", "THE DARK TRUTH"], "blank": [" ", ""],
    })).collect()}
    assert "blank" not in got
    assert got["dash"]["dash_density"] == pytest.approx(3 / 6)
    assert got["symbols"]["capitalization_ratio"] == 0.0
    assert got["symbols"]["title_length_std"] == pytest.approx(0.5)
    assert got["vi"]["title_length_std"] == 0.0
    assert got["click"]["click_marker_share"] == pytest.approx(0.5)
    assert got["click"]["clickbait_phrase_ratio"] == pytest.approx(0.25)
    assert got["click"]["capitalization_ratio"] == pytest.approx((1 / 3 + 0 + 1 / 3 + 1) / 4)


def test_vocabulary_follows_the_language(spark):
    t = titles(spark, {"en": ["The end The end", "the end the end of"],
                       "vi": ["Đá đá Đá", "Đá đá đá"]})
    out = vocabulary(t).join(language(t), "channel_id").select(
        "channel_id", *pick_vocabulary(F.col("language") == "vi"))
    got = {r["channel_id"]: r for r in out.collect()}
    assert got["en"]["type_token_ratio"] == pytest.approx(3 / 9)
    assert got["en"]["opening_repeat_ratio"] == pytest.approx(0.5)
    assert got["vi"]["type_token_ratio"] == pytest.approx(2 / 6)
    assert got["vi"]["opening_repeat_ratio"] == 0.0


def test_whitespace_tokens_keep_punctuation(spark):
    got = vocabulary(titles(spark, {"c": ["Go, go go"]}), "whitespace").first()
    assert got["ttr_plain"] == pytest.approx(2 / 3)


def test_temporal_clickbait(spark):
    df = spark.sql("SELECT * FROM VALUES (0.5D, 1.0D), (0.5D, -1.0D), (NULL, 2.0D) AS t(s, d)")
    out = [r[0] for r in df.select(temporal_clickbait(F.col("s"), F.col("d"))).collect()]
    assert out == [0.25, 0.0, 0.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_scalar_text_functions_agree_with_python(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(X.strip(F.col("t")), X.word_count(F.col("t")), X.upper_share(F.col("t"))).collect()
    for t, (stripped, words, upper) in zip(texts, out):
        assert stripped == t.strip()
        assert words == len(t.split())
        assert upper is None or 0.0 <= upper <= 1.0
