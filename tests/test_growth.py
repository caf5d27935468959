"""Steps whose rows must not grow faster than their input."""

import contextlib
import io
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from channel_signals.constants import CLICKBAIT_PHRASES, VIETNAMESE_LETTERS
from channel_signals.functions import text as X
from channel_signals.functions.segment import longest_match
from channel_signals.operators import language as L
from channel_signals.operators.similarity import avg_title_similarity, mean_similarities
from channel_signals.operators.titles import vocabulary
from channel_signals.workload import spark_queries as Q
from channel_signals.workload import views as V

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_similarity_makes_no_row_of_a_term(spark):
    assert "Generate" not in plan(avg_title_similarity(V.titles_conv(spark, SF)))


def test_capped_terms_tie_by_name(spark):
    # counts: aa and bb 2, their pair 2, the others 1; of these "bb cc" comes before "cc"
    titles = spark.createDataFrame([(1, 0, "aa bb cc"), (1, 1, "aa bb"), (2, 0, "zz"), (3, 0, "."), (3, 1, "?")], "channel_id long, pos long, title string")
    got = {k: dict(avg_title_similarity(titles, max_terms=k).collect()) for k in (3, 4, 100)}
    assert got[3][1] == pytest.approx(1.0)  # both titles hold just the three shared terms
    # (1, 1, 1, idf) against (1, 1, 1, 0)
    idf = 1.0 + math.log(3 / 2)
    assert got[4][1] == pytest.approx(3 / (3 * (3 + idf * idf)) ** 0.5)
    assert got[100][2] == got[100][3] == 0.0


def _counts(texts):
    out = Counter()
    for t in texts:
        for n in (1, 2, 3):
            out.update(t[i:i + n] for i in range(len(t) - n + 1))
    out.pop(" ", None)
    return out


def test_grams_of_a_key_leave_a_batch_once(spark):
    rows = [("a", "xyz xyz")] * 50 + [(None, "é𝒳")] * 3 + [("b", None), ("b", "")]
    found = L.gram_counts(spark.createDataFrame(rows, "lang string, text string").coalesce(1), "lang", "text").collect()
    assert {(r["lang"], r["gram"]): r["n"] for r in found} == {
        (k, g): n for k, texts in (("a", ["xyz xyz"] * 50), (None, ["é𝒳"] * 3)) for g, n in _counts(texts).items()}
    assert len(found) == len({(r["lang"], r["gram"]) for r in found})


def test_ranked_grams_of_keys_that_repeat(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(6)]), "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 30)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        ranked = L._ranked(df, "k", "text", 7)
        assert "Aggregate" not in plan(ranked)
        got = {(r["k"], r["rank"]): r["gram"] for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {k for k, _ in rows}:
        of_key = Counter()
        for k, t in rows:
            if k == key:
                of_key += _counts([re.sub(" +", " ", t)])
        want |= {(key, i + 1): g for i, (g, _) in enumerate(sorted(of_key.items(), key=lambda x: (-x[1], x[0]))[:7])}
    assert got == want


def test_buckets_follow_the_partitions_of_a_shuffle(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "18")
    try:
        made = Q.QUERIES["features_bucketed"](spark, SF)
        assert "SelectedBucketsCount: 18 out of 18" in plan(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_place_in_the_quota_needs_no_task_for_a_whole_target(tiny_tasks, monkeypatch):
    """Slices of three rows give what one window gave."""
    made = []
    monkeypatch.setattr(Q, "prefix_sums", lambda df, *a: made.append(df) or prefix_sums(df, *a))
    from channel_signals.operators.skew import prefix_sums
    assert all(r["consistent"] for r in Q.QUERIES["curate_with_model"](tiny_tasks, SF).collect())
    assert made


def test_phrases_are_tried_where_they_may_begin(spark):
    pattern = X.click_phrase_pattern()
    assert pattern.count(r"(?i)") == 0 and pattern.count("(?=") == 1
    texts = ["YOU WON'T believe it", "untruth", "the truth", "xthe truth", "Not a but", "knot a but", "Genius Of all", "explained in 5 minutes",
             "ÍT AI BIẾT", "ít ai biết", "Review phim", "review phim", "sự thật bí ẩn", "", "không phải a mà là", "few people realize", "carl sagan on"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one_by_one = F.array(*[F.col("t").rlike(p) for p in CLICKBAIT_PHRASES])
    got = df.select("t", X.has_click_phrase(F.col("t")).alias("all"), F.exists(one_by_one, lambda b: b).alias("any")).collect()
    assert all(r["all"] == r["any"] for r in got) and 5 < sum(r["all"] for r in got) < len(texts)


def test_vietnamese_letters_are_looked_for_beyond_ascii(spark):
    texts = [None, "", "plain", "ĐÂY là Ở", "KİΣ é", "tiếng Việt — x"]
    old = F.length(F.lower("t")) - F.length(F.translate(F.lower("t"), VIETNAMESE_LETTERS, ""))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.vietnamese_letters(F.col("t")).alias("a"), old.alias("b"))
    assert "octet_length" in plan(df)
    assert [r["a"] for r in df.collect()] == [r["b"] for r in df.collect()] == [None, 0, 0, 4, 1, 2]


def test_tokens_are_no_structs_before_they_are_counted(spark):
    titles = spark.createDataFrame([(1, 0, "A a b c d"), (1, 1, "A a b x"), (1, 2, "..."), (2, 0, "?")], "channel_id long, pos long, title string")
    for kind in ("words", "whitespace"):
        assert "transform(" not in plan(vocabulary(titles, kind))
    got = {r["channel_id"]: r for r in vocabulary(titles).collect()}
    assert got[1]["ttr_vi"] == pytest.approx(6 / 9) and got[1]["ttr_plain"] == pytest.approx(5 / 9)
    assert got[1]["open_vi"] == pytest.approx(0.5) and got[2]["ttr_vi"] == got[2]["open_plain"] == 0.0


def test_longest_words_by_their_first_syllables(spark):
    rnd = random.Random(3)
    words = ["a b", "b c a", "a b c", "c"]
    texts = [" ".join(rnd.choice("aBcd") for _ in range(rnd.randint(0, 9))) for _ in range(80)]

    def naive(t):
        own, out, at = t.split(), [], 0
        while at < len(own):
            n = next((n for n in (3, 2) if " ".join(own[at:at + n]).lower() in words and at + n <= len(own)), 1)
            out.append(" ".join(own[at:at + n]))
            at += n
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "channel_id long, title string")
    assert {r["channel_id"]: r["w"] for r in longest_match(words)(df).collect()} == {i: naive(t) for i, t in enumerate(texts)}


def test_no_titles_are_not_alike():
    words = pa.array([None, [["aa", "bb"], ["aa", "bb"]], [], [[]]], pa.list_(pa.list_(pa.string())))
    assert mean_similarities(words, 10).tolist() == pytest.approx([0.0, 1.0, 0.0, 0.0])
