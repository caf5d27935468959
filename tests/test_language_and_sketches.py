"""Language choice, tokenizers of one's own, and mergeable quantiles."""

import bisect
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from channel_signals.functions.segment import arrow_segmenter, longest_match
from channel_signals.operators import bayes as NB
from channel_signals.operators import sketches as K
from channel_signals.operators.titles import title_style, vocabulary
from channel_signals.plans.build import build_features

TEXTS = [
    ("vi", "những câu chuyện về cuộc sống"), ("vi", "cách nấu phở bò tại nhà"), ("vi", "tin tức hôm nay"),
    ("vi", "tieng viet khong dau"), ("en", "how to cook beef at home"), ("en", "news of the day"), ("en", "stories about life"),
    ("de", "nachrichten des tages"), (None, "nobody knows"), ("en", None),
]


@pytest.fixture(scope="module")
def model(spark):
    return NB.fit_languages(spark.createDataFrame(TEXTS, "lang string, text string"), grams=150)


def grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in low:
        low = low.replace("  ", " ")
    return [low[i:i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if low[i:i + n].strip()]


def test_weights_are_smoothed_shares(model):
    each = {}
    for lang, text in TEXTS:
        if lang and text is not None:
            each.setdefault(lang, Counter()).update(grams(text))
    total = Counter()
    for c in each.values():
        total.update(c)
    top = [g for g, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:150]]
    want = {(lang, ""): round(math.log(n / 8) * NB.SCALE) for lang, n in (("vi", 4), ("en", 3), ("de", 1))}
    for lang, c in each.items():
        whole = sum(c[g] for g in top) + len(top)
        want |= {(lang, g): round(math.log((c[g] + 1) / whole) * NB.SCALE) for g in top}
    got = {(r["language"], r["gram"]): r["weight"] for r in model.rows().collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1 for k in got)


def test_decisions_and_fallbacks(spark, model):
    titles = [("a", 0, "phở bò và cuộc sống"), ("a", 1, "tin tức"), ("b", 0, "the news at home"), ("b", 1, None),
              ("blank", 0, "  123 "), ("null", 0, None), ("letters", 0, "ỹỵỷ"), ("c", 0, "tieng viet")]
    got = {r["channel_id"]: r["language"] for r in NB.channel_language(
        spark.createDataFrame(titles, "channel_id string, pos int, title string"), model).collect()}
    assert got == {"a": "vi", "b": "en", "blank": "en", "null": "en", "letters": "vi", "c": "vi"}


def test_ties_go_to_the_first_name(spark):
    both = NB.fit_languages(spark.createDataFrame([("y", "abc"), ("x", "abc")], "lang string, text string"))
    titles = spark.createDataFrame([("c", 0, "abc")], "channel_id string, pos int, title string")
    assert NB.channel_language(titles, both).first()["language"] == "x"


def test_no_labelled_text(spark):
    none = NB.fit_languages(spark.createDataFrame([], "lang string, text string"))
    titles = spark.createDataFrame([("c", 0, "àáả")], "channel_id string, pos int, title string")
    assert none.rows().count() == 0
    assert NB.channel_language(titles, none).first()["language"] == "vi"


def test_language_of_a_feature_build(spark, model):
    """Without marks the letters don't tell Vietnamese; the model does, and the tokens keep case."""
    channels = spark.createDataFrame([("c", "t", 1, 1, 1, 1, 1)], "channel_id string, title string, label int, "
                                     "subscriber_count long, view_count long, video_count long, n_videos_crawled long")
    uploads = spark.createDataFrame([], "channel_id string, published_at timestamp")
    titles = spark.createDataFrame([("c", 0, "Tieng viet tieng Viet")], "channel_id string, pos int, title string")

    def ratio(**kwargs):
        return build_features(channels, uploads, titles, "2024-01-01", **kwargs).first()["type_token_ratio"]

    assert ratio() == 0.5
    assert ratio(language=NB.is_vietnamese(titles, model)) == 1.0
    joined = longest_match(["tieng viet"])
    assert ratio(segment=joined) == 0.5
    assert ratio(language=NB.is_vietnamese(titles, model), segment=longest_match(["viet tieng viet"])) == 1.0


@pytest.fixture(scope="module")
def titles(spark):
    rows = [("a", 0, "Học máy là gì? Học Máy!"), ("a", 1, "trí tuệ nhân tạo, nhân"), ("a", 2, None), ("a", 3, "  "),
            ("b", 0, "?!"), ("b", 1, "one_two 3 four"), ("b", 2, "one_two")]
    return spark.createDataFrame(rows, "channel_id string, pos int, title string")


def cut(run, titles):
    return sorted((r["channel_id"], r["w"]) for r in run(titles.where("title is not null")).collect())


def test_longest_match(titles):
    got = cut(longest_match(["học máy", "trí tuệ", "trí tuệ nhân tạo", "nhân tạo", "là gì học"]), titles)
    assert got == [("a", []), ("a", ["Học máy", "là gì Học", "Máy"]), ("a", ["trí tuệ nhân tạo", "nhân"]),
                   ("b", []), ("b", ["one_two"]), ("b", ["one_two", "3", "four"])]


def test_no_words_give_the_plain_tokens(titles):
    a = vocabulary(titles).orderBy("channel_id").collect()
    b = vocabulary(titles, segment=longest_match([])).orderBy("channel_id").select(a[0].__fields__).collect()
    assert a == b


def test_a_tokenizer_of_ones_own(titles):
    letters = arrow_segmenter(list)
    assert cut(letters, titles)[-1] == ("b", list("one_two 3 four"))
    assert vocabulary(titles, segment=letters).where("channel_id = 'b'").first()["ttr_vi"] == pytest.approx(
        len(set("?!one_two 3 fourone_two")) / len("?!one_two 3 fourone_two"))
    assert title_style(titles).count() == 2


def test_sketches_merge_and_stay_within_their_bound(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), rng.gauss(0, 5), rng.choice([None, float("nan"), 1.0, 2.0, 3.0])) for _ in range(30_000)]
    rows.append((None, 7.0, None))
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    part = F.col("a") < 2
    K.quantile_sketches(df.where(part), ["g"], ["a", "b"]).write.parquet(str(tmp_path / "s"))
    merged = K.merged_sketches(spark.read.parquet(str(tmp_path / "s")), K.quantile_sketches(df.where(~part), ["g"], ["a", "b"]), ["g"])
    merged = merged.cache()
    probs = {f"p{i}": i / 20 for i in range(21)}
    got = K.sketch_quantiles(merged, ["g"], probs).collect()
    assert len(got) == 5
    for r in got:
        values = sorted(x[1 if r["feature"] == "a" else 2] for x in rows if x[0] == r["g"] and x[2 if r["feature"] == "b" else 1] is not None
                        and not math.isnan(x[1 if r["feature"] == "a" else 2] or 0))
        assert r["n"] == len(values)
        assert (r["p0"], r["p20"]) == (values[0], values[-1])
        for name, p in probs.items():
            lo, hi = bisect.bisect_left(values, r[name]), bisect.bisect_right(values, r[name])
            off = 2 * K.rank_error() + 1 / len(values)
            assert lo / len(values) - off <= p <= hi / len(values) + off
    box = K.sketch_box(merged, ["g"]).where("feature = 'b' and g = 'x'").first()
    assert (box["low"], box["median"], box["high"]) == (1.0, 2.0, 3.0)
    rank = K.sketch_ranks(merged, ["g"], {"zero": 0.0}).where("feature = 'a' and g = 'x'").first()["zero"]
    assert rank == pytest.approx(0.5, abs=0.03)
    assert K.quantile_sketches(df.limit(0), ["g"], ["a"]).count() == 0
