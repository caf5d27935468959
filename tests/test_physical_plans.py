"""The plans that matter at scale, read from Spark itself."""

import contextlib
import io
import uuid

import pytest

from channel_signals.operators.iforest import IntervalForest
from channel_signals.operators.similarity import avg_title_similarity
from channel_signals.operators.timing import intervals, timing_features
from channel_signals.operators.titles import title_style, vocabulary
from channel_signals.plans.build import bucketed_features, build_features
from channel_signals.sources.buckets import BucketedInputs
from channel_signals.workload import views as V

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_timing_takes_one_shuffle_and_two_columns(spark):
    p = plan(timing_features(V.uploads_ord(spark, SF)))
    assert p.count("Exchange") == 1
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_similarity_shuffles_first_titles_only(spark):
    p = plan(avg_title_similarity(V.titles_conv(spark, SF)))
    assert p.count("Exchange") == 1
    below = p[p.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_style_combines_before_its_shuffle(spark):
    p = plan(title_style(V.titles_conv(spark, SF)))
    assert p.count("Exchange") == 1 and "partial_" in p[p.index("Exchange"):]


def test_vocabulary_needs_no_distinct_count(spark):
    p = plan(vocabulary(V.titles_conv(spark, SF)))
    assert "Expand" not in p and p.count("FileScan") == 1
    # tokens, lower-cased tokens, openings of a channel, the channel
    assert p.count("Exchange") <= 4


@pytest.fixture
def joined_by_sorting(spark):
    """No table is small enough to be broadcast, as at scale."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def bucketed(spark, tmp_path):
    inputs = BucketedInputs(f"t_{uuid.uuid4().hex}", str(tmp_path), 4)
    inputs.write(channels=V.channels_ord(spark, SF), uploads=V.uploads_ord(spark, SF), titles=V.titles_conv(spark, SF))
    return inputs


def ran(df) -> str:
    """The plan as it ran, and not the one it began with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_bucketed_inputs_are_never_shuffled(spark, bucketed, joined_by_sorting):
    uploads, titles = bucketed.read(spark, "uploads"), bucketed.read(spark, "titles")
    hot = bucketed.hot_channels(spark)
    assert hot is None
    for df in (timing_features(uploads, hot), intervals(uploads, hot=hot), title_style(titles), vocabulary(titles),
               avg_title_similarity(titles), bucketed_features(spark, bucketed, V.AS_OF_ORDERS)):
        p = ran(df)
        assert "Exchange" not in p and "Bucketed: true" in p and "Bucketed: false" not in p


def test_known_channels_need_no_count(spark, bucketed, monkeypatch):
    from channel_signals.operators import skew

    monkeypatch.setattr(skew, "hot_keys", lambda *_: pytest.fail("counted again"))
    assert bucketed_features(spark, bucketed, V.AS_OF_ORDERS).count() == V.channels_ord(spark, SF).count()


def test_bucketed_features_are_the_same(spark, bucketed):
    a = bucketed_features(spark, bucketed, V.AS_OF_ORDERS, extra=True).collect()
    b = build_features(V.channels_ord(spark, SF), V.uploads_ord(spark, SF), V.titles_conv(spark, SF), V.AS_OF_ORDERS, extra=True)
    assert sorted(map(repr, a)) == sorted(map(repr, b.select(a[0].__fields__).collect()))


def test_hot_channels_are_found_while_writing(tiny_tasks, tmp_path):
    spark = tiny_tasks
    inputs = BucketedInputs(f"t_{uuid.uuid4().hex}", str(tmp_path), 4)
    inputs.write(channels=V.channels_ord(spark, SF), uploads=V.uploads_ord(spark, SF), titles=V.titles_conv(spark, SF))
    assert inputs.hot_channels(spark).count() > 10
    a = timing_features(inputs.read(spark, "uploads"), inputs.hot_channels(spark))
    b = timing_features(V.uploads_ord(spark, SF))
    key = ["channel_id", "n_timestamps", "n_intervals"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def test_a_forest_looks_at_each_row_once_a_pass(spark):
    """Ranks for all trees come from one digest; only low ranks become rows."""
    forest = IntervalForest(numTrees=10, sampleSize=16)
    values = forest._values(intervals(V.uploads_ord(spark, SF)))
    seen = []
    real = forest._grow
    forest._grow = lambda sample, size: seen.append(sample.count()) or real(sample, size)
    forest._fit(intervals(V.uploads_ord(spark, SF)))
    assert seen == [160] and values.count() > 500
