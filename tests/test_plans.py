import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from channel_signals.constants import ALL_FEATURES, META_COLUMNS, STATIC_FEATURES
from channel_signals.operators.language import identify, language_profiles
from channel_signals.operators.timing import intervals
from channel_signals.plans import build as B
from channel_signals.plans import curate as U
from channel_signals.streaming import jobs as Z

AS_OF = "2024-06-01"


@pytest.fixture(scope="module")
def landed(spark):
    channels = spark.createDataFrame(
        [("a", "A", 1, 5000, 20000, 12, None), ("b", "B", 0, None, None, None, None)],
        "channel_id string, title string, label int, subscriber_count long, view_count long, "
        "video_count long, n_videos_crawled long")
    start = datetime(2024, 1, 1)
    uploads = spark.createDataFrame(
        [("a", start + timedelta(days=d)) for d in (0, 2, 3, 9)],
        "channel_id string, published_at timestamp")
    titles = spark.createDataFrame(
        [("a", i, f"Part {i} lofi hip hop") for i in range(4)],
        "channel_id string, pos int, title string")
    return channels, uploads, titles


def test_channels_without_anything_stay(landed):
    out = B.build_features(*landed, AS_OF)
    assert out.columns == ["channel_id", "title", "label", *ALL_FEATURES, *META_COLUMNS]
    b = out.where("channel_id = 'b'").first()
    assert (b["time_interval_std"], b["video_upload_frequency"], b["subscriber_velocity"]) == (-1, -1, -1)
    assert b["avg_title_similarity"] == 0.0 and b["upload_burst_ratio"] == 0.0


def test_scoring_and_training_features_agree(landed):
    train = B.build_features(*landed, AS_OF).where("channel_id = 'a'").first()
    score = B.scoring_features(*landed, AS_OF).where("channel_id = 'a'").first()
    for c in STATIC_FEATURES:
        if c != "video_upload_frequency":
            assert score[c] == train[c]
    assert score["n_videos_crawled"] == 4


def test_features_do_not_depend_on_task_limits(landed, tiny_tasks):
    hot = B.build_features(*landed, AS_OF).orderBy("channel_id").collect()
    tiny_tasks.conf.unset("spark.channelSignals.hotKeyRows")
    tiny_tasks.conf.unset("spark.channelSignals.sliceRows")
    plain = B.build_features(*landed, AS_OF).orderBy("channel_id").collect()
    for x, y in zip(hot, plain):
        assert [x[c] for c in ALL_FEATURES] == pytest.approx([y[c] for c in ALL_FEATURES])


def test_decisions(spark):
    df = spark.sql("""SELECT * FROM VALUES (0.97D, true), (0.95D, true), (0.95D, false), (0.5D, false),
        (0.15D, true), (0.05D, false) AS t(p, x)""")
    out = df.select(U.classify(F.col("p"), F.col("x")), U.self_training_label(F.col("p")),
                    U.self_training_label(F.col("p"), F.lit("genuine"))).collect()
    assert [r[0] for r in out] == ["slop", None, "slop", None, "genuine", "genuine"]
    assert [r[1] for r in out] == ["slop", "slop", "slop", None, None, "genuine"]
    assert {r[2] for r in out} == {"genuine"}


def test_curation_by_hand(spark):
    cols = "target string, query string, query_order int, rank int, channel_id string, title string, country string, " \
           "subscriber_count long, video_count long, view_count long, p double"
    big = (5000, 20, 50000)
    cand = spark.createDataFrame([
        ("slop", "q", 0, 0, "s1", "one", "", *big, 0.98), ("slop", "q", 0, 1, "s2", "asmr night", "", *big, 0.93),
        ("slop", "q", 1, 0, "s1", "one", "", *big, 0.98), ("slop", "q", 1, 1, "s3", "three", "", *big, 0.95),
        ("genuine", "q", 2, 0, "small", "x", "", 10, 20, 50000, 0.99), ("genuine", "q", 2, 1, "few", "x", "", *big, 0.99),
        ("genuine", "q", 2, 2, "g1", "g", "", *big, 0.01), ("genuine", "q", 2, 3, "s4", "four", "", *big, 0.99)], cols)
    ids = ["s1", "s2", "s3", "s4", "g1", "small"]
    start = datetime(2024, 1, 1)
    ups = spark.createDataFrame(
        [(c, start + timedelta(days=d)) for c in ids for d in range(3)] + [("few", start)],
        "channel_id string, published_at timestamp")
    titles = spark.createDataFrame([(c, 0, "t") for c in ids], "channel_id string, pos int, title string")
    new = U.curate(cand, ups, titles, lambda c, u, t: c.select("channel_id", F.col("p").alias("p1")), quota=2)
    assert sorted((r["channel_id"], r["label"]) for r in new.collect()) == [
        ("g1", "genuine"), ("s1", "slop"), ("s3", "slop"), ("s4", "slop")]
    seeds = spark.createDataFrame([("s1", 1)], "channel_id string, label int")
    grown = U.seeds_with(seeds, new)
    assert sorted(map(tuple, grown.collect())) == [("g1", 0), ("s1", 1), ("s3", 1), ("s4", 1)]


def test_curation_scores_each_candidate_once(spark):
    """The quota reads the decided rows several times; what comes before runs once."""
    cand = spark.range(12).selectExpr(
        "if(id % 2 = 0, 'slop', 'genuine') as target", "'q' as query", "cast(id % 2 as int) as query_order", "cast(id as int) as rank",
        "cast(id as string) as channel_id", "'t' as title", "'' as country", "5000L as subscriber_count", "20L as video_count", "50000L as view_count")
    ups = spark.range(36).selectExpr("cast(id % 12 as string) as channel_id", "timestamp_seconds(id * 86400) as published_at")
    titles = spark.range(12).selectExpr("cast(id as string) as channel_id", "0 as pos", "'t' as title")
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def p1(channel):
        scored.add(1)
        return 0.99 if int(channel) % 2 == 0 else 0.01

    new = U.curate(cand, ups, titles, lambda c, u, t: c.select("channel_id", p1("channel_id").alias("p1")), quota=3)
    assert sorted((r["channel_id"], r["label"]) for r in new.collect()) == [
        (str(i), "genuine" if i % 2 else "slop") for i in range(6)]
    assert scored.value == 12


def test_searches_stop_at_their_target_only(spark):
    cols = "target string, query_order int, rank int, channel_id int, decision string"
    rows = [("slop", 0, i, i, "genuine") for i in range(60)] + [("slop", 1, i, 100 + i, "slop") for i in range(5)]
    later = [("genuine", 6, 0, 200, "genuine"), ("genuine", 6, 1, 201, "slop")]

    def kept(data, quota):
        found = U.within_quota(spark.createDataFrame(data, cols), quota).collect()
        return sorted(r["channel_id"] for r in found)

    # sixty genuine channels come out of slop searches, and no genuine search is needed
    assert kept(rows + later, 50) == [*range(60), *range(100, 105)]
    # three slop channels are enough: the fourth and fifth are not looked at
    assert kept(rows + later, 3) == [*range(60), 100, 101, 102]
    # a genuine search may find slop while it lacks genuine ones
    assert kept(rows[:40] + later, 50) == [*range(40), 200, 201]
    assert kept(rows[:40] + later, 41) == [*range(40), 200]
    assert kept(rows, 0) == []


def test_low_result_searches_take_ten_uploads(spark):
    cand = spark.createDataFrame(
        [("lofi hip hop radio to relax", "a"), ("other", "b")], "query string, channel_id string")
    start = datetime(2024, 1, 1)
    ups = spark.createDataFrame(
        [(c, start + timedelta(days=d)) for c in "ab" for d in range(60)],
        "channel_id string, published_at timestamp")
    got = {r[0]: (r[1], r[2]) for r in U.capped_uploads(ups, cand).groupBy("channel_id").agg(
        F.count(F.lit(1)), F.max("published_at")).collect()}
    newest = start + timedelta(days=59)
    assert got == {"a": (10, newest), "b": (50, newest)}


def test_country_default(spark):
    df = spark.sql("SELECT * FROM VALUES ('', 'bí ẩn'), (NULL, 'abc'), ('US', 'bí ẩn') AS t(c, q)")
    assert [r[0] for r in df.select(U.default_country(F.col("c"), F.col("q"))).collect()] == ["VN", None, "US"]


def test_language_profiles_tell_languages_apart(spark):
    docs = spark.createDataFrame([
        (1, "en", "the cat and the dog are in the house with the other animals"),
        (2, "es", "el perro y el gato estan en la casa con los otros animales")],
        "doc_id int, lang string, text string")
    new = spark.createDataFrame([(9, "the dog with the cat"), (8, "el gato con el perro")], "doc_id int, text string")
    got = dict(map(tuple, identify(new, language_profiles(docs), "doc_id").collect()))
    assert got == {9: "en", 8: "es"}


def test_ingest_stream_resumes(spark, tmp_path):
    src, table, state = (str(tmp_path / d) for d in ("src", "table", "state"))
    def land(ids):
        spark.createDataFrame([(i,) for i in ids], "channel_id string").coalesce(1).write.mode("append").parquet(src)

    land(["a", "b", "b"])
    schema = spark.read.parquet(src).schema
    for more in (["b", "c"], []):
        Z.ingest_stream(Z.read_landed(spark, src, schema), table, state).awaitTermination()
        if more:
            land(more)
    # a lost checkpoint replays everything, and still nothing doubles
    shutil.copytree(src, str(tmp_path / "again"))
    Z.ingest_stream(Z.read_landed(spark, src, schema), table, str(tmp_path / "fresh")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


class FixedScore:
    """Stands for a fitted classifier."""

    def predict(self, features, intervals):
        return features.withColumn("p1", F.when(F.col("n_videos_crawled") > 3, 0.93).otherwise(0.01))


def test_score_stream(spark, landed, tmp_path):
    channels, uploads, titles = landed
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    channels.write.parquet(src)
    Z.score_stream(
        Z.read_landed(spark, src, channels.schema), uploads, titles, intervals(uploads), FixedScore(),
        AS_OF, out, str(tmp_path / "state")).awaitTermination()
    got = sorted((r["channel_id"], r["decision"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", None), ("b", "genuine")]


def test_daily_uploads_stream(spark, landed, tmp_path):
    _, uploads, _ = landed
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    uploads.write.parquet(src)
    Z.daily_uploads_stream(
        Z.read_landed(spark, src, uploads.schema), out, str(tmp_path / "state")).awaitTermination()
    assert Z.daily_uploads(spark, out).agg(F.sum("n_uploads")).first()[0] == 4
