import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from channel_signals.operators import timing as T
from channel_signals.sources.json_cells import explode_intervals, interval_cells

START = datetime(2024, 1, 1)


def uploads(spark, days_by_channel):
    rows = [(c, START + timedelta(days=d)) for c, days in days_by_channel.items() for d in days]
    return spark.createDataFrame(rows, "channel_id string, published_at timestamp")


def by_channel(df):
    return {r["channel_id"]: r.asDict() for r in df.collect()}


CASES = {
    "one": [0], "two": [0, 3], "three": [0, 1, 3], "equal": [5, 5, 5],
    "year": [0, 365, 366], "gap": [0, 366, 800], "half": [0, 366, 367], "burst": [0, 10, 20, 21, 40],
    "copies": [0, 0, 0, 4, 4, 9, 400],
}


def brute(days):
    days = sorted(days)
    kept = [b - a for a, b in zip(days, days[1:]) if b - a <= 365]
    enough = len(days) >= 3
    std = float(np.std(kept)) if enough and len(kept) >= 2 else -1.0
    burst = float(np.mean(np.array(kept) < 0.3 * np.median(kept))) if enough and kept else 0.0
    return std, burst


def check(df, cases):
    got = by_channel(df)
    assert set(got) == set(cases)
    for c, days in cases.items():
        std, burst = brute(days)
        assert got[c]["time_interval_std"] == pytest.approx(std), c
        assert got[c]["upload_burst_ratio"] == pytest.approx(burst), c
        assert got[c]["n_timestamps"] == len(days)


def test_guards(spark):
    check(T.timing_features(uploads(spark, CASES)), CASES)


def test_hot_channels_agree(tiny_tasks):
    rng = random.Random(3)
    cases = dict(CASES, hot=[rng.choice([0.0, 1.0, rng.uniform(0, 900)]) for _ in range(80)])
    check(T.timing_features(uploads(tiny_tasks, cases)), cases)


def test_hot_gaps_equal_ordinary_gaps(spark, tiny_tasks):
    up = uploads(spark, CASES)
    hot = sorted(map(tuple, T.gaps(up).select("channel_id", "seq", "days").na.fill(-1.0).collect()))
    spark.conf.set("spark.channelSignals.hotKeyRows", "1000")
    plain = sorted(map(tuple, T.gaps(up).select("channel_id", "seq", "days").na.fill(-1.0).collect()))
    assert hot == plain


def test_shift_invariance(spark):
    moved = {c: [d + 17.25 for d in days] for c, days in CASES.items()}
    check(T.timing_features(uploads(spark, moved)), CASES)


def test_interval_cells_keep_order_and_split(spark, tiny_tasks, monkeypatch):
    monkeypatch.setattr("channel_signals.sources.json_cells.CELL_VALUES", 2)
    iv = T.intervals(uploads(spark, {"a": [0, 1, 3, 6, 10], "b": [0, 1]}))
    cells = interval_cells(iv)
    assert cells.count() > 1
    text = {r["part"]: r["intervals_json"] for r in cells.collect()}
    assert "".join(text[k] for k in sorted(text)) == "[1.0][2.0,3.0][4.0]"
    back = [tuple(r) for r in explode_intervals(cells).orderBy("seq").collect()]
    assert [r[2] for r in back] == [1.0, 2.0, 3.0, 4.0] and len({r[:2] for r in back}) == 4


def test_interval_cells_do_not_depend_on_task_limits(spark):
    iv = T.intervals(uploads(spark, {"a": [0, 1, 3, 6, 10], "b": [0, 1, 2]}))
    want = sorted(interval_cells(iv).collect())
    spark.conf.set("spark.channelSignals.hotKeyRows", "2")
    got = sorted(interval_cells(iv).collect())
    spark.conf.unset("spark.channelSignals.hotKeyRows")
    assert got == want and [r["part"] for r in got] == [0, 0]


def test_age_and_frequency(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (CAST(NULL AS timestamp), 0, 5, 5), (timestamp'2024-01-31 12:00:00', 3, NULL, NULL),
        (timestamp'2024-01-01', 4, 9, 0), (timestamp'2024-01-01', 4, 9, 62) AS t(f, n, v, c)""")
    age = T.channel_age_days(F.col("f"), F.lit("2024-02-01").cast("timestamp"))
    out = df.select(age.alias("a"), T.video_upload_frequency(
        age, F.col("n"), F.col("v"), F.col("c")).alias("q")).collect()
    assert [r["a"] for r in out] == [-1.0, 1.0, 31.0, 31.0]
    assert [r["q"] for r in out] == pytest.approx([-1.0, 3.0, 9 / 31, 2.0])
