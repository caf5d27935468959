from datetime import datetime

import pytest
from pyspark.sql import functions as F

from channel_signals import schemas
from channel_signals.functions import refs
from channel_signals.sources import ingest as I
from channel_signals.sources import json_cells as J
from channel_signals.sources import seeds as S
from channel_signals.sources.tables import read_csv, write_table
from channel_signals.streaming import jobs

LINES = [
    ("https://www.youtube.com/@Some.Handle-1", "handle", "Some.Handle-1", None),
    ("https://www.youtube.com/@%C4%90i+x?a=1", "handle", "Đi", None),
    ("https://www.youtube.com/@bad%zz", "handle", "bad", None),
    ("https://www.youtube.com/channel/UCabc_-1/videos", "id", "UCabc_-1", "UCabc_-1"),
    ("UC" + "a" * 22, None, None, "UC" + "a" * 22),
    ("UC" + "a" * 23, None, None, None),
    ("https://www.youtube.com/results?search_query=@x", None, None, None),
    ("# https://www.youtube.com/@x", None, None, None),
    ("   ", None, None, None),
]


def test_refs(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LINES)], "i int, v string")
    out = df.select("i", refs.ref_type(F.col("v")), refs.ref_value(F.col("v")),
                    refs.channel_id(F.col("v"))).orderBy("i").collect()
    for row, want in zip(out, LINES):
        assert tuple(row)[1:] == want[1:], want[0]


def test_read_seeds(spark, tmp_path):
    slop, real = tmp_path / "s.txt", tmp_path / "g.txt"
    slop.write_text("https://www.youtube.com/@One\r\n\nhttps://www.youtube.com/@ONE\nUC" + "b" * 22 + "\n")
    real.write_text("https://www.youtube.com/@One\n# note\n")
    paths = {str(slop): 1, str(real): 0}
    got = {m: sorted((r["label"], r["ref_type"], r["ref_value"], r["raw_url"])
                     for r in S.read_seeds(spark, paths, m).collect()) for m in ("url", "id", "both")}
    one = "https://www.youtube.com/@One"
    assert got["url"] == [(0, "handle", "One", one), (1, "handle", "One", one)]
    assert got["id"] == [(1, "id", "UC" + "b" * 22, "UC" + "b" * 22)]
    assert len(got["both"]) == 3
    counts = S.line_counts(S.read_seed_lines(spark, paths)).collect()
    assert sorted((r["label"], r["n_lines"]) for r in counts) == [(0, 2), (1, 3)]


def test_genuine_wins(spark):
    a = spark.createDataFrame([("x",), ("y",)], "channel_id string")
    b = spark.createDataFrame([("y",)], "channel_id string")
    assert sorted(map(tuple, S.union_labels(a, b).collect())) == [("x", 1), ("y", 0)]


def test_json_cells(spark):
    cells = [None, "oops", "{}", "3", '["2024-01-01T00:00:00Z","x","2024","2024-01-01T07:00:00+07:00"]',
             '[" a ","",null,"b"]']
    df = spark.createDataFrame(list(enumerate(cells)), "channel_id int, c string")
    ups = J.explode_uploads(df, "c").collect()
    assert [(r["channel_id"], r["pos"]) for r in ups] == [(4, 0), (4, 1)]
    assert ups[0]["published_at"] == ups[1]["published_at"]
    assert [(r["pos"], r["title"]) for r in J.explode_titles(df, "c").where("channel_id = 5").collect()] \
        == [(0, "a"), (1, "b")]
    flat = df.select(J.flatten_titles(F.col("c"))).collect()
    assert [r[0] for r in flat] == ["", "", "", "", flat[4][0], "a b"]
    assert spark.range(1).select(J.parse_intervals(F.lit(None).cast("string"))).first()[0] == []


def test_csv_round_trip(spark, tmp_path):
    row = ("c", 't "q", \n line', "d", None, "VN", 1, 2, 3, "p", 1, "u", 2, '["2024-01-01"]', '["a, \\"b\\""]')
    df = spark.createDataFrame([row], schemas.CHANNELS_RAW)
    write_table(df, str(tmp_path / "t"), "csv")
    assert read_csv(spark, str(tmp_path / "t"), schemas.CHANNELS_RAW).collect() == df.collect()


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "channel_id string, n int")
    for _ in range(2):
        I.incremental_ingest(df, at)
    I.incremental_ingest(spark.createDataFrame([("c", 9), ("b", 0)], df.schema), at)
    assert sorted(r[0] for r in spark.read.parquet(at).select("channel_id").collect()) == ["a", "b", "c"]


def test_append_new_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a",)], "channel_id string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "channel_id string")
    once = I.append_new(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, I.append_new(once, new).collect()))


def test_known_ids_are_compared_as_text(spark):
    old = spark.createDataFrame([(1,), (None,)], "channel_id long")
    new = spark.createDataFrame([("1",), ("2",)], "channel_id string")
    assert [tuple(r) for r in I.new_rows(old, new).collect()] == [("2",)]


def test_missing_columns_are_named():
    from channel_signals.operators.prep import require_columns

    class Frame:
        columns = ["a"]
    with pytest.raises(ValueError, match="b"):
        require_columns(Frame(), ["a", "b"])


def test_first_row_wins(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 5, "w"), (None, 0, "n")]
    df = spark.createDataFrame(rows, "channel_id string, seen int, title string").repartition(4)
    by_order = I.first_rows(df, order=["seen"]).collect()
    assert sorted(map(tuple, by_order)) == [("a", 1, "y"), ("b", 5, "w")]
    known = spark.createDataFrame([("b",)], "channel_id string")
    assert [tuple(r) for r in I.new_rows(known, df).collect()] == [("a", 1, "y")]


def test_uploads_count_however_late_they_are(spark, tmp_path):
    """Two batches out of order: a day inside the watermark grows, and so does a final one."""
    schema = "channel_id string, published_at timestamp"
    land = str(tmp_path / "in")

    def batch(*times):
        spark.createDataFrame([("a", datetime.fromisoformat(t)) for t in times], schema).coalesce(1).write.mode("append").parquet(land)

    def run():
        stream = jobs.read_landed(spark, land, spark.createDataFrame([], schema).schema)
        jobs.daily_uploads_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 day").awaitTermination()
        return {str(r["day"])[:10]: r["n_uploads"] for r in jobs.daily_uploads(spark, str(tmp_path / "out")).collect()}

    batch("2024-01-01 10:00:00", "2024-01-05 10:00:00")
    assert run() == {"2024-01-01": 1, "2024-01-05": 1}
    batch("2024-01-01 12:00:00", "2024-01-04 23:00:00", "2024-01-05 09:00:00")
    assert run() == {"2024-01-01": 2, "2024-01-04": 1, "2024-01-05": 2}
