"""Keyed tables, keyed state of streams, and uploads that arrive late."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from channel_signals.sources.id_index import KeyedTable
from channel_signals.streaming import jobs as Z

ROW = "channel_id string, at int, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def files(path):
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def stored(table, spark):
    return sorted((r["channel_id"], r["at"], r["note"]) for r in table.stored(spark).collect())


@pytest.fixture
def table(tmp_path):
    return KeyedTable(str(tmp_path / "t"), buckets=8, filter_bits=1 << 12)


def test_first_batch_and_first_row_win(spark, table):
    table.append(frame(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 1, "lost")]), ["at"])
    added = table.append(frame(spark, [("a", 0, "z"), ("c", 5, "n"), ("c", 5, None)]), ["at"])
    assert [r["channel_id"] for r in added.collect()] == ["c"]
    assert stored(table, spark) == [("a", 1, "y"), ("b", 1, None), ("c", 5, None)]


def test_a_rerun_writes_nothing(spark, table):
    rows = frame(spark, [(f"k{i}", i, "x") for i in range(300)])
    table.append(rows)
    before = files(table.rows_path)
    assert table.append(rows).count() == 0
    assert files(table.rows_path) == before


def test_an_interrupted_batch_is_completed(spark, table):
    """The filters of a batch were written, its rows were not."""
    rows = frame(spark, [(f"k{i}", i, "x") for i in range(50)])
    table.append(rows.limit(20))
    kept = stored(table, spark)
    words = table.placed(rows).groupBy("bucket", "_word").agg(F.bit_or("_bits").alias("_bits"))
    words.write.mode("append").partitionBy("bucket").parquet(table.filters_path)
    table.append(rows)
    assert stored(table, spark) == sorted((r["channel_id"], r["at"], r["note"]) for r in rows.collect())
    assert set(kept) <= set(stored(table, spark))


def test_filters_never_miss_and_rule_most_out(spark, table):
    table.append(frame(spark, [(f"k{i}", i, "x") for i in range(200)]))
    asked = table.possible(table.placed(frame(spark, [(f"k{i}", i, "x") for i in range(4000)])))
    rows = asked.select("channel_id", "_possible").collect()
    assert all(r["_possible"] for r in rows if int(r["channel_id"][1:]) < 200)
    wrong = sum(r["_possible"] for r in rows if int(r["channel_id"][1:]) >= 200)
    assert wrong < 0.02 * 3800


def test_only_touched_buckets_are_read(spark, table):
    table.append(frame(spark, [(f"k{i}", i, "x") for i in range(400)]))
    one = table.placed(frame(spark, [("k7", 0, "x")])).first()["bucket"]
    plan = table.stored_keys(spark, [one])._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "at#" not in plan
    read = {r[0] for r in table.stored_keys(spark, [one]).select(F.input_file_name()).distinct().collect()}
    assert read and all(f"/bucket={one}/" in f for f in read)
    # keys that the filters rule out read no stored row at all
    fresh = frame(spark, [("never seen", 1, "x")])
    possible = table.possible(table.placed(fresh)).first()["_possible"]
    plan = table.new_rows(fresh)._jdf.queryExecution().analyzed().toString()
    assert possible or "rows" not in plan and "parquet" not in plan


def test_compacted_table_is_the_same(spark, table, tmp_path):
    for i in range(4):
        table.append(frame(spark, [(f"k{j}", i, "x") for j in range(30 * i, 30 * i + 60)]))
    out = table.compact(spark, str(tmp_path / "u"))
    assert stored(out, spark) == stored(table, spark)
    assert len(files(out.rows_path)) <= 8 < len(files(table.rows_path))
    assert out.append(frame(spark, [("k3", 9, "y"), ("new", 9, "y")])).count() == 1


def test_large_batches_are_split_into_files(spark, table, monkeypatch):
    from channel_signals.sources import id_index

    monkeypatch.setattr(id_index, "ROWS_PER_FILE", 10)
    rows = frame(spark, [(f"k{i}", i, "x") for i in range(400)])
    table.append(rows)
    assert len(files(table.rows_path)) > 16
    assert table.append(rows).count() == 0 and len(stored(table, spark)) == 400


def test_names_of_the_table_itself_are_refused(spark, table):
    with pytest.raises(ValueError, match="bucket"):
        table.append(frame(spark, [("a", 1, "x")]).withColumn("Bucket", F.lit(1)))


def test_stream_into_a_keyed_table(spark, table, tmp_path):
    landed = str(tmp_path / "landed")
    for rows in ([("a", 1, "x"), ("b", 1, "x")], [("b", 0, "y"), ("c", 2, "x")]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        s = Z.read_landed(spark, landed, frame(spark, rows).schema, files_per_batch=1)
        Z.ingest_stream(s, table, str(tmp_path / "cp")).awaitTermination()
    assert stored(table, spark) == [("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x")]


def test_first_seen_over_a_restart(spark, tmp_path):
    landed, out, cp = (str(tmp_path / n) for n in ("landed", "out", "cp"))
    batches = [[("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], [("a", 0, "late"), ("c", 1, None)],
               [("b", 0, "late"), ("c", 0, "late"), ("d", 4, "x"), (None, 1, "lost")]]
    for rows in batches:  # each batch is a run of its own
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        with Z.keyed_state(spark):
            s = Z.read_landed(spark, landed, frame(spark, rows).schema, files_per_batch=1)
            Z.first_seen_stream(s, out, cp, order=["at"]).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == [("a", 1, "y"), ("b", None, "z"), ("c", 1, None), ("d", 4, "x")]


def test_late_uploads_are_kept_and_settled(spark, tmp_path):
    landed, out, cp, target = (str(tmp_path / n) for n in ("landed", "out", "cp", "target"))
    day = dt.datetime(2024, 5, 1)

    def land(*rows):
        spark.createDataFrame([(c, day + dt.timedelta(hours=h)) for c, h in rows], "channel_id string, published_at timestamp"
                              ).coalesce(1).write.mode("append").parquet(landed)
        s = Z.read_landed(spark, landed, spark.read.parquet(landed).schema, files_per_batch=1)
        Z.daily_uploads_stream(s, out, cp, "12 hours").awaitTermination()

    land(("a", 1), ("a", 50), ("b", 60))
    land(("a", 2), ("a", 49), ("b", 70))  # day 0 is behind the watermark (hour 48), day 2 is not
    rows = {(r["channel_id"], r["day"].day): (r["n_uploads"], r["n_late"], r["final"])
            for r in Z.daily_uploads(spark, out, "12 hours").collect()}
    assert rows == {("a", 1): (2, 1, True), ("a", 3): (2, 0, False), ("b", 3): (2, 0, False)}
    Z.merge_late(spark, out, target, "12 hours")
    assert [(r["channel_id"], r["n_uploads"]) for r in spark.read.parquet(target).collect()] == [("a", 2)]
    land(("b", 3), ("b", 100))  # late again for the settled day
    Z.merge_late(spark, out, target, "12 hours")
    settled = {(r["channel_id"], r["day"].day): r["n_uploads"] for r in spark.read.parquet(target).collect()}
    assert settled == {("a", 1): 2, ("b", 1): 1, ("a", 3): 2, ("b", 3): 2}
    assert len([d for d in os.listdir(f"{out}/late") if d.startswith("batch=")]) == 3
