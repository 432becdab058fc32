import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from larder.streaming import ingest


def write(folder, name, rows):
    table = pa.table({
        "event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": [r[3] for r in rows], "value": pa.array([float(r[0]) for r in rows]), "props": ["{}"] * len(rows),
    })
    pq.write_table(table, f"{folder}/{name}")


T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_upserts_continue_from_checkpoint(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        rows = ingest.read_events(spark, str(src), files_per_batch=1).selectExpr(
            "user_id", "'r' AS recipe_id", "event_type AS feedback_type", "CAST(value AS INT) AS rating", "ts AS created_at", "ts AS updated_at", "CASE WHEN event_id < 3 THEN 's' END AS session_id", "event_id")
        return {(r.user_id, r.feedback_type): r for r in ingest.run_upserts(rows, str(out), ingest.merge_feedback).collect()}

    write(src, "events1.parquet", [(1, at(0), 1, "LIKE"), (2, at(1), 1, "LIKE")])
    write(src, "events2.parquet", [(3, at(2), 1, "LIKE"), (4, at(2), 2, "HIDE")])
    first = run()
    assert first[(1, "LIKE")].rating == 3 and first[(1, "LIKE")].session_id == "s"
    write(src, "events3.parquet", [(5, at(9), 1, "LIKE")])
    second = run()
    assert second[(1, "LIKE")].rating == 5 and second[(1, "LIKE")].created_at == first[(1, "LIKE")].created_at and len(second) == 2


def test_late_rows_are_dropped_and_duplicates_removed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "events1.parquet", [(1, at(0), 1, "view"), (2, at(200), 1, "view")])
    out = str(tmp_path / "out")

    def run():
        rows = ingest.read_events(spark, str(src), files_per_batch=1)
        return {r.hour: r.n for r in ingest.run_to_table(ingest.hourly_counters(rows, [], "30 minutes"), out).collect()}

    assert run() == {T0: 1}
    write(src, "events2.parquet", [(3, at(5), 1, "view"), (4, at(600), 1, "view")])  # the first row is too late
    assert run() == {T0: 1, T0 + dt.timedelta(hours=3): 1}

    dup = tmp_path / "dup"
    dup.mkdir()
    write(dup, "events1.parquet", [(1, at(0), 1, "view"), (2, at(1), 1, "view"), (3, at(1), 2, "view")])
    rows = ingest.read_events(spark, str(dup)).select(F.col("user_id").cast("string").alias("session_id"), F.lit("r").alias("recipe_id"), "ts")
    assert ingest.run_to_table(ingest.distinct_impressions(rows), str(tmp_path / "dupout")).count() == 2


def test_unmatched_impressions_appear_after_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "events1.parquet", [(1, at(0), 1, "view"), (2, at(10), 1, "like"), (3, at(0), 2, "view")])
    write(src, "events2.parquet", [(8, at(6000), 9, "view"), (9, at(6000), 9, "like")])  # moves the time on
    rows = ingest.read_events(spark, str(src), files_per_batch=1).withColumn("recipe_id", F.lit("r"))
    shown = rows.where("event_type = 'view'").selectExpr("event_id", "user_id", "recipe_id", "ts AS impression_ts")
    given = rows.where("event_type = 'like'").selectExpr("event_id", "user_id", "recipe_id", "event_type AS feedback_type", "ts AS feedback_ts")
    got = {r.event_id: r.feedback_id for r in ingest.run_to_table(ingest.match_feedback(shown, given), str(tmp_path / "out")).collect()}
    assert got[1] == 2 and got[3] is None


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        rows = ingest.read_events(spark, str(src), files_per_batch=1).selectExpr("user_id", "ts", "event_id", "value")
        return sorted((r.user_id, r.event_id) for r in ingest.run_upserts(rows, str(out), ingest.merge_recent, buckets=8).collect())

    write(src, "events1.parquet", [(i, at(i), i % 10, "view") for i in range(40)])
    assert len(run()) == 40
    write(src, "events2.parquet", [(100 + i, at(100 + i), 3, "view") for i in range(35)])
    write(src, "events3.parquet", [(200, at(300), 3, "view")])
    got = run()
    assert [e for u, e in got if u == 3] == [*range(106, 135), 200] and len(got) == 36 + 30
    batches = sorted(p.name for p in (out / "data").iterdir())
    touched = [len(list((out / "data" / b).glob("_bucket=*"))) for b in batches]
    assert touched[1:] == [1, 1] and len(list((out / "manifest").iterdir())) <= 3
    assert run() == got


def test_recent_lists_continue_after_a_restart(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def run():
            rows = ingest.read_events(spark, str(src), files_per_batch=1).selectExpr("user_id", "event_id", "ts")
            found = ingest.run_upserts(ingest.recent_recommendations(rows, 5), str(out), ingest.merge_recent, buckets=4)
            return sorted((r.user_id, r.event_id) for r in found.collect())

        write(src, "events1.parquet", [(i, at(i), i % 2, "view") for i in range(6)])
        write(src, "events2.parquet", [(i, at(i), 0, "view") for i in range(10, 13)])
        assert [e for u, e in run() if u == 0] == [0, 2, 4, 10, 11, 12]  # the table keeps 30, the state 5
        write(src, "events3.parquet", [(20, at(1), 1, "view")])
        assert [e for u, e in run() if u == 1] == [1, 3, 5, 20]
    finally:
        spark.conf.set(name, before)


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write(src, "events1.parquet", [(1, at(0), 1, "view"), (2, at(200), 1, "view")])
    run = lambda: sorted(r.event_id for r in ingest.late_rows(ingest.read_events(spark, str(src), files_per_batch=1), out, "30 minutes").collect())
    assert run() == []
    write(src, "events2.parquet", [(3, at(5), 1, "view"), (4, at(125), 1, "view"), (5, at(100), 1, "view"), (6, at(600), 1, "view")])
    assert run() == [3, 5] and run() == [3, 5]
