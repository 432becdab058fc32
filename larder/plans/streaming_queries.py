"""S: the events table replayed as a file stream."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from larder.functions.common import rnd
from larder.plans.bindings import BASE
from larder.plans.registry import Tables, query
from larder.plans.sqltext import sql_round
from larder.sources.shared import shared_dir
from larder.streaming import ingest


PARTS = 4


def replay(t: Tables, again: bool = False) -> str:
    """A folder with the events in PARTS files in order of time, written one after the other; ``again`` adds the first of them once more."""
    folder = _dir(t, "events")
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    if first is not None:
        seconds = lambda c: F.unix_micros(c.cast("timestamp"))
        place = F.least(F.floor((seconds(F.col("ts")) - seconds(F.lit(first))) * PARTS / (seconds(F.lit(last)) - seconds(F.lit(first)) + 1)), F.lit(PARTS - 1))
        for i in [*range(PARTS), *([0] if again else [])]:
            t.events.where(place == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def live(t: Tables, again: bool = False):
    """The interactions relation over a stream of the events, a file a batch."""
    events = ingest.read_events(t.spark, replay(t, again), "*.parquet", files_per_batch=1)
    return t.spark.sql(BASE["interactions"].replace("FROM events", "FROM {events}"), events=events)


def _dir(t: Tables, name: str) -> str:
    return shared_dir(t.spark, f"stream-{name}")


@contextmanager
def state_store(t: Tables):
    """The state store that keyed list state needs, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        t.spark.conf.set(name, before)


@query("S1_impression_log", f"""SELECT session_id, user_id, recipe_id || '-' || CAST(i AS VARCHAR) AS recipe_id, CAST(i AS INT) AS position, {sql_round('value / (3 * i)', 6)} AS base_score, {sql_round('value', 6)} AS final_score, epoch_us(ts) AS ts FROM (SELECT *, unnest([1, 2, 3]) AS i FROM interactions)""")
def s1(t: Tables):
    item = lambda i: F.struct(F.concat("recipe_id", F.lit(f"-{i}")).alias("recipe_id"), (F.col("value") / (3 * i)).alias("base_score"), F.col("value").alias("final_score"))
    shown = live(t).withColumn("items", F.array(*[item(i) for i in (1, 2, 3)]))
    return ingest.run_to_table(ingest.impressions(shown), _dir(t, "log")).select("session_id", "user_id", "recipe_id", "position", "base_score", "final_score", ingest.micros("ts"))


_SESS = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE session_id END"


@query("S2_feedback_upsert", f"""SELECT user_id, recipe_id, feedback_type, max_by(position, (ts, event_id)) AS rating, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS updated_at, max_by(s, (ts, event_id)) FILTER (s IS NOT NULL) AS session_id
FROM (SELECT *, {_SESS} AS s FROM interactions WHERE feedback_type IS NOT NULL) GROUP BY 1, 2, 3""")
def s2(t: Tables):
    rows = live(t).where("feedback_type IS NOT NULL").select(
        "user_id", "recipe_id", "feedback_type", F.col("position").alias("rating"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.when(F.col("event_id") % 4 != 0, F.col("session_id")).alias("session_id"), "event_id")
    out = ingest.run_upserts(rows, _dir(t, "feedback"), ingest.merge_feedback, ["user_id", "recipe_id", "feedback_type"], buckets=16)
    return out.select("user_id", "recipe_id", "feedback_type", "rating", ingest.micros("created_at"), ingest.micros("updated_at"), "session_id")


_NAME = "CASE WHEN event_id % 2 = 0 THEN 'Item ' ELSE 'item ' END || CAST(event_id % 11 AS VARCHAR)"
_PID = "CASE WHEN event_id % 3 <> 0 THEN 'ING' || CAST(event_id % 11 AS VARCHAR) END"


@query("S3_pantry_upsert", f"""SELECT user_id, max_by(nm, (ts, event_id)) AS ingredient_name, max_by(pid, (ts, event_id)) FILTER (pid IS NOT NULL) AS ingredient_id, max_by(coalesce(feedback_type, 'SEEN'), (ts, event_id)) AS status FROM (SELECT *, {_NAME} AS nm, {_PID} AS pid FROM interactions) GROUP BY user_id, lower(nm)""")
def s3(t: Tables):
    e = F.col("event_id")
    rows = live(t).select(
        "user_id", F.concat(F.when(e % 2 == 0, "Item ").otherwise("item "), (e % 11).cast("string")).alias("ingredient_name"),
        F.when(e % 3 != 0, F.concat(F.lit("ING"), (e % 11).cast("string"))).alias("ingredient_id"), F.coalesce("feedback_type", F.lit("SEEN")).alias("status"), F.col("ts").alias("updated_at"), "event_id")
    return ingest.run_upserts(rows, _dir(t, "pantry"), ingest.merge_pantry, ["user_id", F.lower("ingredient_name")], buckets=16).select("user_id", "ingredient_name", "ingredient_id", "status")


@query("S4_last_recommended", "SELECT user_id, recipe_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM interactions) WHERE r <= 30")
def s4(t: Tables):
    rows = live(t).select("user_id", "recipe_id", "event_id", "ts")
    with state_store(t):
        return ingest.run_upserts(ingest.recent_recommendations(rows), _dir(t, "recent"), ingest.merge_recent, buckets=16).select("user_id", "recipe_id", "event_id")


_PAIRED = """SELECT i.event_id, f.event_id AS feedback_id, f.feedback_type FROM (SELECT * FROM interactions WHERE feedback_type IS NULL) i LEFT JOIN (SELECT * FROM interactions WHERE feedback_type IS NOT NULL) f
  ON i.user_id = f.user_id AND i.recipe_id = f.recipe_id AND f.ts >= i.ts AND f.ts <= i.ts + INTERVAL 24 HOUR"""


@query("S5_feedback_match", f"""SELECT p.event_id, CAST(p.feedback_id AS DOUBLE) AS feedback_id, p.feedback_type FROM ({_PAIRED}) p JOIN interactions i ON p.event_id = i.event_id
WHERE p.feedback_id IS NOT NULL OR i.ts + INTERVAL 24 HOUR < (SELECT least(max(ts) FILTER (feedback_type IS NULL), max(ts) FILTER (feedback_type IS NOT NULL)) - INTERVAL 48 HOUR FROM interactions)""")
def s5(t: Tables):
    shown = live(t).where("feedback_type IS NULL").select("event_id", "user_id", "recipe_id", F.col("ts").alias("impression_ts"))
    given = live(t).where("feedback_type IS NOT NULL").select("event_id", "user_id", "recipe_id", "feedback_type", F.col("ts").alias("feedback_ts"))
    out = ingest.run_to_table(ingest.match_feedback(shown, given, "24 hours", "48 hours"), _dir(t, "match"))
    return out.select("event_id", F.col("feedback_id").cast("double").alias("feedback_id"), "feedback_type")


@query("S6_distinct_impressions", "SELECT DISTINCT session_id, recipe_id FROM interactions")
def s6(t: Tables):
    return ingest.run_to_table(ingest.distinct_impressions(live(t).select("session_id", "recipe_id", "ts")), _dir(t, "distinct")).select("session_id", "recipe_id")


@query("S7_hourly_counters", f"""SELECT epoch_us(date_trunc('hour', ts)) AS hour, coalesce(feedback_type, 'SEEN') AS kind, count(*) AS n, {sql_round('sum(value)', 4)} AS total FROM interactions GROUP BY ALL
HAVING max(date_trunc('hour', ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM interactions)""")
def s7(t: Tables):
    rows = live(t).select("ts", "value", F.coalesce("feedback_type", F.lit("SEEN")).alias("kind"))
    out = ingest.run_to_table(ingest.hourly_counters(rows, ["kind"]), _dir(t, "hourly"))
    return out.select(ingest.micros("hour"), "kind", "n", rnd("total", 4).alias("total"))


_CUT = f"""(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts)) + 1) / {PARTS}.0 FROM interactions)"""


@query("S7_late_rows", f"""SELECT event_id, epoch_us(ts) AS ts, value FROM interactions WHERE epoch_us(ts) < {_CUT}
AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM interactions)""")
def s7b(t: Tables):
    """The first quarter of the events comes again after the last: all of it is late, and none is lost sight of."""
    rows = live(t, again=True).select("event_id", "ts", "value")
    return ingest.late_rows(rows, _dir(t, "late")).select("event_id", ingest.micros("ts"), "value")


@query("S8_activity_sessions", """SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM interactions))
GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM interactions)""")
def s8(t: Tables):
    out = ingest.run_to_table(ingest.activity_sessions(live(t).select("user_id", "ts")), _dir(t, "sessions"))
    return out.select("user_id", ingest.micros("session_start"), ingest.micros("session_end"), "n")
