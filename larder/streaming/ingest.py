"""Event ingestion as Structured Streaming jobs.

Every job is a plain streaming DataFrame plus ``run_to_table`` or
``run_upserts``, which start it with a checkpoint, process what is available and
return the resulting table. Rerunning with the same folder continues where the
last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from larder.functions import rules
from larder.functions.common import rnd, top_k
from larder.sources.shared import children, remove

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """File stream of events with the time as an instant (watermarks need one)."""
    stream = (
        spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Append a stream to a Parquet table under ``folder`` and return the table."""
    out = f"{folder}/table"
    (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


Merge = Callable[[DataFrame], DataFrame]
#: Parts of an upserted table; a batch rewrites those that its keys fall in.
BUCKETS = 64


def run_upserts(stream: DataFrame, folder: str, merge: Merge, keys: Sequence[Column | str] = ("user_id",), buckets: int = BUCKETS) -> DataFrame:
    """Keep a merged table: each micro-batch rewrites the buckets that its keys fall in.

    The table is cut into ``buckets`` by the hash of ``keys``, which ``merge`` must
    group by at least. A batch merges its rows with those of its own buckets and
    writes them below its number; its manifest says for every bucket which batch
    wrote it last. A batch that is run again reads the manifest before its own and
    replaces what it wrote, so the result is exactly-once. What neither this nor
    the last manifest names is removed. ``merge`` maps old and new rows to the rows
    to keep.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def manifests() -> list[int]:
        return sorted(int(x.partition("=")[2]) for x in children(spark, f"{folder}/manifest") if x.startswith("batch="))

    def manifest(epoch: int) -> dict[int, int]:
        return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{folder}/manifest/batch={epoch}").collect()}  # a row per bucket

    def part(key: tuple[int, int]) -> str:
        return f"{folder}/data/batch={key[1]}/_bucket={key[0]}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most one row per bucket
            known = [e for e in manifests() if e < epoch]
            before = manifest(known[-1]) if known else {}
            old = [part((b, before[b])) for b in touched if b in before]
            rows = batch.sparkSession.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
            merged = merge(rows).select(*batch.columns).withColumn("_bucket", bucket)
            merged.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{folder}/data/batch={epoch}")
        finally:
            batch.unpersist()
        after = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={epoch}")
        for gone in known[:-1]:
            for key in (set(manifest(gone).items()) - set(before.items()) - set(after.items())):
                remove(spark, part(key))
            remove(spark, f"{folder}/manifest/batch={gone}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = manifests()
    parts = [part(key) for key in sorted(manifest(last[-1]).items())] if last else []
    return spark.read.schema(stream.schema).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)


def impressions(shown: DataFrame) -> DataFrame:
    """One event per shown item, position from 1, scores to 6 digits.

    ``shown`` carries ``items``, an array of struct(recipe_id, base_score, final_score).
    """
    rows = shown.select("session_id", "user_id", "ts", F.posexplode("items").alias("_p", "_i"))
    return rows.select(
        "session_id", "user_id", "ts", (F.col("_p") + 1).alias("position"), "_i.recipe_id",
        rnd("_i.base_score", 6).alias("base_score"), rnd("_i.final_score", 6).alias("final_score"),
    )


def merge_feedback(rows: DataFrame) -> DataFrame:
    """Latest feedback per (user, recipe, type); first creation time and known session kept."""
    order = F.struct("updated_at", "event_id")
    known = F.when(F.col("session_id").isNotNull(), order)
    return rows.groupBy("user_id", "recipe_id", "feedback_type").agg(
        F.max_by("rating", order).alias("rating"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.max_by("session_id", known).alias("session_id"), F.max("event_id").alias("event_id"),
    )


def merge_pantry(rows: DataFrame) -> DataFrame:
    """Latest pantry row per (user, lower name); an unresolved update keeps the old id (S3)."""
    order = F.struct("updated_at", "event_id")
    known = F.when(F.col("ingredient_id").isNotNull(), order)
    return rows.withColumn("_name", F.lower("ingredient_name")).groupBy("user_id", "_name").agg(
        F.max_by("ingredient_name", order).alias("ingredient_name"), F.max_by("ingredient_id", known).alias("ingredient_id"),
        F.max_by("status", order).alias("status"), F.max("updated_at").alias("updated_at"), F.max("event_id").alias("event_id"),
    )


class _Recent(StatefulProcessor):
    """The newest rows of each user as a list state of at most ``limit`` rows."""

    def __init__(self, row: T.StructType, limit: int, ttl_ms: int | None):
        self.row, self.limit, self.ttl_ms = row, limit, ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getListState("recent", self.row, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        order = [self.row.names.index(c) for c in ("ts", "event_id")]
        names = self.row.names
        kept = list(self.held.get()) if self.held.exists() else []
        for frame in rows:
            for row in frame[names].itertuples(index=False, name=None):
                kept.append(tuple(x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in row))
            kept = sorted(kept, key=lambda r: tuple(r[i] for i in order), reverse=True)[: self.limit]
        self.held.put(kept)
        yield pd.DataFrame(kept, columns=names)


def recent_recommendations(rows: DataFrame, limit: int = rules.RECENT_LIMIT, ttl_days: int | None = None) -> DataFrame:
    """The last ``limit`` rows (user_id, event_id, ts and others, none null) of each user that a batch brings rows of.

    State is a list per user that never grows beyond ``limit`` rows. With
    ``ttl_days``, users that stay away so long are forgotten; that takes a query
    that goes on running, because one that ends with the rows at hand would wait
    for their time to pass. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    processor = _Recent(rows.schema, limit, ttl_days and ttl_days * 86_400_000)
    return rows.groupBy("user_id").transformWithStateInPandas(
        processor, outputStructType=rows.schema, outputMode="Update", timeMode="ProcessingTime" if ttl_days else "None"
    )


def merge_recent(rows: DataFrame) -> DataFrame:
    """Of the lists of a user, old and new, the rows of the newest (S4): a new list holds all that stays of the old."""
    return top_k(rows.distinct(), ["user_id"], [F.desc("ts"), F.desc("event_id")], rules.RECENT_LIMIT, "_r").drop("_r")


def late_rows(rows: DataFrame, folder: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """The rows that ``hourly_counters`` drops because their hour had passed when they came (S7), as a table.

    A second job over the same source: each batch compares its rows with the
    largest time of the batches before it, less ``late``, which is the watermark
    that the counters had, and writes those whose window ends no later. A batch
    that is run again replaces its own output.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        seen = [int(x.partition("=")[2]) for x in children(spark, f"{folder}/seen") if x.startswith("batch=")]
        paths = [f"{folder}/seen/batch={e}" for e in seen if e < epoch]
        top = spark.read.schema("ts timestamp").parquet(*paths).agg(F.max("ts")).first()[0] if paths else None
        mark = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {late}")
        batch.where(F.window("ts", window)["end"] <= mark).write.mode("overwrite").parquet(f"{folder}/late/batch={epoch}")
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{folder}/seen/batch={epoch}")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    paths = [f"{folder}/late/{x}" for x in children(spark, f"{folder}/late")]
    return spark.read.schema(rows.schema).parquet(*paths) if paths else spark.createDataFrame([], rows.schema)


def match_feedback(shown: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Impressions with the feedback that follows in time (S5); unmatched ones once the watermark has passed."""
    left = shown.withWatermark("impression_ts", late)
    right = feedback.withWatermark("feedback_ts", late).select(
        F.col("user_id").alias("_user"), F.col("recipe_id").alias("_recipe"), "feedback_type", "feedback_ts", F.col("event_id").alias("feedback_id")
    )
    on = (
        (F.col("user_id") == F.col("_user")) & (F.col("recipe_id") == F.col("_recipe")) & (F.col("feedback_ts") >= F.col("impression_ts"))
        & (F.col("feedback_ts") <= F.col("impression_ts") + F.expr(f"INTERVAL {within}"))
    )
    return left.join(right, on, "leftOuter").drop("_user", "_recipe")


def distinct_impressions(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """First impression per (session, recipe) within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "recipe_id"])


def hourly_counters(rows: DataFrame, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Events per hour and group (S7); an hour is emitted when the watermark has passed it."""
    return (
        rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("hour"), *by, "n", "total")
    )


def activity_sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity per user, split at a gap."""
    return (
        rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")
    )


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c)).alias(c)
