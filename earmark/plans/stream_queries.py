"""Streams over the given tables, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions.times import epoch_micros
from earmark.plans import timeline_queries, transcript_queries, views  # noqa: F401
from earmark.plans.registry import SQL, query, table
from earmark.session import scratch_path
from earmark.streaming import jobs

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _as_stream(rows, name: str, files: int = 4, per_batch: int = 2):
    """``rows`` written as files and read back as a stream, in file order.

    There are as many files as a shuffle has parts, so none grows with the
    input; the number of batches stays that of ``files`` by ``per_batch``.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    parts = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-parts * per_batch // files)).parquet(path)


def _run(stream, name: str):
    """Run to the end with an append sink and read what was written."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, name + "-log")).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _published(spark, sf):
    rows = timeline_queries._chunk_segments(spark, sf)
    stream = _as_stream(rows, "chunk-segments")
    out, log = scratch_path(spark, "timeline"), scratch_path(spark, "chunks-done")
    jobs.publish_timeline(stream, timeline_queries._windows(spark, sf), out, log, scratch_path(spark, "timeline-log")).awaitTermination()
    return out, log


@query("stream_timeline", SQL["global_timeline"])
def stream_timeline(spark, sf):
    return spark.read.parquet(_published(spark, sf)[0]).drop("batch")


@query("stream_status", SQL["timeline_status"])
def stream_status(spark, sf):
    return jobs.published_status(timeline_queries._windows(spark, sf), _published(spark, sf)[1])


@query("stream_progress", SQL["progress_eta"])
def stream_progress(spark, sf):
    """Running progress; the last complete state is read back."""
    steps = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.timestamp_micros(epoch_micros(F.col("ts"))).alias("at"),
        (F.col("event_type") == "purchase").alias("done"))
    out = scratch_path(spark, "progress")

    def keep(rows, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    jobs.live_progress(_as_stream(steps, "steps", 4, 4), "400 days").writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "progress-log")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.where(F.col("batch") == rows.select(F.max("batch")).scalar()).drop("batch")


def _with_last(rows):
    ends = rows.groupBy("episode_id").agg(F.max("pos").alias("_last"))
    return rows.join(ends, "episode_id").withColumn("last", F.col("pos") == F.col("_last")).drop("_last")


@query("stream_captions", SQL["caption_dedup"])
def stream_captions(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    cues = _as_stream(_with_last(views.rolling(spark, sf)), "cues")
    return _run(jobs.merge_captions_stream(cues), "captions")


@query("stream_chunks", views.with_views("v_ranges", "SELECT episode_id, chunk_id, first_pos, last_pos FROM v_ranges"))
def stream_chunks(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = _with_last(views.segments(spark, sf)).select("episode_id", "pos", "start_seconds", "end_seconds", "text", "last")
    return _run(jobs.chunk_ranges_stream(_as_stream(rows, "segments"), views.MAX_CHARS, views.MAX_SECONDS), "ranges")


def _deliveries(spark, sf):
    """Every order as a delivery of a chunk."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("episode_id"), F.col("o_orderstatus").alias("chunk_key"),
        F.timestamp_seconds(F.col("o_orderkey") + 1000000000).alias("at"), F.lit("s").alias("settings"),
        F.length("o_orderpriority").cast("long").alias("size_bytes"), F.col("o_orderkey").alias("modified"),
        F.sha2("o_orderpriority", 256).alias("sha256"))


def _logged(spark, sf):
    """Each delivery twice in one batch."""
    rows = _deliveries(spark, sf)
    log = scratch_path(spark, "arrivals")
    stream = _as_stream(rows.unionByName(rows), "deliveries", 4, 4)
    jobs.log_arrivals(stream, log, scratch_path(spark, "held"), scratch_path(spark, "arrivals-log"), "400 days").awaitTermination()
    return spark.read.schema(rows.schema).parquet(log)


@query("stream_late", """
SELECT CAST(o_custkey AS VARCHAR) AS episode_id, o_orderstatus AS chunk_key, o_orderkey AS version,
  CASE WHEN o_orderkey < max(o_orderkey) OVER () - 3600 THEN 'late' ELSE 'repeated' END AS reason
FROM orders
UNION ALL SELECT NULL, o_orderstatus, o_orderkey, 'bad' FROM orders""")
def stream_late(spark, sf):
    """All deliveries, then all of them again, once as they were and once without an episode: what is held back and why."""
    rows = _deliveries(spark, sf)
    path, held = scratch_path(spark, "waves"), scratch_path(spark, "held")
    rows.repartition(4).write.parquet(path)
    rows.unionByName(rows.withColumn("episode_id", F.lit(None).cast("string"))).repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    jobs.log_arrivals(stream, scratch_path(spark, "arrivals"), held, scratch_path(spark, "arrivals-log"), "1 hour").awaitTermination()
    return spark.read.parquet(held).select("episode_id", "chunk_key", F.col("modified").alias("version"), "reason")


@query("stream_replacements", """
SELECT CAST(o_custkey AS VARCHAR) AS episode_id, o_orderstatus AS chunk_key, arg_max(sha256(o_orderpriority), o_orderkey) AS sha256
FROM orders GROUP BY o_custkey, o_orderstatus""")
def stream_replacements(spark, sf):
    """Chunks that arrive again: the newest version of each is kept."""
    return jobs.current_chunks(_logged(spark, sf)).select("episode_id", "chunk_key", "sha256")


@query("stream_quarantine", """
SELECT CAST(o_custkey AS VARCHAR) AS episode_id, o_orderstatus AS chunk_key, o_orderkey AS version, 'source_fingerprint_changed' AS reason
FROM orders QUALIFY o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus)""")
def stream_quarantine(spark, sf):
    """Versions that newer deliveries replaced."""
    logged = _logged(spark, sf)
    return jobs.replaced_chunks(logged, jobs.current_chunks(logged)).select(
        "episode_id", "chunk_key", (F.unix_seconds("at") - 1000000000).alias("version"), "reason")
