"""Streams end without their last row, and every delivery is in one of two tables."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from earmark.session import scratch_path
from earmark.streaming import jobs
from tests.test_folds import plain_chunks, plain_merge

BEGIN = datetime(2026, 1, 1)
CUES = "episode_id string, pos long, start_seconds double, end_seconds double, speaker string, text string, last boolean, at timestamp"


def stream_of(spark, waves, schema):
    """Each wave is one file and one batch."""
    path = scratch_path(spark, "waves")
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream):
    spark, out, schema = stream.sparkSession, scratch_path(stream.sparkSession, "out"), stream.schema
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(spark.read.schema(schema).parquet(out).collect()), query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture(scope="module")
def episodes():
    """Row 3 of ``gap`` never comes, ``open`` has no last row, ``done`` has both; rows come in no order."""
    texts = ["a", "ab", "abc", "x", "xy", "z", "z", "q"]
    rows = {}
    for episode in ("gap", "open", "done"):
        rows[episode] = [(episode, i, float(i), i + 0.5, None, t, episode == "done" and i == 7, BEGIN + timedelta(seconds=i))
                         for i, t in enumerate(texts) if not (episode == "gap" and i == 3)]
    return rows


def waves_of(episodes):
    mixed = [r for rows in episodes.values() for r in rows]
    # The watermark passes all of them with the second to last wave; the last lets the timers run.
    ticks = [[("tick", i, float(i), i + 0.5, None, "t", False, BEGIN + timedelta(hours=h))] for i, h in enumerate((5, 9))]
    return [mixed[1::2][::-1], mixed[::2], *ticks]


def test_captions_of_unfinished_episodes_come_out(spark, episodes):
    got, state = run(jobs.merge_captions_stream(stream_of(spark, waves_of(episodes), CUES), "1 minute", 60_000))
    for episode, rows in episodes.items():
        cues = [{"pos": r[1], "start": r[2], "end": r[3], "speaker": r[4], "text": r[5]} for r in rows]
        found = [(r.pos, r.text, r.speaker, r.start_seconds, r.end_seconds, r.merged_rows) for r in got if r.episode_id == episode]
        assert found == plain_merge(cues), episode
    # What the last tick opened is all that is left: next position and open caption.
    assert state <= 4


def test_chunks_of_unfinished_episodes_come_out(spark, episodes):
    got, _ = run(jobs.chunk_ranges_stream(stream_of(spark, waves_of(episodes), CUES), 4, 100.0, 1, late="1 minute", patience_ms=60_000))
    for episode, rows in episodes.items():
        segments = [{"pos": r[1], "start": r[2], "end": r[3], "chars": len(r[5])} for r in rows]
        found = [(r.first_pos, r.last_pos) for r in got if r.episode_id == episode]
        assert found == plain_chunks(segments, 4, 100.0, 1), episode


def test_without_times_an_unfinished_episode_waits(spark, episodes):
    got, _ = run(jobs.merge_captions_stream(stream_of(spark, waves_of(episodes), CUES)))
    assert [r.pos for r in got if r.episode_id == "done"] == [p[0] for p in plain_merge(
        [{"pos": r[1], "start": r[2], "end": r[3], "speaker": r[4], "text": r[5]} for r in episodes["done"]])]
    # Its first three rows are one caption, which stays open.
    assert not [r for r in got if r.episode_id == "gap"]


ARRIVAL = "episode_id string, chunk_key string, at timestamp, settings string, size_bytes long, modified long, sha256 string"


def test_every_delivery_is_in_one_of_two_tables(spark):
    def row(episode, chunk, hours, version=1, digest="d"):
        return (episode, chunk, None if hours is None else BEGIN + timedelta(hours=hours), "s", 1, version, digest)

    waves = [
        [row("e", "a", 0), row("e", "a", 0), row("e", "b", 5), row(None, "b", 5), row("e", None, 5), row("e", "c", None)],
        # The watermark is hour 4 here.
        [row("e", "a", 3), row("e", "a", 4), row("e", "b", 5), row("e", "b", 6, 2), row("f", "a", 9, None, None), row("f", "a", 9, None, None)],
        [row("e", "b", 6, 2), row("f", "a", 8, None, None), row("f", "a", 8, 3)],
        [],
    ]
    stream = stream_of(spark, waves, ARRIVAL)
    log, held = scratch_path(spark, "log"), scratch_path(spark, "held")
    seen = []
    for _ in range(2):  # the second run replays every batch into the same folders
        jobs.log_arrivals(stream, log, held, scratch_path(spark, "checkpoint"), "1 hour").awaitTermination()
        fresh = spark.read.schema(ARRIVAL).parquet(log)
        kept = spark.read.schema(ARRIVAL + ", reason string").parquet(held)
        seen.append((sorted(fresh.collect(), key=str), sorted(kept.collect(), key=str)))
    assert seen[0] == seen[1]
    fresh, kept = seen[0]
    key = lambda r: (r[0], r[1], r[2], *r[3:7])
    assert Counter(map(key, [*fresh, *kept])) == Counter(map(key, [r for w in waves for r in w]))
    assert Counter(r.reason for r in kept) == {"bad": 3, "late": 2, "repeated": 4}
    # Version 1 of chunk a came at hour 0, which the watermark has passed by more than an hour: at hour 4 it is fresh again.
    assert [(r.episode_id, r.chunk_key, (r.at - BEGIN).total_seconds() / 3600) for r in sorted(fresh, key=lambda r: (r.at, r.episode_id, r.chunk_key))] == [
        ("e", "a", 0), ("e", "a", 4), ("e", "b", 5), ("e", "b", 6), ("f", "a", 8), ("f", "a", 9)]
