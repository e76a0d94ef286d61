"""Speakers, timelines, coverage, sampling, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions.times import epoch_micros
from earmark.operators import timeline, transcripts
from earmark.plans import views
from earmark.plans.registry import query, table
from earmark.plans.views import with_views

views.VIEW_SQL["v_turns"] = """
    v_turns AS (
      SELECT CAST(user_id AS VARCHAR) AS episode_id, event_id AS turn_no,
             CAST(floor(epoch(ts)) AS BIGINT) % 600 + 0.0::DOUBLE AS start,
             CAST(floor(epoch(ts)) AS BIGINT) % 600 + CASE WHEN event_type = 'error' THEN -1.0 ELSE 1.0 END * value / 10 AS "end",
             CASE WHEN event_type <> 'signup' THEN event_type ELSE '' END AS speaker
      FROM events)"""
views.VIEW_SQL["v_clean"] = """
    v_clean AS (SELECT * FROM v_turns WHERE "end" >= start AND speaker <> '')"""
# Line items as chunks of a recording: one source per order.
views.VIEW_SQL["v_windows"] = """
    v_windows AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS episode_id,
             CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS chunk_key,
             CAST(l_linenumber AS BIGINT) AS sequence, l_extendedprice / 10 AS global_offset_seconds, l_quantity AS duration_seconds
      FROM lineitem WHERE l_returnflag <> 'A')"""
views.VIEW_SQL["v_chunk_segments"] = """
    v_chunk_segments AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS episode_id,
             CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS chunk_key,
             l_quantity AS start_seconds, l_quantity + l_tax AS end_seconds, l_returnflag || l_linestatus AS text
      FROM lineitem WHERE l_linestatus = 'F')"""
views.NEEDS["v_clean"] = ["v_turns"]


def _raw_turns(spark, sf):
    second = (F.floor(epoch_micros(F.col("ts")) / 1000000) % 600).cast("double")
    way = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0)
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("turn_no"),
        second.alias("start"), (second + way * F.col("value") / 10).alias("end"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).otherwise("").alias("speaker"))


def _turns(spark, sf):
    return timeline.clean_turns(_raw_turns(spark, sf))


@query("turns_clean", with_views("v_clean", 'SELECT episode_id, turn_no, start, "end", speaker FROM v_clean'))
def turns_clean(spark, sf):
    return _turns(spark, sf)


_DIARIZED = """
  o AS (
    SELECT s.episode_id, segment_id, t.speaker, min(turn_no) AS first,
           CAST(sum(greatest(0, least(CAST(round(end_seconds * 1000000) AS BIGINT), CAST(round("end" * 1000000) AS BIGINT))
                   - greatest(CAST(round(start_seconds * 1000000) AS BIGINT), CAST(round(start * 1000000) AS BIGINT)))) AS BIGINT) AS ov
    FROM v_segments s JOIN v_clean t USING (episode_id) GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY episode_id, segment_id ORDER BY ov DESC, first) AS r FROM o),
  d AS (
    SELECT s.episode_id, s.segment_id, s.speaker AS old, b.speaker AS who,
           -- An episode without turns has no confidence (least() skips nulls).
           CASE WHEN ov IS NOT NULL THEN round(least(1.0, ov / greatest(1000,
             CAST(round(end_seconds * 1000000) AS BIGINT) - CAST(round(start_seconds * 1000000) AS BIGINT))), 4) END AS speaker_confidence
    FROM v_segments s LEFT JOIN b ON b.episode_id = s.episode_id AND b.segment_id = s.segment_id AND r = 1)
"""


@query("diarize", with_views("v_segments v_clean", _DIARIZED + """
SELECT episode_id, segment_id, CASE WHEN speaker_confidence >= 0.35 THEN who ELSE old END AS speaker, speaker_confidence FROM d"""))
def diarize(spark, sf):
    return timeline.assign_speakers(views.segments(spark, sf), _turns(spark, sf)).select(
        "episode_id", "segment_id", "speaker", "speaker_confidence")


@query("diarization_coverage", with_views("v_segments v_clean", _DIARIZED + """
SELECT episode_id, count(*) FILTER (speaker_confidence >= 0.35) AS assigned_segments, count(*) AS total_segments,
       round(count(*) FILTER (speaker_confidence >= 0.35) / count(*), 4) AS coverage FROM d GROUP BY episode_id"""))
def diarization_coverage(spark, sf):
    return timeline.diarization_coverage(timeline.assign_speakers(views.segments(spark, sf), _turns(spark, sf)))


def _items(spark, sf):
    return table(spark, sf, "lineitem").withColumns({
        "episode_id": F.col("l_orderkey").cast("string"),
        "chunk_key": F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})


def _windows(spark, sf):
    return _items(spark, sf).where("l_returnflag <> 'A'").select(
        "episode_id", "chunk_key", F.col("l_linenumber").cast("long").alias("sequence"),
        (F.col("l_extendedprice") / 10).alias("global_offset_seconds"), F.col("l_quantity").alias("duration_seconds"))


def _chunk_segments(spark, sf):
    return _items(spark, sf).where("l_linestatus = 'F'").select(
        "episode_id", "chunk_key", F.col("l_quantity").alias("start_seconds"),
        (F.col("l_quantity") + F.col("l_tax")).alias("end_seconds"), F.concat("l_returnflag", "l_linestatus").alias("text"))


@query("global_timeline", with_views("v_windows v_chunk_segments", """
SELECT episode_id, sequence AS chunk_sequence, round(start_seconds + global_offset_seconds, 6) AS start_seconds,
       round(end_seconds + global_offset_seconds, 6) AS end_seconds, text
FROM v_chunk_segments JOIN v_windows USING (episode_id, chunk_key)"""))
def global_timeline(spark, sf):
    return timeline.global_timeline(_chunk_segments(spark, sf), _windows(spark, sf))


@query("missing_chunks", with_views("v_windows v_chunk_segments", """
SELECT episode_id, chunk_key, sequence FROM v_windows w
WHERE NOT EXISTS (SELECT 1 FROM v_chunk_segments s WHERE s.episode_id = w.episode_id AND s.chunk_key = w.chunk_key)"""))
def missing_chunks(spark, sf):
    return timeline.missing_chunks(_windows(spark, sf), _chunk_segments(spark, sf)).select("episode_id", "chunk_key", "sequence")


@query("timeline_status", with_views("v_windows v_chunk_segments", """
SELECT episode_id, count(d.chunk_key) AS completed_chunks, count(*) AS total_chunks,
       CASE WHEN count(d.chunk_key) < count(*) THEN 'partial' ELSE 'complete' END AS status
FROM v_windows w LEFT JOIN (SELECT DISTINCT episode_id, chunk_key FROM v_chunk_segments) d USING (episode_id, chunk_key)
GROUP BY episode_id"""))
def timeline_status(spark, sf):
    return timeline.timeline_status(_windows(spark, sf), _chunk_segments(spark, sf))


@query("sequence_gaps", """
SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS distinct_values,
       CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high
FROM lineitem GROUP BY l_orderkey
HAVING NOT (count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*))""")
def sequence_gaps(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return timeline.sequence_gaps(rows, ["l_orderkey"], "l_linenumber")


@query("coverage_audit", """
WITH i AS (SELECT DISTINCT l_orderkey, (l_linenumber - 1) * 20.0::DOUBLE AS start, (l_linenumber - 1) * 20 + l_quantity AS "end" FROM lineitem),
g AS (SELECT *, lag("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end") AS prev,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY start DESC, "end" DESC) AS r FROM i),
f AS (SELECT l_orderkey, min(start) AS first, max("end") FILTER (r = 1) AS last, count(*) FILTER (start > prev + 0.5) AS gaps FROM g GROUP BY ALL)
SELECT o_orderkey AS l_orderkey, coalesce(gaps, 0) AS gaps,
       coalesce(first <= 0.5 AND last >= o_totalprice / 2000 - 2 AND gaps = 0, false) AS complete
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def coverage_audit(spark, sf):
    begin = (F.col("l_linenumber") - 1) * 20.0
    spans = table(spark, sf, "lineitem").select("l_orderkey", begin.alias("start"), (begin + F.col("l_quantity")).alias("end"))
    lengths = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 2000).alias("duration"))
    return timeline.coverage_audit(spans, lengths, ["l_orderkey"])


@query("overlap_windows", """
WITH s AS (
  SELECT CAST(conv_id AS VARCHAR) AS episode_id, turn + 1 AS source_index, length(text) / 4 AS d,
         coalesce(CAST(sum(CAST(round(length(text) / 4 * 1000000) AS BIGINT)) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) / 1000000 AS before
  FROM conversations),
w AS (SELECT *, unnest(range(CAST(greatest(1, ceil(d / 60)) AS BIGINT))) AS i FROM s),
x AS (SELECT *, greatest(0.0, i * 60.0 - CASE WHEN i > 0 THEN 1.5 ELSE 0.0 END)::DOUBLE AS b, least(d, (i + 1) * 60.0)::DOUBLE AS e FROM w)
SELECT episode_id, source_index, i + 1 AS source_chunk_index, round(b, 6) AS source_offset_seconds,
       round(before + b, 6) AS global_offset_seconds, round(greatest(0.01, e - b), 6) AS duration_seconds FROM x""")
def overlap_windows(spark, sf):
    sources = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("episode_id"), (F.col("turn") + 1).alias("source_index"),
        (F.length("text") / 4).alias("duration_seconds"))
    return timeline.plan_windows(sources, 60.0, 1.5)


_SAMPLES = """
  d AS (SELECT episode_id, max(coalesce(nullif(end_seconds, 0), start_seconds)) AS d FROM v_segments GROUP BY ALL),
  p AS (SELECT episode_id, d, CASE WHEN d <= 2 THEN 1 ELSE least(16, greatest(1, CAST(floor(d / 2) AS BIGINT))) END AS n FROM d),
  q AS (SELECT episode_id, d, n, unnest(range(1, n + 1)) AS sample_id FROM p),
  samples AS (SELECT episode_id, sample_id, round(CASE WHEN d <= 2 THEN d / 2 ELSE sample_id * d / (n + 1) END, 3) AS seconds FROM q)
"""


def _samples(spark, sf):
    return timeline.sample_times(transcripts.durations(views.segments(spark, sf)), 16)


@query("sample_times", with_views("v_segments", _SAMPLES + "SELECT * FROM samples"))
def sample_times(spark, sf):
    return _samples(spark, sf)


@query("sample_asof_segment", with_views("v_segments", _SAMPLES + """
SELECT s.episode_id, sample_id, seconds, segment_id
FROM samples s ASOF LEFT JOIN v_segments g ON g.episode_id = s.episode_id AND s.seconds >= g.start_seconds"""))
def sample_asof_segment(spark, sf):
    return timeline.segment_at(_samples(spark, sf), views.segments(spark, sf))


@query("duration_complete", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_discount > 0 THEN abs(l_extendedprice - l_extendedprice * (1 + l_discount / 10)) <= greatest(3.0, l_extendedprice * (1 + l_discount / 10) * 0.005)
            ELSE l_extendedprice > 0 END AS complete FROM lineitem""")
def duration_complete(spark, sf):
    actual = F.col("l_extendedprice")
    expected = F.when(F.col("l_discount") > 0, actual * (1 + F.col("l_discount") / 10))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice",
        timeline.duration_complete(actual, expected).alias("complete"))


@query("progress_eta", """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS episode_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) AS total,
                  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS elapsed FROM events GROUP BY user_id),
r AS (SELECT *, CASE WHEN completed > 0 AND elapsed > 0 THEN completed / elapsed END AS rate FROM p)
SELECT episode_id, completed, total, round(completed / total * 100, 1) AS percent, round(elapsed, 1) AS elapsed_seconds,
       round((total - completed) / rate, 1) AS eta_seconds, CASE WHEN completed = total THEN 'complete' ELSE 'running' END AS status FROM r""")
def progress_eta(spark, sf):
    steps = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("done"))
    return timeline.progress(steps)


@query("turn_documents", with_views("v_clean", """
SELECT turn_no AS event_id, start, "end", speaker FROM v_clean"""))
def turn_documents(spark, sf):
    """Each event as a turn document, in the shapes such files come in."""
    from earmark.sources.evidence import parse_turns

    raw = _raw_turns(spark, sf)
    k = F.col("turn_no") % 3
    plain = F.struct("start", "end", "speaker")
    other = F.struct(F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.col("speaker").alias("label"))
    text = F.when(k == 0, F.to_json(F.array(plain))).when(k == 1, F.to_json(F.struct(F.array(other).alias("turns")))).otherwise(
        F.to_json(F.struct(F.array(plain).alias("segments"))))
    docs = raw.select(F.col("turn_no").cast("string").alias("episode_id"), text.alias("text"))
    rows = timeline.clean_turns(parse_turns(docs))
    return rows.select(F.col("episode_id").cast("long").alias("event_id"), "start", "end", "speaker")
