"""Work on time ranges: speakers, global timelines, coverage, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions.times import epoch_micros, micros
from earmark.operators.ordered import position_block, scan
from earmark.session import materialize

BUCKET_SECONDS = 30
_EP = "episode_id"


def clean_turns(raw: DataFrame) -> DataFrame:
    """Speaker turns with usable numbers and a name; alternative fields merged.

    Input columns, all optional but the episode and order: ``start_seconds``
    or ``start``, ``end_seconds`` or ``end``, ``speaker`` or ``label``.
    """
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None))
    return raw.select(
        _EP, "turn_no", pick("start_seconds", "start").cast("double").alias("start"),
        pick("end_seconds", "end").cast("double").alias("end"),
        F.coalesce(*[F.nullif(n, F.lit("")) for n in ("speaker", "label") if n in raw.columns]).alias("speaker"),
    ).where("start IS NOT NULL AND `end` >= start AND speaker IS NOT NULL")


def speaker_overlap(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """``episode_id, segment_id, speaker, overlap`` (microseconds, > 0).

    No segment meets a turn directly. For one speaker the time covered up to
    ``t`` is ``n(t) * t - s(t)``, with ``n`` the turns open at ``t`` and ``s`` a
    sum of edges, so a segment's overlap is that value at its end minus that
    at its start. Edges are first added up per distinct time; running sums go
    through time buckets. Speakers are looked up per bucket, so a segment only
    meets speakers whose turns come near it.
    """
    bucket = BUCKET_SECONDS * 1000000
    edges = turns.select(_EP, "speaker", F.explode(F.array(
        F.struct(micros(F.col("start")).alias("t"), F.lit(1).alias("n")),
        F.struct(micros(F.col("end")).alias("t"), F.lit(-1).alias("n")))).alias("e"))
    edges = edges.groupBy(_EP, "speaker", F.col("e.t").alias("t")).agg(F.sum("e.n").alias("n"))
    near = turns.select(_EP, "speaker", F.explode(F.sequence(
        F.floor(micros(F.col("start")) / bucket), F.floor(micros(F.col("end")) / bucket))).alias("b")).distinct()
    spans = segments.where("start_seconds IS NOT NULL AND end_seconds >= start_seconds").select(
        _EP, "segment_id", micros(F.col("start_seconds")).alias("t0"), micros(F.col("end_seconds")).alias("t1"))
    pairs = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket)))) \
        .join(near, [_EP, "b"]).select(_EP, "segment_id", "speaker", "t0", "t1").distinct()
    pairs = materialize(pairs, "speaker-pairs")
    marks = pairs.select(_EP, "segment_id", "speaker", F.explode(F.array(
        F.struct(F.col("t0").alias("t"), F.lit(-1).alias("sign")),
        F.struct(F.col("t1").alias("t"), F.lit(1).alias("sign")))).alias("m")).select(
        _EP, "segment_id", "speaker", "m.t", "m.sign")
    asked = marks.select(_EP, "speaker", "t").distinct()
    moments = edges.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy(_EP, "speaker", "t").agg(F.sum("n").alias("n"))
    n, t = F.col("n"), F.col("t")
    moments = scan(moments, [_EP, "speaker"], ["t"], F.floor(t / bucket), total={
        "_n": n, "_s": n.cast("decimal(38,0)") * t})
    opened = F.coalesce("_n", F.lit(0)) + n
    edge_sum = F.coalesce("_s", F.lit(0)) + n.cast("decimal(38,0)") * t
    covered = moments.select(_EP, "speaker", "t", (opened * t - edge_sum).cast("long").alias("c"))
    return marks.join(covered, [_EP, "speaker", "t"]).groupBy(_EP, "segment_id", "speaker").agg(
        F.sum(F.col("sign") * F.col("c")).alias("overlap")).where("overlap > 0")


def assign_speakers(segments: DataFrame, turns: DataFrame, least: float = 0.35) -> DataFrame:
    """Give each segment the speaker who talks most during it.

    Ties go to the speaker whose turn comes first. Below ``least`` of the
    segment's length the old speaker stays. Adds ``speaker_confidence``: null
    for untimed rows, 0.0 where nobody talks, and ``assigned``.
    """
    first = turns.groupBy(_EP, "speaker").agg(F.min("turn_no").alias("first"))
    spoken = speaker_overlap(segments, turns).join(first, [_EP, "speaker"])
    best = spoken.groupBy(_EP, "segment_id").agg(
        F.max("overlap").alias("overlap"), F.max_by("speaker", F.struct("overlap", -F.col("first"))).alias("_who"))
    opening = first.groupBy(_EP).agg(F.min_by("speaker", "first").alias("_first_speaker"))
    rows = segments.join(best, [_EP, "segment_id"], "left").join(opening, _EP, "left")
    timed = F.col("start_seconds").isNotNull() & (F.col("end_seconds") >= F.col("start_seconds")) & F.col("_first_speaker").isNotNull()
    length = F.greatest(F.lit(1000), micros(F.col("end_seconds")) - micros(F.col("start_seconds")))
    sure = F.when(timed, F.round(F.least(F.lit(1.0), F.coalesce("overlap", F.lit(0)) / length), 4))
    taken = F.coalesce(sure >= least, F.lit(False))
    return rows.withColumns({"speaker_confidence": sure, "assigned": taken}).withColumn(
        "speaker", F.when(F.col("assigned"), F.coalesce("_who", "_first_speaker")).otherwise(F.col("speaker"))
    ).drop("overlap", "_who", "_first_speaker")


def diarization_coverage(assigned: DataFrame) -> DataFrame:
    n, total = F.count_if("assigned"), F.count("*")
    return assigned.groupBy(_EP).agg(
        n.alias("assigned_segments"), total.alias("total_segments"), F.round(n / total, 4).alias("coverage"))


def global_timeline(chunk_segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Chunk-local times moved onto the episode's timeline.

    Joined on (episode, chunk), so the work is spread by chunk and the size of
    neither side matters. Adds ``chunk_sequence``.
    """
    offset = F.coalesce("global_offset_seconds", F.lit(0.0))
    move = lambda c: F.round(F.col(c) + offset, 6)
    joined = chunk_segments.join(
        windows.select(_EP, "chunk_key", F.col("sequence").alias("chunk_sequence"), "global_offset_seconds"), [_EP, "chunk_key"])
    return joined.withColumns({"start_seconds": move("start_seconds"), "end_seconds": move("end_seconds")}).drop(
        "global_offset_seconds", "chunk_key")


def missing_chunks(windows: DataFrame, chunk_segments: DataFrame) -> DataFrame:
    """Planned chunks that have no transcript yet."""
    return windows.join(chunk_segments.select(_EP, "chunk_key").distinct(), [_EP, "chunk_key"], "left_anti")


def timeline_status(windows: DataFrame, chunk_segments: DataFrame) -> DataFrame:
    """``partial`` or ``complete`` per episode, with chunk counts."""
    done = chunk_segments.select(_EP, "chunk_key").distinct().withColumn("done", F.lit(1))
    counts = windows.join(done, [_EP, "chunk_key"], "left").groupBy(_EP).agg(
        F.count("done").alias("completed_chunks"), F.count("*").alias("total_chunks"))
    return counts.withColumn("status", F.when(F.col("completed_chunks") < F.col("total_chunks"), F.lit("partial")).otherwise(F.lit("complete")))


def sequence_gaps(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Groups whose index is not exactly 1, 2, …, n."""
    exact = rows.groupBy(*keys, index).agg(F.count("*").alias("times")).groupBy(*keys).agg(
        F.sum("times").alias("rows"), F.count(index).alias("values"), F.min(index).alias("low"), F.max(index).alias("high"))
    fine = (F.col("rows") == F.col("values")) & (F.col("low") == 1) & (F.col("high") == F.col("rows"))
    return exact.where(~F.coalesce(fine, F.lit(False))).select(*keys, "rows", F.col("values").alias("distinct_values"), "low", "high")


def coverage_audit(intervals: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Whether intervals cover their source: start, end and no gap over 0.5 s.

    ``intervals``: keys, ``start``, ``end``; ``durations``: keys, ``duration``.
    """
    # Per start only the longest interval meets the next one; shorter ones can
    # break the cover only by ending before they begin.
    late = F.col("end") + 0.5 < F.col("start")
    spans = intervals.select(*keys, "start", "end").distinct().groupBy(*keys, "start").agg(
        F.max("end").alias("end"), F.count_if(late).alias("_bad"))
    spans = spans.withColumn("_bad", F.col("_bad") - late.cast("long"))
    spans = scan(spans, keys, ["start"], F.floor(F.col("start") / 3600), lag={"_end": F.col("end")})
    found = spans.groupBy(*keys).agg(
        F.min("start").alias("first"), F.max_by("end", "start").alias("last"),
        (F.count_if(F.col("start") > F.col("_end") + 0.5) + F.sum("_bad")).alias("gaps"))
    rows = durations.join(found, keys, "left")
    whole = (F.col("first") <= 0.5) & (F.col("last") >= F.col("duration") - 2) & (F.col("gaps") == 0)
    return rows.select(*keys, F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce(whole, F.lit(False)).alias("complete"))


def plan_windows(sources: DataFrame, length: float, overlap: float) -> DataFrame:
    """Windows over ordered sources, each but the first starting a bit early.

    ``sources``: ``episode_id, source_index, duration_seconds``.
    """
    timed = scan(sources, [_EP], ["source_index"], position_block("source_index"),
                 total={"_before": micros(F.col("duration_seconds"))})
    count = F.greatest(F.lit(1), F.ceil(F.col("duration_seconds") / length))
    rows = timed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    begin = F.greatest(F.lit(0.0), F.col("i") * length - F.when(F.col("i") > 0, overlap).otherwise(0.0))
    finish = F.least(F.col("duration_seconds"), (F.col("i") + 1) * length)
    return rows.select(
        _EP, "source_index", (F.col("i") + 1).alias("source_chunk_index"), F.round(begin, 6).alias("source_offset_seconds"),
        F.round(F.coalesce("_before", F.lit(0)) / 1000000 + begin, 6).alias("global_offset_seconds"),
        F.round(F.greatest(F.lit(0.01), finish - begin), 6).alias("duration_seconds"))


def sample_times(episodes: DataFrame, count: int) -> DataFrame:
    """Evenly spaced sample times of each episode's ``duration``."""
    d = F.col("duration")
    n = F.least(F.lit(count), F.greatest(F.lit(1), F.floor(d / 2))).cast("int")
    points = F.when(d <= 2, F.array(F.greatest(F.lit(0.0), d / 2))).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: i * d / (n + 1)))
    return episodes.select(_EP, F.posexplode(points).alias("i", "at")).select(
        _EP, (F.col("i") + 1).cast("long").alias("sample_id"), F.round("at", 3).alias("seconds"))


def segment_at(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """The last segment that began at or before each sample (as-of join)."""
    # Of segments that begin together only the last can be in force.
    begun = segments.where("start_seconds IS NOT NULL").groupBy(_EP, F.col("start_seconds").alias("t")).agg(
        F.max(F.col("segment_id").cast("long")).alias("n")).select(_EP, "t", F.lit(0).alias("kind"), "n")
    asked = samples.select(_EP, F.col("seconds").alias("t"), F.lit(1).alias("kind"), F.col("sample_id").cast("long").alias("n"))
    line = scan(begun.unionByName(asked), [_EP], ["t", "kind", "n"], F.floor(F.col("t") / BUCKET_SECONDS),
                latest={"segment_id": F.when(F.col("kind") == 0, F.col("n"))})
    return line.where("kind = 1").select(_EP, F.col("n").alias("sample_id"), F.col("t").alias("seconds"), "segment_id")


def duration_complete(actual: Column, expected: Column, floor: float = 3.0) -> Column:
    """Close enough to the announced length; anything goes if none is known."""
    known = expected.isNotNull() & (expected > 0)
    return F.when(known, F.abs(actual - expected) <= F.greatest(F.lit(floor), expected * 0.005)).otherwise(actual > 0)


def progress(events: DataFrame) -> DataFrame:
    """Chunks done, percent, rate and time left, per episode.

    ``events``: ``episode_id, at`` (timestamp), ``done`` (boolean).
    """
    at = epoch_micros(F.col("at"))
    n, total = F.count_if("done"), F.count("*")
    rows = events.groupBy(_EP).agg(
        n.alias("completed"), total.alias("total"), ((F.max(at) - F.min(at)) / 1000000).alias("elapsed"))
    return with_eta(rows)


def with_eta(rows: DataFrame) -> DataFrame:
    rate = F.when((F.col("completed") > 0) & (F.col("elapsed") > 0), F.col("completed") / F.col("elapsed"))
    return rows.select(
        _EP, "completed", "total",
        F.when(F.col("total") > 0, F.round(F.col("completed") / F.col("total") * 100, 1)).otherwise(100.0).alias("percent"),
        F.round("elapsed", 1).alias("elapsed_seconds"),
        F.round((F.col("total") - F.col("completed")) / rate, 1).alias("eta_seconds"),
        F.when(F.col("completed") == F.col("total"), F.lit("complete")).otherwise(F.lit("running")).alias("status"))
