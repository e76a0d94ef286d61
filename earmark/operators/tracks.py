"""Platform metadata: subtitle tracks, audio streams, compact records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold
from earmark.functions.urls import sanitize_url, suffix


def requested_languages(spec: Column) -> Column:
    """Concrete languages of a comma-separated wish list, in order."""
    parts = F.transform(F.split(spec, ","), lambda p: F.btrim(p))
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "all") & ~F.startswith(p, F.lit("-")))


def _plain(c: Column) -> Column:
    return F.replace(casefold(c), F.lit("_"), F.lit("-"))


def language_tier(available: Column, wanted: Column) -> Column:
    """0 same, 1 same Chinese script, 2 same base language; else null."""
    a, w = _plain(available), _plain(wanted)
    return (
        F.when(a == w, 0).when(a.isin(fixed.SIMPLIFIED) & w.isin(fixed.SIMPLIFIED), 1)
        .when(a.isin(fixed.TRADITIONAL) & w.isin(fixed.TRADITIONAL), 1)
        .when(F.split(a, "-", 2)[0] == F.split(w, "-", 2)[0], 2))


def _target_list(requested: Column, source: Column) -> Column:
    """First wish, source language, other wishes; each language once."""
    said = F.when(F.coalesce(source, F.lit("")) != "", F.array(source)).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.slice(requested, 1, 1), said, F.when(F.size(requested) > 1, F.slice(requested, 2, F.greatest(F.size(requested), F.lit(1))))
                     .otherwise(F.array().cast("array<string>")))
    folded = F.transform(every, casefold)
    return F.filter(every, lambda x, i: F.array_position(folded, casefold(x)) == i + 1)


def rank_tracks(media: DataFrame, tracks: DataFrame, limit: int = fixed.MAX_TRACKS) -> DataFrame:
    """Tracks to try for each media item, best first.

    ``media``: ``media_id, requested`` (text), ``language``; ``tracks``:
    ``media_id, kind`` (``human``/``automatic``), ``language``. All human tracks
    come before automatic ones; automatic ones try the source language first.
    """
    wishes = media.select("media_id", "language", _target_list(requested_languages(F.col("requested")), F.col("language")).alias("t"))
    said = F.when(F.coalesce("language", F.lit("")) != "", F.array("language")).otherwise(F.array().cast("array<string>"))
    per_kind = F.array(
        F.struct(F.lit("human").alias("kind"), F.lit(0).alias("kind_no"), F.col("t").alias("targets")),
        F.struct(F.lit("automatic").alias("kind"), F.lit(1).alias("kind_no"), F.concat(said, "t").alias("targets")))
    targets = wishes.select("media_id", F.explode(per_kind).alias("k")).select(
        "media_id", "k.kind", "k.kind_no", F.posexplode("k.targets").alias("target_no", "target"))
    usable = tracks.where(F.lower("language") != "live_chat").select("media_id", "kind", F.col("language").alias("track")).distinct()
    rows = targets.join(usable, ["media_id", "kind"]).withColumn("tier", language_tier(F.col("track"), F.col("target"))).where("tier IS NOT NULL")
    best = rows.groupBy("media_id", "kind", "kind_no", "target_no").agg(
        F.min_by("track", F.struct("tier", _plain(F.col("track")).alias("p"), "track")).alias("track"))
    once = best.groupBy("media_id", "kind", "kind_no", casefold(F.col("track")).alias("_t")).agg(
        F.min(F.struct("target_no", "track")).alias("m"))
    order = Window.partitionBy("media_id").orderBy("kind_no", "m.target_no")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(
        "media_id", "place", "kind", F.col("m.track").alias("language"))


def best_subtitle(files: DataFrame, languages: list[str]) -> DataFrame:
    """One transcript file per episode by language, format and name."""
    name = F.element_at(F.split("path", "/"), -1)
    plain = _plain(name)
    language = F.lit(len(languages))
    for i, wanted in reversed(list(enumerate(languages))):
        w = wanted.lower()
        language = F.when(F.contains(plain, F.lit(f".{w}")) | F.contains(plain, F.lit(f"-{w}.")), i).otherwise(language)
    end = suffix(F.col("path"))
    form = F.when(end == ".vtt", 0).when(end == ".srt", 1).when(end == ".json", 2).when(end == ".txt", 3).otherwise(9)
    return files.where(end.isin(fixed.TRANSCRIPT_SUFFIXES)).groupBy("episode_id").agg(
        F.min_by("path", F.struct(language.alias("l"), form.alias("f"), name.alias("n"), F.col("path"))).alias("path"))


def best_stream(streams: DataFrame) -> DataFrame:
    """The audio stream of most bandwidth (else highest id); first on ties.

    ``streams``: ``media_id, position, bandwidth, stream_id, url``.
    """
    rate = F.coalesce(F.nullif("bandwidth", F.lit(0)), "stream_id", F.lit(0)).cast("long")
    return streams.groupBy("media_id").agg(F.max_by("url", F.struct(rate.alias("r"), -F.col("position"))).alias("url"))


def compact_metadata(raw: DataFrame) -> DataFrame:
    """Keep what is worth keeping; signed media addresses are not."""
    pick = lambda first, second: F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    keys = lambda c: F.coalesce(F.array_sort(F.map_keys(c)), F.array().cast("array<string>"))
    return raw.select(
        "media_id", "title", pick("extractor_key", "extractor").alias("extractor"), pick("uploader", "channel").alias("uploader"),
        "duration_seconds", "language", sanitize_url(pick("webpage_url", "original_url")).alias("webpage_url"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        keys("subtitles").alias("available_subtitles"), keys("automatic_captions").alias("available_automatic_captions"))
