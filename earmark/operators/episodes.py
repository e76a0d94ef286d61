"""Episode records: upserts, reuse, inventories, audits, clean-up, sharing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import let, redact_paths, slug, strip
from earmark.functions.urls import sanitize_url, source_key, suffix

_EP = "episode_id"
READY = ["ready", "ready_for_analysis", "analyzed"]


def episode_key(kind: Column, title: Column, locator: Column) -> Column:
    """Readable key: platform folder, title slug and source key."""
    return F.concat(slug(F.replace(kind, F.lit("local_"), F.lit("local")), "source"), F.lit("/"), slug(title), F.lit("-"), source_key(locator))


def upsert(current: DataFrame, incoming: DataFrame, source_columns: Sequence[str]) -> DataFrame:
    """One row per episode: the newest record with the first-seen source.

    ``updated_at`` orders the records. Grouped with ``max_by``/``min_by``, so
    all versions of an episode are combined before the shuffle.
    """
    rows = current.unionByName(incoming, allowMissingColumns=True)
    newest = [F.max_by(c, "updated_at").alias(c) for c in rows.columns if c not in (_EP, *source_columns)]
    first = [F.min_by(c, "updated_at").alias(c) for c in source_columns]
    return rows.groupBy(_EP).agg(*newest, *first)


def write_episodes(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Episode table by hash of the episode; only touched buckets are replaced."""
    (rows.withColumn("bucket", F.pmod(F.xxhash64(_EP), F.lit(buckets)).cast("int")).repartition("bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def reusable(episodes: DataFrame, artifacts: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether what exists already answers a request (``mode, languages``)."""
    end, name = suffix(F.col("path")), F.element_at(F.split("path", "/"), -1)
    media = F.col("category") == "media"
    has = artifacts.groupBy(_EP).agg(
        F.bool_or(name == "source.json").alias("has_source"),
        F.bool_or(media & end.isin(fixed.VIDEO_SUFFIXES)).alias("has_video"),
        F.bool_or(media & end.isin(fixed.AUDIO_SUFFIXES)).alias("has_audio"))
    rows = requests.join(episodes, _EP).join(has, _EP, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    normalized = F.col("transcript_status") == "normalized"
    mode = F.col("mode")
    fits = (
        F.when(mode.eqNullSafe(F.col("request_mode")) & F.col("languages").eqNullSafe(F.col("request_languages")), F.lit(True))
        .when(mode == "metadata", flag("has_source")).when(mode == "subtitles", normalized)
        .when(mode == "auto", F.col("status").isin("ready_for_analysis", "needs_transcription", "analyzed"))
        .when(mode == "video", flag("has_video")).when(mode == "audio", flag("has_audio"))
        .when(mode == "all", normalized & flag("has_audio")).otherwise(F.lit(False)))
    return rows.select(_EP, "mode", flag(fits).alias("reusable"))


def stale_items(cached: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Why cached results cannot be reused; unchanged items give no row.

    Both sides: key, ``settings``, ``size_bytes``, ``modified``, ``sha256``.
    """
    key, fields = list(key), ["settings", "size_bytes", "modified", "sha256"]
    old = cached.select(*key, F.lit(True).alias("_old"), *[F.col(c).alias(f"o_{c}") for c in fields])
    both = current.select(*key, F.lit(True).alias("_new"), *fields).join(old, key, "full_outer")
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    reason = (
        F.when(F.col("_old").isNull(), F.lit("not_cached")).when(F.col("_new").isNull(), F.lit("source_removed"))
        .when(changed("settings"), F.lit("settings_changed"))
        .when(changed("size_bytes") | changed("modified") | changed("sha256"), F.lit("source_fingerprint_changed")))
    return both.select(*key, reason.alias("reason")).where("reason IS NOT NULL")


def _climbs_out(steps: Column) -> Column:
    """Whether the steps of a path lead above its beginning at any point."""
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda so_far, step: let(
        so_far["at"] + F.when(step == "..", -1).when(step.isin("", "."), 0).otherwise(1),
        lambda at: F.struct(at.alias("at"), F.least(so_far["least"], at).alias("least"))))
    return depth["least"] < 0


def dangling_artifacts(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed artifacts that are absent, or whose path leaves the episode."""
    steps = F.split("path", "/")
    escapes = F.startswith("path", F.lit("/")) | F.regexp_like("path", F.lit(r"^[A-Za-z]:[\\/]")) | _climbs_out(steps)
    rows = listed.withColumn("escapes", escapes)
    missing = rows.where("NOT escapes").join(files.select(_EP, "path").distinct(), [_EP, "path"], "left_anti")
    return rows.where("escapes").select(_EP, "path", F.lit("escapes_episode").alias("problem")).unionByName(
        missing.select(_EP, "path", F.lit("missing").alias("problem")))


def media_union(*sources: DataFrame) -> DataFrame:
    """Audio paths from several listings, each once, earlier listings first."""
    rows = None
    for i, source in enumerate(sources):
        part = source.select(_EP, "path", "position").withColumn("source", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    audio = suffix(F.col("path")).isin(fixed.AUDIO_SUFFIXES) & ~F.array_contains(F.split("path", "/"), "audio-chunks")
    return rows.where(audio).groupBy(_EP, "path").agg(F.min(F.struct("source", "position")).alias("m")).select(
        _EP, "path", "m.source", "m.position")


def reclaimable(files: DataFrame, scope: str = "cache") -> DataFrame:
    """What a clean-up of ``cache``, ``media`` or ``all`` would remove.

    Cache folders count as one target; knowledge files are never listed.
    Ordered consumers sort by ``depth`` and ``target``, both descending.
    """
    top, name = F.split("path", "/")[0], F.element_at(F.split("path", "/"), -1)
    nested = F.size(F.split("path", "/")) > 1
    target = F.lit(None).cast("string")
    if scope in ("media", "all"):
        target = F.when(~nested & suffix(F.col("path")).isin(fixed.MEDIA_SUFFIXES) & ~name.isin(fixed.PRESERVED_NAMES), F.col("path")).otherwise(target)
    if scope in ("cache", "all"):
        folder = F.when(top.isin(fixed.CACHE_DIRS) & nested, top)
        part = F.when(F.endswith("path", F.lit(".part")), F.col("path"))
        # A partial file inside a cache folder is a target of its own as well.
        targets = F.array_distinct(F.array_compact(F.array(folder, part, target)))
    else:
        targets = F.array_compact(F.array(target))
    rows = files.select(_EP, "size_bytes", F.explode(targets).alias("target"))
    return rows.groupBy(_EP, "target").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")).withColumn(
        "depth", F.size(F.split("target", "/")).cast("long"))


def contract_audit(
    episodes: DataFrame, segments: DataFrame, chunks: DataFrame, files: DataFrame, manifests: DataFrame | None = None,
) -> DataFrame:
    """Structural errors and warnings per episode (``level, rule``).

    ``episodes``: ``episode_id, source_input, status, transcript_status,
    next_actions``; ``chunks``: ``episode_id, chunk_id, text, last_segment``
    or any segment bound in ``segment_count``; ``files``: ``episode_id, path``.
    """
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    seg = segments.groupBy(_EP).agg(F.count("*").alias("segments"), F.count_if(blank(F.col("text"))).alias("empty_segments"))
    chk = chunks.groupBy(_EP).agg(
        F.count("*").alias("chunks"), F.count_if(blank(F.col("text")) | F.col("chunk_id").isNull()).alias("empty_chunks"),
        F.max("segment_count").alias("indexed"))
    name = F.col("path")
    held = files.groupBy(_EP).agg(
        F.bool_or(name == "source.json").alias("source"), F.bool_or(name == "analysis.md").alias("analysis"),
        F.bool_or(name == "evidence.json").alias("evidence"), F.bool_or(name == "reader.html").alias("reader"),
        F.bool_or(F.endswith(name, F.lit(".part"))).alias("partial"))
    rows = episodes.join(seg, _EP, "left").join(chk, _EP, "left").join(held, _EP, "left")
    if manifests is not None:
        rows = rows.join(manifests.select(_EP, F.col("status").alias("manifest_status")), _EP, "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    ready = F.col("status").isin(READY) | F.coalesce(F.col("transcript_status") == "normalized", F.lit(False))
    done = F.col("status") == "analyzed"
    rule = lambda test, level, text: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(text).alias("rule")))
    rules = [
        rule(blank(F.col("source_input")), "error", "source_identity"), rule(blank(F.col("status")), "error", "status"),
        rule(F.coalesce(F.size("next_actions"), F.lit(0)) <= 0, "error", "next_actions"),
        rule(~has("source"), "error", "source_missing"),
        rule(ready & F.col("segments").isNull(), "error", "transcript_missing"),
        rule(ready & F.col("chunks").isNull(), "error", "chunks_missing"),
        rule(F.col("empty_segments") > 0, "error", "transcript_text"), rule(F.col("empty_chunks") > 0, "error", "chunks_text"),
        rule(F.col("indexed") != F.col("segments"), "warning", "segment_count_differs"),
        rule(done & ~has("analysis"), "error", "analysis_missing"), rule(done & ~has("evidence"), "error", "evidence_missing"),
        rule(done & ~has("reader"), "error", "reader_missing"), rule(has("partial"), "warning", "partial_files"),
    ]
    if manifests is not None:
        rules.append(rule(F.col("manifest_status") != "complete", "error", "manifest_incomplete"))
    return rows.select(_EP, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(_EP, "r.level", "r.rule")


def completion_gate(episodes: DataFrame, inputs: DataFrame, violations: DataFrame) -> DataFrame:
    """Mark episodes ``analyzed`` where all inputs exist and nothing is violated.

    ``inputs``: ``episode_id`` and boolean columns; ``violations``: rows with
    ``episode_id``. Adds ``valid`` and ``next_actions`` text.
    """
    flags = [c for c in inputs.columns if c != _EP]
    bad = violations.groupBy(_EP).agg(F.count("*").alias("violations"))
    rows = episodes.join(inputs, _EP, "left").join(bad, _EP, "left")
    whole = F.lit(True)
    for c in flags:
        whole = whole & F.coalesce(F.col(c), F.lit(False))
    valid = whole & F.col("violations").isNull()
    return rows.select(
        _EP, F.when(valid, F.lit("analyzed")).otherwise(F.col("status")).alias("status"), valid.alias("valid"),
        F.coalesce("violations", F.lit(0).cast("long")).alias("violations"),
        F.when(valid, F.lit("answer questions; export collections")).otherwise(F.lit("fix violations")).alias("next_actions"))


def shared_files(files: DataFrame, profile: str = "share", full_text: bool = False) -> DataFrame:
    """Files a ``share``, ``portable`` or ``archive`` export would hold."""
    path, steps = F.col("path"), F.split("path", "/")
    name = F.element_at(steps, -1)
    chosen = path.isin(fixed.ALWAYS_SHARED) | F.startswith(path, F.lit("frames/"))
    if profile in ("portable", "archive") and full_text:
        chosen = chosen | path.isin(fixed.FULL_TEXT_NAMES) | F.startswith(path, F.lit("translations/"))
    if profile == "archive":
        kept = ~F.endswith(path, F.lit(".part")) & ~F.array_contains(steps, ".invalid-cache")
        if not full_text:
            kept = kept & ~(F.startswith(name, F.lit("transcript")) | (name == "chunks.json"))
        chosen = chosen | kept
    return files.where(chosen)


def sanitize_text(text: Column, root: Column | None = None) -> Column:
    return redact_paths(text, root)


def plain_escapes(text: Column) -> Column:
    r"""JSON text with ``\/`` and the ``\u00xx`` of printable ASCII written out, so that no address hides in escapes.

    The value stays the same: quotes and backslashes keep their escapes, and an
    escaped backslash before ``u`` or ``/`` isn't taken for an escape.
    """
    even = r"(?<!\\)((?:\\\\)*)\\"  # the backslash that begins an escape: those before it are pairs
    slashes = F.regexp_replace(text, F.lit(even + "/"), F.lit("$1/"))
    found = F.array_distinct(F.regexp_extract_all(slashes, F.lit(even + r"(u00(?:2[013-9a-fA-F]|[3467][0-9a-fA-F]|5[0-9abd-fABD-F]))"), 2))

    def written(so_far: Column, e: Column) -> Column:
        letter = F.decode(F.unhex(F.substring(e, 4, 2)), "UTF-8")
        return F.regexp_replace(so_far, F.concat(F.lit(even), e), F.concat(F.lit("$1\\"), letter))

    return F.aggregate(found, slashes, written)


def sanitize_json(text: Column, root: Column | None = None) -> Column:
    """JSON text whose web addresses and local paths inside strings are made safe.

    Strings that begin with an address are decoded, rewritten one by one with
    trackers dropped, and encoded again, whatever else they hold; absolute
    paths keep their last step.
    """
    text = plain_escapes(text)
    strings = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?<!\\)("(?i:https?)://[^"\\]*+(?:\\.[^"\\]*+)*+")'), 1))

    def rewritten(one: Column) -> Column:
        inner = F.substr(one, F.lit(2), F.length(one) - 2)
        plain = F.from_json(F.concat(F.lit("["), one, F.lit("]")), "array<string>", {"allowUnquotedControlChars": "true"})[0]
        safe = F.to_json(F.array(sanitize_url(F.coalesce(plain, inner), drop_trackers=True)))
        return F.substr(safe, F.lit(2), F.length(safe) - 2)

    safe = F.aggregate(strings, text, lambda acc, one: F.replace(acc, one, rewritten(one)))
    if root is not None:
        safe = F.replace(safe, F.concat(F.lit('"'), root, F.lit("/")), F.lit('"'))
    return F.regexp_replace(safe, r'"/(?:[^"/\\]+/)*([^"/\\]+)"', r'"[LOCAL_PATH_REDACTED]/$1"')


def export_manifest(files: DataFrame, profile: str = "share", full_text: bool = False) -> DataFrame:
    """``episode_id, path, size_bytes, sha256`` after sanitizing the texts."""
    end = suffix(F.col("path"))
    text = F.when(end == ".json", sanitize_json(F.col("text"))).when(
        end.isin(".md", ".html", ".txt", ".vtt", ".srt", ".csv"), sanitize_text(F.col("text"))).otherwise(F.col("text"))
    return shared_files(files, profile, full_text).withColumn("text", text).select(
        _EP, "path", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
