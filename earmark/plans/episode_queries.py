"""URLs, tracks, episode records, inventories, clean-up and sharing."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions import fixed, urls
from earmark.functions.text import language_slug, redact_paths, redact_remote_urls, safe_name, slug
from earmark.operators import episodes, tracks
from earmark.plans.registry import query, table
from earmark.sources import files

_URL = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'https://www.YouTube.com/watch?v=a' || page_id || '&utm_source=z&t=9'
  WHEN 2 THEN 'https://www.bilibili.com/video/BV' || page_id || '/?p=2&spm=1' WHEN 3 THEN 'https://youtu.be/k' || page_id || '?si=1'
  WHEN 4 THEN 'https://cdn.example.com/a/' || page_id || '.MP3?token=t&utm_medium=m#x' WHEN 5 THEN '/data/' || page_id || '.vtt'
  WHEN 6 THEN 'ftp://files.example.com/' || page_id ELSE 'http://me:pw@10.0.0.' || page_id % 256 || ':8080/f?sessionid=1&q=2' END"""


def _locators(spark, sf):
    """Page addresses, most of them turned into other kinds of locators."""
    n = F.col("page_id").cast("string")
    kinds = [
        F.col("url"), F.concat(F.lit("https://www.YouTube.com/watch?v=a"), n, F.lit("&utm_source=z&t=9")),
        F.concat(F.lit("https://www.bilibili.com/video/BV"), n, F.lit("/?p=2&spm=1")), F.concat(F.lit("https://youtu.be/k"), n, F.lit("?si=1")),
        F.concat(F.lit("https://cdn.example.com/a/"), n, F.lit(".MP3?token=t&utm_medium=m#x")), F.concat(F.lit("/data/"), n, F.lit(".vtt")),
        F.concat(F.lit("ftp://files.example.com/"), n),
        F.concat(F.lit("http://me:pw@10.0.0."), (F.col("page_id") % 256).cast("string"), F.lit(":8080/f?sessionid=1&q=2"))]
    return table(spark, sf, "pages").select("page_id", F.element_at(F.array(*kinds), (F.col("page_id") % 8 + 1).cast("int")).alias("u"))


@query("classify_urls", f"""
SELECT page_id, u, CASE page_id % 8 WHEN 1 THEN 'youtube' WHEN 2 THEN 'bilibili' WHEN 3 THEN 'youtube' WHEN 4 THEN 'media_url'
       WHEN 5 THEN 'local_transcript' WHEN 6 THEN 'unknown' ELSE 'web_url' END AS kind FROM (SELECT page_id, {_URL} AS u FROM pages)""")
def classify_urls(spark, sf):
    return _locators(spark, sf).withColumn("kind", urls.source_kind(F.col("u")))


@query("unsafe_urls", f"""
SELECT page_id, CASE WHEN page_id % 8 IN (5, 6) THEN 'scheme' ELSE 'credentials' END AS reason FROM pages WHERE page_id % 8 IN (5, 6, 7)
UNION ALL SELECT page_id, 'private_address' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'loopback_name' FROM pages WHERE page_id % 2 = 1""")
def unsafe_urls(spark, sf):
    """Locators that must not be fetched, and the same pages on local hosts."""
    local = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://192.168.1."), (F.col("page_id") % 250).cast("string"), F.lit("/")))\
        .otherwise(F.concat(F.lit("https://n"), F.col("page_id").cast("string"), F.lit(".localhost:80/x")))
    rows = _locators(spark, sf).unionByName(table(spark, sf, "pages").select("page_id", local.alias("u")))
    return rows.select("page_id", urls.unsafe_reason(F.col("u")).alias("reason")).where("reason IS NOT NULL")


_HOST = "lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1))"
_QUERY = r"regexp_extract(u, '\?([^#]*)', 1)"
_PATH = r"regexp_extract(u, '^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)', 1)"


@query("source_keys", rf"""
SELECT page_id, canonical, substr(sha256(canonical), 1, 12) AS source_key FROM (
  SELECT page_id, CASE WHEN starts_with(u, '/') THEN '' ELSE lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' END || {_HOST} || rtrim({_PATH}, '/')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM (SELECT page_id, u, list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND CASE
          WHEN page_id % 8 = 3 THEN false WHEN page_id % 8 = 1 THEN starts_with(x, 'v=') WHEN page_id % 8 = 2 THEN starts_with(x, 'p=')
          ELSE NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)=') END) AS q
        FROM (SELECT page_id, {_URL} AS u FROM pages)))""")
def source_keys(spark, sf):
    return _locators(spark, sf).select("page_id", urls.canonical_url(F.col("u")).alias("canonical"), urls.source_key(F.col("u")).alias("source_key"))


@query("sanitized_urls", rf"""
SELECT page_id, CASE WHEN page_id % 8 IN (5, 6) THEN u ELSE
         lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace({_HOST}, '^.*@', '') || {_PATH}
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS safe,
       CASE WHEN page_id % 8 IN (5, 6) THEN u ELSE lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace({_HOST}, '^.*@', '') || {_PATH} END AS bare,
       CASE WHEN page_id % 8 IN (5, 6) THEN NULL WHEN page_id % 8 = 1 THEN 'https://www.YouTube.com/watch?v=a' || page_id || '&utm_source=z&t=90s'
            WHEN page_id % 8 = 2 THEN 'https://www.bilibili.com/video/BV' || page_id || '/?p=2&spm=1&t=90' WHEN page_id % 8 = 3 THEN u || '&t=90s'
            ELSE regexp_replace(u, '#.*', '') || '#t=90' END AS seek
FROM (SELECT page_id, u, list_transform(list_filter(string_split({_QUERY}, '&'), lambda x: x <> ''), lambda x:
        CASE WHEN regexp_matches(string_split(x, '=')[1], '(?i)token|sig|auth|secret|session|jwt|key|policy|expires?|credential|hdnea')
             THEN string_split(x, '=')[1] || '=%5BREDACTED%5D' ELSE x END) AS q
      FROM (SELECT page_id, {_URL} AS u FROM pages))""")
def sanitized_urls(spark, sf):
    u = F.col("u")
    return _locators(spark, sf).select("page_id", urls.sanitize_url(u).alias("safe"), urls.sanitize_url(u, strip_query=True).alias("bare"),
                                       urls.seek_url(u, F.lit(90.7)).alias("seek"))


@query("media_suffixes", f"""
SELECT page_id, CASE page_id % 8 WHEN 4 THEN '.mp3' ELSE CASE page_id % 3 WHEN 0 THEN '.ogg' WHEN 1 THEN '.mp4' ELSE '.mp3' END END AS suffix FROM pages""")
def media_suffixes(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "audio/OGG; codecs=opus").when(F.col("page_id") % 3 == 1, "video/mp4").otherwise("text/html")
    return _locators(spark, sf).select("page_id", urls.media_suffix(F.col("u"), kind).alias("suffix"))


@query("slugs", r"""
SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]+', '-', 'g'), '\s+', '-', 'g'), '^[ .-]+|[ .-]+$', '', 'g'), 1, 90), ''), 'episode') AS slug,
       coalesce(nullif(regexp_replace(substr(replace(trim(regexp_replace(text, '[^\pL\pN_\-. ]+', '', 'g')), ' ', '-'), 1, 100), '^[.-]+|[.-]+$', '', 'g'), ''), 'x') AS name,
       nullif(regexp_replace(regexp_replace(lang || ' ' || source, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS language
FROM documents""")
def slugs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", slug(F.col("text")).alias("slug"), safe_name(F.col("text"), "x").alias("name"),
        language_slug(F.concat_ws(" ", "lang", "source")).alias("language"))


@query("redacted_text", r"""
SELECT doc_id, regexp_replace(t, 'https?://[^\s''"]+', '[REMOTE_URL_REDACTED]', 'g') AS no_urls,
       regexp_replace(t, '(?:(?:[A-Za-z]:[\\/])|/Users/|/home/)[^\s"''<>]+', '[LOCAL_PATH_REDACTED]', 'g') AS no_paths
FROM (SELECT doc_id, text || ' /home/me/' || doc_id || '.txt see https://cdn.example/' || doc_id || '?sig=1' AS t FROM documents)""")
def redacted_text(spark, sf):
    n = F.col("doc_id").cast("string")
    t = F.concat("text", F.lit(" /home/me/"), n, F.lit(".txt see https://cdn.example/"), n, F.lit("?sig=1"))
    return table(spark, sf, "documents").select("doc_id", redact_remote_urls(t).alias("no_urls"), redact_paths(t).alias("no_paths"))


# --- tracks ---------------------------------------------------------------------------

_LANGS = ["zh-CN", "en", "zh-Hans", "en-orig", "de", "fr-CA", "zh_TW", "EN", "live_chat"]


def _media(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("media_id"),
        F.when(k % 3 == 0, "zh-Hans,en").when(k % 3 == 1, "de, all, fr,-x").otherwise("en_US").alias("requested"),
        F.when(k % 4 == 0, "en").when(k % 4 == 1, "zh-HK").when(k % 4 == 2, "").alias("language"))


def _tracks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("media_id"), F.when(F.col("o_orderstatus") == "F", "human").otherwise("automatic").alias("kind"),
                    F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("language"))


_FOLD = "replace(lower({}), '_', '-')"


@query("track_ranking", f"""
WITH m AS (SELECT c_custkey AS media_id, CASE c_custkey % 3 WHEN 0 THEN ['zh-Hans', 'en'] WHEN 1 THEN ['de', 'fr'] ELSE ['en_US'] END AS req,
                  CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-HK' END AS lang FROM customer),
l AS (SELECT media_id, lang, CASE WHEN lang IS NULL THEN req ELSE [req[1], lang] || req[2:] END AS every FROM m),
o AS (SELECT media_id, lang, list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i) AS t FROM l),
targets AS (
  SELECT media_id, 'human' AS kind, 0 AS kind_no, unnest(t) AS target, unnest(range(len(t))) AS no FROM o
  UNION ALL SELECT media_id, 'automatic', 1, unnest(a), unnest(range(len(a))) FROM (SELECT media_id, CASE WHEN lang IS NULL THEN t ELSE [lang] || t END AS a FROM o)),
tracks AS (SELECT DISTINCT o_custkey AS media_id, CASE WHEN o_orderstatus = 'F' THEN 'human' ELSE 'automatic' END AS kind,
                  {_LANGS}[o_orderkey % 9 + 1] AS track FROM orders WHERE o_orderkey % 9 <> 8),
scored AS (
  SELECT *, CASE WHEN a = w THEN 0 WHEN a IN ('zh-cn', 'zh-hans', 'zh-sg') AND w IN ('zh-cn', 'zh-hans', 'zh-sg') THEN 1
                 WHEN a IN ('zh-tw', 'zh-hant', 'zh-hk', 'zh-mo') AND w IN ('zh-tw', 'zh-hant', 'zh-hk', 'zh-mo') THEN 1
                 WHEN string_split(a, '-')[1] = string_split(w, '-')[1] THEN 2 END AS tier
  FROM (SELECT *, {_FOLD.format('track')} AS a, {_FOLD.format('target')} AS w FROM targets JOIN tracks USING (media_id, kind))),
best AS (SELECT * FROM scored WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media_id, kind, no ORDER BY tier, a, track) = 1),
once AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY media_id, kind, lower(track) ORDER BY no, track) = 1)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY kind_no, no) AS place, kind, track AS language FROM once
QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY kind_no, no) <= 16""")
def track_ranking(spark, sf):
    return tracks.rank_tracks(_media(spark, sf), _tracks(spark, sf)).withColumn("place", F.col("place").cast("long"))


def _subtitle_paths(spark, sf):
    k = F.col("o_orderkey")
    end = F.element_at(F.array(*map(F.lit, [".srt", ".vtt", ".json", ".mp3"])), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("episode_id"), F.concat(
            F.lit("in/show."), F.element_at(F.array(*map(F.lit, _LANGS)), (k % 9 + 1).cast("int")), F.lit("."), k.cast("string"), end).alias("path"))


@query("best_track", f"""
SELECT episode_id, path FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS episode_id, 'in/show.' || {_LANGS}[o_orderkey % 9 + 1] || '.' || o_orderkey || ['.srt', '.vtt', '.json', '.mp3'][o_orderkey % 4 + 1] AS path,
         o_orderkey % 4 AS f FROM orders)
WHERE f <> 3
QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY
  CASE WHEN contains({_FOLD.format('path')}, '.zh-hans') THEN 0 WHEN contains({_FOLD.format('path')}, '.en') THEN 1 ELSE 2 END,
  CASE f WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, path) = 1""")
def best_track(spark, sf):
    return tracks.best_subtitle(_subtitle_paths(spark, sf), ["zh-Hans", "en"])


@query("best_stream", """
SELECT o_custkey AS media_id, 'https://s.example/' || o_orderkey AS url FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END, 0), o_orderkey % 100000) DESC, o_orderkey) = 1""")
def best_stream(spark, sf):
    streams = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("media_id"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 100000).alias("stream_id"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.floor("o_totalprice")).cast("long").alias("bandwidth"),
        F.concat(F.lit("https://s.example/"), F.col("o_orderkey").cast("string")).alias("url"))
    return tracks.best_stream(streams)


@query("compact_metadata", r"""
SELECT page_id AS media_id, 'Page' AS extractor, CASE WHEN page_id % 2 = 0 THEN 'ch' || page_id ELSE 'up' || page_id END AS uploader,
       regexp_replace(url, '#.*', '') AS webpage_url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'en,zh' END AS available_subtitles
FROM pages""")
def compact_metadata(spark, sf):
    n, text = F.col("page_id"), F.col("page_id").cast("string")
    raw = table(spark, sf, "pages").select(
        n.alias("media_id"), F.lit("t").alias("title"), F.lit("").alias("extractor_key"), F.lit("Page").alias("extractor"),
        F.when(n % 2 != 0, F.concat(F.lit("up"), text)).alias("uploader"), F.concat(F.lit("ch"), text).alias("channel"),
        F.lit(1.5).alias("duration_seconds"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("webpage_url"),
        F.col("url").alias("original_url"), F.lit(None).cast("array<string>").alias("tags"),
        F.when(n % 3 != 0, F.create_map(F.lit("zh"), F.lit(1), F.lit("en"), F.lit(2))).alias("subtitles"),
        F.lit(None).cast("map<string,int>").alias("automatic_captions"))
    return tracks.compact_metadata(raw).select("media_id", "extractor", "uploader", "webpage_url",
                                               F.array_join("available_subtitles", ",").alias("available_subtitles"))


# --- episode records --------------------------------------------------------------------


@query("episode_upsert", """
SELECT CAST(o_custkey AS VARCHAR) AS episode_id, max(o_orderkey) AS updated_at, arg_max(o_orderstatus, o_orderkey) AS status,
       'https://s.example/' || arg_min(o_orderpriority, o_orderkey) || '?token=%5BREDACTED%5D' AS source
FROM orders GROUP BY o_custkey""")
def episode_upsert(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("episode_id"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderstatus").alias("status"),
        urls.sanitize_url(F.concat(F.lit("https://s.example/"), "o_orderpriority", F.lit("?token=abc"))).alias("source"))
    even = F.col("updated_at") % 2 == 0
    return episodes.upsert(o.where(even), o.where(~even), ["source"])


_FILE = """CASE doc_id % 12 WHEN 0 THEN 'source.json' WHEN 1 THEN 'transcript-raw' || doc_id || '.txt' WHEN 2 THEN 'a' || doc_id || '.MP3' WHEN 3 THEN 'v.mkv'
  WHEN 4 THEN 'chunks.json' WHEN 5 THEN 'analysis.md' WHEN 6 THEN 'frames/' || doc_id || '.jpg' WHEN 7 THEN 'audio-chunks/' || doc_id || '.ogg'
  WHEN 8 THEN 'x' || doc_id || '.part' WHEN 9 THEN '.invalid-cache/' || doc_id || '.part' WHEN 10 THEN '../up' || doc_id ELSE 'notes/' || doc_id || '.bin' END"""


def _files(spark, sf):
    """Documents as episode files; the episode is the source."""
    n = F.col("doc_id").cast("string")
    names = [F.lit("source.json"), F.concat(F.lit("transcript-raw"), n, F.lit(".txt")), F.concat(F.lit("a"), n, F.lit(".MP3")), F.lit("v.mkv"),
             F.lit("chunks.json"), F.lit("analysis.md"), F.concat(F.lit("frames/"), n, F.lit(".jpg")),
             F.concat(F.lit("audio-chunks/"), n, F.lit(".ogg")), F.concat(F.lit("x"), n, F.lit(".part")),
             F.concat(F.lit(".invalid-cache/"), n, F.lit(".part")), F.concat(F.lit("../up"), n), F.concat(F.lit("notes/"), n, F.lit(".bin"))]
    return table(spark, sf, "documents").select(
        F.col("source").alias("episode_id"), "doc_id", F.element_at(F.array(*names), (F.col("doc_id") % 12 + 1).cast("int")).alias("path"),
        F.col("n_chars").alias("size_bytes"), "text")


_CATEGORY = """CASE doc_id % 12 WHEN 0 THEN 'metadata' WHEN 1 THEN 'transcripts' WHEN 2 THEN 'media' WHEN 3 THEN 'media' WHEN 4 THEN 'indexes'
  WHEN 5 THEN 'analysis' WHEN 6 THEN 'visual' WHEN 7 THEN 'media' ELSE 'other' END"""


@query("artifact_inventory", f"""
SELECT source AS episode_id, {_FILE} AS path, {_CATEGORY} AS category, n_chars AS size_bytes, sha256(text) AS sha256
FROM documents WHERE doc_id % 12 NOT IN (8, 9)""")
def artifact_inventory(spark, sf):
    return files.inventory(_files(spark, sf)).select("episode_id", "path", "category", "size_bytes", F.sha2("text", 256).alias("sha256"))


@query("inventory_summary", f"""
SELECT source AS episode_id, {_CATEGORY} AS category, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size_bytes
FROM documents WHERE doc_id % 12 NOT IN (8, 9) GROUP BY ALL""")
def inventory_summary(spark, sf):
    return files.inventory_summary(_files(spark, sf))


@query("reusable_episodes", f"""
WITH a AS (SELECT source AS episode_id, bool_or(doc_id % 12 = 0) AS has_source, bool_or(doc_id % 12 = 3) AS has_video,
                  bool_or(doc_id % 12 IN (2, 7)) AS has_audio FROM documents WHERE doc_id % 12 NOT IN (8, 9) GROUP BY ALL),
r AS (SELECT 'src' || c_custkey % 30 AS episode_id, c_custkey, ['metadata', 'subtitles', 'auto', 'video', 'audio', 'all', 'other'][c_custkey % 7 + 1] AS mode FROM customer)
SELECT c_custkey, r.episode_id, mode, CASE WHEN c_custkey % 30 = 9 AND mode = 'other' THEN true
  WHEN mode = 'metadata' THEN coalesce(has_source, false) WHEN mode = 'subtitles' THEN c_custkey % 30 % 2 = 0
  WHEN mode = 'auto' THEN c_custkey % 30 % 3 = 0 WHEN mode = 'video' THEN coalesce(has_video, false) WHEN mode = 'audio' THEN coalesce(has_audio, false)
  WHEN mode = 'all' THEN c_custkey % 30 % 2 = 0 AND coalesce(has_audio, false) ELSE false END AS reusable
FROM r LEFT JOIN a USING (episode_id)""")
def reusable_episodes(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("src"), (k % 30).cast("string"))
    modes = F.array(*map(F.lit, ["metadata", "subtitles", "auto", "video", "audio", "all", "other"]))
    asked = c.select(name.alias("episode_id"), "c_custkey", F.element_at(modes, (k % 7 + 1).cast("int")).alias("mode"), F.lit("en").alias("languages"))
    n = k % 30
    known = c.select(
        name.alias("episode_id"), F.when(n % 2 == 0, "normalized").otherwise("none").alias("transcript_status"),
        F.when(n % 3 == 0, "analyzed").otherwise("failed").alias("status"), F.when(n == 9, "other").alias("request_mode"),
        F.lit("en").alias("request_languages")).distinct()
    rows = episodes.reusable(known, files.inventory(_files(spark, sf)), asked.withColumn("episode_id", F.col("episode_id")))
    # The answer depends on episode and mode only; give it back per request.
    answers = rows.distinct()
    return asked.drop("languages").join(answers, ["episode_id", "mode"])


@query("stale_items", """
SELECT doc_id, reason FROM (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_cached' WHEN doc_id % 11 = 1 THEN 'source_removed' WHEN doc_id % 11 = 2 THEN 'settings_changed'
                      WHEN doc_id % 11 = 3 OR (doc_id % 11 = 4 AND lower(text) <> text) THEN 'source_fingerprint_changed' END AS reason FROM documents)
WHERE reason IS NOT NULL""")
def stale_items(spark, sf):
    d, m = table(spark, sf, "documents"), F.col("doc_id") % 11
    columns = lambda settings, size, text: ["doc_id", settings.alias("settings"), size.alias("size_bytes"), F.lit(1).alias("modified"), F.sha2(text, 256).alias("sha256")]
    cached = d.where(m != 0).select(*columns(
        F.when(m == 2, "old").otherwise("new"), F.when(m == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")),
        F.when(m == 4, F.lower("text")).otherwise(F.col("text"))))
    current = d.where(m != 1).select(*columns(F.lit("new"), F.col("n_chars"), F.col("text")))
    return episodes.stale_items(cached, current, ["doc_id"])


@query("dangling_artifacts", f"""
SELECT source AS episode_id, {_FILE} AS path, CASE WHEN doc_id % 12 = 10 THEN 'escapes_episode' ELSE 'missing' END AS problem
FROM documents d WHERE doc_id % 12 = 10 OR (source || '|' || {_FILE}) NOT IN (SELECT source || '|' || {_FILE} FROM documents WHERE n_chars % 2 = 0)""")
def dangling_artifacts(spark, sf):
    listed = _files(spark, sf)
    return episodes.dangling_artifacts(listed.select("episode_id", "path"), listed.where("size_bytes % 2 = 0"))


@query("media_union", """
WITH u AS (
  SELECT CAST(o_custkey AS VARCHAR) AS episode_id, 'm/' || o_orderkey % 50 || CASE WHEN o_orderkey % 5 = 0 THEN '.mkv' ELSE '.mp3' END AS path, s AS source, o_orderkey AS position
  FROM orders, (SELECT unnest([0, 1, 2]) AS s) WHERE (s = 0 AND o_orderstatus = 'F') OR (s = 1 AND o_orderstatus = 'O') OR s = 2)
SELECT episode_id, path, CAST(source AS BIGINT) AS source, position FROM u WHERE NOT ends_with(path, '.mkv')
QUALIFY row_number() OVER (PARTITION BY episode_id, path ORDER BY source, position) = 1""")
def media_union(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("episode_id"), "o_orderstatus", k.alias("position"),
        F.concat(F.lit("m/"), (k % 50).cast("string"), F.when(k % 5 == 0, ".mkv").otherwise(".mp3")).alias("path"))
    rows = episodes.media_union(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o)
    return rows.withColumn("source", F.col("source").cast("long"))


@query("reclaimable_bytes", f"""
WITH f AS (SELECT source AS episode_id, doc_id % 12 AS k, {_FILE} AS path, n_chars FROM documents),
t AS (SELECT episode_id, n_chars, unnest(CASE k WHEN 7 THEN ['audio-chunks'] WHEN 9 THEN ['.invalid-cache', path] WHEN 8 THEN [path] WHEN 2 THEN [path] WHEN 3 THEN [path] ELSE [] END) AS target FROM f)
SELECT episode_id, target, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size_bytes, CAST(len(string_split(target, '/')) AS BIGINT) AS depth FROM t GROUP BY ALL""")
def reclaimable_bytes(spark, sf):
    return episodes.reclaimable(_files(spark, sf), "all")


_CONTRACT = f"""
  e AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS episode_id, CASE WHEN n_chars % 10 = 0 THEN '' ELSE source END AS source_input,
               CASE lang WHEN 'en' THEN 'analyzed' WHEN 'de' THEN 'ready' ELSE 'failed' END AS status,
               CASE WHEN lang = 'fr' THEN 'normalized' END AS transcript_status, n_chars % 7 <> 0 AS actions FROM documents),
  s AS (SELECT CAST(conv_id AS VARCHAR) AS episode_id, count(*) AS n, count(*) FILTER (turn = 0) AS c, max(turn) AS top FROM conversations GROUP BY ALL),
  h AS (SELECT CAST(page_id AS VARCHAR) AS episode_id, page_id % 3 = 0 AS src, page_id % 3 = 1 AS part FROM pages),
  v AS (
    SELECT episode_id, unnest(list_filter([
      CASE WHEN source_input = '' THEN 'error/source_identity' END, CASE WHEN NOT actions THEN 'error/next_actions' END,
      CASE WHEN NOT coalesce(src, false) THEN 'error/source_missing' END,
      CASE WHEN (status IN ('ready', 'analyzed') OR transcript_status = 'normalized') AND n IS NULL THEN 'error/transcript_missing' END,
      CASE WHEN (status IN ('ready', 'analyzed') OR transcript_status = 'normalized') AND n IS NULL THEN 'error/chunks_missing' END,
      CASE WHEN top <> n THEN 'warning/segment_count_differs' END,
      CASE WHEN status = 'analyzed' THEN 'error/analysis_missing' END, CASE WHEN status = 'analyzed' THEN 'error/evidence_missing' END,
      CASE WHEN status = 'analyzed' THEN 'error/reader_missing' END, CASE WHEN coalesce(part, false) THEN 'warning/partial_files' END],
      lambda x: x IS NOT NULL)) AS r
    FROM e LEFT JOIN s USING (episode_id) LEFT JOIN h USING (episode_id))
"""


def _contract(spark, sf):
    d = table(spark, sf, "documents")
    known = d.select(
        F.col("doc_id").cast("string").alias("episode_id"), F.when(F.col("n_chars") % 10 == 0, "").otherwise(F.col("source")).alias("source_input"),
        F.when(F.col("lang") == "en", "analyzed").when(F.col("lang") == "de", "ready").otherwise("failed").alias("status"),
        F.when(F.col("lang") == "fr", "normalized").alias("transcript_status"),
        F.when(F.col("n_chars") % 7 != 0, F.array(F.lit("next"))).otherwise(F.array().cast("array<string>")).alias("next_actions"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("episode_id"), "turn", "text")
    chunks = turns.select("episode_id", F.col("turn").alias("chunk_id"), "text", F.col("turn").alias("segment_count"))
    names = F.when(F.col("page_id") % 3 == 0, "source.json").when(F.col("page_id") % 3 == 1, "x.part").otherwise("y.txt")
    held = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("episode_id"), names.alias("path"))
    return known, held, episodes.contract_audit(known, turns, chunks, held)


@query("contract_audit", "WITH " + _CONTRACT + """
SELECT episode_id, string_split(r, '/')[1] AS level, string_split(r, '/')[2] AS rule FROM v""")
def contract_audit(spark, sf):
    return _contract(spark, sf)[2]


@query("completion_gate", "WITH " + _CONTRACT + """,
  b AS (SELECT episode_id, count(*) AS violations FROM v WHERE starts_with(r, 'error') GROUP BY ALL)
SELECT e.episode_id, CASE WHEN ok THEN 'analyzed' ELSE status END AS status, ok AS valid, coalesce(violations, 0) AS violations,
       CASE WHEN ok THEN 'answer questions; export collections' ELSE 'fix violations' END AS next_actions
FROM (SELECT e.*, violations, coalesce(src, false) AND violations IS NULL AS ok FROM e LEFT JOIN h USING (episode_id) LEFT JOIN b USING (episode_id)) e""")
def completion_gate(spark, sf):
    known, held, found = _contract(spark, sf)
    inputs = held.groupBy("episode_id").agg(F.bool_or(F.col("path") == "source.json").alias("source"))
    return episodes.completion_gate(known, inputs, found.where("level = 'error'"))


@query("share_manifest", f"""
WITH f AS (SELECT source AS episode_id, {_FILE} AS path, doc_id % 12 AS k, regexp_replace(text || ' /home/me/' || doc_id || '.txt', '(?:(?:[A-Za-z]:[\\\\/])|/Users/|/home/)[^\\s"''<>]+', '[LOCAL_PATH_REDACTED]', 'g') AS md,
                  '{{"u":"https://s.example/x?utm_source=1&k=' || doc_id || '&token=1#f","p":"/srv/data/' || doc_id || '.wav","n":' || doc_id || '}}' AS js, doc_id, text || ' /home/me/' || doc_id || '.txt' AS raw FROM documents),
t AS (SELECT episode_id, path, CASE WHEN k IN (0, 4) THEN '{{"u":"https://s.example/x?k=' || doc_id || '&token=%5BREDACTED%5D","p":"[LOCAL_PATH_REDACTED]/' || doc_id || '.wav","n":' || doc_id || '}}'
                             WHEN k IN (1, 5) THEN md ELSE raw END AS x FROM f WHERE k NOT IN (8, 9))
SELECT episode_id, path, CAST(octet_length(encode(x)) AS BIGINT) AS size_bytes, sha256(x) AS sha256 FROM t""")
def share_manifest(spark, sf):
    n = F.col("doc_id").cast("string")
    js = F.concat(F.lit('{"u":"https://s.example/x?utm_source=1&k='), n, F.lit('&token=1#f","p":"/srv/data/'), n, F.lit('.wav","n":'), n, F.lit("}"))
    raw = F.concat("text", F.lit(" /home/me/"), n, F.lit(".txt"))
    held = _files(spark, sf).withColumn("text", F.when(F.col("path").isin("source.json", "chunks.json"), js).otherwise(raw))
    return episodes.export_manifest(held, "archive", True)
