"""Normal form, cleanup, chunks, rendering, translation, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions.text import keyword_tokens
from earmark.operators import chunking, transcripts
from earmark.operators.captions import merge_captions
from earmark.plans import views
from earmark.plans.registry import SQL, query, table
from earmark.plans.views import folded, ordered_distinct, searched, sql_clock, sql_clock_ms, sql_longest_repeat, with_views
from earmark.session import scratch_path


@query("normalized_segments", with_views("v_rolling v_kept", f"""
SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS segment_id,
       {sql_clock('start_seconds')} AS start, {sql_clock('end_seconds')} AS "end", start_seconds, end_seconds,
       speaker, 'und' AS language, text
FROM v_kept"""))
def normalized_segments(spark, sf):
    cues = views.rolling(spark, sf).withColumns({
        "language": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return transcripts.normalize(cues, "und").drop("confidence")


@query("caption_dedup", with_views("v_rolling v_kept", """
SELECT episode_id, pos, speaker, start_seconds, end_seconds, text, merged_rows FROM v_kept"""))
def caption_dedup(spark, sf):
    return merge_captions(views.rolling(spark, sf)).select(
        "episode_id", "pos", "speaker", "start_seconds", "end_seconds", "text", "merged_rows")


@query("chunk_membership", with_views("v_ranges", """
SELECT episode_id, chunk_id, unnest(range(first_pos, last_pos + 1)) AS pos FROM v_ranges"""))
def chunk_membership(spark, sf):
    return chunking.chunk_members(chunking.chunk_ranges(views.segments(spark, sf), views.MAX_CHARS, views.MAX_SECONDS))


@query("chunks", with_views("v_chunks", rf"""
  k AS (
    SELECT episode_id, chunk_id, string_agg(t, ' ' ORDER BY n DESC, ix) AS hints
    FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, chunk_id ORDER BY n DESC, ix) AS r
          FROM (SELECT episode_id, chunk_id, t, count(*) AS n, min(ix) AS ix
                FROM (SELECT episode_id, chunk_id, unnest(x) AS t, unnest(range(len(x))) AS ix
                      FROM (SELECT episode_id, chunk_id, regexp_extract_all({folded('text')}, '[A-Za-z0-9_+#.-]{{2,}}') AS x FROM v_chunks))
                GROUP BY episode_id, chunk_id, t)) WHERE r <= 20 GROUP BY episode_id, chunk_id)
SELECT episode_id, chunk_id, segment_ids, {sql_clock('start_seconds')} AS start, {sql_clock('end_seconds')} AS "end",
       start_seconds, end_seconds, array_to_string({ordered_distinct('sp')}, ',') AS speakers, text,
       length(text) AS char_count, {searched('text')} AS search_text, coalesce(hints, '') AS keyword_hints
FROM v_chunks LEFT JOIN k USING (episode_id, chunk_id)"""))
def chunks(spark, sf):
    rows = views.chunked(spark, sf)
    return rows.withColumns({
        "segment_ids": F.array_join("segment_ids", ","), "speakers": F.array_join("speakers", ","),
        "keyword_hints": F.array_join("keyword_hints", " ")})


@query("chunk_index", SQL["chunks"])
def chunk_index(spark, sf):
    """The chunks written as an index by episode and read back."""
    path = scratch_path(spark, "index")
    chunking.write_chunks(chunks(spark, sf), path)
    return spark.read.parquet(path).drop("bucket")


@query("transcript_chunks")
def transcript_chunks(spark, sf):
    """Every source of documents as one transcript, a document a segment: empty ones left out, long ones split, then cut."""
    docs = table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("")).alias("episode_id"), F.col("doc_id").alias("segment_id"), "text", F.col("lang").alias("speaker"),
        F.lit(None).cast("double").alias("start_seconds"), F.lit(None).cast("double").alias("end_seconds"))
    return chunking.transcript_chunks(docs).select(
        "episode_id", "chunk_id", F.array_join("segment_ids", ",").alias("segment_ids"), "char_count", "text")


@query("oversized_split", r"""
WITH RECURSIVE big AS (
  SELECT CAST(doc_id AS VARCHAR) AS episode_id, trim(text, E' \n') AS text FROM documents WHERE length(trim(text, E' \n')) > 1000),
s AS (
  SELECT episode_id, list_filter(list_transform(string_split_regex(
           regexp_replace(text, '([。！？!?；;.])\s+', E'\\1\x01', 'g'), E'\x01|\n+'), lambda x: trim(x, E' \n')), lambda x: x <> '') AS s FROM big),
u AS (
  SELECT episode_id, flatten(list_transform(s, lambda x: list_transform(range(0, (length(x) - 1) // 1000 + 1),
           lambda i: substr(x, i * 1000 + 1, 1000)))) AS u FROM s),
w AS (
  SELECT episode_id, u, 1 AS i, CAST(1 AS BIGINT) AS part, trim(u[1], E' \n') AS cur FROM u
  UNION ALL
  SELECT episode_id, u, i + 1,
         CASE WHEN length(trim(cur || ' ' || u[i + 1])) > 1000 THEN part + 1 ELSE part END,
         CASE WHEN length(trim(cur || ' ' || u[i + 1])) > 1000 THEN u[i + 1] ELSE trim(cur || ' ' || u[i + 1]) END
  FROM w WHERE i < len(u))
SELECT episode_id, '1.' || part AS segment_id, CAST(1 AS BIGINT) AS source_segment_id, part, arg_max(cur, i) AS text,
       round((sum(length(arg_max(cur, i))) OVER (PARTITION BY episode_id ORDER BY part) - length(arg_max(cur, i))) * 100.0
             / sum(length(arg_max(cur, i))) OVER (PARTITION BY episode_id), 6) AS start_seconds,
       round(sum(length(arg_max(cur, i))) OVER (PARTITION BY episode_id ORDER BY part) * 100.0
             / sum(length(arg_max(cur, i))) OVER (PARTITION BY episode_id), 6) AS end_seconds
FROM w GROUP BY episode_id, part
UNION ALL
SELECT CAST(doc_id AS VARCHAR), '1', 1, 0, text, 0.0, 100.0 FROM documents WHERE length(trim(text, E' \n')) <= 1000""")
def oversized_split(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("episode_id"), F.lit(1).cast("long").alias("segment_id"), "text",
        F.lit(0.0).alias("start_seconds"), F.lit(100.0).alias("end_seconds"),
        F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    parts = chunking.split_oversized(docs, 1000)
    return parts.select("episode_id", "segment_id", "source_segment_id", "part", "text",
                        F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"))


@query("keyword_hints", with_views("v_segments", f"""
  x AS (SELECT episode_id, segment_id, regexp_extract_all({folded('text')}, '[A-Za-z0-9_+#.-]{{2,}}') AS x FROM v_segments),
  t AS (SELECT episode_id, segment_id, unnest(x) AS term, unnest(range(len(x))) AS ix FROM x),
  c AS (SELECT episode_id, segment_id, term, count(*) AS n, min(ix) AS first FROM t GROUP BY ALL)
SELECT * EXCLUDE (first) FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, segment_id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 20"""))
def keyword_hints(spark, sf):
    text = F.col("text")
    rows = views.units(spark, sf).select("episode_id", F.col("chunk_id").alias("segment_id"), keyword_tokens(text).alias("tokens"),
                                         F.posexplode(chunking.keyword_hints(text)).alias("i", "term"))
    return rows.select("episode_id", "segment_id", "term",
                       F.size(F.filter("tokens", lambda t: t == F.col("term"))).cast("long").alias("n"),
                       (F.col("i") + 1).cast("long").alias("place"))


_TIMED = """
  timed AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY segment_id) AS line_no,
                   CASE WHEN end_seconds > start_seconds THEN end_seconds
                        ELSE coalesce(lead(start_seconds) OVER (PARTITION BY episode_id ORDER BY segment_id), start_seconds + 4) END AS e
            FROM v_lines WHERE start_seconds IS NOT NULL)
"""


@query("render_srt", with_views("v_lines", _TIMED + rf"""
SELECT episode_id, line_no, line_no || E'\n' || {sql_clock_ms('start_seconds', ',')} || ' --> ' || {sql_clock_ms('e', ',')} || E'\n'
       || speaker || ': ' || text || E'\n' AS text FROM timed"""))
def render_srt(spark, sf):
    return transcripts.render_srt(views.lines(spark, sf))


@query("render_vtt", with_views("v_lines", _TIMED + rf"""
SELECT episode_id, line_no, {sql_clock_ms('start_seconds')} || ' --> ' || {sql_clock_ms('e')} || E'\n<v ' || speaker || '>' || text
       || E'</v>\n' AS text FROM timed
UNION ALL SELECT DISTINCT episode_id, 0, E'WEBVTT\n' FROM timed"""))
def render_vtt(spark, sf):
    return transcripts.render_vtt(views.lines(spark, sf))


@query("render_markdown", with_views("v_segments", rf"""
SELECT episode_id, segment_id AS line_no, '[' || {sql_clock('start_seconds')} || '] **' || speaker || ':** ' || text || E'\n' AS text FROM v_segments
UNION ALL
SELECT episode_id, 0, E'# Timestamped transcript\n\n- Source file: `' || episode_id || E'`\n- Method: normalized\n- Language: unknown\n- Segments: '
       || count(*) || E'\n' FROM v_segments GROUP BY episode_id"""))
def render_markdown(spark, sf):
    return transcripts.render_markdown(views.display_segments(spark, sf))


@query("linked_segments", with_views("v_segments", f"""
SELECT episode_id, segment_id, {sql_clock('start_seconds')} AS stamp,
       url_base || CASE WHEN strpos(url, '#') > 0 THEN '' ELSE '' END || '#t=' || CAST(floor(start_seconds) AS BIGINT) AS link,
       speaker, {folded("speaker || ' ' || text")} AS search
FROM v_segments JOIN (SELECT CAST(page_id AS VARCHAR) AS episode_id, url, string_split(url, '#')[1] AS url_base FROM pages) USING (episode_id)"""))
def linked_segments(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("episode_id"), "url")
    rows = views.display_segments(spark, sf).join(pages, "episode_id")
    return transcripts.linked(rows, F.col("url")).drop("text")


@query("transcript_header", with_views("v_lines", """
SELECT episode_id, count(*) AS segment_count, count(start_seconds) AS timed_segment_count,
       count(DISTINCT speaker) AS speaker_count, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers,
       max(coalesce(nullif(end_seconds, 0), start_seconds, 0)) AS duration_seconds
FROM v_lines GROUP BY episode_id"""))
def transcript_header(spark, sf):
    rows = transcripts.header(views.lines(spark, sf))
    return rows.withColumn("speakers", F.array_join("speakers", ","))


@query("translation_request", with_views("v_segments", "SELECT episode_id, segment_id, speaker, text FROM v_segments"))
def translation_request(spark, sf):
    return transcripts.translation_request(views.segments(spark, sf))


_TRANSLATED = """
  given AS (
    SELECT episode_id, segment_id + CASE WHEN contains(text, 'ß') THEN 1 ELSE 0 END AS segment_id, upper(text) AS text FROM v_segments),
  g AS (SELECT episode_id, segment_id, count(*) AS times, count(*) FILTER (trim(text) = '') AS blank FROM given GROUP BY ALL),
  f AS (SELECT episode_id, segment_id, s.text IS NOT NULL AS wanted, times, blank FROM v_segments s FULL JOIN g USING (episode_id, segment_id)),
  problems AS (
    SELECT episode_id, segment_id, 'missing' AS problem FROM f WHERE times IS NULL
    UNION ALL SELECT episode_id, segment_id, 'extra' FROM f WHERE NOT wanted
    UNION ALL SELECT episode_id, segment_id, 'duplicate' FROM f WHERE times > 1
    UNION ALL SELECT episode_id, segment_id, 'empty' FROM f WHERE blank > 0)
"""


def _translated(spark, sf):
    """A translation that slips by one segment wherever a sharp s occurs."""
    slip = F.when(F.contains("text", F.lit("ß")), 1).otherwise(0)
    return views.segments(spark, sf).select(
        "episode_id", (F.col("segment_id") + slip).alias("segment_id"), F.upper("text").alias("text"))


@query("translation_coverage", with_views("v_segments", _TRANSLATED + "SELECT * FROM problems"))
def translation_coverage(spark, sf):
    return transcripts.translation_coverage(views.segments(spark, sf), _translated(spark, sf))


@query("translation_apply", with_views("v_segments", _TRANSLATED + """
SELECT episode_id, segment_id, speaker, start_seconds, end_seconds, s.text AS source_text, trim(g.text) AS text, 'xx' AS language
FROM v_segments s JOIN given g USING (episode_id, segment_id)
WHERE episode_id NOT IN (SELECT episode_id FROM problems)"""))
def translation_apply(spark, sf):
    return transcripts.apply_translation(views.segments(spark, sf), _translated(spark, sf), "xx").drop("pos")


_QUALITY = rf"""
  t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, start_seconds IS NOT NULL AND end_seconds IS NOT NULL AS timed FROM v_lines),
  r AS (SELECT episode_id, sum(n - 1) AS reps, sum(n) AS texts FROM (
          SELECT episode_id, {folded('x')} AS f, count(*) AS n FROM t WHERE x <> '' GROUP BY ALL) GROUP BY ALL),
  m AS (
    SELECT episode_id, count(*) AS segments, count(*) FILTER (timed) AS timed_segments,
           count(*) FILTER (timed AND end_seconds < start_seconds) AS reversed_ranges, count(*) FILTER (x = '') AS empty_segments,
           round(coalesce(max(end_seconds) FILTER (timed), 0.0), 3) AS duration_seconds,
           round(coalesce(CAST(sum(greatest(CAST(round(end_seconds * 1000000) AS BIGINT) - CAST(round(start_seconds * 1000000) AS BIGINT), 0)) FILTER (timed) AS BIGINT), 0) / 1000000, 3) AS speech_seconds,
           CAST(sum(length(x)) AS BIGINT) AS characters,
           CAST(sum(CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END) AS BIGINT) AS words,
           bool_or(x <> '' AND len(string_split(x, ' ')) >= 8 AND len(list_distinct(string_split({folded('x')}, ' '))) <= 2) AS stuck,
           count(confidence) AS confidence_samples, round(sum(confidence) / count(confidence), 4) AS average_confidence,
           count(*) FILTER (confidence < 0.5) AS low_confidence_segments
    FROM t GROUP BY episode_id),
  spans AS (SELECT episode_id, segment_id, {sql_longest_repeat('text')} AS span FROM v_lines),
  q AS (SELECT m.*, (SELECT count(*) FROM spans s WHERE s.episode_id = m.episode_id AND span >= 32) AS pathological_segments, CAST(coalesce(reps, 0) AS BIGINT) AS exact_repetitions, coalesce(texts, 0) AS texts,
               round(timed_segments / segments, 4) AS timed_coverage FROM m LEFT JOIN r USING (episode_id))
"""


@query("quality_metrics", with_views("v_lines", _QUALITY + """
SELECT episode_id, segments, timed_segments, timed_coverage, reversed_ranges, empty_segments, duration_seconds, speech_seconds,
       characters, words, exact_repetitions, confidence_samples, average_confidence, low_confidence_segments FROM q"""))
def quality_metrics(spark, sf):
    return transcripts.quality(views.lines(spark, sf)).select(
        "episode_id", "segments", "timed_segments", "timed_coverage", "reversed_ranges", "empty_segments", "duration_seconds",
        "speech_seconds", "characters", "words", "exact_repetitions", "confidence_samples", "average_confidence",
        "low_confidence_segments")


@query("quality_score", with_views("v_lines", _QUALITY + """,
  w AS (SELECT *, reversed_ranges > 0 OR empty_segments > 0 AS bad, timed_segments / segments < 0.95 AS thin,
               CASE WHEN exact_repetitions / greatest(1, texts) > 0.15 THEN 1 ELSE 0 END
               + CASE WHEN stuck THEN 1 ELSE 0 END + CASE WHEN pathological_segments > 0 THEN 1 ELSE 0 END
               + CASE WHEN low_confidence_segments / nullif(confidence_samples, 0) > 0.2 THEN 1 ELSE 0 END AS early FROM q)
SELECT episode_id, CASE WHEN bad THEN 'fail' WHEN early > 0 OR thin THEN 'warn' ELSE 'pass' END AS status,
       CAST(greatest(0, 100 - CASE WHEN bad THEN 30 ELSE 0 END - least(25, early * 10) - CASE WHEN thin THEN 15 ELSE 0 END) AS BIGINT) AS score
FROM w"""))
def quality_score(spark, sf):
    return transcripts.quality(views.lines(spark, sf)).select("episode_id", "status", "score")


@query("exact_repetitions", with_views("v_lines", _QUALITY + "SELECT episode_id, exact_repetitions FROM q WHERE exact_repetitions > 0"))
def exact_repetitions(spark, sf):
    return transcripts.quality(views.lines(spark, sf)).where("exact_repetitions > 0").select("episode_id", "exact_repetitions")


@query("token_repetition", with_views("v_lines", rf"""
SELECT episode_id, segment_id, len(w) AS words, len(list_distinct(w)) AS distinct_words
FROM (SELECT episode_id, segment_id, string_split({searched('text')}, ' ') AS w FROM v_lines)
WHERE len(w) >= 3 AND len(list_distinct(w)) <= 2"""))
def token_repetition(spark, sf):
    return transcripts.stuck_tokens(views.lines(spark, sf), 3, 2)


@query("repeated_spans", with_views("v_lines", f"""
SELECT episode_id, segment_id, span AS repeated_span
FROM (SELECT episode_id, segment_id, CAST({sql_longest_repeat('text')} AS BIGINT) AS span FROM v_lines) WHERE span >= 12"""))
def repeated_spans(spark, sf):
    return transcripts.repeated_spans(views.lines(spark, sf), 12)


@query("spot_check_queue", with_views("v_lines", r"""
SELECT episode_id, segment_id, confidence, concat_ws(',',
         CASE WHEN regexp_matches(text, '\d') THEN 'number_or_date' END,
         CASE WHEN regexp_matches(text, '[$€£¥]\s*\d|\d\s*(?:%|％|percent)') THEN 'price_or_percent' END,
         CASE WHEN regexp_matches(text, '(?i)(?:^|[^\pL\pN_])(?:not|never|no)(?:[^\pL\pN_]|$)|不会|并非') THEN 'negation' END,
         CASE WHEN regexp_matches(text, '(?i)https?://|www\.') THEN 'url' END,
         CASE WHEN regexp_matches(text, '(?i)(?:^|[^\pL\pN_])(?:my name is|i am|i''m|welcome)(?:[^\pL\pN_]|$)') THEN 'introduction' END) AS reasons
FROM v_lines WHERE regexp_matches(text, '(?i)\d|(?:^|[^\pL\pN_])(?:not|never|no|my name is|i am|i''m|welcome)(?:[^\pL\pN_]|$)|不会|并非|https?://|www\.')"""))
def spot_check_queue(spark, sf):
    return transcripts.spot_checks(views.lines(spark, sf)).select(
        "episode_id", "segment_id", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query("asr_confidence", """
SELECT vec_id, round(greatest(0.0, least(1.0, exp(CAST(embedding[1] AS DOUBLE)))), 6) AS confidence FROM embeddings""")
def asr_confidence(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", transcripts.confidence_from_logprob(F.col("embedding")[0].cast("double")).alias("confidence"))
