"""Documents written as caption files, feeds and pages, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions.times import clock, clock_ms
from earmark.operators.transcripts import cleaned
from earmark.plans import views
from earmark.plans.registry import query, spread_table, table
from earmark.plans.views import with_views
from earmark.sources import captions, feeds, pages

SECOND = 2.0


def sql_clean(x: str) -> str:
    plain = f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    return rf"trim(regexp_replace(regexp_replace({plain}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


_NAME = r"regexp_extract(c, '^([^:：]{1,60})[:：]\s+(.+)$', 1)"
_SAID = rf"({_NAME} <> '' AND len(string_split(trim({_NAME}), ' ')) <= 8)"
views.VIEW_SQL["v_cues"] = rf"""
    v_cues AS (
      SELECT CAST(doc_id AS VARCHAR) AS episode_id, doc_id, source, i, c, n,
             CASE WHEN {_SAID} THEN trim({_NAME}) END AS who,
             CASE WHEN {_SAID} THEN trim(regexp_extract(c, '^([^:：]{{1,60}})[:：]\s+(.+)$', 2)) ELSE c END AS said,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
      FROM (SELECT doc_id, source, i, n, {sql_clean('line')} AS c FROM (
              SELECT doc_id, source, unnest(string_split(text, E'\n')) AS line, unnest(range(len(string_split(text, E'\n')))) AS i,
                     len(string_split(text, E'\n')) AS n FROM documents)) WHERE c <> '')"""


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def caption_files(spark, sf, kind: str):
    """Each document as one caption file: a cue per line, one every 2 s."""
    docs = spread_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("episode_id"), "source", F.split("text", "\n").alias("lines"), "doc_id")
    at = lambda i: i * SECOND
    say = {
        "srt": lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock_ms(at(i), ","), F.lit(" --> "),
                                     clock_ms(at(i) + 1.5, ","), F.lit("\n"), x, F.lit("\n\n")),
        "ass": lambda x, i: F.concat(F.lit("Dialogue: 0,"), clock_ms(at(i)), F.lit(","), clock_ms(at(i) + 1.5), F.lit(",Default,"),
                                     F.col("source"), F.lit(",0,0,0,,{\\i1}"), x, F.lit("\n")),
        "ttml": lambda x, i: F.concat(F.lit('<tt:p begin="'), at(i).cast("string"), F.lit('s" dur="1500ms" voice="'), F.col("source"),
                                      F.lit('">'), _escaped(x), F.lit("</tt:p>\n")),
        "txt": lambda x, i: F.concat(F.lit("["), clock(at(i)), F.lit("] "), x, F.lit("\n")),
    }
    if kind in say:
        text = F.array_join(F.transform("lines", say[kind]), "")
        if kind == "ttml":
            text = F.concat(F.lit('<tt:tt xmlns:tt="http://www.w3.org/ns/ttml"><body>'), text, F.lit("</body></tt:tt>"))
    elif kind == "json":
        text = F.to_json(F.struct(F.struct(F.transform("lines", lambda x, i: F.struct(
            x.alias("content"), (at(i) * 1000).alias("start_ms"), at(i).cast("string").alias("start"),
            clock_ms(at(i) + 1.5).alias("end"), F.col("source").alias("speaker_name"), F.lit(0.5).alias("confidence"))).alias("utterances")).alias("transcript")))
    else:
        text = F.to_json(F.struct(F.transform("lines", lambda x, i: F.struct(
            (at(i) * 1000).alias("tStartMs"), F.when(F.length(x) % 3 != 0, 1500.0).otherwise(0.0).alias("dDurationMs"),
            F.array(F.struct(x.alias("utf8")), F.struct(F.lit(" ").alias("utf8"))).alias("segs"))).alias("events")))
    return docs.select("episode_id", "doc_id", F.lit("." + kind).alias("suffix"), text.alias("text"))


_OUT = ("episode_id", "pos", "start_seconds", "end_seconds", "speaker", "text")


@query("caption_cues", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, i * 2.0::DOUBLE + 1.5 AS end_seconds, who AS speaker, said AS text FROM v_cues"""))
def caption_cues(spark, sf):
    return captions.parse_captions(caption_files(spark, sf, "srt")).select(*_OUT)


@query("ass_dialogue", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, i * 2.0::DOUBLE + 1.5 AS end_seconds, source AS speaker, c AS text FROM v_cues"""))
def ass_dialogue(spark, sf):
    return captions.parse_ass(caption_files(spark, sf, "ass")).select(*_OUT)


@query("ttml_cues", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, i * 2.0::DOUBLE + 1.5 AS end_seconds, source AS speaker, c AS text FROM v_cues"""))
def ttml_cues(spark, sf):
    return captions.parse_ttml(caption_files(spark, sf, "ttml")).select(*_OUT)


@query("bracket_lines", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, CASE WHEN i + 1 < n THEN i * 2.0::DOUBLE + 2 END AS end_seconds,
       who AS speaker, said AS text FROM v_cues"""))
def bracket_lines(spark, sf):
    return captions.parse_lines(caption_files(spark, sf, "txt")).select(*_OUT)


@query("untimed_text", rf"""
SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS episode_id, CAST(0 AS BIGINT) AS pos, {sql_clean("text")} AS text FROM documents) WHERE text <> ''""")
def untimed_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), "text")
    return captions.parse_lines(docs).select("episode_id", "pos", "text")


@query("json_segments", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, i * 2.0::DOUBLE + 1.5 AS end_seconds, source AS speaker, c AS text,
       0.5::DOUBLE AS confidence FROM v_cues"""))
def json_segments(spark, sf):
    return captions.parse_json(caption_files(spark, sf, "json")).select(*_OUT, "confidence")


@query("json3_events", with_views("v_cues", """
  raw AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, unnest(range(len(l))) AS i, length(unnest(l)) AS m
          FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents))
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds, CASE WHEN m % 3 <> 0 THEN i * 2.0::DOUBLE + 1.5 END AS end_seconds, c AS text
FROM v_cues JOIN raw USING (episode_id, i)"""))
def json3_events(spark, sf):
    return captions.parse_events(caption_files(spark, sf, "json3")).select(*[c for c in _OUT if c != "speaker"])


@query("ingest_formats", with_views("v_cues", """
SELECT episode_id, pos, i * 2.0::DOUBLE AS start_seconds,
       CASE doc_id % 4 WHEN 1 THEN CASE WHEN i + 1 < n THEN i * 2.0::DOUBLE + 2 END ELSE i * 2.0::DOUBLE + 1.5 END AS end_seconds,
       CASE WHEN doc_id % 4 < 2 THEN who ELSE source END AS speaker, CASE WHEN doc_id % 4 < 2 THEN said ELSE c END AS text
FROM v_cues"""))
def ingest_formats(spark, sf):
    """Every document in one of four formats, told apart by suffix."""
    files = None
    for i, kind in enumerate(("srt", "txt", "ass", "json")):
        part = caption_files(spark, sf, kind).where(F.col("doc_id") % 4 == i).drop("doc_id")
        files = part if files is None else files.unionByName(part)
    return captions.parse_files(files).select(*_OUT)


@query("cleaned_text", f"""
SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS episode_id, {sql_clean("text")} AS text FROM documents) WHERE text <> ''""")
def cleaned_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), "text")
    return cleaned(docs)


# --- feeds: one per order -------------------------------------------------------------


def _feed_files(spark, sf):
    o = spread_table(spark, sf, "orders")
    number = F.col("o_orderkey").cast("string")
    even = F.col("o_orderkey") % 2 == 0
    when = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    rss = F.concat(
        F.lit('<rss><channel><title>all</title><item><title>  '), "o_orderpriority", F.lit("</title><guid>"), number,
        F.lit("</guid><pubDate>"), when, F.lit(' GMT</pubDate><itunes:duration>'), F.col("o_totalprice").cast("string"),
        F.lit('</itunes:duration><link>x</link><enclosure url="../a/'), number, F.lit('.mp3" type="audio/mpeg"/><enclosure url="n.pdf"/>'
              '<podcast:transcript url="t/'), number, F.lit('.vtt"/><description><![CDATA[<p>Status '), "o_orderstatus",
        F.lit(" &amp; more</p>]]></description></item></channel></rss>"))
    atom = F.concat(
        F.lit('<feed><title>all</title><entry><title>'), "o_orderpriority", F.lit("</title><id>"), number, F.lit("</id><updated>"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('</updated><link rel="enclosure" type="audio/mp4" href="/b/'), number,
        F.lit('.m4a"/><link href="p?id='), number, F.lit('"/><summary>Status '), "o_orderstatus", F.lit(" &amp;amp; more</summary></entry></feed>"))
    return o.select(F.concat(F.lit("https://feeds.example.org/show/"), number, F.lit("/feed.xml")).alias("feed_url"),
                    F.when(even, atom).otherwise(rss).alias("text"))


@query("feed_items", """
SELECT 'https://feeds.example.org/show/' || o_orderkey || '/feed.xml' AS feed_url, CAST(0 AS BIGINT) AS position, o_orderpriority AS title,
       CAST(o_orderkey AS VARCHAR) AS guid, CASE WHEN o_orderkey % 2 = 0 THEN 'https://feeds.example.org/show/' || o_orderkey || '/p?id=' || o_orderkey END AS episode_url,
       CASE WHEN o_orderkey % 2 = 0 THEN 'https://feeds.example.org/b/' || o_orderkey || '.m4a'
            ELSE 'https://feeds.example.org/show/a/' || o_orderkey || '.mp3' END AS audio_url,
       CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'https://feeds.example.org/show/' || o_orderkey || '/t/' || o_orderkey || '.vtt' END AS transcript_urls,
       'Status ' || o_orderstatus || ' & more' AS description, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS published_at
FROM orders""")
def feed_items(spark, sf):
    from earmark.functions.times import published_at

    rows = feeds.parse_feeds(_feed_files(spark, sf))
    return rows.select("feed_url", "position", "title", "guid", "episode_url", "audio_url",
                       F.array_join("transcript_urls", ",").alias("transcript_urls"), "description",
                       F.unix_seconds(published_at(F.col("published"))).alias("published_at"))


def _items(spark, sf):
    """Each customer's orders as one feed."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("feed_url"), F.col("o_orderkey").alias("position"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.col("o_orderkey").cast("string").alias("guid"),
        F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")).otherwise("unknown").alias("published"))


@query("latest_per_feed", """
SELECT CAST(o_custkey AS VARCHAR) AS feed_url, o_orderkey AS position, o_orderpriority || ' ' || o_orderstatus AS title
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'F' THEN date_trunc('second', o_orderdate) END DESC NULLS LAST, o_orderkey) AS r
      FROM orders) WHERE r = 1""")
def latest_per_feed(spark, sf):
    return feeds.latest_items(_items(spark, sf)).select("feed_url", "position", "title")


def _requests(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("feed_url"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("1-URGENT F")).when(F.col("c_custkey") % 4 == 1, F.lit(" urgent o"))
        .when(F.col("c_custkey") % 4 == 2, F.lit("nothing")).alias("query"))


@query("select_item", """
WITH q AS (SELECT CAST(c_custkey AS VARCHAR) AS feed_url, CASE c_custkey % 4 WHEN 0 THEN '1-URGENT F' WHEN 1 THEN ' urgent o' WHEN 2 THEN 'nothing' END AS query FROM customer),
i AS (SELECT CAST(o_custkey AS VARCHAR) AS feed_url, o_orderkey AS position, lower(o_orderpriority || ' ' || o_orderstatus) AS t, CAST(o_orderkey AS VARCHAR) AS g FROM orders),
m AS (SELECT q.feed_url, query, position, CASE WHEN query IS NULL THEN 3 WHEN t = trim(lower(query)) OR g = trim(lower(query)) THEN 1
             WHEN contains(t, trim(lower(query))) OR contains(g, trim(lower(query))) THEN 2 END AS tier FROM q JOIN i USING (feed_url)),
b AS (SELECT feed_url, min(tier) AS best, count(tier) AS n FROM m GROUP BY ALL),
s AS (SELECT feed_url, count(*) AS matches, min(position) AS position FROM m JOIN b USING (feed_url) WHERE tier = best AND (tier < 3 OR n = 1) GROUP BY ALL)
SELECT q.feed_url, query, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN position END AS position,
       CASE WHEN matches = 1 THEN 'selected' WHEN matches > 1 THEN 'ambiguous' WHEN query IS NOT NULL THEN 'no_match' ELSE 'open' END AS status
FROM q LEFT JOIN s USING (feed_url)""")
def select_item(spark, sf):
    return feeds.selection_status(_items(spark, sf), _requests(spark, sf)).withColumn("matches", F.col("matches").cast("long"))


@query("feed_candidates", """
SELECT CAST(o_custkey AS VARCHAR) AS feed_url, o_orderkey AS position, n AS episode_count
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 20""")
def feed_candidates(spark, sf):
    return feeds.feed_candidates(_items(spark, sf)).select("feed_url", "position", "episode_count")


# --- pages -------------------------------------------------------------------------------


def _rich_pages(spark, sf):
    """The pages with media links and JSON-LD added to their heads."""
    p, number = spread_table(spark, sf, "pages"), F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<link href="/feed.xml" type="application/rss+xml" rel="alternate"><meta content="a/'), number, F.lit('.mp3" property="og:audio">'
              '<link rel="transcript" href="t.html"><audio src=\'/x/'), number, F.lit('.ogg\'></audio><source type="image/png" src="i.png">'
              '<script type="application/ld+json">{"@graph":[{"@type":"Thing","name":"no"},{"@type":["PodcastEpisode"],"name":"E'), number,
        F.lit('","duration":"PT1M","audio":{"@type":"AudioObject","contentUrl":"../c/'), number, F.lit('.mp3"},"transcript":"https://t.example/'),
        number, F.lit('"}]}</script></head>'))
    return p.select("page_id", "url", F.replace("html", F.lit("</head>"), extra).alias("html"))


_TITLE = r"""trim(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'))"""


@query("page_title_links", rf"""
WITH p AS (SELECT page_id, url, {_TITLE} AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
                  regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/|)[^/?#]*', 1) AS folder,
                  string_split(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/|)[^/?#]*', 1), '/') AS steps FROM pages)
SELECT page_id, title, 'PT1M' AS duration,
       concat_ws(',', site || coalesce(nullif(folder, ''), '/') || 'a/' || page_id || '.mp3', site || '/x/' || page_id || '.ogg',
                 site || coalesce(nullif(array_to_string(steps[1:len(steps) - 2], '/') || '/', '/'), '/') || 'c/' || page_id || '.mp3') AS audio_candidates,
       site || coalesce(nullif(folder, ''), '/') || 't.html' || ',https://t.example/' || page_id AS transcript_candidates,
       site || '/feed.xml' AS feed_candidates
FROM p""")
def page_title_links(spark, sf):
    rows = pages.parse_pages(_rich_pages(spark, sf))
    return rows.select("page_id", "title", "duration", *[
        F.array_join(c, ",").alias(c) for c in ("audio_candidates", "transcript_candidates", "feed_candidates")])


@query("jsonld_nodes", """
SELECT page_id, '0,0,1' AS path, 'E' || page_id AS name, 'PT1M' AS duration, NULL::VARCHAR AS content_url, 'https://t.example/' || page_id AS transcript FROM pages
UNION ALL SELECT page_id, '0,0,1,1', NULL, NULL, '../c/' || page_id || '.mp3', NULL FROM pages""")
def jsonld_nodes(spark, sf):
    rows = pages.jsonld_nodes(_rich_pages(spark, sf))
    return rows.select("page_id", F.array_join("path", ",").alias("path"), "name", "duration", "content_url", "transcript")
