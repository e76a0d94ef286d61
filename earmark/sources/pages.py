"""Episode pages: title, media, feed and transcript links, JSON-LD nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import strip, unescape
from earmark.functions.urls import resolve_url, split_url, suffix, url_base
from earmark.session import materialize
from earmark.sources.feeds import attribute

_TAG = r"(?is)(<(?:meta|audio|source|link)\b[^>]*>)"
# Comments and other scripts are matched, too, so that nothing inside them counts; they leave group 1 empty.
_JSON_LD = r"""(?is)<!--.*?-->|<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>|<script\b[^>]*>.*?</script>"""
EPISODE_TYPES = ["podcastepisode", "audioobject", "videoobject", "episode"]


def _visible(html: Column) -> Column:
    """Markup without comments and the bodies of scripts and styles."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1")


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page: title, duration and the ordered distinct candidates.

    ``pages``: ``page_id, url, html``. Tags are worked on as arrays inside the
    row; only pages with JSON-LD are exploded.
    """
    def tag(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^<(\w+)", 1))
        return F.struct(
            name.alias("name"), F.lower(F.coalesce(F.nullif(attribute(t, "property"), F.lit("")), attribute(t, "name"))).alias("key"),
            strip(attribute(t, "content")).alias("content"), attribute(t, "src").alias("src"), attribute(t, "href").alias("href"),
            F.lower(attribute(t, "type")).alias("type"), F.lower(attribute(t, "rel")).alias("rel"))

    base = F.col("_base")
    rows = pages.select("page_id", "url", url_base(F.col("url")).alias("_base"), F.transform(F.regexp_extract_all(_visible(F.col("html")), F.lit(_TAG), 1), tag).alias("tags"),
                        F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<title\b[^>]*>(.*?)</title>"), 1).alias("titles"))
    media_type = lambda t: F.regexp_like(t["type"], F.lit("^(?:audio|video)/"))
    feed_type = lambda t: t["type"].isin("application/rss+xml", "application/atom+xml")
    meta = lambda t: (t["name"] == "meta") & (t["key"] != "") & (t["content"] != "")
    linked = lambda t: (t["name"] == "link") & (t["href"] != "")
    first_meta = lambda key: F.get(F.filter("tags", lambda t: meta(t) & (t["key"] == key)), F.lit(0))["content"]
    audio = F.transform("tags", lambda t: (
        F.when(meta(t) & t["key"].isin("og:audio", "og:audio:url", "twitter:player:stream"), resolve_url(base, t["content"]))
        .when(t["name"].isin("audio", "source") & (t["src"] != "") & ((t["name"] == "audio") | (t["type"] == "") | media_type(t)),
              resolve_url(base, t["src"]))
        .when(linked(t) & ~feed_type(t) & media_type(t), resolve_url(base, t["href"]))))
    feeds = F.transform("tags", lambda t: F.when(linked(t) & feed_type(t), resolve_url(base, t["href"])))
    written = F.transform("tags", lambda t: F.when(
        linked(t) & ~feed_type(t) & ~media_type(t) & (F.contains(t["rel"], F.lit("transcript")) | suffix(
            split_url(resolve_url(base, t["href"])).path).isin(fixed.PAGE_TRANSCRIPT_SUFFIXES)), resolve_url(base, t["href"])))
    named = strip(F.array_join(F.transform("titles", unescape), " "))
    rows = rows.select(
        "page_id", "url", F.coalesce(first_meta("og:title"), named).alias("title"),
        F.coalesce(first_meta("music:duration"), first_meta("video:duration")).alias("duration"),
        F.array_compact(audio).alias("audio"), F.array_compact(feeds).alias("feeds"), F.array_compact(written).alias("written"))
    nodes = jsonld_nodes(pages).join(pages.select("page_id", url_base(F.col("url")).alias("_base")), "page_id")
    http = F.when(F.regexp_like("transcript", F.lit("^https?://")), F.col("transcript"))
    found = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "path", "name", "duration",
        F.array_compact(F.array(resolve_url(base, F.col("content_url")), resolve_url(base, F.col("embed_url")))).alias("audio"),
        http.alias("written")))).alias("n"))
    rows = rows.join(found, "page_id", "left")
    listed = lambda field: F.coalesce(F.transform("n", lambda x: x[field]), F.array())
    first = lambda field: F.get(F.filter(F.transform("n", lambda x: x[field]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    unique = lambda *arrays: F.array_distinct(F.filter(F.concat(*arrays), lambda v: F.coalesce(v, F.lit("")) != ""))
    return rows.select(
        "page_id", "url", strip(unescape(F.coalesce(F.nullif("title", F.lit("")), first("name"), F.lit("")))).alias("title"),
        F.coalesce("duration", first("duration")).alias("duration"),
        unique(F.col("audio"), F.flatten(listed("audio"))).alias("audio_candidates"),
        unique(F.col("written"), listed("written")).alias("transcript_candidates"),
        F.array_distinct("feeds").alias("feed_candidates"))


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """Episode-like JSON-LD objects of each page, in document order.

    ``path`` is the position of a node in its tree and sorts like a walk.
    Trees are walked level by level until a level is empty, each level worked
    out once; single values are not carried on. Blocks that are not JSON give
    nothing.
    """
    spark = pages.sparkSession
    blocks = pages.select("page_id", F.posexplode(F.filter(F.regexp_extract_all("html", F.lit(_JSON_LD), 1), lambda x: x != "")).alias("b", "json"))
    # Few pages have such blocks; they are found once for all levels.
    blocks = materialize(blocks, "json-ld")
    inner = F.startswith(F.schema_of_variant("node"), F.lit("OBJECT")) | F.startswith(F.schema_of_variant("node"), F.lit("ARRAY"))
    level = blocks.select("page_id", F.array("b").alias("path"), F.try_parse_json("json").alias("node")).where("node IS NOT NULL").where(inner)
    level = materialize(level, "json-ld-level")
    levels = [level]
    while not level.isEmpty():
        level = materialize(level.lateralJoin(spark.tvf.variant_explode(F.col("node").outer())).select(
            "page_id", F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("node")).where(inner), "json-ld-level")
        levels.append(level)
    nodes = reduce(DataFrame.unionByName, levels)
    get = lambda name: F.try_variant_get("node", f"$.{name}", "string")
    kinds = F.coalesce(F.try_variant_get("node", '$["@type"]', "array<string>"), F.array(F.try_variant_get("node", '$["@type"]', "string")))
    return nodes.where(F.arrays_overlap(F.transform(kinds, F.lower), F.array(*map(F.lit, EPISODE_TYPES)))).select(
        "page_id", "path", get("name").alias("name"), get("duration").alias("duration"),
        get("contentUrl").alias("content_url"), get("embedUrl").alias("embed_url"), get("transcript").alias("transcript"))
