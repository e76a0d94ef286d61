"""RSS, Atom and RDF feeds as item rows, and choosing items from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold, collapse, let, strip_markup, unescape
from earmark.functions.times import published_at
from earmark.functions.urls import resolve_url, split_url, suffix, url_base

_ITEM = r"(?is)(<(?:[\w.-]+:)?(?:item|entry)\b[^>]*>.*?</(?:[\w.-]+:)?(?:item|entry)\s*>)"
_TAG = r"(?is)(<(?:[\w.-]+:)?(?:enclosure|link|transcript)\b[^>]*>)"


def _node_text(raw: Column) -> Column:
    plain = unescape(F.regexp_replace(raw, r"(?s)<[^!>][^>]*>", ""))
    quoted = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return collapse(F.when(F.contains(raw, F.lit("<![CDATA[")), quoted).otherwise(plain))


def _children(item: Column) -> Column:
    """``name`` (lower case, without prefix) and ``inner`` of the elements directly below an item; what is nested in them is part of them."""
    inner = F.regexp_replace(item, r"^<[^>]*>", "")
    found = F.regexp_extract_all(inner, F.lit(r"(?is)(<((?:[\w.-]+:)?[\w.-]+)(?:\s[^>]*)?(?<!/)>.*?</\2\s*>)"), 1)
    return F.transform(found, lambda c: F.struct(
        F.lower(F.regexp_extract(c, r"^<(?:[\w.-]+:)?([\w.-]+)", 1)).alias("name"),
        F.regexp_extract(c, r"(?s)^<[^>]*>(.*)</[^>]*>$", 1).alias("inner")))


def _first_text(children: Column, *names: str) -> Column:
    """Text of the first named child that has some, in document order."""
    texts = F.transform(F.filter(children, lambda c: c["name"].isin(*names)), lambda c: let(c["inner"], _node_text))
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, or empty."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    bare = lambda raw: F.when(F.startswith(raw, F.lit('"')) | F.startswith(raw, F.lit("'")), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return unescape(let(F.regexp_extract(tag, pattern, 1), bare))


def parse_feeds(files: DataFrame) -> DataFrame:
    """``feed_url, position, title, …`` from ``feed_url, text``, one row a feed."""
    items = files.select("feed_url", F.posexplode(F.regexp_extract_all("text", F.lit(_ITEM), 1)).alias("position", "item"))
    item, base = F.col("item"), F.col("_base")

    def tag(t: Column) -> Column:
        link = let(attribute(t, "href"), lambda h: F.when(h == "", attribute(t, "url")).otherwise(h))
        return let(link, lambda href: let(F.lower(attribute(t, "type")), lambda kind: F.struct(
            F.lower(F.regexp_extract(t, r"(?i)^<(?:[\w.-]+:)?(\w+)", 1)).alias("name"), href.alias("href"),
            F.startswith(kind, F.lit("audio/")).alias("audio"), F.lower(attribute(t, "rel")).alias("rel"),
            suffix(split_url(href).path).isin(fixed.MEDIA_SUFFIXES).alias("named"))))

    rows = items.withColumn("_base", url_base(F.col("feed_url"))).withColumn("children", _children(item)).withColumn("tags", F.filter(
        F.transform(F.regexp_extract_all(item, F.lit(_TAG), 1), tag), lambda t: t["href"] != ""))
    media = lambda t: t["audio"] | t["named"]
    enclosures = F.filter("tags", lambda t: (t["name"] == "enclosure") & media(t))
    links = F.filter("tags", lambda t: t["name"] == "link")
    first = lambda array: F.get(array, F.lit(0))["href"]
    url = lambda link: let(link, lambda l: F.when(l.isNotNull(), resolve_url(base, l)))
    audio_links = F.filter(links, lambda t: t["audio"])
    sets_audio = lambda t: ((t["name"] == "enclosure") & media(t)) | ((t["name"] == "link") & t["audio"])
    # An audio link counts as a page link only once the audio is known.
    page_links = F.filter("tags", lambda t, i: (t["name"] == "link") & t["rel"].isin("alternate", "") & (
        ~t["audio"] | F.exists(F.slice("tags", F.lit(1), i), sets_audio)))
    return rows.select(
        "feed_url", F.col("position").cast("long").alias("position"),
        _first_text(F.col("children"), "title").alias("title"), _first_text(F.col("children"), "guid", "id").alias("guid"),
        _first_text(F.col("children"), "pubdate", "published", "updated", "date").alias("published"),
        F.nullif(_first_text(F.col("children"), "duration"), F.lit("")).alias("duration"),
        url(first(page_links)).alias("episode_url"),
        url(F.coalesce(first(F.reverse(enclosures)), first(audio_links))).alias("audio_url"),
        F.transform(F.filter("tags", lambda t: t["name"] == "transcript"), lambda t: resolve_url(base, t["href"])).alias("transcript_urls"),
        strip_markup(_first_text(F.col("children"), "description", "summary", "content", "encoded")).alias("description"))


def latest_items(items: DataFrame) -> DataFrame:
    """The newest dated item of each feed; the first one where no date is known."""
    at = published_at(F.col("published"))
    row = F.struct(*[F.col(c) for c in items.columns])
    best = items.groupBy("feed_url").agg(F.max_by(row, F.struct(at.isNotNull(), at, -F.col("position"))).alias("r"))
    return best.select("r.*")


def select_items(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``feed_url, query, position, tier``: items a query names.

    An exact title or guid beats a substring; without a query the single item
    of a feed is taken.
    """
    asked = requests.withColumn("_q", F.btrim(casefold(F.coalesce("query", F.lit("")))))
    title, guid = casefold(F.col("title")), casefold(F.col("guid"))
    rows = asked.join(items.select("feed_url", "position", title.alias("_t"), guid.alias("_g")), "feed_url")
    tier = F.when(F.col("_q") == "", F.lit(3)).when(F.col("_q").isin(F.col("_t"), F.col("_g")), F.lit(1)).when(
        F.contains("_t", "_q") | F.contains("_g", "_q"), F.lit(2))
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    key = ["feed_url", "query"]
    best = rows.groupBy("feed_url", F.col("query").alias("_query")).agg(F.min("tier").alias("_best"), F.count("*").alias("_n"))
    joined = rows.join(best, (rows["feed_url"] == best["feed_url"]) & rows["query"].eqNullSafe(best["_query"])).drop(best["feed_url"])
    return joined.where("tier = _best AND (tier < 3 OR _n = 1)").select(*key, "position", "tier")


def selection_status(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``selected``, ``ambiguous``, ``no_match`` or ``open`` per request."""
    chosen = select_items(items, requests).groupBy("feed_url", F.col("query").alias("_query")).agg(
        F.count("*").alias("matches"), F.min("position").alias("position"))
    rows = requests.join(chosen.withColumnRenamed("feed_url", "_feed"),
                         (F.col("feed_url") == F.col("_feed")) & F.col("query").eqNullSafe(F.col("_query")), "left")
    n = F.coalesce("matches", F.lit(0))
    status = F.when(n == 1, F.lit("selected")).when(n > 1, F.lit("ambiguous")).when(
        F.coalesce("query", F.lit("")) != "", F.lit("no_match")).otherwise(F.lit("open"))
    return rows.select("feed_url", "query", n.alias("matches"), F.when(n == 1, F.col("position")).alias("position"), status.alias("status"))


def feed_candidates(items: DataFrame, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Item count and the first items of each feed, by position.

    Per feed the smallest positions are kept while grouping (a top-k report),
    so a feed of any length never meets in one task.
    """
    from pyspark.sql import Window

    counted = items.groupBy("feed_url").agg(F.count("*").alias("episode_count"))
    order = Window.partitionBy("feed_url").orderBy("position")
    first = items.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    return first.join(counted, "feed_url")
