"""URL functions. Parts are taken by pattern, so odd URLs never raise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold, let

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@dataclass(frozen=True)
class Parts:
    """Columns with the five parts of a URL; absent parts are empty."""

    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column

    @property
    def host(self) -> Column:
        """Host without user info and port, lower case."""
        return F.lower(F.regexp_extract(self._server, r"^(\[[^\]]*\]|[^:]*)", 1))

    @property
    def port(self) -> Column:
        return F.regexp_extract(self._server, r":(\d+)$", 1)

    @property
    def _server(self) -> Column:
        return F.regexp_replace(self.netloc, r"^.*@", "")

    @property
    def site(self) -> Column:
        """Network location up to the first colon, caseless."""
        return F.split(casefold(self.netloc), ":")[0]

    @property
    def server(self) -> Column:
        return F.concat(self.host, F.when(self.port != "", F.concat(F.lit(":"), self.port)).otherwise(F.lit("")))


def split_url(c: Column) -> Parts:
    return Parts(F.lower(F.regexp_extract(c, _SPLIT, 1)), *[F.regexp_extract(c, _SPLIT, i) for i in (2, 3, 4, 5)])


def join_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    lead = F.when(netloc != "", F.concat(F.lit("//"), netloc,
                                         F.when((path != "") & ~F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))))
    tail = lambda mark, part: F.when(part != "", F.concat(F.lit(mark), part)).otherwise(F.lit(""))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.coalesce(lead, F.lit("")), path, tail("?", query),
        tail("#", fragment) if fragment is not None else F.lit(""),
    )


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(query: Column) -> Column:
    """Decoded ``array<struct<k,v>>`` of a query string; blanks are kept."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        _decoded(F.split(p, "=", 2)[0]).alias("k"),
        _decoded(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v")))


def encode_pairs(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _youtube(site: Column) -> Column:
    return (site == "youtu.be") | F.endswith(site, F.lit("youtube.com"))


def _bilibili(site: Column) -> Column:
    return (site == "b23.tv") | F.endswith(site, F.lit("bilibili.com"))


def _web(c: Column) -> Column:
    return split_url(c).scheme.isin("http", "https")


def canonical_url(c: Column) -> Column:
    """The same media gives the same text, whatever parameters were added."""
    u = split_url(F.btrim(c))
    items = pairs(u.query)
    kept = (
        F.when(u.site == "youtu.be", F.filter(items, lambda p: F.lit(False)))
        .when(F.endswith(u.site, F.lit("youtube.com")), F.filter(items, lambda p: p["k"] == "v"))
        .when(_bilibili(u.site), F.filter(items, lambda p: p["k"] == "p"))
        .otherwise(F.filter(items, lambda p: ~F.regexp_like(p["k"], F.lit(fixed.TRACKER_KEY))))
    )
    return join_url(u.scheme, casefold(u.netloc), F.rtrim(u.path, F.lit("/")), encode_pairs(kept))


def source_key(c: Column) -> Column:
    return F.substring(F.sha2(canonical_url(c), 256), 1, 12)


def local_source_key(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")), 256), 1, 12)


def sanitize_url(c: Column, strip_query: bool = False, drop_trackers: bool = False) -> Column:
    """Redact secret query values; drop user info and fragment."""
    u = split_url(c)
    items = pairs(u.query)
    if drop_trackers:
        items = F.filter(items, lambda p: ~F.regexp_like(p["k"], F.lit(fixed.TRACKER_KEY)))
    safe = F.transform(items, lambda p: F.struct(
        p["k"].alias("k"),
        F.when(F.regexp_like(p["k"], F.lit(fixed.SENSITIVE_KEY)), F.lit("[REDACTED]")).otherwise(p["v"]).alias("v")))
    query = F.lit("") if strip_query else encode_pairs(safe)
    return F.when(_web(c), join_url(u.scheme, u.server, u.path, query)).otherwise(c)


def seek_url(c: Column, seconds: Column) -> Column:
    """Link that opens the source at a time; null when it is not a web link."""
    u = split_url(c)
    at = F.greatest(F.lit(0), F.floor(seconds)).cast("string")
    rest = F.filter(pairs(u.query), lambda p: p["k"] != "t")
    query = lambda value: encode_pairs(F.concat(rest, F.array(F.struct(F.lit("t").alias("k"), value.alias("v")))))
    return F.when(_web(c), (
        F.when(_youtube(u.host), join_url(u.scheme, u.netloc, u.path, query(F.concat(at, F.lit("s")))))
        .when(_bilibili(u.host), join_url(u.scheme, u.netloc, u.path, query(at)))
        .otherwise(join_url(u.scheme, u.netloc, u.path, u.query, F.concat(F.lit("t="), at)))
    ))


def suffix(path: Column) -> Column:
    """Lower-case file suffix of a path, or empty."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def source_kind(c: Column) -> Column:
    """Kind of a locator: media, platform or page URL, or local file by suffix."""
    text = F.btrim(c)
    u = split_url(text)
    local = suffix(text)
    return (
        F.when(~u.scheme.isin("http", "https") & ~F.startswith(text, F.lit("/")), F.lit("unknown"))
        .when(F.startswith(text, F.lit("/")),
              F.when(local.isin(fixed.FEED_SUFFIXES), F.lit("local_rss"))
              .when(local.isin(fixed.TRANSCRIPT_SUFFIXES), F.lit("local_transcript"))
              .when(local.isin(fixed.MEDIA_SUFFIXES), F.lit("local_media"))
              .otherwise(F.lit("local_file")))
        .when(suffix(u.path).isin(fixed.MEDIA_SUFFIXES), F.lit("media_url"))
        .when(_youtube(u.site), F.lit("youtube"))
        .when(_bilibili(u.site), F.lit("bilibili"))
        .otherwise(F.lit("web_url"))
    )


def unsafe_reason(c: Column) -> Column:
    """Why a URL must not be fetched, judged from the text alone; null if fine."""
    u = split_url(c)
    host = F.rtrim(u.host, F.lit("."))
    private_v4 = (r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
                  r"|^192\.0\.[02]\.|^198\.(?:1[89]\.|51\.100\.)|^203\.0\.113\.|^(?:24\d|25[0-5])\.")
    literal_v4 = F.regexp_like(host, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$"))
    private_v6 = F.regexp_like(host, F.lit(r"^\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*|2001:db8:.*)\]$"))
    # One number, hexadecimal, octal or short forms, and IPv4 inside IPv6, can all mean a private address.
    odd_number = F.regexp_like(host, F.lit(r"^(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}$")) & (
        ~literal_v4 | F.regexp_like(host, F.lit(r"(?:^|\.)0\d")))
    mapped = F.regexp_like(host, F.lit(r"^\[(?:0*:)*:?(?:ffff:)?(?:\d{1,3}(?:\.\d{1,3}){3}|ffff:[0-9a-f:]+)\]$"))
    dotted = F.regexp_extract(host, r"^\[[0:]*(?:ffff:)?(\d{1,3}(?:\.\d{1,3}){3})\]$", 1)
    high, low = (F.conv(F.nullif(F.regexp_extract(host, r"^\[[0:]*ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]$", i), F.lit("")), 16, 10).cast("int") for i in (1, 2))
    hexed = F.concat_ws(".", *[F.floor(part / 256).cast("string") if top else (part % 256).cast("string") for part in (high, low) for top in (True, False)])
    inside = F.coalesce(F.nullif(dotted, F.lit("")), F.nullif(hexed, F.lit("")))
    mapped = mapped & (inside.isNull() | F.regexp_like(inside, F.lit(private_v4)))
    return (
        F.when(~u.scheme.isin("http", "https"), F.lit("scheme"))
        .when(F.regexp_like(u.netloc, F.lit("^[^@]+@")), F.lit("credentials"))
        .when(host == "", F.lit("no_host"))
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")), F.lit("loopback_name"))
        .when((literal_v4 & F.regexp_like(host, F.lit(private_v4))) | private_v6 | odd_number | mapped, F.lit("private_address"))
    )


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` steps walked."""
    steps = F.split(path, "/")
    walked = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda kept, step: F.when(step == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(step == ".", kept).otherwise(F.concat(kept, F.array(step))))
    trailing = F.when(F.regexp_like(path, F.lit(r"/\.{1,2}$")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(walked, "/"), trailing)


def url_base(c: Column) -> Column:
    """What links are resolved against, as a struct to keep in a column."""
    part = lambda pattern, group=0: F.regexp_extract(c, pattern, group)
    return F.struct(
        c.alias("text"), part(r"^([^:/?#]+:)//", 1).alias("scheme"), part(r"^[^:/?#]+://[^/?#]*").alias("root"),
        part(r"^[^:/?#]+://[^/?#]*(/[^?#]*/|/)", 1).alias("folder"),
        part(r"^[^?#]*").alias("bare"), part("^[^#]*").alias("whole"))


def resolve_url(base: Column, link: Column) -> Column:
    """A link on the page described by ``url_base``, made absolute."""

    def resolved(l: Column) -> Column:
        path = F.regexp_extract(l, r"^[^?#]*", 0)
        rest = F.regexp_extract(l, r"^[^?#]*(.*)$", 1)
        below = F.when(F.startswith(l, F.lit("/")), path).otherwise(
            F.concat(F.when(base["folder"] == "", F.lit("/")).otherwise(base["folder"]), path))
        clean = let(below, lambda p: F.when(F.contains(p, F.lit("/.")), _without_dots(p)).otherwise(p))
        return (
            F.when(l == "", base["text"]).when(F.regexp_like(l, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), l)
            .when(F.startswith(l, F.lit("//")), F.concat(base["scheme"], l))
            .when(F.startswith(l, F.lit("?")), F.concat(base["bare"], l))
            .when(F.startswith(l, F.lit("#")), F.concat(base["whole"], l))
            .otherwise(F.concat(base["root"], clean, rest)))

    return let(link, resolved)


def absolute_url(base: Column, link: Column) -> Column:
    """Resolve a link against its page, with ``.`` and ``..`` steps removed."""
    return resolve_url(url_base(base), link)


def media_suffix(url: Column, content_type: Column) -> Column:
    named = suffix(split_url(url).path)
    lookup = F.create_map(*[F.lit(x) for item in fixed.CONTENT_TYPE_SUFFIX.items() for x in item])
    kind = F.lower(F.btrim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.when(named.isin([s for s in fixed.MEDIA_SUFFIXES if s not in (".mkv", ".mov")]), named).otherwise(
        F.coalesce(F.try_element_at(lookup, kind), F.lit(".mp3")))
