"""URL filters with dated lists: an as-of join of captures and list entries, in DataFrame operations only.

A list is a table of dated entries: on ``day`` the key (a host with an optional
path prefix) was listed or unlisted. They become validity intervals, one row
from each change to the next. A host entry covers its subdomains, a prefix
entry the path itself and all below it. A capture is blocked if any entry that
covers it was listed on the day it was fetched.

Everything is worked out for distinct (host, day) and (host, path, day) before
it goes to single captures, so a host that holds a third of all captures is at
most one row a day and path in the joins with the list. Only prefixes as deep
as those the list has for a host are made, never all prefixes of a path.

Entries of one key and day count once (listed if any of them lists). A URL
without a scheme and host, null, or with a host over 253 characters is covered by nothing and kept, as
is one with a null day. Entries with a null host, day or action are ignored. Repeated
captures are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
MOST_HOST = 253


def host_of(url: Column | str) -> Column:
    """The host in lower case, without user, port and last dot; empty if there is none or it is too long."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    host = F.lower(F.regexp_replace(authority, "\\.?(:[0-9]*)?$", ""))
    return F.when(F.length(host).between(1, MOST_HOST), host).otherwise("")


def path_of(url: Column | str) -> Column:
    """The path without query, fragment and slashes at its end; empty for null."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """``host``, ``prefix``, ``depth``, ``since``, ``until`` (null: open) of the times that a key was listed.

    A key has one row a day at most before the window, so no group is larger
    than the calendar of the list.
    """
    clean = entries.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("day").isNotNull() & F.col("listed").isNotNull())
    prefix = F.regexp_replace(F.coalesce("prefix", F.lit("")), "/+$", "")
    daily = clean.select("host", prefix.alias("prefix"), "day", "listed").groupBy("host", "prefix", "day").agg(F.max("listed").alias("listed"))
    until = F.lead("day").over(Window.partitionBy("host", "prefix").orderBy("day"))
    spans = daily.withColumn("until", until).where("listed")
    return spans.select("host", "prefix", (F.size(F.split("prefix", "/")) - 1).alias("depth"), F.col("day").alias("since"), "until")


def _active(day: str = "day") -> Column:
    return (F.col("since") <= F.col(day)) & (F.col("until").isNull() | (F.col(day) < F.col("until")))


def _summary(rows: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Number of covering entries and the longest of them (the last in order, if two are as long)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.struct(F.length(key).alias("l"), key.alias("k"))).alias("longest"))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """All rows and columns of ``captures`` with ``host``, ``n_matches``, ``matched`` (the longest key that covers it) and ``kept``.

    ``captures`` has a URL and the day it was fetched, ``entries`` has ``host``,
    ``prefix``, ``day`` and ``listed``. Columns of ``captures`` that have the
    name of a result are replaced.
    """
    spans = intervals(entries)
    whole, folders = spans.where("prefix = ''").select("host", "since", "until"), spans.where("prefix <> ''")
    own = [c for c in captures.columns if c not in ("host", "n_matches", "matched", "kept")]
    rows = captures.select(*[F.col(f"`{c}`") for c in own], host_of(f"`{url}`").alias("host"), path_of(f"`{url}`").alias("__path"), F.col(f"`{day}`").alias("__day"))

    # Hosts: each distinct host and day against the entries of its own suffixes.
    sites = rows.where("host <> '' AND __day IS NOT NULL").select(F.col("host").alias("site"), F.col("__day").alias("day")).distinct()
    labels = F.split("site", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = sites.withColumn("host", F.explode(F.array_distinct(suffixes))).join(whole, "host").where(_active())
    by_host = _summary(by_host, ["site", "day"], F.col("host")).select(F.col("site").alias("host"), F.col("day").alias("__day"), F.col("n").alias("n_h"), F.col("longest").alias("longest_h"))

    # Paths: each distinct path and day cut at the depths that the list has for its host.
    depths = folders.select("host", "depth").distinct()
    paths = rows.where("host <> '' AND __day IS NOT NULL AND __path <> ''").select("host", F.col("__path").alias("path"), F.col("__day").alias("day")).distinct()
    cut = paths.join(depths, "host").where(F.size(F.split("path", "/")) > F.col("depth"))
    cut = cut.withColumn("prefix", F.expr("substring_index(path, '/', depth + 1)"))
    by_path = cut.join(folders, ["host", "prefix", "depth"]).where(_active())
    by_path = _summary(by_path, ["host", "path", "day"], F.concat("host", "prefix")).select("host", F.col("path").alias("__path"), F.col("day").alias("__day"), F.col("n").alias("n_p"), F.col("longest").alias("longest_p"))

    out = rows.join(by_host, ["host", "__day"], "left").join(by_path, ["host", "__path", "__day"], "left")
    n = F.coalesce("n_h", F.lit(0)) + F.coalesce("n_p", F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in own], "host", n.cast("long").alias("n_matches"),
                      F.greatest("longest_h", "longest_p").getField("k").alias("matched"), (n == 0).alias("kept"))
