"""Clock values: offsets in seconds and their display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from earmark.functions.text import let, strip

_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _number(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(_NUMBER)), F.btrim(c).cast("double"))


def _whole(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"^\s*[+-]?\d+\s*$")), F.btrim(c).cast("double"))


def to_seconds(c: Column) -> Column:
    """``1:02:03.5``, ``02:03,5``, ``90``, ``1500ms`` or ``1.5s``; else null."""
    return let(F.replace(strip(c), F.lit(","), F.lit(".")), lambda text: let(F.split(text, ":"), lambda part: _seconds(text, part)))


def _seconds(text: Column, part: Column) -> Column:
    at = lambda i: _number(F.get(part, F.lit(i)))
    return (
        F.when(F.endswith(text, F.lit("ms")), _number(F.regexp_replace(text, "ms$", "")) / 1000)
        .when(F.endswith(text, F.lit("s")), _number(F.regexp_replace(text, "s$", "")))
        .when(F.size(part) == 3, at(0) * 3600 + at(1) * 60 + at(2))
        .when(F.size(part) == 2, at(0) * 60 + at(1))
        .when(F.size(part) == 1, at(0))
    )


def stamp_seconds(c: Column) -> Column:
    """Stricter form for evidence: only ``m:s`` and ``h:m:s``."""
    part = F.split(F.replace(strip(c), F.lit(","), F.lit(".")), ":")
    get = lambda i: F.get(part, F.lit(i))
    return (
        F.when(F.size(part) == 3, _whole(get(0)) * 3600 + _whole(get(1)) * 60 + _number(get(2)))
        .when(F.size(part) == 2, _whole(get(0)) * 60 + _number(get(1)))
    )


def clock(c: Column) -> Column:
    """``HH:MM:SS`` of the whole seconds, never negative."""
    s = F.floor(F.greatest(c, F.lit(0.0))).cast("long")
    return F.when(c.isNotNull(), F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def clock_ms(c: Column, separator: str = ".") -> Column:
    """``HH:MM:SS.mmm``; the rounded milliseconds carry into the seconds."""
    s = F.greatest(c, F.lit(0.0))
    whole = F.floor(s).cast("long")
    ms = whole * 1000 + F.bround((s - whole) * 1000).cast("long")
    return F.when(c.isNotNull(), F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000))


def micros(c: Column) -> Column:
    """Whole microseconds, so sums do not depend on the order of addition."""
    return F.round(c * 1000000).cast("long")


def end_or_start(end: Column, start: Column) -> Column:
    """The end, or the start where the end is missing or zero."""
    return F.coalesce(F.nullif(end, F.lit(0.0)), start)


def published_at(c: Column) -> Column:
    """Mail-style or ISO date with or without zone; a missing zone is UTC."""
    iso_day = F.regexp_like(c, F.lit(r"^\s*\d{4}-\d{2}-\d{2}"))
    return let(strip(c), lambda text: _published(text, iso_day))


def _published(c: Column, iso_day: Column) -> Column:
    bare = F.regexp_replace(c, r"^[A-Za-z]{3,9},?\s+", "")
    bare = F.regexp_replace(bare, r"\s*\([^)]*\)$", "")
    zoned = let(bare, lambda b: F.when(F.regexp_like(b, F.lit(r"(?:[A-Za-z]{1,5}|[+-]\d{2}:?\d{2})$")), b).otherwise(F.concat(b, F.lit(" +0000"))))
    day = F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    zone = F.regexp_like(c, F.lit(r"(?:[A-Za-z]|:\d{2}[+-]\d{2}:?\d{0,2})$"))
    utc = F.when(day, F.concat(c, F.lit("T00:00:00Z"))).when(zone, c).otherwise(F.concat(c, F.lit("Z")))
    iso = F.when(iso_day, F.try_to_timestamp(utc))
    return F.coalesce(iso, let(zoned, _mail_date))


def _mail_date(zoned: Column) -> Column:
    # One pattern is chosen by shape, so a date is parsed only once.
    numeric = F.regexp_like(zoned, F.lit(r"[+-]\d{2}:?\d{2}$"))
    parse = lambda pattern: F.try_to_timestamp(zoned, F.lit(pattern))
    full = F.regexp_like(zoned, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}"))
    short = F.regexp_like(zoned, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{2} \d{1,2}:\d{2}"))
    return (F.when(full & numeric, parse("d MMM yyyy H:mm[:ss] Z")).when(full, parse("d MMM yyyy H:mm[:ss] z"))
            .when(short & numeric, parse("d MMM yy H:mm[:ss] Z")).when(short, parse("d MMM yy H:mm[:ss] z")))


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
