"""Text functions: ``Column -> Column``, all evaluated inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from earmark.functions import fixed

_WS = f"(?U){fixed.WS}+"
# One string, as a map of so many names would be searched name by name and go to each task as objects.
_NAMED = "\x01" + "".join(f"&{name}\x02{char}\x01" for name, char in html5.items())
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
# Names that also hold without their semicolon, the longest first.
_BARE = "^&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# Numbers from 0x80 to 0x9f mean Windows-1252 characters, where it has one.
_REMAP = json.dumps({i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")})
_REFERENCE = "(&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]{0,31};?))"
_EDGE = f"(?U)^{fixed.WS}+|{fixed.WS}+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(c, _WS, " "))


def casefold(c: Column) -> Column:
    """Caseless form. ``lower`` leaves sharp s, long s and final sigma alone."""
    return F.replace(F.translate(F.lower(c), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def search_text(c: Column) -> Column:
    return collapse(casefold(c))


def words(c: Column) -> Column:
    """White-space separated words; an empty text has none."""
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _numbered(reference: Column) -> Column:
    """The character of ``&#…``: none for control characters and non-characters, U+FFFD where there can't be one."""
    hexed = F.regexp_like(reference, F.lit("^&#[xX]"))
    digits = F.regexp_replace(F.regexp_replace(reference, "^&#[xX]?0*|;", ""), "^$", "0")
    # Nine digits and more are beyond all characters, and would leave the range of numbers.
    number = F.when(F.length(digits) > 8, F.lit(1 << 32)).when(hexed, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))

    def character(n: Column) -> Column:
        none = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | n.isin(0xB, 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(F.from_json(F.lit(_REMAP), "map<string,string>"), n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
            .when(none, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    return let(number, character)


def _named(reference: Column) -> Column:
    def known(name: Column) -> Column:
        key = F.concat(F.lit("\x01"), name, F.lit("\x02"))
        cut = lambda text, mark, n: F.call_function("substring_index", text, mark, F.lit(n))
        return let(key, lambda k: F.when(F.contains(F.lit(_NAMED), k), cut(cut(F.lit(_NAMED), k, -1), F.lit("\x01"), 1)))

    common = F.when(F.lit(False), F.lit(""))
    for name, char in _COMMON.items():
        common = common.when(reference == name, F.lit(char))
    longer = let(F.regexp_extract(reference, f"({_BARE})", 1), lambda begin: F.concat(
        known(begin), F.substring(reference, F.length(begin) + 1, F.length(reference))))
    return F.coalesce(common, known(reference), longer, reference)


def unescape(c: Column) -> Column:
    """Resolve character references once, in one pass (``&amp;lt;`` becomes ``&lt;``)."""
    return let(c, _unescaped)


def _unescaped(c: Column) -> Column:
    resolved = F.transform(
        F.regexp_extract_all(c, F.lit(_REFERENCE), 1),
        lambda ref: F.when(F.startswith(ref, F.lit("&#")), _numbered(ref)).otherwise(_named(ref)))
    between = F.split(c, _REFERENCE, -1)
    joined = F.array_join(F.zip_with(between, resolved, lambda text, char: F.concat(text, F.coalesce(char, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def clean_text(c: Column) -> Column:
    """Caption text without character references, tags, and odd spaces."""
    bare = F.regexp_replace(F.regexp_replace(unescape(c), fixed.CLASS_TAG, ""), fixed.ANY_TAG, "")
    return collapse(F.replace(F.translate(bare, "\u200b", " "), F.lit("\ufeff"), F.lit("")))


def speaker_and_text(c: Column) -> Column:
    """``struct(speaker, text)`` from a voice tag or a ``Name: text`` prefix."""
    voiced = lambda raw: F.struct(
        clean_text(F.regexp_extract(raw, fixed.VOICE_TAG, 1)).alias("speaker"), clean_text(F.regexp_extract(raw, fixed.VOICE_TAG, 2)).alias("text"))
    return let(c, lambda raw: F.when(F.regexp_like(raw, F.lit(fixed.VOICE_TAG)), voiced(raw)).otherwise(
        let(clean_text(raw), lambda cleaned: let(F.regexp_extract(cleaned, fixed.SPEAKER_PREFIX, 1), lambda name: _prefixed(cleaned, name)))))


def _prefixed(cleaned: Column, name: Column) -> Column:
    return F.when(
        (name != "") & (F.size(words(name)) <= fixed.SPEAKER_MAX_WORDS),
        F.struct(strip(name).alias("speaker"), strip(F.regexp_extract(cleaned, fixed.SPEAKER_PREFIX, 2)).alias("text")),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("speaker"), cleaned.alias("text")))


def keyword_tokens(c: Column) -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(f"({fixed.KEYWORD})"), 1)


def query_terms(c: Column) -> Column:
    """Latin tokens, then CJK bigrams (and short whole runs), first seen first."""
    folded = casefold(c)
    latin = F.regexp_extract_all(folded, F.lit(f"({fixed.LATIN_TERM})"), 1)
    runs = F.regexp_extract_all(folded, F.lit(f"({fixed.CJK_RUN})"), 1)
    grams = F.flatten(F.transform(runs, lambda run: F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)),
                    lambda at: F.substring(run, at, F.lit(2))),
        F.when(F.length(run) <= 4, F.array(run)).otherwise(F.array().cast("array<string>")),
    )))
    return F.array_distinct(F.concat(latin, grams))


def ranking_terms(c: Column) -> Column:
    return F.array_except(query_terms(c), F.array(*map(F.lit, fixed.STOP_TERMS)))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part`` (not empty) in ``text``."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))


def slug(c: Column, fallback: str = "episode") -> Column:
    dashed = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, _WS, "-"), r"^[ .-]+|[ .-]+$", "")
    cut = F.substring(trimmed, 1, 90)
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def safe_name(c: Column, fallback: str) -> Column:
    kept = F.replace(strip(F.regexp_replace(c, r"(?U)[^\w\-. ]+", "")), F.lit(" "), F.lit("-"))
    cut = F.regexp_replace(F.substring(kept, 1, 100), r"^[.-]+|[.-]+$", "")
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def language_slug(c: Column) -> Column:
    """Null when nothing portable is left of the language name."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", ""), F.lit(""))


def redact_paths(c: Column, root: Column | None = None) -> Column:
    base = c if root is None else F.replace(F.replace(c, root, F.lit(".")), F.replace(root, F.lit("\\"), F.lit("/")), F.lit("."))
    return F.regexp_replace(base, fixed.LOCAL_PATH, "[LOCAL_PATH_REDACTED]")


def redact_remote_urls(c: Column) -> Column:
    return F.regexp_replace(c, fixed.REMOTE_URL, "[REMOTE_URL_REDACTED]")


def strip_markup(c: Column) -> Column:
    """Description text: tags become spaces, references are resolved."""
    return strip(unescape(F.regexp_replace(c, fixed.ANY_TAG, " ")))


def longest_repeat(c: Column) -> Column:
    """Longest span of one repeated unit: a character 12 or more times, or a
    2 to 12 character unit 8 or more times, ignoring white space."""
    return longest_repeat_packed(F.regexp_replace(casefold(c), _WS, ""))


def longest_repeat_packed(packed: Column) -> Column:
    """``longest_repeat`` of a caseless text without white space."""
    spans = [F.regexp_extract_all(packed, F.lit(r"(?s)((.)\2{11,})"), 1)]
    # The last unit of a span is left for the next match: the span after it may begin inside.
    spans += [F.regexp_extract_all(packed, F.lit(rf"(?s)(?=((.{{{width}}})\2{{7,}}))\2+(?=\2)"), 1) for width in range(2, 13)]
    longest = F.coalesce(F.array_max(F.transform(F.concat(*spans), lambda span: F.length(span))), F.lit(0))
    # Eight units in a row hold four in a row (of the unit, turned round) from each of their first five places, so every fifth place is
    # enough to look at; few texts have that.
    some = F.regexp_like(packed, F.lit(r"(?s)\A(?:.{5})*?(.{1,12}?)\1{3}"))
    return F.when(some & F.regexp_like(packed, F.lit(r"(?s)(.{1,12}?)\1{7,}")), longest).otherwise(F.lit(0))


def flat_list(c: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "; "), F.lit(""))


def flat_span(c: Column) -> Column:
    """``start–end (label)`` for a struct with start, end and label."""
    text = lambda name: F.coalesce(c[name].cast("string"), F.lit(""))
    start, end, label = text("start"), text("end"), text("label")
    span = F.concat(start, F.when((end != "") & (end != start), F.concat(F.lit("–"), end)).otherwise(F.lit("")))
    shown = F.when(label != "", F.concat(span, F.lit(" ("), label, F.lit(")"))).otherwise(span)
    return F.when((start != "") | (end != ""), shown).otherwise(F.to_json(c))


def flat_bool(c: Column) -> Column:
    return F.when(c, F.lit("true")).when(~c, F.lit("false")).otherwise(F.lit(""))
