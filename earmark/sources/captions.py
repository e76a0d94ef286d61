"""Caption and transcript files as cue rows.

Every parser takes ``path, episode_id, text`` (one row per file) and gives
``episode_id, pos, start_seconds, end_seconds, speaker, language, confidence,
text`` with ``pos`` counting from 0 without gaps. Cues are found inside the
row by patterns and array functions, so parsing needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import clean_text, let, speaker_and_text, strip, unescape
from earmark.functions.times import to_seconds

_KEEP = ("episode_id", "pos", "start_seconds", "end_seconds", "speaker", "language", "confidence", "text")


def _rows(files: DataFrame, cues: Column) -> DataFrame:
    """Explode an array of cue structs; cues without text are dropped first."""
    full = F.filter(cues, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    rows = files.select("episode_id", F.posexplode(full).alias("pos", "cue"))
    return rows.select("episode_id", F.col("pos").cast("long").alias("pos"), *[F.col(f"cue.{n}").alias(n) for n in _KEEP[2:]])


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _cue(start: Column, end: Column, speaker: Column, text: Column,
         language: Column | None = None, confidence: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        start.cast("double").alias("start_seconds"), end.cast("double").alias("end_seconds"), speaker.cast("string").alias("speaker"),
        (none if language is None else language).cast("string").alias("language"),
        (none if confidence is None else confidence).cast("double").alias("confidence"), text.alias("text"))


def caption_cues(text: Column) -> Column:
    """SRT and VTT: a line with ``t --> t`` opens a cue, a blank line ends it."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    # A block is a time line and the non-blank lines after it; possessive, so that long blocks take no stack.
    block = rf"(?m)^([^\n]*?{fixed.CUE_RANGE}[^\n]*(?:\n(?=[^\n]*\S)[^\n]*)*+)"
    blocks = F.regexp_extract_all(text, F.lit(block), 1)

    def cue(lines: Column) -> Column:
        body = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), strip), " ")
        return let(speaker_and_text(body), lambda said: let(lines[0], lambda times: _cue(
            *[to_seconds(F.regexp_extract(times, fixed.CUE_RANGE, i)) for i in (1, 2)], said["speaker"], said["text"])))

    return F.transform(blocks, lambda b: let(F.split(b, "\n"), cue))


def line_cues(text: Column) -> Column:
    """Plain text: ``[time] text`` lines; without any, the file is one cue."""
    return let(F.filter(F.transform(_lines(text), strip), lambda x: x != ""), _cues_of_lines)


def _cues_of_lines(lines: Column) -> Column:
    timed = F.filter(lines, lambda x: F.regexp_like(x, F.lit(fixed.BRACKET_LINE)))
    whole = clean_text(F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit("#"))), " "))
    none = F.lit(None)
    return let(timed, lambda found: F.when(F.size(found) > 0, _timed_lines(found)).otherwise(F.array(_cue(none, none, none, whole))))


def _timed_lines(timed: Column) -> Column:
    starts = F.transform(timed, lambda x: to_seconds(F.regexp_extract(x, fixed.BRACKET_LINE, 1)))

    def cue(line: Column, i: Column, at: Column) -> Column:
        # The next line's time, whether or not that line has text.
        return let(speaker_and_text(F.regexp_extract(line, fixed.BRACKET_LINE, 2)), lambda said: _cue(
            F.get(at, i), F.get(at, i + 1), said["speaker"], said["text"]))

    return let(starts, lambda at: F.transform(timed, lambda line, i: cue(line, i, at)))


def ass_cues(text: Column) -> Column:
    """ASS dialogue lines of exactly ten fields; the last keeps its commas."""
    said = F.filter(_lines(text), lambda x: F.regexp_like(x, F.lit(r"(?i)^\s*dialogue:")))

    def cue(f: Column) -> Column:
        body = F.replace(F.replace(F.regexp_replace(F.get(f, F.lit(9)), r"\{[^}]*\}", ""), F.lit("\\N"), F.lit(" ")), F.lit("\\n"), F.lit(" "))
        return _cue(to_seconds(F.get(f, F.lit(1))), to_seconds(F.get(f, F.lit(2))),
                    F.nullif(strip(F.get(f, F.lit(4))), F.lit("")), clean_text(body))

    return F.transform(said, lambda line: let(F.split(F.regexp_replace(line, r"^[^:]*:", ""), ",", 10), cue))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    got = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.nullif(got, F.lit(""))


def ttml_cues(text: Column) -> Column:
    """TTML paragraphs of any namespace; the end may follow from ``dur``."""
    block = r"(?is)(<(?:[\w.-]+:)?p\b[^>]*(?<!/)>.*?</(?:[\w.-]+:)?p\s*>)"

    def cue(b: Column) -> Column:
        head = F.regexp_extract(b, r"(?s)^(<[^>]*>)", 1)
        start, end = to_seconds(_attribute(head, "begin")), to_seconds(_attribute(head, "end"))
        said = clean_text(unescape(F.regexp_replace(b, fixed.ANY_TAG, " ")))
        return _cue(start, F.coalesce(end, start + to_seconds(_attribute(head, "dur"))),
                    F.coalesce(_attribute(head, "speaker"), _attribute(head, "voice")), said)

    return F.transform(F.regexp_extract_all(text, F.lit(block), 1), cue)


_TEXT_KEYS = ("text", "transcript", "content")
_LIST_KEYS = ("segments", "utterances", "cues", "transcript")


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "string")


def _filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _picked(doc: Column, text: Column) -> Column:
    """The first list under the usual keys, at any depth; an empty one ends the object that it is in.

    What is still to be looked at waits in order with its depth. ``text`` bounds
    the steps: a value is looked at once, and only what a key opens has inner ones.
    """
    entry = lambda depth, value: F.struct(depth.cast("int").alias("depth"), value.alias("value"))
    state = lambda waiting, found: F.struct(waiting.alias("waiting"), found.alias("found"))
    none = F.lit(None).cast("array<variant>")

    def step(so_far: Column, _: Column) -> Column:
        first, rest = F.get(so_far["waiting"], F.lit(0)), F.slice(so_far["waiting"], F.lit(2), F.size(so_far["waiting"]))
        listed = F.try_variant_get(first["value"], "$", "array<variant>")
        inner = F.array(*[entry(first["depth"] + 1, F.try_variant_get(first["value"], f"$.{k}", "variant")) for k in _LIST_KEYS])
        return (
            F.when(so_far["found"].isNotNull() | (F.size(so_far["waiting"]) == 0), so_far)
            .when(F.size(listed) > 0, state(so_far["waiting"], listed))
            .when(listed.isNotNull(), state(F.filter(rest, lambda e: e["depth"] < first["depth"]), none))
            .otherwise(state(F.concat(F.filter(inner, lambda e: e["value"].isNotNull()), rest), none)))

    opened = F.coalesce(F.regexp_count(text, F.lit(r'"\s*:\s*[{\[]')), F.lit(0)) + 1
    found = F.aggregate(F.sequence(F.lit(0), opened * len(_LIST_KEYS)), state(F.array(entry(F.lit(0), doc)), none), step)
    return F.coalesce(found["found"], F.array().cast("array<variant>"))


def json_cues(text: Column) -> Column:
    """JSON segments under any of the usual keys and field names, however deep.

    ``start_ms``/``end_ms`` win over seconds. Texts that are not JSON give no rows.
    """
    return let(F.try_parse_json(text), lambda doc: _cues_of_json(_picked(doc, text)))


def _cues_of_json(items: Column) -> Column:
    def cue(item: Column) -> Column:
        get = lambda *names: F.coalesce(*[_field(item, n) for n in names])
        ms = lambda name: F.try_variant_get(item, f"$.{name}", "double") / 1000
        return _cue(
            F.coalesce(ms("start_ms"), to_seconds(get("start_seconds", "start", "begin"))),
            F.coalesce(ms("end_ms"), to_seconds(get("end_seconds", "end", "finish"))),
            _filled(*[_field(item, n) for n in ("speaker", "speaker_name", "speaker_label")]),
            clean_text(F.coalesce(_filled(*[_field(item, n) for n in _TEXT_KEYS]), F.lit(""))),
            language=_field(item, "language"), confidence=F.try_variant_get(item, "$.confidence", "double"))

    return F.transform(items, cue)


_EVENTS = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"


def event_cues(text: Column) -> Column:
    """JSON3: timed events whose text is the joined segment pieces."""
    events = F.coalesce(F.from_json(text, _EVENTS)["events"], F.array().cast("array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"))

    def cue(e: Column) -> Column:
        text = clean_text(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")),
                                                   lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
        start = F.coalesce(e["tStartMs"], F.lit(0.0)) / 1000
        length = F.nullif(F.coalesce(e["dDurationMs"], F.lit(0.0)) / 1000, F.lit(0.0))
        return _cue(start, start + length, F.lit(None), text)

    return F.transform(events, cue)


def _parser(cues):
    def parse(files: DataFrame) -> DataFrame:
        return _rows(files, cues(F.col("text")))

    parse.__doc__ = cues.__doc__
    return parse


parse_captions, parse_lines, parse_ass = _parser(caption_cues), _parser(line_cues), _parser(ass_cues)
parse_ttml, parse_json, parse_events = _parser(ttml_cues), _parser(json_cues), _parser(event_cues)


def parse_files(files: DataFrame) -> DataFrame:
    """Parse files by suffix; an unknown suffix is looked at for cue times.

    ``files``: ``episode_id, suffix, text``. The texts are read once; only the
    fitting parser runs on each.
    """
    text, end = F.col("text"), F.col("suffix")
    has_events = F.try_variant_get(F.try_parse_json(text), "$.events", "array<variant>").isNotNull()
    cues = (
        F.when(end.isin(".json", ".json3"), F.when(has_events, event_cues(text)).otherwise(json_cues(text)))
        .when(end == ".ass", ass_cues(text)).when(end.isin(".ttml", ".xml"), ttml_cues(text))
        .when(end.isin(".srt", ".vtt") | F.regexp_like(text, F.lit(fixed.CUE_RANGE)), caption_cues(text))
        .otherwise(line_cues(text)))
    return _rows(files, cues)
