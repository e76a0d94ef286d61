"""Checks of evidence, quotes and reports against the transcript."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold, search_text, strip
from earmark.functions.times import end_or_start, stamp_seconds
from earmark.operators.ordered import position_block, scan

_EP = "episode_id"
BUCKET_SECONDS = 30
QUOTE_BLOCK = 2048


def _issue(test: Column, name: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(name))


def _blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def range_issues(start: Column, end: Column, duration: Column) -> list[Column]:
    """Rule names broken by a start and end in seconds; nulls where fine."""
    known = start.isNotNull() & end.isNotNull()
    return [
        _issue(~known, "invalid_range"),
        _issue(known & ((start < 0) | (end < start)), "reversed_range"),
        _issue(known & (duration > 0) & (end > duration + 2), "beyond_duration"),
    ]


def _rules(rows: DataFrame, key: Sequence[str], issues: list[Column]) -> DataFrame:
    return rows.select(*key, F.explode(F.array_compact(F.array(*issues))).alias("rule"))


def check_references(refs: DataFrame, segments: DataFrame, durations: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per broken rule of an evidence reference.

    ``refs``: the key (with ``episode_id``), ``start``, ``end`` as stamps and
    ``segment_ids``. Ids are exploded and joined on (episode, segment), so one
    much-cited episode is spread by segment.
    """
    key = list(key)
    cited = refs.select(*key, F.explode(F.array_distinct("segment_ids")).alias("segment_id"))
    known = segments.select(
        _EP, "segment_id", F.coalesce("start_seconds", F.lit(0.0)).alias("s"),
        F.coalesce(end_or_start(F.col("end_seconds"), F.col("start_seconds")), F.lit(0.0)).alias("e"))
    found = cited.join(known, [_EP, "segment_id"], "left").groupBy(*key).agg(
        F.count_if(F.col("s").isNull()).alias("unknown"), F.min("s").alias("from"), F.max("e").alias("to"))
    rows = refs.join(found, key, "left").join(durations, _EP, "left")
    start, end = stamp_seconds(F.col("start")), stamp_seconds(F.col("end"))
    listed = F.coalesce(F.size("segment_ids"), F.lit(-1)) > 0
    stamped = listed & (F.col("start").isNotNull() | F.col("end").isNotNull())
    timed = [F.when(stamped, issue) for issue in range_issues(start, end, F.coalesce("duration", F.lit(0.0)))]
    apart = stamped & ((start > F.col("to") + 2) | (end < F.col("from") - 2))
    return _rules(rows, key, [
        _issue(~listed, "segment_ids_required"), _issue(F.col("unknown") > 0, "unknown_segment_ids"), *timed,
        _issue(apart, "apart_from_segments")])


def quote_segments(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """``episode_id, idx, segment_id, text`` of the segments a quote may be in.

    Quotes that name segments use those; others take what is within a second
    of their time, matched in time buckets so that the join stays an equality.
    """
    texts = segments.select(
        _EP, "segment_id", F.coalesce("start_seconds", F.lit(0.0)).alias("s"),
        F.coalesce(end_or_start(F.col("end_seconds"), F.col("start_seconds")), F.lit(0.0)).alias("e"),
        search_text(F.coalesce("text", F.lit(""))).alias("text"))
    named = F.coalesce(F.size("segment_ids"), F.lit(-1)) > 0
    by_id = quotes.where(named).select(_EP, "idx", F.explode(F.array_distinct("segment_ids")).alias("segment_id")).join(
        texts.select(_EP, "segment_id", "text"), [_EP, "segment_id"])
    b = lambda c: F.floor(c / BUCKET_SECONDS)
    windows = quotes.where(~named & (F.col("end_at") >= F.col("start_at") - 2)).select(
        _EP, "idx", "start_at", "end_at",
        F.explode(F.sequence(b(F.col("start_at") - 1), b(F.col("end_at") + 1))).alias("b"))
    near = texts.where("e >= s").withColumn("b", F.explode(F.sequence(b(F.col("s")), b(F.col("e")))))
    by_time = windows.join(near, [_EP, "b"]).where("e >= start_at - 1 AND s <= end_at + 1").select(
        _EP, "idx", "segment_id", "text").dropDuplicates([_EP, "idx", "segment_id"])
    return by_id.unionByName(by_time).where("text <> ''")


def quote_found(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """``episode_id, idx, found``: is the quote a substring of its segments?

    The segments of a quote, joined in order, may be a whole episode. They are
    cut into blocks, each with enough following rows that a quote across the
    edge is still seen whole; a block is one bounded task.
    """
    rows = quote_segments(quotes, segments)
    rows = scan(rows, [_EP, "idx"], ["segment_id"], position_block("segment_id"), total={"_n": F.lit(1)})
    wanted = quotes.select(_EP, "idx", search_text(F.coalesce("text", F.lit(""))).alias("quote"))
    rows = rows.join(wanted, [_EP, "idx"])
    # A segment takes at least two characters with its space.
    ahead = F.floor(F.length("quote") / 2) + 2
    n = F.coalesce("_n", F.lit(0))
    size = F.greatest(F.lit(QUOTE_BLOCK), ahead)
    own = F.floor(n / size)
    rows = rows.withColumn("b", F.explode(F.array_compact(F.array(
        own, F.when((own > 0) & (n % size < ahead), own - 1)))))
    blocks = rows.groupBy(_EP, "idx", "b").agg(
        F.any_value("quote").alias("quote"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("text").alias("text")))),
                                 lambda x: x["text"]), " ").alias("tape"))
    seen = blocks.groupBy(_EP, "idx").agg(F.bool_or(F.contains("tape", "quote")).alias("found"))
    return quotes.select(_EP, "idx").join(seen, [_EP, "idx"], "left").select(
        _EP, "idx", F.coalesce("found", F.lit(False)).alias("found"))


def check_quotes(quotes: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Broken rules of quotes (``episode_id, idx, rule``)."""
    key = [_EP, "idx"]
    start, end = stamp_seconds(F.col("start")), stamp_seconds(F.col("end"))
    rows = quotes.withColumns({"start_at": start, "end_at": end})
    empty = _blank(F.col("text"))
    full = rows.where(~empty)
    timed = full.join(durations, _EP, "left")
    issues = _rules(timed, key, range_issues(F.col("start_at"), F.col("end_at"), F.coalesce("duration", F.lit(0.0))))
    refs = full.where(F.coalesce(F.size("segment_ids"), F.lit(-1)) > 0).select(*key, "start", "end", "segment_ids")
    absent = quote_found(full, segments).where("NOT found").select(*key, F.lit("not_in_transcript").alias("rule"))
    return (
        rows.where(empty).select(*key, F.lit("text_required").alias("rule"))
        .unionByName(issues).unionByName(check_references(refs, segments, durations, key)).unionByName(absent).distinct())


def check_chapters(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Broken rules of chapters; untitled ones count for nothing else."""
    key = [_EP, "idx"]
    untitled = _blank(F.col("title"))
    titled = chapters.where(~untitled).select(
        *key, stamp_seconds(F.col("start")).alias("s"), stamp_seconds(F.col("end")).alias("e"))
    titled = scan(titled, [_EP], ["idx"], position_block("idx"), latest={"_end": F.col("e")}).join(durations, _EP, "left")
    issues = range_issues(F.col("s"), F.col("e"), F.coalesce("duration", F.lit(0.0)))
    early = F.col("s") < F.coalesce("_end", F.lit(-1.0)) - 1
    return chapters.where(untitled).select(*key, F.lit("title_required").alias("rule")).unionByName(
        _rules(titled, key, [*issues, _issue(early, "out_of_order")]))


def check_claims(claims: DataFrame) -> DataFrame:
    """Missing text and values outside the allowed sets."""
    key, empty = [_EP, "idx"], _blank(F.col("claim"))
    allowed = {"kind": fixed.CLAIM_KINDS, "support": fixed.SUPPORT_KINDS,
               "confidence": fixed.CONFIDENCE_LEVELS, "verification": fixed.VERIFICATION_STATES}
    outside = [_issue(~empty & ~F.coalesce(F.col(c).isin(values), F.lit(False)), f"invalid_{c}") for c, values in allowed.items()]
    return _rules(claims, key, [_issue(empty, "claim_required"), *outside])


def check_named(rows: DataFrame, field: str, types: Sequence[str] | None = None) -> DataFrame:
    """Rules of actions, entities and glossary entries."""
    key, empty = [_EP, "idx"], _blank(F.col(field))
    issues = [_issue(empty, f"{field}_required")]
    if types:
        issues.append(_issue(~empty & ~F.coalesce(F.col("type").isin(list(types)), F.lit(False)), "invalid_type"))
    return _rules(rows, key, issues)


def evidence_audit(
    segments: DataFrame, durations: DataFrame, *, chapters: DataFrame | None = None, claims: DataFrame | None = None,
    quotes: DataFrame | None = None, actions: DataFrame | None = None, entities: DataFrame | None = None,
    glossary: DataFrame | None = None, refs: DataFrame | None = None,
) -> DataFrame:
    """``episode_id, collection, idx, rule``: every violation, one row each.

    ``refs`` holds ``episode_id, collection, idx, ref_no, start, end,
    segment_ids``. Glossary entries may go without references, but where
    ``glossary`` has its ``evidence`` (as parsed), that must be a list.
    """
    parts: list[DataFrame] = []
    add = lambda name, rows: parts.append(rows.select(_EP, F.lit(name).alias("collection"), "idx", "rule"))
    named = {"claims": (claims, "claim", None), "actions": (actions, "action", None),
             "entities": (entities, "name", fixed.ENTITY_TYPES), "glossary": (glossary, "source_term", None)}
    items: list[DataFrame] = []
    cited = [refs.select(_EP, "collection", "idx", "ref_no", "start", "end", "segment_ids")] if refs is not None else []
    for name, (rows, field, types) in named.items():
        if rows is None:
            continue
        add(name, check_claims(rows) if name == "claims" else check_named(rows, field, types))
        items.append(rows.where(~_blank(F.col(field))).select(
            _EP, F.lit(name).alias("collection"), "idx", F.lit(name != "glossary").alias("needed")))
        if name == "glossary" and "evidence" in rows.columns:
            add(name, rows.where(~_blank(F.col(field)) & F.col("evidence").isNull()).select(_EP, "idx", F.lit("evidence_not_a_list").alias("rule")))
    if chapters is not None:
        add("chapters", check_chapters(chapters, durations))
    if quotes is not None:
        add("quotes", check_quotes(quotes, segments, durations))
    if items and cited:
        # All collections go through one pass of the reference check.
        known = reduce(DataFrame.unionByName, items)
        key = [_EP, "collection", "idx"]
        parts.append(known.where("needed").join(cited[0].select(*key).distinct(), key, "left_anti").select(
            *key, F.lit("evidence_required").alias("rule")))
        used = cited[0].join(known.select(*key), key, "left_semi")
        parts.append(check_references(used, segments, durations, [*key, "ref_no"]).drop("ref_no"))
    return reduce(DataFrame.unionByName, parts)


def cited_segments(refs: DataFrame) -> DataFrame:
    """Every segment some reference names, once."""
    return refs.select(_EP, F.explode("segment_ids").alias("segment_id")).where("segment_id IS NOT NULL").distinct()


def citation_coverage(segments: DataFrame, refs: DataFrame) -> DataFrame:
    """Share of each episode's segments that claims, actions or entities cite."""
    cited = cited_segments(refs).withColumn("cited", F.lit(1))
    rows = segments.select(_EP, "segment_id").distinct().join(cited, [_EP, "segment_id"], "left")
    return rows.groupBy(_EP).agg(
        F.count("*").alias("segments"), F.count("cited").alias("cited_segments"),
        F.round(F.count("cited") / F.count("*"), 4).alias("citation_coverage"))


# --- reports ---------------------------------------------------------------------


def _heading(name: str) -> Column:
    titles = F.regexp_extract_all(casefold(F.col("text")), F.lit(r"(?m)^##+\s+(.+)$"), 1)
    hit = lambda title: F.array_max(F.array(*[F.contains(title, F.lit(w)) for w in fixed.HEADING_WORDS[name]]))
    return F.exists(titles, hit)


def report_checks(reports: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """One row per report with its ten checks as columns, and ``transcript_read``.

    ``reports``: ``report_id, episode_id, text``. An episode without a row in
    ``durations`` has no transcript that could be read.
    """
    text, stamp = F.col("text"), fixed.STAMP
    lines = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)(^>\s+.+$)"), 1),
                     lambda q: F.regexp_like(q, F.lit(r'[“”"]|—\s*\S')))
    rows = reports.select(
        "report_id", _EP, "text", lines.alias("quotes"),
        F.regexp_extract_all(text, F.lit(f"({stamp})"), 1).alias("stamps")).join(
            durations.withColumn("_read", F.lit(True)), _EP, "left").withColumn("transcript_read", F.coalesce("_read", F.lit(False))).drop("_read")
    values = lambda s: F.transform(F.regexp_extract_all(s, F.lit(f"({fixed.STAMP_PART})"), 1), stamp_seconds)
    limit = F.col("duration") + 2

    def wrong(one: Column) -> Column:
        v = values(one)
        return (F.get(v, F.lit(1)) < F.get(v, F.lit(0))) | F.exists(v, lambda x: x > limit)

    like = lambda pattern: F.regexp_like(text, F.lit(pattern))
    rows = rows.withColumns({
        "h1_title": like(r"(?m)^#\s+\S"), "source_provenance": like(fixed.SOURCE_LINE),
        "summary": _heading("summary"), "chapters_or_timeline": _heading("chapters_or_timeline"),
        "evidence_timestamps": F.size("stamps") > 0, "limitations": _heading("limitations"),
        "no_placeholders": ~like(fixed.PLACEHOLDER),
        "quotes_are_timestamped": F.forall("quotes", lambda q: F.regexp_like(q, F.lit(stamp))),
        "timestamp_ranges_valid": F.col("duration").isNull() | ~F.coalesce(
            F.exists("stamps", wrong), F.lit(False)),
    })
    asked = rows.where(F.col("duration").isNotNull()).select("report_id", _EP, F.posexplode("quotes").alias("n", "q"))
    parts = F.regexp_extract_all(F.regexp_extract("q", f"({stamp})", 1), F.lit(f"({fixed.STAMP_PART})"), 1)
    asked = asked.select(
        "report_id", _EP, F.concat_ws("/", "report_id", "n").alias("idx"),
        F.regexp_extract("q", r'[“"](.+?)[”"]', 1).alias("text"),
        stamp_seconds(F.get(parts, F.lit(0))).alias("start_at"),
        F.when(F.size(parts) > 1, stamp_seconds(F.element_at(parts, -1))).otherwise(stamp_seconds(F.get(parts, F.lit(0))) + 8).alias("end_at"),
        F.lit(None).cast("array<long>").alias("segment_ids"), F.size(parts).alias("stamps"),
    ).where("text <> '' AND stamps > 0")
    missed = quote_found(asked, segments).where("NOT found").join(asked.select(_EP, "idx", "report_id"), [_EP, "idx"])
    bad = missed.select("report_id").distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, "report_id", "left").withColumn(
        "quotes_match_transcript", F.col("_bad").isNull()).drop("_bad", "text", "quotes", "stamps", "duration")


REPORT_REQUIRED = ["h1_title", "source_provenance", "summary", "no_placeholders"]
REPORT_STRICT = ["chapters_or_timeline", "evidence_timestamps", "limitations", "quotes_are_timestamped"]
REPORT_GROUNDED = ["timestamp_ranges_valid", "quotes_match_transcript"]


REPORT_WARNED = ["evidence_timestamps", "limitations", "quotes_are_timestamped", "no_placeholders", "timestamp_ranges_valid", "quotes_match_transcript"]


def report_audit(checks: DataFrame, strict: bool = True, grounded: bool = True) -> DataFrame:
    """Add ``failures``, ``warnings`` and ``valid`` for the chosen strictness.

    Where reports are held against transcripts (``grounded``), one without a
    transcript fails as ``transcript_unreadable``, strict or not. A check that
    isn't required still warns.
    """
    names = REPORT_REQUIRED + (REPORT_STRICT + (REPORT_GROUNDED if grounded else []) if strict else [])
    missed = lambda some: [F.when(~F.col(n), F.lit(n)) for n in some]
    unread = [F.when(~F.col("transcript_read"), F.lit("transcript_unreadable"))] if grounded else []
    return checks.withColumn("failures", F.array_compact(F.array(*missed(names), *unread))).withColumn(
        "warnings", F.array_compact(F.array(*missed(REPORT_WARNED)))).withColumn("valid", F.size("failures") == 0)


def write_collection(rows: DataFrame, path: str) -> None:
    """One collection as CSV that spreadsheet programs read as UTF-8: the
    first column's header carries the byte order mark."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
