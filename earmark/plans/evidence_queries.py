"""Evidence, quotes, citation coverage and report checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions.text import flat_bool, flat_list, flat_span
from earmark.functions.times import clock
from earmark.operators import evidence, transcripts
from earmark.operators.ordered import neighbours
from earmark.plans import views
from earmark.plans.registry import query
from earmark.plans.views import searched, sql_clock, with_views
from earmark.session import materialize


def sql_stamp(x: str) -> str:
    p = f"string_split({x}, ':')"
    return f"(CAST({p}[1] AS DOUBLE) * 3600 + CAST({p}[2] AS DOUBLE) * 60 + CAST({p}[3] AS DOUBLE))"


KINDS = "['fact', 'opinion', 'anecdote', 'prediction', 'recommendation', 'synthesis', 'rumor']"
SUPPORTS = "['stated', 'illustrated', 'argued', 'asserted', 'contradicted', NULL]"
LEVELS = "['high', 'medium', 'low', 'sure']"
STATES = "['not_checked', 'supported', 'mixed', 'contradicted', 'outdated', 'not_verifiable', 'maybe']"
TYPES = "['person', 'organization', 'product', 'book', 'paper', 'concept', 'tool', 'place']"

views.VIEW_SQL["v_evidence"] = f"""
    v_l AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (PARTITION BY episode_id ORDER BY pos), '') AS next FROM v_segments),
    v_durations AS (SELECT episode_id, max(coalesce(nullif(end_seconds, 0), start_seconds, 0)) AS duration FROM v_segments GROUP BY ALL),
    v_claims AS (SELECT episode_id, pos AS idx, CASE WHEN n % 13 = 0 THEN '' ELSE text END AS claim, {KINDS}[n % 7 + 1] AS kind,
                        {SUPPORTS}[n % 6 + 1] AS support, {LEVELS}[n % 4 + 1] AS confidence, {STATES}[n % 7 + 1] AS verification FROM v_l),
    v_chapters AS (SELECT episode_id, pos AS idx, CASE WHEN n % 11 = 0 THEN ' ' ELSE text END AS title, {sql_clock('start_seconds')} AS start,
                          {sql_clock('end_seconds + n % 5')} AS "end" FROM v_l),
    v_quotes AS (SELECT episode_id, pos AS idx, CASE WHEN n % 23 = 0 THEN '' ELSE trim(substr(text, n // 2 + 1) || ' ' || substr(next, 1, length(next) // 2)) END AS text,
                        {sql_clock('start_seconds')} AS start, {sql_clock('end_seconds')} AS "end",
                        CASE WHEN n % 2 = 0 THEN NULL WHEN n % 3 = 0 THEN [segment_id] ELSE [segment_id, segment_id + 1] END AS segment_ids FROM v_l),
    v_entities AS (SELECT episode_id, pos AS idx, speaker AS name, {TYPES}[n % 8 + 1] AS type FROM v_l),
    v_refs AS (SELECT episode_id, 'claims' AS collection, pos AS idx, 0 AS ref_no, {sql_clock('start_seconds + (n % 5 - 2) * 3')} AS start,
                      {sql_clock('end_seconds + (n % 7 - 3) * 3')} AS "end",
                      CASE WHEN n % 19 = 0 THEN [] ELSE [segment_id, segment_id + n % 3] END AS segment_ids FROM v_l WHERE n % 17 <> 0
               UNION ALL
               SELECT episode_id, 'entities', pos, 0, NULL, NULL, [segment_id + 1] FROM v_l WHERE n % 5 <> 0)"""
views.NEEDS["v_evidence"] = ["v_segments"]
_EP = "episode_id"


def _pick(values: str, at):
    names = [v.strip().strip("'") for v in values.strip("[]").split(",")]
    return F.element_at(F.array(*[F.lit(None if v == "NULL" else v) for v in names]), (at + 1).cast("int"))


def _base(spark, sf):
    """The transcript with what the evidence is made from, stored once."""
    rows = neighbours(views.segments(spark, sf), [_EP], "pos", lead={"next": F.col("text")})
    return materialize(rows.withColumns({
        "n": F.length("text"), "next": F.coalesce("next", F.lit("")), "idx": F.col("pos")}), "transcript")


def _claims(rows):
    n = F.col("n")
    return rows.select(
        _EP, "idx", F.when(n % 13 == 0, "").otherwise(F.col("text")).alias("claim"), _pick(KINDS, n % 7).alias("kind"),
        _pick(SUPPORTS, n % 6).alias("support"), _pick(LEVELS, n % 4).alias("confidence"), _pick(STATES, n % 7).alias("verification"))


def _chapters(rows):
    n = F.col("n")
    return rows.select(_EP, "idx", F.when(n % 11 == 0, " ").otherwise(F.col("text")).alias("title"),
                       clock(F.col("start_seconds")).alias("start"), clock(F.col("end_seconds") + n % 5).alias("end"))


def _quotes(rows):
    n, m = F.col("n"), F.length("next")
    crossing = F.concat(F.substring("text", F.floor(n / 2).cast("int") + 1, n), F.lit(" "),
                        F.substring("next", F.lit(1), F.floor(m / 2).cast("int")))
    return rows.select(
        _EP, "idx", F.when(n % 23 == 0, "").otherwise(F.btrim(crossing)).alias("text"),
        clock(F.col("start_seconds")).alias("start"), clock(F.col("end_seconds")).alias("end"),
        F.when(n % 2 == 0, F.lit(None)).when(n % 3 == 0, F.array("segment_id"))
        .otherwise(F.array(F.col("segment_id"), F.col("segment_id") + 1)).alias("segment_ids"))


def _entities(rows):
    return rows.select(_EP, "idx", F.col("speaker").alias("name"), _pick(TYPES, F.col("n") % 8).alias("type"))


def _refs(rows):
    n, s = F.col("n"), F.col("segment_id")
    first = rows.where("n % 17 <> 0").select(
        _EP, F.lit("claims").alias("collection"), "idx", F.lit(0).alias("ref_no"),
        clock(F.col("start_seconds") + (n % 5 - 2) * 3).alias("start"), clock(F.col("end_seconds") + (n % 7 - 3) * 3).alias("end"),
        F.when(n % 19 == 0, F.array().cast("array<long>")).otherwise(F.array(s, s + n % 3)).alias("segment_ids"))
    none = F.lit(None).cast("string")
    second = rows.where("n % 5 <> 0").select(
        _EP, F.lit("entities").alias("collection"), "idx", F.lit(0).alias("ref_no"), none.alias("start"), none.alias("end"),
        F.array(s + 1).alias("segment_ids"))
    return first.unionByName(second)


_RANGE = """
    SELECT {key}, unnest(list_filter([CASE WHEN s IS NULL OR e IS NULL THEN 'invalid_range' END,
        CASE WHEN s < 0 OR e < s THEN 'reversed_range' END, CASE WHEN duration > 0 AND e > duration + 2 THEN 'beyond_duration' END],
        lambda x: x IS NOT NULL)) AS rule FROM {src}"""


def _ref_sql(name: str, source: str) -> str:
    """Rules of references; ``source`` has episode_id, collection, idx, ref_no, start, end, segment_ids."""
    return f"""
  {name}_r AS (SELECT r.*, {sql_stamp('start')} AS s, {sql_stamp('"end"')} AS e, coalesce(duration, 0) AS duration
               FROM {source} r LEFT JOIN v_durations USING (episode_id)),
  {name}_x AS (SELECT r.episode_id, collection, idx, ref_no, count(*) FILTER (g.segment_id IS NULL) AS unknown,
                      min(coalesce(g.start_seconds, 0)) FILTER (g.segment_id IS NOT NULL) AS lo,
                      max(coalesce(nullif(g.end_seconds, 0), g.start_seconds, 0)) FILTER (g.segment_id IS NOT NULL) AS hi
               FROM (SELECT episode_id, collection, idx, ref_no, unnest(list_distinct(segment_ids)) AS sid FROM {source}) r
               LEFT JOIN v_segments g ON g.episode_id = r.episode_id AND g.segment_id = sid GROUP BY ALL),
  {name}_v AS (
    SELECT episode_id, collection, idx, unnest(list_filter([
        CASE WHEN coalesce(len(segment_ids), 0) = 0 THEN 'segment_ids_required' END,
        CASE WHEN unknown > 0 THEN 'unknown_segment_ids' END,
        CASE WHEN len(segment_ids) > 0 AND (start IS NOT NULL OR "end" IS NOT NULL) AND (s IS NULL OR e IS NULL) THEN 'invalid_range' END,
        CASE WHEN len(segment_ids) > 0 AND (s < 0 OR e < s) THEN 'reversed_range' END,
        CASE WHEN len(segment_ids) > 0 AND duration > 0 AND e > duration + 2 THEN 'beyond_duration' END,
        CASE WHEN s > hi + 2 OR e < lo - 2 THEN 'apart_from_segments' END], lambda x: x IS NOT NULL)) AS rule
    FROM {name}_r LEFT JOIN {name}_x USING (episode_id, collection, idx, ref_no))"""


_QUOTE_SQL = f"""
  qs AS (SELECT *, {sql_stamp('start')} AS s, {sql_stamp('"end"')} AS e FROM v_quotes WHERE trim(text) <> ''),
  hay AS (SELECT q.episode_id, q.idx, any_value(q.text) AS quote, string_agg(g.text, ' ' ORDER BY g.segment_id) AS tape
          FROM qs q LEFT JOIN v_segments g ON g.episode_id = q.episode_id AND CASE WHEN len(q.segment_ids) > 0 THEN list_contains(q.segment_ids, g.segment_id)
               ELSE coalesce(nullif(g.end_seconds, 0), g.start_seconds, 0) >= s - 1 AND coalesce(g.start_seconds, 0) <= e + 1 END
          GROUP BY q.episode_id, q.idx),
  found AS (SELECT episode_id, idx, coalesce(contains({searched('tape')}, {searched('quote')}), false) AS found FROM hay)
"""


@query("quote_check", with_views("v_evidence", _QUOTE_SQL + "SELECT * FROM found"))
def quote_check(spark, sf):
    from earmark.functions.times import stamp_seconds

    rows = _base(spark, sf)
    quotes = _quotes(rows).where("trim(text) <> ''").withColumns({
        "start_at": stamp_seconds(F.col("start")), "end_at": stamp_seconds(F.col("end"))})
    return evidence.quote_found(quotes, rows)


@query("evidence_refs_check", with_views("v_evidence", f"""
  {_ref_sql('a', 'v_refs')}
SELECT * FROM a_v"""))
def evidence_refs_check(spark, sf):
    rows = _base(spark, sf)
    key = [_EP, "collection", "idx", "ref_no"]
    return evidence.check_references(_refs(rows), rows, transcripts.durations(rows), key).drop("ref_no")


@query("chapter_order", with_views("v_evidence", f"""
  c AS (SELECT *, {sql_stamp('start')} AS s, {sql_stamp('"end"')} AS e FROM v_chapters LEFT JOIN v_durations USING (episode_id) WHERE trim(title) <> ''),
  o AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT episode_id, idx, rule FROM ({_RANGE.format(key='episode_id, idx', src='c')})
UNION ALL SELECT episode_id, idx, 'out_of_order' FROM o WHERE s < coalesce(before, -1) - 1
UNION ALL SELECT episode_id, idx, 'title_required' FROM v_chapters WHERE trim(title) = ''"""))
def chapter_order(spark, sf):
    rows = _base(spark, sf)
    return evidence.check_chapters(_chapters(rows), transcripts.durations(rows))


def _audit_parts(spark, sf):
    rows = _base(spark, sf)
    return rows, evidence.evidence_audit(
        rows, transcripts.durations(rows), chapters=_chapters(rows), claims=_claims(rows), quotes=_quotes(rows),
        entities=_entities(rows), refs=_refs(rows))


_AUDIT = f"""
  {_ref_sql('a', 'v_ok_refs')},
  {_ref_sql('b', 'v_quote_refs')},
  {_QUOTE_SQL},
  c AS (SELECT *, {sql_stamp('start')} AS s, {sql_stamp('"end"')} AS e FROM v_chapters LEFT JOIN v_durations USING (episode_id) WHERE trim(title) <> ''),
  o AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
  qd AS (SELECT qs.*, duration FROM qs LEFT JOIN v_durations USING (episode_id)),
  violations AS (
    SELECT episode_id, 'chapters' AS collection, idx, rule FROM ({_RANGE.format(key='episode_id, idx', src='c')})
    UNION ALL SELECT episode_id, 'chapters', idx, 'out_of_order' FROM o WHERE s < coalesce(before, -1) - 1
    UNION ALL SELECT episode_id, 'chapters', idx, 'title_required' FROM v_chapters WHERE trim(title) = ''
    UNION ALL SELECT episode_id, 'claims', idx, 'claim_required' FROM v_claims WHERE claim = ''
    UNION ALL SELECT episode_id, 'claims', idx, 'invalid_kind' FROM v_claims WHERE claim <> '' AND kind = 'rumor'
    UNION ALL SELECT episode_id, 'claims', idx, 'invalid_support' FROM v_claims WHERE claim <> '' AND support IS NULL
    UNION ALL SELECT episode_id, 'claims', idx, 'invalid_confidence' FROM v_claims WHERE claim <> '' AND confidence = 'sure'
    UNION ALL SELECT episode_id, 'claims', idx, 'invalid_verification' FROM v_claims WHERE claim <> '' AND verification = 'maybe'
    UNION ALL SELECT episode_id, 'entities', idx, 'invalid_type' FROM v_entities WHERE type = 'place'
    UNION ALL SELECT episode_id, 'claims', idx, 'evidence_required' FROM v_claims c WHERE claim <> ''
       AND NOT EXISTS (SELECT 1 FROM v_refs r WHERE r.episode_id = c.episode_id AND r.idx = c.idx AND collection = 'claims')
    UNION ALL SELECT episode_id, 'entities', idx, 'evidence_required' FROM v_entities c
       WHERE NOT EXISTS (SELECT 1 FROM v_refs r WHERE r.episode_id = c.episode_id AND r.idx = c.idx AND collection = 'entities')
    UNION ALL SELECT * FROM a_v
    UNION ALL (SELECT * FROM b_v UNION SELECT episode_id, 'quotes', idx, rule FROM ({_RANGE.format(key='episode_id, idx', src='qd')})
               UNION SELECT episode_id, 'quotes', idx, 'not_in_transcript' FROM found WHERE NOT found)
    UNION ALL SELECT episode_id, 'quotes', idx, 'text_required' FROM v_quotes WHERE trim(text) = '')
"""
_AUDIT = """
  v_ok_refs AS (SELECT r.* FROM v_refs r WHERE collection <> 'claims' OR EXISTS (
      SELECT 1 FROM v_claims c WHERE c.episode_id = r.episode_id AND c.idx = r.idx AND claim <> '')),
  v_quote_refs AS (SELECT episode_id, 'quotes' AS collection, idx, 0 AS ref_no, start, "end", segment_ids FROM v_quotes
                   WHERE trim(text) <> '' AND len(segment_ids) > 0),
""" + _AUDIT.lstrip()


@query("evidence_audit", with_views("v_evidence", _AUDIT + "SELECT * FROM violations"))
def evidence_audit(spark, sf):
    return _audit_parts(spark, sf)[1]


@query("evidence_validity", with_views("v_evidence", _AUDIT + """
SELECT episode_id, count(rule) AS violations, count(rule) = 0 AS valid
FROM (SELECT DISTINCT episode_id FROM v_segments) LEFT JOIN violations USING (episode_id) GROUP BY episode_id"""))
def evidence_validity(spark, sf):
    """Roll-up per episode: valid when nothing is violated."""
    segments, found = _audit_parts(spark, sf)
    counted = found.groupBy(_EP).agg(F.count("*").alias("violations"))
    return segments.select(_EP).distinct().join(counted, _EP, "left").select(
        _EP, F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), F.col("violations").isNull().alias("valid"))


@query("cited_segments", with_views("v_evidence", """
SELECT DISTINCT episode_id, unnest(segment_ids) AS segment_id FROM v_refs"""))
def cited_segments(spark, sf):
    return evidence.cited_segments(_refs(_base(spark, sf)))


@query("citation_coverage", with_views("v_evidence", """
  c AS (SELECT DISTINCT episode_id, unnest(segment_ids) AS segment_id FROM v_refs WHERE collection = 'claims')
SELECT episode_id, count(*) AS segments, count(c.segment_id) AS cited_segments, round(count(c.segment_id) / count(*), 4) AS citation_coverage
FROM v_segments s LEFT JOIN c USING (episode_id, segment_id) GROUP BY episode_id"""))
def citation_coverage(spark, sf):
    rows = _base(spark, sf)
    return evidence.citation_coverage(rows, _refs(rows).where("collection = 'claims'"))


@query("evidence_flat", with_views("v_evidence", """
SELECT episode_id, idx, start || CASE WHEN "end" <> start THEN '–' || "end" ELSE '' END || ' (' || collection || ')' AS span,
       coalesce(array_to_string(segment_ids, '; '), '') AS segment_ids, CASE WHEN len(segment_ids) > 1 THEN 'true' ELSE 'false' END AS several
FROM v_refs WHERE start IS NOT NULL"""))
def evidence_flat(spark, sf):
    rows = _refs(_base(spark, sf)).where("start IS NOT NULL")
    span = F.struct("start", "end", F.col("collection").alias("label"))
    return rows.select(_EP, "idx", flat_span(span).alias("span"), flat_list(F.col("segment_ids")).alias("segment_ids"),
                       flat_bool(F.size("segment_ids") > 1).alias("several"))


# --- reports: one per turn, with parts that are sometimes missing ------------------

_REPORT_SQL = rf"""
  reports AS (
    SELECT episode_id || '/' || pos AS report_id, episode_id,
           CASE WHEN n % 9 <> 0 THEN E'# ' || speaker || E'\n\n' ELSE '' END || CASE WHEN n % 7 <> 0 THEN E'- Source: x\n' ELSE E'- y\n' END
           || CASE WHEN n % 5 <> 0 THEN E'## Summary\n' ELSE E'## Notes\n' END || CASE WHEN n % 11 = 0 THEN E'TODO\n' ELSE '' END
           || E'## Timeline\n- [' || {sql_clock('start_seconds')} || '–' || {sql_clock('end_seconds + (n % 6 - 4) * 8')} || E'] part\n'
           || CASE WHEN n % 4 <> 0 THEN E'## Limitations\n' ELSE '' END
           || '> “' || trim(regexp_replace(substr(text, n // 2 + 1), '\s+', ' ', 'g')) || '” ' || CASE WHEN n % 13 <> 0 THEN '[' || {sql_clock('start_seconds + n % 50')} || ']' ELSE '' END AS text,
           {searched("substr(text, n // 2 + 1)")} AS quote, floor(start_seconds + n % 50) AS q0, n,
           floor(start_seconds) AS t0, CASE WHEN end_seconds + (n % 6 - 4) * 8 < 0 THEN 0 ELSE floor(end_seconds + (n % 6 - 4) * 8) END AS t1
    FROM v_l),
  tapes AS (
    SELECT r.report_id, {searched("coalesce(string_agg(g.text, ' ' ORDER BY g.segment_id), '')")} AS tape
    FROM reports r LEFT JOIN v_segments g ON g.episode_id = r.episode_id AND coalesce(nullif(g.end_seconds, 0), g.start_seconds, 0) >= q0 - 1 AND g.start_seconds <= q0 + 9
    GROUP BY r.report_id),
  checks AS (
    SELECT report_id, n % 9 <> 0 AS h1_title, n % 7 <> 0 AS source_provenance, n % 5 <> 0 AS summary, true AS chapters_or_timeline,
           true AS evidence_timestamps, n % 4 <> 0 AS limitations, n % 11 <> 0 AS no_placeholders, n % 13 <> 0 AS quotes_are_timestamped,
           NOT (t1 < t0 OR t0 > duration + 2 OR t1 > duration + 2 OR (n % 13 <> 0 AND q0 > duration + 2)) AS timestamp_ranges_valid,
           n % 13 = 0 OR quote = '' OR contains(tape, quote) AS quotes_match_transcript
    FROM reports JOIN tapes USING (report_id) JOIN v_durations USING (episode_id))
"""


def _reports(rows):
    n = F.col("n")
    pick = lambda test, yes, no="": F.when(test, F.lit(yes)).otherwise(F.lit(no))
    half = F.btrim(F.regexp_replace(F.substring("text", F.floor(n / 2).cast("int") + 1, n), r"\s+", " "))
    text = F.concat(
        F.when(n % 9 != 0, F.concat(F.lit("# "), "speaker", F.lit("\n\n"))).otherwise(F.lit("")),
        pick(n % 7 != 0, "- Source: x\n", "- y\n"), pick(n % 5 != 0, "## Summary\n", "## Notes\n"), pick(n % 11 == 0, "TODO\n"),
        F.lit("## Timeline\n- ["), clock(F.col("start_seconds")), F.lit("–"), clock(F.col("end_seconds") + (n % 6 - 4) * 8), F.lit("] part\n"),
        pick(n % 4 != 0, "## Limitations\n"), F.lit("> “"), half, F.lit("” "),
        F.when(n % 13 != 0, F.concat(F.lit("["), clock(F.col("start_seconds") + n % 50), F.lit("]"))).otherwise(F.lit("")))
    return rows.select(F.concat_ws("/", _EP, "pos").alias("report_id"), _EP, text.alias("text"))


def _report_checks(spark, sf):
    rows = _base(spark, sf)
    return evidence.report_checks(_reports(rows), rows, transcripts.durations(rows))


@query("report_audit", with_views("v_evidence", _REPORT_SQL + """
SELECT *, h1_title AND source_provenance AND summary AND no_placeholders AND limitations AND quotes_are_timestamped
          AND timestamp_ranges_valid AND quotes_match_transcript AS valid FROM checks"""))
def report_audit(spark, sf):
    return evidence.report_audit(_report_checks(spark, sf)).drop("episode_id", "failures", "warnings", "transcript_read")


_FINDINGS = [("h1_title", "n % 9 <> 0"), ("source_provenance", "n % 7 <> 0"), ("summary", "n % 5 <> 0"), ("no_placeholders", "n % 11 <> 0")]


def _listed(rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in rules) + "], lambda x: x IS NOT NULL), ' ')"


@query("report_findings", with_views("v_evidence", _REPORT_SQL + f""",
  held AS (SELECT r.report_id, n, n % 17 = 0 AS unread, n % 17 = 0 OR timestamp_ranges_valid AS ranges, n % 17 = 0 OR quotes_match_transcript AS quoted
           FROM reports r JOIN checks USING (report_id))
SELECT report_id, {_listed(_FINDINGS + [("transcript_unreadable", "NOT unread")])} AS failures,
       {_listed([("limitations", "n % 4 <> 0"), ("quotes_are_timestamped", "n % 13 <> 0"), ("no_placeholders", "n % 11 <> 0"),
                 ("timestamp_ranges_valid", "ranges"), ("quotes_match_transcript", "quoted")])} AS warnings
FROM held"""))
def report_findings(spark, sf):
    """What isn't strictly required only warns; every 17th length has no transcript to be held against."""
    rows = _base(spark, sf)
    reports = _reports(rows.withColumn(_EP, F.when(F.col("n") % 17 == 0, F.concat(_EP, F.lit(" without transcript"))).otherwise(F.col(_EP))))
    named = reports.withColumn("report_id", F.replace("report_id", F.lit(" without transcript"), F.lit("")))
    found = evidence.report_audit(evidence.report_checks(named, rows, transcripts.durations(rows)), strict=False)
    return found.select("report_id", F.array_join("failures", " ").alias("failures"), F.array_join("warnings", " ").alias("warnings"))


@query("report_quote_check", with_views("v_evidence", _REPORT_SQL + """
SELECT report_id, quotes_match_transcript FROM checks WHERE NOT quotes_match_transcript"""))
def report_quote_check(spark, sf):
    return _report_checks(spark, sf).where("NOT quotes_match_transcript").select("report_id", "quotes_match_transcript")


# --- documents -------------------------------------------------------------------------


def _documents(spark, sf):
    """Every turn as an evidence document of its own, some of them broken."""
    n, s = F.col("n"), F.col("segment_id")
    refs = F.array(F.struct(clock(F.col("start_seconds")).alias("start"), F.array(s, s + 1).alias("segment_ids")))
    claims = F.array(F.struct(F.col("text").alias("claim"), F.lit("fact").alias("kind"), refs.alias("evidence")),
                     F.struct(F.col("speaker").alias("claim"), F.lit("rumor").alias("kind"), F.array().cast(
                         "array<struct<start:string,segment_ids:array<bigint>>>").alias("evidence")))
    version = F.when(n % 5 == 0, "3.0").otherwise("2.0").alias("schema_version")
    whole = F.to_json(F.struct(version, claims.alias("claims")))
    broken = F.to_json(F.struct(version, F.col("speaker").alias("claims")))
    text = F.when(n % 7 == 0, broken).when(n % 11 == 0, F.lit("[1]")).otherwise(whole)
    return _base(spark, sf).select(F.concat_ws("/", _EP, "pos").alias("episode_id"), text.alias("text"))


@query("evidence_documents", with_views("v_evidence", f"""
  w AS (SELECT *, episode_id || '/' || pos AS doc FROM v_l WHERE n % 7 <> 0 AND n % 11 <> 0)
SELECT doc AS episode_id, CAST(0 AS BIGINT) AS idx, text AS claim, 'fact' AS kind, segment_id || ',' || segment_id + 1 AS segment_ids, {sql_clock('start_seconds')} AS start FROM w
UNION ALL SELECT doc, 1, speaker, 'rumor', NULL, NULL FROM w"""))
def evidence_documents(spark, sf):
    from earmark.sources import evidence as documents

    docs = materialize(_documents(spark, sf), "documents")
    refs = documents.parse_references(docs).select("episode_id", "idx", F.array_join("segment_ids", ",").alias("segment_ids"), "start")
    return documents.parse_collection(docs, "claims").select("episode_id", "idx", "claim", "kind").join(refs, ["episode_id", "idx"], "left")


@query("evidence_document_issues", with_views("v_evidence", """
  w AS (SELECT *, episode_id || '/' || pos AS doc FROM v_l)
SELECT doc AS episode_id, 'claims_not_a_list' AS rule FROM w WHERE n % 7 = 0
UNION ALL SELECT doc, 'not_an_object' FROM w WHERE n % 7 <> 0 AND n % 11 = 0
UNION ALL SELECT doc, 'schema_version' FROM w WHERE n % 5 = 0 AND (n % 7 = 0 OR n % 11 <> 0)"""))
def evidence_document_issues(spark, sf):
    from earmark.sources import evidence as documents

    return documents.document_issues(_documents(spark, sf))
