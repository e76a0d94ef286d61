"""Search, expansion, boosts, context and budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold, words
from earmark.operators import search
from earmark.operators.chunking import chunk_members, chunk_ranges
from earmark.operators.substring import owners_in
from earmark.plans import views
from earmark.plans.registry import query, spread_table, table
from earmark.plans.views import folded, ordered_distinct, searched, with_views

_RANKED = f"""
  n AS (SELECT count(*) AS c FROM v_units),
  m AS (SELECT query_id, ix, term, episode_id, chunk_id,
               (length(st) - length(replace(st, term, ''))) // length(term) AS tf
        FROM v_terms JOIN v_units ON contains(st, term)),
  df AS (SELECT term, count(DISTINCT episode_id || '/' || chunk_id) AS df FROM m GROUP BY term),
  scored AS (
    SELECT query_id, episode_id, chunk_id, string_agg(term, ' ' ORDER BY ix) AS terms,
           sum((1 + ln(tf)) * (ln((c + 1) / (df + 0.5)) + 1)) AS base
    FROM m JOIN df USING (term), n GROUP BY ALL),
  phrase AS (SELECT query_id, episode_id, chunk_id, 8.0 AS bonus
             FROM v_queries JOIN v_units ON contains(st, trim({folded('query')}))),
  total AS (
    SELECT query_id, episode_id, chunk_id, terms, round(coalesce(base, 0) + coalesce(bonus, 0), 4) AS score
    FROM scored FULL JOIN phrase USING (query_id, episode_id, chunk_id)),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, episode_id, chunk_id) AS rank FROM total)
"""


def _hits(spark, sf):
    return search.rank(views.questions(spark, sf), views.units(spark, sf))


@query("ranked_search", with_views("v_terms v_units", _RANKED + """
SELECT query_id, episode_id, chunk_id, CAST(score AS DOUBLE) AS score, terms AS matched_terms, rank
FROM ranked WHERE rank <= 8"""))
def ranked_search(spark, sf):
    return _hits(spark, sf).select(
        "query_id", "episode_id", "chunk_id", "score",
        F.array_join("matched_terms", " ").alias("matched_terms"), F.col("rank").cast("long").alias("rank"))


@query("term_matches", with_views("v_terms v_units", """
SELECT term, episode_id, chunk_id, CAST((length(st) - length(replace(st, term, ''))) // length(term) AS BIGINT) AS tf
FROM (SELECT DISTINCT term FROM v_terms) JOIN v_units ON contains(st, term)"""))
def term_matches(spark, sf):
    asked = views.questions(spark, sf).select(F.explode(search.ranking_terms(F.col("query"))).alias("term"))
    return search.term_matches(asked, views.units(spark, sf))


@query("retrieval_confidence", with_views("v_queries v_terms v_units", _RANKED + """
SELECT DISTINCT query_id, CASE WHEN s1 >= 8 AND (s2 IS NULL OR s1 >= s2 * 1.25) THEN 'high'
                      WHEN s1 >= 3 THEN 'medium' ELSE 'low' END AS confidence
FROM v_queries LEFT JOIN (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2
                          FROM ranked GROUP BY query_id) USING (query_id)"""))
def retrieval_confidence(spark, sf):
    return search.confidence(_hits(spark, sf), views.questions(spark, sf))


@query("context_chunks", with_views("v_terms v_units", _RANKED + """
SELECT DISTINCT r.query_id, u.episode_id, u.chunk_id, u.text
FROM ranked r JOIN v_units u ON u.episode_id = r.episode_id AND abs(u.chunk_id - r.chunk_id) <= 1
WHERE r.rank <= 8"""))
def context_chunks(spark, sf):
    units = views.units(spark, sf).select("episode_id", "chunk_id", "text")
    return search.context_chunks(_hits(spark, sf), units, 1).select("query_id", "episode_id", "chunk_id", "text")


@query("budgeted_hits", with_views("v_terms v_units", "RECURSIVE " + _RANKED + r""",
  texts AS (SELECT r.*, u.text FROM ranked r JOIN v_units u USING (episode_id, chunk_id) WHERE rank <= 8),
  kept AS (
    SELECT query_id, rank, episode_id, chunk_id,
           CASE WHEN length(text) > 2500 THEN rtrim(substr(text, 1, 2500), E' \n\t') || '…' ELSE text END AS text,
           length(text) > 2500 AS text_truncated,
           length(CASE WHEN length(text) > 2500 THEN rtrim(substr(text, 1, 2500), E' \n\t') || '…' ELSE text END) AS used
    FROM texts WHERE rank = 1
    UNION ALL
    SELECT t.query_id, t.rank, t.episode_id, t.chunk_id,
           CASE WHEN length(t.text) > 2500 - k.used THEN rtrim(substr(t.text, 1, 2500 - k.used), E' \n\t') || '…' ELSE t.text END,
           length(t.text) > 2500 - k.used,
           k.used + length(CASE WHEN length(t.text) > 2500 - k.used THEN rtrim(substr(t.text, 1, 2500 - k.used), E' \n\t') || '…' ELSE t.text END)
    FROM kept k JOIN texts t ON t.query_id = k.query_id AND t.rank = k.rank + 1 WHERE k.used < 2500)
SELECT query_id, rank, episode_id, chunk_id, text, text_truncated FROM kept"""))
def budgeted_hits(spark, sf):
    texts = views.units(spark, sf).select("episode_id", "chunk_id", "text")
    hits = _hits(spark, sf).join(texts, ["episode_id", "chunk_id"])
    return search.within_budget(hits, 2500).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "episode_id", "chunk_id", "text", "text_truncated")


def _claims(spark, sf):
    """Every turn as a claim that cites itself and the turn after it."""
    return spread_table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("item"), F.col("conv_id").cast("string").alias("episode_id"),
        F.col("text").alias("searchable"),
        F.array(F.col("turn") + 1, F.col("turn") + 2).alias("segment_ids"))


_BOOSTS = f"""
  claims AS (SELECT episode_id, segment_id, {folded('text')} AS t FROM v_segments),
  found AS (SELECT query_id, episode_id, segment_id, least(14.0, 4.0 + 2.0 * count(*)) AS boost
            FROM v_terms JOIN claims ON contains(t, term) GROUP BY ALL),
  boosts AS (SELECT query_id, episode_id, sid AS segment_id, CAST(max(boost) AS DOUBLE) AS boost
             FROM (SELECT *, unnest([segment_id, segment_id + 1]) AS sid FROM found) GROUP BY ALL)
"""


@query("evidence_boosts", with_views("v_terms v_segments", _BOOSTS + "SELECT * FROM boosts"))
def evidence_boosts(spark, sf):
    return search.evidence_boosts(views.questions(spark, sf), _claims(spark, sf))


def _glossary(spark, sf):
    """Each document's long words as one entry of interchangeable labels."""
    listed = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]{13,})"), 1))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), listed.alias("labels")).where("size(labels) > 1")


_EXPANDED = f"""
  entries AS (SELECT doc_id AS entry, {ordered_distinct("regexp_extract_all(text, '[A-Za-z]{13,}')")} AS labels FROM documents),
  labels AS (SELECT entry, unnest(labels) AS label, unnest(range(0, len(labels))) AS ix FROM entries WHERE len(labels) > 1),
  hit AS (SELECT DISTINCT query_id, {folded('query')} AS q, entry
          FROM v_queries JOIN labels ON contains({folded('query')}, {folded('label')})),
  added AS (SELECT query_id, label, min(struct_pack(entry := entry, ix := ix)) AS first
            FROM hit JOIN labels USING (entry) WHERE NOT contains(q, {folded('label')}) GROUP BY ALL),
  expanded AS (SELECT v_queries.query_id, query, coalesce(string_agg(label, ' ' ORDER BY first), '') AS added
               FROM v_queries LEFT JOIN added USING (query_id) GROUP BY ALL)
"""


@query("query_expansion", with_views("v_queries", _EXPANDED + """
SELECT query_id, added, trim(query || CASE WHEN added = '' THEN '' ELSE ' ' || added END) AS expanded FROM expanded"""))
def query_expansion(spark, sf):
    rows = search.expand_queries(views.questions(spark, sf), _glossary(spark, sf))
    return rows.select("query_id", F.array_join("added", " ").alias("added"), "expanded")


@query("expanded_search", with_views("v_units", f"""
  v_queries0 AS (SELECT item_id AS query_id, text AS query FROM benchmark),
  {_EXPANDED.replace("v_queries", "v_queries0")},
  v_queries AS (SELECT query_id, trim(query || CASE WHEN added = '' THEN '' ELSE ' ' || added END) AS query FROM expanded),
  {views.VIEW_SQL["v_terms"]},
  {_BOOSTS.replace("v_terms", "terms0").replace("claims AS", "terms0 AS (SELECT query_id, unnest(" + views.TERMS + ") AS term FROM v_queries0), claims AS")},
  {_RANKED[:_RANKED.index("total AS")]}
  total AS (
    SELECT query_id, episode_id, chunk_id, terms, coalesce(boost, 0) AS evidence_boost,
           round(coalesce(base, 0) + coalesce(bonus, 0) + coalesce(boost, 0), 4) AS score
    FROM scored FULL JOIN phrase USING (query_id, episode_id, chunk_id)
    FULL JOIN (SELECT query_id, episode_id, segment_id AS chunk_id, boost FROM boosts
               WHERE (episode_id, segment_id) IN (SELECT (episode_id, chunk_id) FROM v_units)) USING (query_id, episode_id, chunk_id)),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, episode_id, chunk_id) AS rank FROM total)
SELECT query_id, episode_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(evidence_boost AS DOUBLE) AS evidence_boost,
       coalesce(terms, '') AS matched_terms, rank FROM ranked WHERE rank <= 8"""))
def expanded_search(spark, sf):
    asked = views.questions(spark, sf)
    wider = search.expand_queries(asked, _glossary(spark, sf)).select("query_id", F.col("expanded").alias("query"))
    boosts = search.evidence_boosts(asked, _claims(spark, sf))
    return search.rank(wider, views.units(spark, sf), boosts).select(
        "query_id", "episode_id", "chunk_id", "score", "evidence_boost",
        F.array_join("matched_terms", " ").alias("matched_terms"), F.col("rank").cast("long").alias("rank"))


def _partners(spark, sf):
    """Passages 2j and 2j + 1 name the same thing by their first two words."""
    first = table(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("label"))
    listed = F.array_sort(F.collect_list(F.struct("item_id", "label")))
    return first.groupBy(F.floor(F.col("item_id") / 2).alias("entry")).agg(F.transform(listed, lambda x: x["label"]).alias("labels"))


def _records(spark, sf):
    """The claims as JSON items of a collection."""
    cited = F.array(F.struct(F.array(F.col("turn") + 1, F.col("turn") + 2).alias("segment_ids")))
    return spread_table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("episode_id"), F.lit("claims").alias("collection"), F.col("turn").alias("idx"),
        F.to_json(F.struct(F.col("text").alias("claim"), cited.alias("evidence"))).alias("item"))


SEARCH_CHARS = 2500
_CUT = rf"""CASE WHEN length(t.text) > {SEARCH_CHARS} - used_before THEN
  regexp_replace(substr(t.text, 1, {SEARCH_CHARS} - used_before), '\s+$', '') || '…' ELSE t.text END"""


@query("corpus_search", with_views("v_units", "RECURSIVE " + f"""
  v_queries0 AS (SELECT item_id AS query_id, text AS query FROM benchmark),
  labels AS (SELECT item_id // 2 AS entry, regexp_extract(text, '^(\\S+\\s+\\S+)', 1) AS label, min(item_id) AS ix
             FROM benchmark WHERE regexp_extract(text, '^(\\S+\\s+\\S+)', 1) <> '' GROUP BY ALL),
  hit AS (SELECT DISTINCT query_id, {folded('query')} AS q, entry
          FROM v_queries0 JOIN labels ON contains({folded('query')}, {folded('label')})),
  added AS (SELECT query_id, label, min(struct_pack(entry := entry, ix := ix)) AS first
            FROM hit JOIN labels USING (entry) WHERE NOT contains(q, {folded('label')}) GROUP BY ALL),
  v_queries AS (SELECT v_queries0.query_id, trim(query || coalesce(' ' || string_agg(label, ' ' ORDER BY first), '')) AS query,
                       count(DISTINCT first.entry) AS expansions
                FROM v_queries0 LEFT JOIN added USING (query_id) GROUP BY v_queries0.query_id, v_queries0.query),
  {views.VIEW_SQL["v_terms"]},
  {_BOOSTS.replace("v_terms", "terms0").replace("claims AS", "terms0 AS (SELECT query_id, unnest(" + views.TERMS + ") AS term FROM v_queries0), claims AS")},
  {_RANKED[:_RANKED.index("total AS")]}
  total AS (
    SELECT query_id, episode_id, chunk_id, round(coalesce(base, 0) + coalesce(bonus, 0) + coalesce(boost, 0), 4) AS score
    FROM scored FULL JOIN phrase USING (query_id, episode_id, chunk_id)
    FULL JOIN (SELECT query_id, episode_id, segment_id AS chunk_id, boost FROM boosts
               WHERE (episode_id, segment_id) IN (SELECT (episode_id, chunk_id) FROM v_units)) USING (query_id, episode_id, chunk_id)),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, episode_id, chunk_id) AS rank FROM total QUALIFY rank <= 8),
  texts AS (SELECT r.*, u.text FROM ranked r JOIN v_units u USING (episode_id, chunk_id)),
  kept AS (
    SELECT query_id, rank, episode_id, chunk_id, score, length({_CUT.replace("used_before", "0")}) AS chars,
           length({_CUT.replace("used_before", "0")}) AS used FROM texts t WHERE rank = 1
    UNION ALL
    SELECT t.query_id, t.rank, t.episode_id, t.chunk_id, t.score, length({_CUT.replace("used_before", "k.used")}),
           k.used + length({_CUT.replace("used_before", "k.used")})
    FROM kept k JOIN texts t ON t.query_id = k.query_id AND t.rank = k.rank + 1 WHERE k.used < {SEARCH_CHARS}),
  answers AS (
    SELECT query_id, count(*) AS hit_count, CAST(sum(chars) AS BIGINT) AS returned_chars, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2,
           string_agg(episode_id || '/' || chunk_id, ' ' ORDER BY rank) AS hits FROM kept GROUP BY query_id),
  near AS (SELECT query_id, count(DISTINCT u.episode_id || '/' || u.chunk_id) AS context_chunks
           FROM kept k JOIN v_units u ON u.episode_id = k.episode_id AND abs(u.chunk_id - k.chunk_id) <= 1 GROUP BY query_id),
  matched AS (SELECT query_id, count(*) AS evidence_matches FROM found GROUP BY query_id),
  counted AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id)
SELECT query_id, query AS expanded, (SELECT count(*) FROM v_units) AS total_chunks, coalesce(hit_count, 0) AS hit_count,
       coalesce(returned_chars, 0) AS returned_chars, coalesce(hit_count, 0) < coalesce(n, 0) AS truncated_by_budget,
       CASE WHEN s1 >= 8 AND (s2 IS NULL OR s1 >= s2 * 1.25) THEN 'high' WHEN s1 >= 3 THEN 'medium' ELSE 'low' END AS confidence,
       CAST(s1 AS DOUBLE) AS best_score, coalesce(hits, '') AS hits, coalesce(context_chunks, 0) AS context_chunks, expansions,
       coalesce(evidence_matches, 0) AS evidence_matches
FROM v_queries LEFT JOIN answers USING (query_id) LEFT JOIN near USING (query_id) LEFT JOIN matched USING (query_id)
LEFT JOIN counted USING (query_id)"""))
def corpus_search(spark, sf):
    """Every question over every turn, with expansion, evidence, budget and context."""
    found = search.corpus_search(
        views.questions(spark, sf), views.units(spark, sf), _partners(spark, sf), search.searchable_items(_records(spark, sf)),
        max_chars=SEARCH_CHARS, context=1)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("/", "episode_id", "chunk_id").alias("at"))))
    hits = found.hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"), F.array_join(F.transform(listed, lambda h: h["at"]), " ").alias("hits"))
    out = found.queries.drop("query").join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit("")))
    for name, rows in (("context_chunks", found.context), ("expansions", found.expansions), ("evidence_matches", found.evidence_matches)):
        out = out.join(rows.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


@query("topic_timeline", with_views("v_queries v_segments", f"""
  hits AS (SELECT DISTINCT query_id, s.episode_id, s.segment_id
           FROM (SELECT query_id, unnest(string_split(trim(query), ' ')) AS topic FROM v_queries) t
           JOIN v_segments s ON topic <> '' AND contains({searched('s.text')}, {folded('topic')}))
SELECT DISTINCT h.query_id, s.episode_id, s.segment_id, s.start_seconds,
       row_number() OVER (PARTITION BY h.query_id, s.episode_id ORDER BY s.segment_id) AS place
FROM (SELECT DISTINCT query_id, episode_id, unnest(range(segment_id - 1, segment_id + 2)) AS segment_id FROM hits) h
JOIN v_segments s USING (episode_id, segment_id)"""))
def topic_timeline(spark, sf):
    """The words of each query as topics: hits with neighbours, in order."""
    topics = views.questions(spark, sf).select(
        "query_id", F.explode(F.split(F.btrim("query"), " ")).alias("t")).where("t <> ''")
    topics = topics.select("query_id", casefold(F.col("t")).alias("topic")).distinct()
    units = views.units(spark, sf).select("episode_id", "chunk_id", "search_text")
    found = owners_in(units, "search_text", topics, "query_id", "topic", keep=["episode_id", "chunk_id"]).withColumnRenamed("owner", "query_id")
    times = views.segments(spark, sf).select("episode_id", F.col("segment_id").alias("chunk_id"), "start_seconds")
    near = search.context_chunks(found, times, 1)
    placed = search.in_order(near, ["query_id", "episode_id"], "chunk_id")
    return placed.select("query_id", "episode_id", F.col("chunk_id").alias("segment_id"), "start_seconds", "place")
