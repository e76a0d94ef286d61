"""The given tables seen as transcripts, turns, feeds and so on.

Each view is stated twice: as a DataFrame and, in ``VIEW_SQL``, as the text the
SQL counterparts are built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.functions.text import collapse, search_text
from earmark.functions.times import clock
from earmark.operators.chunking import chunk_ranges, chunk_rows
from earmark.operators.ordered import position_block, scan
from earmark.plans.registry import spread_table, table

CHARS_PER_SECOND = 15.0

def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def searched(x: str) -> str:
    return rf"trim(regexp_replace({folded(x)}, '\s+', ' ', 'g'))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def sql_clock(x: str) -> str:
    s = f"CAST(floor(greatest({x}, 0.0)) AS BIGINT)"
    return f"CASE WHEN {x} IS NOT NULL THEN printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) END"


def sql_clock_ms(x: str, separator: str = ".") -> str:
    whole = f"CAST(floor({x}) AS BIGINT)"
    ms = f"({whole} * 1000 + CAST(round_even(({x} - {whole}) * 1000, 0) AS BIGINT))"
    return (f"printf('%02d:%02d:%02d{separator}%03d', {ms} // 3600000, {ms} % 3600000 // 60000, "
            f"{ms} % 60000 // 1000, {ms} % 1000)")


def sql_longest_repeat(x: str) -> str:
    """Longest run of equal characters ``w`` apart, for each unit width ``w``."""
    packed = rf"string_split(regexp_replace({folded(x)}, '\s+', '', 'g'), '')"
    bits = (f"array_to_string(list_transform(range(1, len(p) - w + 1), "
            f"lambda i: CASE WHEN p[i] = p[i + w] THEN '1' ELSE '0' END), '')")
    return (f"(SELECT coalesce(max(span), 0) FROM (SELECT w, (length(unnest(regexp_extract_all({bits}, '1+'))) + w) // w * w AS span "
            f"FROM (SELECT {packed} AS p), (SELECT unnest(range(1, 13)) AS w)) WHERE span >= CASE WHEN w = 1 THEN 12 ELSE 8 * w END)")


MAX_CHARS, MAX_SECONDS = 2000, 100
TERMS = ordered_distinct(f"regexp_extract_all({folded('query')}, '[A-Za-z0-9_+#.-]{{2,}}')")

VIEW_SQL = {
    "v_segments": """
        v_segments AS (
          SELECT CAST(conv_id AS VARCHAR) AS episode_id, turn AS pos, turn + 1 AS segment_id, role AS speaker, text,
                 round(coalesce(CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) / 15.0, 3) AS start_seconds,
                 round(CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) / 15.0, 3) AS end_seconds
          FROM conversations)""",
    "v_queries": "v_queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "v_terms": f"""
        v_terms AS (
          SELECT query_id, unnest(range(0, len(t))) AS ix, unnest(t) AS term
          FROM (SELECT query_id, {TERMS} AS t FROM v_queries))""",
    # Whole segments as search units.
    "v_units": f"""
        v_units AS (SELECT episode_id, segment_id AS chunk_id, text, {searched('text')} AS st FROM v_segments)""",
    # The chunker, one segment at a time.
    "v_ranges": f"""
        v_sized AS (
          SELECT episode_id, pos, length(text) AS len, start_seconds AS st, coalesce(nullif(end_seconds, 0), start_seconds) AS en,
                 CAST(sum(length(text)) OVER (PARTITION BY episode_id ORDER BY pos) AS BIGINT) AS cum
          FROM v_segments),
        v_steps AS (
          SELECT episode_id, pos, CAST(0 AS BIGINT) AS chunk_id, pos AS first FROM v_sized WHERE pos = 0
          UNION ALL
          SELECT n.episode_id, n.pos,
                 CASE WHEN n.cum - b.cum + b.len > {MAX_CHARS} OR n.en - b.st > {MAX_SECONDS} THEN p.chunk_id + 1 ELSE p.chunk_id END,
                 CASE WHEN NOT (n.cum - b.cum + b.len > {MAX_CHARS} OR n.en - b.st > {MAX_SECONDS}) THEN p.first
                      WHEN p.first <= n.pos - 2 AND n.cum - c.cum + c.len <= {MAX_CHARS} THEN n.pos - 2
                      WHEN p.first <= n.pos - 1 AND n.cum - d.cum + d.len <= {MAX_CHARS} THEN n.pos - 1
                      ELSE n.pos END
          FROM v_steps p
          JOIN v_sized n ON n.episode_id = p.episode_id AND n.pos = p.pos + 1
          JOIN v_sized b ON b.episode_id = p.episode_id AND b.pos = p.first
          JOIN v_sized d ON d.episode_id = p.episode_id AND d.pos = p.pos
          LEFT JOIN v_sized c ON c.episode_id = p.episode_id AND c.pos = p.pos - 1),
        v_ranges AS (
          SELECT episode_id, chunk_id, min(first) AS first_pos, max(pos) AS last_pos FROM v_steps GROUP BY ALL)""",
    "v_chunks": f"""
        v_chunks AS (
          SELECT episode_id, chunk_id, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY pos) AS segment_ids,
                 arg_min(start_seconds, pos) AS start_seconds, arg_max(end_seconds, pos) AS end_seconds,
                 list(speaker ORDER BY pos) AS sp, string_agg(trim(text), ' ' ORDER BY pos) AS text
          FROM v_ranges JOIN v_segments USING (episode_id) WHERE pos BETWEEN first_pos AND last_pos
          GROUP BY episode_id, chunk_id)""",
    # Lines of a document as a transcript with odd times and label confidence.
    "v_lines": """
        v_lines AS (
          SELECT CAST(doc_id AS VARCHAR) AS episode_id, pos, pos + 1 AS segment_id, source AS speaker, line AS text,
                 pos * 2.0::DOUBLE AS start_seconds,
                 CASE WHEN length(line) % 7 <> 0 THEN pos * 2.0::DOUBLE + length(line) / 20.0 - 0.5 END AS end_seconds,
                 CAST(quality AS DOUBLE) AS confidence
          FROM (SELECT doc_id, source, unnest(string_split(text, E'\\n')) AS line,
                       unnest(range(len(string_split(text, E'\\n')))) AS pos FROM documents)
          LEFT JOIN labels USING (doc_id))""",
    # Every turn shown first in half, then whole, as rolling captions do.
    "v_rolling": """
        v_rolling AS (
          SELECT episode_id, pos * 2 + k AS pos, speaker,
                 CASE WHEN k = 0 THEN trim(regexp_replace(substr(text, 1, greatest(1, length(text) // 2)), '\\s+', ' ', 'g'))
                      ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text,
                 CASE WHEN k = 0 THEN start_seconds ELSE start_seconds + length(text) % 4 END AS start_seconds,
                 CASE WHEN length(text) % 3 = k THEN NULL WHEN k = 0 THEN start_seconds + 1 ELSE end_seconds END AS end_seconds
          FROM v_segments, (SELECT unnest([0, 1]) AS k))""",
    "v_kept": """
        v_fold AS (
          SELECT episode_id, pos, pos AS kept, text, speaker, start_seconds AS st, end_seconds AS en FROM v_rolling WHERE pos = 0
          UNION ALL
          SELECT n.episode_id, n.pos,
                 CASE WHEN same OR grown THEN p.kept ELSE n.pos END,
                 n.text, n.speaker,
                 CASE WHEN same OR grown THEN p.st ELSE n.start_seconds END,
                 CASE WHEN same THEN coalesce(n.end_seconds, p.en) WHEN grown THEN coalesce(nullif(n.end_seconds, 0), p.en)
                      ELSE n.end_seconds END
          FROM v_fold p JOIN v_rolling n ON n.episode_id = p.episode_id AND n.pos = p.pos + 1,
          LATERAL (SELECT n.text = p.text AND n.speaker IS NOT DISTINCT FROM p.speaker
                          AND (p.en IS NULL OR n.start_seconds IS NULL OR n.start_seconds <= p.en + 2) AS same,
                          starts_with(n.text, p.text) AND n.speaker IS NOT DISTINCT FROM p.speaker
                          AND (p.en IS NULL OR n.start_seconds IS NULL OR n.start_seconds <= p.en + 1) AS grown)),
        v_kept AS (
          SELECT episode_id, kept AS pos, arg_max(text, pos) AS text, any_value(speaker) AS speaker, any_value(st) AS start_seconds,
                 arg_max(en, pos) FILTER (en IS NOT NULL OR true) AS end_seconds, count(*) AS merged_rows
          FROM v_fold GROUP BY episode_id, kept)""",
}
NEEDS = {"v_rolling": ["v_segments"], "v_kept": ["v_rolling"], "v_terms": ["v_queries"], "v_units": ["v_segments"], "v_ranges": ["v_segments"], "v_chunks": ["v_ranges"]}


def with_views(views: str, body: str) -> str:
    """``WITH`` the named views and what they build on, then the statement."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for base in NEEDS.get(name, []):
            add(base)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    head = "WITH RECURSIVE" if "v_ranges" in wanted or "v_kept" in wanted or "RECURSIVE" in body else "WITH"
    body = body.strip().removeprefix("RECURSIVE").strip()
    glue = ",\n" if not body.upper().startswith("SELECT") else "\n"
    return f"{head} " + ",\n".join(VIEW_SQL[v].strip() for v in wanted) + glue + body


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a timed transcript, 15 characters a second."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").alias("pos"),
        (F.col("turn") + 1).alias("segment_id"), F.col("role").alias("speaker"), "text")
    chars = F.length("text").cast("long")
    timed = scan(turns, ["episode_id"], ["pos"], position_block("pos"), total={"_before": chars})
    before = F.coalesce("_before", F.lit(0))
    return timed.select(
        "episode_id", "pos", "segment_id", "speaker", "text",
        F.round(before / CHARS_PER_SECOND, 3).alias("start_seconds"),
        F.round((before + chars) / CHARS_PER_SECOND, 3).alias("end_seconds"))


def display_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return rows.withColumns({"start": clock(F.col("start_seconds")), "end": clock(F.col("end_seconds"))})


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the conversation transcripts."""
    rows = display_segments(spark, sf_dir)
    return chunk_rows(rows, chunk_ranges(rows, MAX_CHARS, MAX_SECONDS))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a search unit of its own."""
    return spread_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("episode_id"), (F.col("turn") + 1).alias("chunk_id"), "text",
        search_text(F.col("text")).alias("search_text"),
        F.array((F.col("turn") + 1).cast("string")).alias("segment_ids"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as segments with odd times and label confidence."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"))
    rows = spread_table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("episode_id"), F.col("source").alias("speaker"), "confidence",
        F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    start = F.col("pos") * 2.0
    chars = F.length("text")
    return rows.select(
        "episode_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + 1).cast("long").alias("segment_id"), "speaker", "text",
        start.alias("start_seconds"), F.when(chars % 7 != 0, start + chars / 20.0 - 0.5).alias("end_seconds"), "confidence")


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn shown first in half, then whole, as rolling captions do."""
    rows = segments(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    chars = F.length("text")
    half = F.substring("text", F.lit(1), F.greatest(F.lit(1), F.floor(chars / 2).cast("int")))
    first = F.col("k") == 0
    return rows.select(
        "episode_id", (F.col("pos") * 2 + F.col("k")).alias("pos"), "speaker",
        collapse(F.when(first, half).otherwise(F.col("text"))).alias("text"),
        F.when(first, F.col("start_seconds")).otherwise(F.col("start_seconds") + chars % 4).alias("start_seconds"),
        F.when(chars % 3 == F.col("k"), F.lit(None)).when(first, F.col("start_seconds") + 1)
        .otherwise(F.col("end_seconds")).cast("double").alias("end_seconds"))
