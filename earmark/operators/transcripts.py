"""Segment tables: normal form, header, rendering, translation, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import casefold, clean_text, collapse, longest_repeat, longest_repeat_packed, strip, words
from earmark.functions.times import clock, clock_ms, end_or_start, micros
from earmark.functions.urls import seek_url
from earmark.operators.captions import merge_captions, number_segments
from earmark.operators.ordered import position_block, scan


def normalize(cues: DataFrame, language: str | None = None) -> DataFrame:
    """Clean, merge, renumber and stamp the cues of every episode.

    Input: ``episode_id, pos`` without gaps, non-empty cleaned ``text``,
    ``speaker, start_seconds, end_seconds, language, confidence``.
    """
    rows = number_segments(merge_captions(cues).drop("merged_rows"))
    return rows.select(
        "episode_id", "segment_id", clock(F.col("start_seconds")).alias("start"), clock(F.col("end_seconds")).alias("end"),
        "start_seconds", "end_seconds", "speaker",
        F.coalesce(F.nullif("language", F.lit("")), F.lit(language)).alias("language"), "confidence", "text")


def header(segments: DataFrame) -> DataFrame:
    """One row per episode: counts, sorted speakers, duration.

    Grouped by speaker first, so no group is larger than its speaker list.
    """
    last = F.coalesce(F.nullif("end_seconds", F.lit(0.0)), "start_seconds", F.lit(0.0))
    by_speaker = segments.groupBy("episode_id", F.nullif("speaker", F.lit("")).alias("speaker")).agg(
        F.count("*").alias("n"), F.count("start_seconds").alias("timed"), F.max(last).alias("duration"))
    return by_speaker.groupBy("episode_id").agg(
        F.sum("n").alias("segment_count"), F.sum("timed").alias("timed_segment_count"),
        F.count("speaker").alias("speaker_count"), F.array_sort(F.collect_list("speaker")).alias("speakers"),
        F.max("duration").alias("duration_seconds"))


def _timed(segments: DataFrame) -> DataFrame:
    """Timed rows, numbered, with an end that comes after the start."""
    rows = segments.where("start_seconds IS NOT NULL")
    rows = scan(rows, ["episode_id"], ["segment_id"], position_block("segment_id"),
                lead={"_next": F.col("start_seconds")}, total={"_n": F.lit(1)})
    usable = F.col("end_seconds") > F.col("start_seconds")
    return rows.withColumns({
        "line_no": (F.coalesce("_n", F.lit(0)) + 1).cast("long"),
        "end_seconds": F.when(usable, F.col("end_seconds")).otherwise(F.coalesce("_next", F.col("start_seconds") + 4)),
    }).drop("_n", "_next")


def _named(template: str, plain: Column) -> Column:
    has = F.coalesce(F.col("speaker"), F.lit("")) != ""
    return F.when(has, F.format_string(template, F.col("speaker"), F.col("text"))).otherwise(plain)


def render_srt(segments: DataFrame) -> DataFrame:
    """``episode_id, line_no, text``: one numbered SRT block per row."""
    body = F.concat(
        F.col("line_no").cast("string"), F.lit("\n"), clock_ms(F.col("start_seconds"), ","), F.lit(" --> "),
        clock_ms(F.col("end_seconds"), ","), F.lit("\n"), _named("%s: %s", F.col("text")), F.lit("\n"))
    return _timed(segments).select("episode_id", "line_no", body.alias("text"))


def render_vtt(segments: DataFrame) -> DataFrame:
    """``episode_id, line_no, text``: the file head (0) and one cue per row."""
    body = F.concat(
        clock_ms(F.col("start_seconds")), F.lit(" --> "), clock_ms(F.col("end_seconds")), F.lit("\n"),
        _named("<v %s>%s</v>", F.col("text")), F.lit("\n"))
    cues = _timed(segments).select("episode_id", "line_no", body.alias("text"))
    heads = segments.where("start_seconds IS NOT NULL").select("episode_id").distinct().select(
        "episode_id", F.lit(0).cast("long").alias("line_no"), F.lit("WEBVTT\n").alias("text"))
    return heads.unionByName(cues)


def render_markdown(segments: DataFrame, method: str = "normalized", language: str | None = None) -> DataFrame:
    """``episode_id, line_no, text``: a head (0) and one paragraph per segment."""
    stamp = F.when(F.col("start").isNotNull(), F.concat(F.lit("["), "start", F.lit("] "))).otherwise(F.lit(""))
    rows = segments.select("episode_id", F.col("segment_id").cast("long").alias("line_no"),
                           F.concat(stamp, _named("**%s:** %s", F.col("text")), F.lit("\n")).alias("text"))
    heads = segments.groupBy("episode_id").agg(F.count("*").alias("n")).select(
        "episode_id", F.lit(0).cast("long").alias("line_no"),
        F.concat(F.lit("# Timestamped transcript\n\n- Source file: `"), "episode_id",
                 F.lit(f"`\n- Method: {method}\n- Language: {language or 'unknown'}\n- Segments: "), "n", F.lit("\n")).alias("text"))
    return heads.unionByName(rows)


def write_rendered(lines: DataFrame, path: str) -> None:
    """Write rendered rows as text, one folder per episode, lines in order.

    A long episode becomes several consecutive files of its folder.
    """
    (lines.repartitionByRange("episode_id", "line_no").sortWithinPartitions("episode_id", "line_no")
     .select("episode_id", "text").write.mode("overwrite").partitionBy("episode_id").text(path))


def linked(segments: DataFrame, source_url: Column) -> DataFrame:
    """Rows of a reader: stamp, link into the source, speaker, search text."""
    start = F.coalesce("start_seconds", F.lit(0.0))
    return segments.select(
        "episode_id", "segment_id", F.coalesce("start", F.lit("--:--")).alias("stamp"),
        seek_url(source_url, start).alias("link"), "speaker", "text",
        casefold(F.concat(F.coalesce("speaker", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("search"))


# --- translation ------------------------------------------------------------


def translation_request(segments: DataFrame) -> DataFrame:
    return segments.select("episode_id", "segment_id", "speaker", "text")


def translation_coverage(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """One row per problem: ``missing``, ``extra``, ``duplicate`` or ``empty``."""
    key = ["episode_id", "segment_id"]
    given = translated.groupBy(*key).agg(
        F.count("*").alias("times"), F.count_if(F.coalesce(strip(F.col("text")), F.lit("")) == "").alias("blank"))
    both = segments.select(*key, F.lit(True).alias("wanted")).join(given, key, "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("times").isNull(), F.lit("missing")), F.when(F.col("wanted").isNull(), F.lit("extra")),
        F.when(F.col("times") > 1, F.lit("duplicate")), F.when(F.col("blank") > 0, F.lit("empty"))))
    return both.select(*key, F.explode(found).alias("problem"))


def apply_translation(segments: DataFrame, translated: DataFrame, language: str) -> DataFrame:
    """Translated segments of the episodes whose translation has no problem."""
    key = ["episode_id", "segment_id"]
    bad = translation_coverage(segments, translated).select("episode_id").distinct()
    texts = translated.select(*key, strip(F.col("text")).alias("_new"))
    return (
        segments.withColumnRenamed("text", "source_text").join(texts, key).join(bad, "episode_id", "left_anti")
        .withColumns({"text": F.col("_new"), "language": F.lit(language)}).drop("_new"))


# --- quality ------------------------------------------------------------------


def quality(segments: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Metrics, warnings, score and status of every episode.

    All metrics add up, so rows are first combined per distinct text (which
    counts the repetitions too) and only then per episode. With ``episodes``
    there is one row for each of them: those without segments fail with score
    0 and have no metrics.
    """
    text = collapse(F.coalesce("text", F.lit("")))
    timed = F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull()
    rows = segments.select("episode_id", "start_seconds", "end_seconds", "confidence", text.alias("text"), timed.alias("timed"))
    span = micros(F.col("end_seconds")) - micros(F.col("start_seconds"))
    by_text = rows.groupBy("episode_id", "text").agg(
        F.count("*").alias("n"), F.count_if("timed").alias("timed"),
        F.count_if(F.col("timed") & (span < 0)).alias("reversed"),
        F.sum(F.when(F.col("timed"), F.greatest(span, F.lit(0)))).alias("speech"),
        F.max(F.when(F.col("timed"), F.col("end_seconds"))).alias("last_end"),
        F.count("confidence").alias("scored"), F.sum("confidence").alias("confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("low"))
    # Texts are collapsed already: words have one blank between them. Each is folded once.
    folded = F.col("folded")
    packed = F.replace(folded, F.lit(" "), F.lit(""))
    blanks = F.length(folded) - F.length(packed)
    distinct = lambda tokens: F.size(F.array_distinct(tokens))
    by_text = by_text.withColumn("folded", casefold(F.col("text"))).withColumns({
        "word_count": F.when(folded == "", 0).otherwise(blanks + 1), "chars": F.length("text"),
        # Eight words in front tell of most texts that they have more than two.
        "stuck": (blanks >= 7) & (distinct(F.slice(F.split(folded, " ", 9), 1, 8)) <= 2) & (distinct(F.split(folded, " ")) <= 2),
        "span": longest_repeat_packed(packed),
    })
    n = F.col("n")
    pathological = F.col("span") >= 32
    by_fold = by_text.groupBy("episode_id", "folded").agg(
        F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.sum("reversed").alias("reversed"),
        F.sum("speech").alias("speech"), F.max("last_end").alias("last_end"), F.sum("scored").alias("scored"),
        F.sum("confidence").alias("confidence"), F.sum("low").alias("low"),
        F.sum(n * F.col("word_count")).alias("words"), F.sum(n * F.col("chars")).alias("chars"),
        F.bool_or("stuck").alias("stuck"), F.sum(F.when(pathological, n).otherwise(0)).alias("pathological"),
        F.max(F.when(pathological, F.col("span")).otherwise(0)).alias("max_span"))
    full = F.col("folded") != ""
    m = by_fold.groupBy("episode_id").agg(
        F.sum("n").alias("segments"), F.sum("timed").alias("timed_segments"), F.sum("reversed").alias("reversed_ranges"),
        F.sum(F.when(~full, n).otherwise(0)).alias("empty_segments"),
        F.sum(F.when(full, n).otherwise(0)).alias("texts"),
        F.sum(F.when(full, n - 1).otherwise(0)).alias("exact_repetitions"),
        F.round(F.coalesce(F.max("last_end"), F.lit(0.0)), 3).alias("duration_seconds"),
        F.round(F.coalesce(F.sum("speech"), F.lit(0)) / 1000000, 3).alias("speech_seconds"),
        F.sum("chars").alias("characters"), F.sum("words").alias("words"),
        F.bool_or("stuck").alias("stuck"), F.sum("pathological").alias("pathological_segments"),
        F.max("max_span").cast("long").alias("max_repeated_span"),
        F.sum("scored").alias("confidence_samples"), F.sum("low").alias("low_confidence_segments"),
        F.round(F.sum("confidence") / F.sum("scored"), 4).alias("average_confidence"))
    m = m.withColumn("timed_coverage", F.round(F.col("timed_segments") / F.col("segments"), 4))
    issue = lambda test, name: F.when(test, F.lit(name))
    m = m.withColumns({
        "errors": F.array_compact(F.array(
            issue(F.col("reversed_ranges") > 0, "reversed_ranges"), issue(F.col("empty_segments") > 0, "empty_segments"))),
        "_early": F.array_compact(F.array(
            issue(F.col("exact_repetitions") / F.greatest(F.lit(1), F.col("texts")) > 0.15, "exact_repetition"),
            issue(F.col("stuck"), "repeated_tokens"),
            issue(F.col("pathological_segments") > 0, "repeated_pattern"),
            issue(F.col("low_confidence_segments") / F.nullif("confidence_samples", F.lit(0)) > 0.2, "low_confidence"))),
        "_thin": F.col("timed_segments") / F.col("segments") < 0.95,
    })
    score = (100 - F.when(F.size("errors") > 0, 30).otherwise(0) - F.least(F.lit(25), F.size("_early") * 10)
             - F.when(F.col("_thin"), 15).otherwise(0))
    out = m.withColumns({
        "warnings": F.concat("_early", F.when(F.col("_thin"), F.array(F.lit("untimed_segments")))
                             .otherwise(F.array().cast("array<string>"))),
        "score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"),
    }).withColumn("status", F.when(F.size("errors") > 0, F.lit("fail")).when(F.size("warnings") > 0, F.lit("warn"))
                  .otherwise(F.lit("pass"))).drop("_early", "_thin", "texts", "stuck")
    if episodes is None:
        return out
    return episodes.select("episode_id").distinct().join(out, "episode_id", "left").withColumns({
        "errors": F.coalesce("errors", F.array(F.lit("no_segments"))),
        "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
        "score": F.coalesce("score", F.lit(0).cast("long")), "status": F.coalesce("status", F.lit("fail"))})


def repeated_spans(segments: DataFrame, least: int = 32) -> DataFrame:
    """Segments with a pathological repeated span."""
    return segments.withColumn("repeated_span", longest_repeat(F.col("text")).cast("long")).where(
        F.col("repeated_span") >= least).select("episode_id", "segment_id", "repeated_span")


def stuck_tokens(segments: DataFrame, least: int = 8, most_distinct: int = 2) -> DataFrame:
    """Segments of many tokens that are nearly all the same."""
    tokens = words(casefold(F.col("text")))
    return segments.select(
        "episode_id", "segment_id", F.size(tokens).cast("long").alias("words"),
        F.size(F.array_distinct(tokens)).cast("long").alias("distinct_words"),
    ).where((F.col("words") >= least) & (F.col("distinct_words") <= most_distinct))


SPOT_RULES = {
    "number_or_date": r"\d",
    "price_or_percent": r"[$€£¥]\s*\d|\d\s*(?:%|％|percent)",
    "negation": r"(?iU)\b(?:not|never|no)\b|不会|并非",
    "url": r"(?i)https?://|www\.",
    "introduction": r"(?iU)\b(?:my name is|i am|i'm|welcome)\b",
}


def spot_checks(segments: DataFrame) -> DataFrame:
    """Segments to listen to again, with the reasons; least certain first."""
    reasons = F.array_compact(F.array(*[
        F.when(F.regexp_like("text", F.lit(rule)), F.lit(name)) for name, rule in SPOT_RULES.items()]))
    return segments.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def cleaned(segments: DataFrame) -> DataFrame:
    """Drop rows without text after cleaning."""
    return segments.withColumn("text", clean_text(F.coalesce("text", F.lit("")))).where("text <> ''")


def durations(segments: DataFrame) -> DataFrame:
    """Transcript duration per episode, as used by the audits."""
    return segments.groupBy("episode_id").agg(F.max(F.coalesce(
        end_or_start(F.col("end_seconds"), F.col("start_seconds")), F.lit(0.0))).alias("duration"))


def confidence_from_logprob(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(F.coalesce(c, F.lit(-10.0))))), 6)
