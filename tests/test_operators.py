"""Operators on small hand-worked tables."""

from pyspark.sql import functions as F

from earmark.operators import episodes, evidence, search, timeline, tracks, transcripts

SEG = "episode_id string, segment_id long, start_seconds double, end_seconds double, speaker string, text string"


def chunks(spark, rows):
    df = spark.createDataFrame(rows, "episode_id string, chunk_id long, segment_ids array<string>, text string")
    return df.withColumn("search_text", F.lower("text"))


def test_search_across_languages(spark):
    index = chunks(spark, [("e", 0, ["1"], "Deep neural networks and agents"), ("e", 1, ["7"], "we grow tomatoes"), ("e", 2, ["9"], "人工智能与人工")])
    asked = spark.createDataFrame([(1, "神经网络"), (2, "人工"), (3, "neural networks and"), (4, "…")], "query_id long, query string")
    glossary = spark.createDataFrame([(0, ["神经网络", "neural networks"])], "entry long, labels array<string>")
    wider = search.expand_queries(asked, glossary)
    assert {r.query_id: r.expanded for r in wider.collect()} == {
        1: "神经网络 neural networks", 2: "人工", 3: "neural networks and 神经网络", 4: "…"}
    hits = search.rank(wider.select("query_id", F.col("expanded").alias("query")), index).collect()
    assert {(r.query_id, r.chunk_id) for r in hits} == {(1, 0), (2, 2), (3, 0)}
    assert next(r for r in hits if r.query_id == 2).matched_terms == ["人工"]
    direct = {r.query_id: r.score for r in search.rank(asked, index).collect()}
    import math
    idf = math.log(4 / 1.5) + 1
    assert direct[2] == round((1 + math.log(2)) * idf + 8, 4) and direct[3] == round(3 * idf + 8, 4)


def test_translated_claim_leads_to_its_segment(spark):
    index = chunks(spark, [("e", 0, ["1"], "unrelated"), ("e", 1, ["7", "8.1"], "the model forgets")])
    asked = spark.createDataFrame([(1, "遗忘 关于")], "query_id long, query string")
    items = spark.createDataFrame([("c1", "e", "模型会遗忘", [7])], "item string, episode_id string, searchable string, segment_ids array<long>")
    boosts = search.evidence_boosts(asked, items)
    assert [tuple(r) for r in boosts.collect()] == [(1, "e", 7, 6.0)]
    row = search.rank(asked, index, boosts).collect()
    assert [(r.chunk_id, r.score, r.evidence_boost, r.matched_terms) for r in row] == [(1, 6.0, 6.0, [])]


def test_budget_and_confidence(spark):
    hits = spark.createDataFrame([(1, 1, "abcde", 9.0), (1, 2, "fghi jk", 7.0), (1, 3, "l", 1.0)], "query_id long, rank int, text string, score double")
    kept = search.within_budget(hits, 10).orderBy("rank").collect()
    assert [(r.rank, r.text, r.text_truncated) for r in kept] == [(1, "abcde", False), (2, "fghi…", True)]
    assert search.confidence(hits).first().confidence == "high"
    assert search.confidence(hits.where("rank > 1").withColumn("rank", F.col("rank") - 1)).first().confidence == "medium"


def test_speakers_by_overlap(spark):
    segments = spark.createDataFrame([("e", 1, 0.0, 10.0, "old", "a"), ("e", 2, 10.0, 20.0, "old", "b"), ("e", 3, 50.0, 60.0, "old", "c"),
                                      ("e", 4, None, None, "old", "d"), ("e", 5, 20.0, 24.0, "old", "t")], SEG)
    turns = spark.createDataFrame([("e", 0, 0.0, 6.0, "A"), ("e", 1, 5.0, 12.0, "B"), ("e", 2, 8.0, 9.0, "A"), ("e", 3, 12.0, 13.0, "A"),
                                   ("e", 4, 20.0, 22.0, "B"), ("e", 5, 22.0, 24.0, "A")],
                                  "episode_id string, turn_no long, start double, end double, speaker string")
    rows = timeline.assign_speakers(segments, turns).orderBy("segment_id").collect()
    assert [(r.speaker, r.speaker_confidence) for r in rows] == [("A", 0.7), ("old", 0.2), ("old", 0.0), ("old", None), ("A", 0.5)]
    got = timeline.diarization_coverage(timeline.assign_speakers(segments, turns)).first()
    assert (got.assigned_segments, got.coverage) == (2, 0.4)


def test_quotes_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(evidence, "QUOTE_BLOCK", 4)
    words = [f"w{i}" for i in range(60)]
    segments = spark.createDataFrame([("e", i + 1, float(i), i + 1.0, None, w) for i, w in enumerate(words)], SEG)
    quotes = [(0, " ".join(words[3:9]).upper(), None, 0.0, 60.0), (1, "w3 w5", None, 0.0, 60.0), (2, "w20  w21", None, 21.0, 21.5),
              (3, "w20 w21", [21, 22], 0.0, 1.0), (4, "w20 w21", [21], 0.0, 1.0), (5, "w50", None, 0.0, 10.0)]
    df = spark.createDataFrame([("e", *q) for q in quotes], "episode_id string, idx long, text string, segment_ids array<long>, start_at double, end_at double")
    found = {r.idx: r.found for r in evidence.quote_found(df, segments).collect()}
    assert found == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_fabricated_evidence_is_reported(spark):
    segments = spark.createDataFrame([("e", 1, 0.0, 5.0, "A", "We ship on Friday"), ("e", 2, 5.0, 18.0, "B", "Never again")], SEG)
    claims = spark.createDataFrame([("e", 0, "ok", "fact", "stated", "high", "not_checked"), ("e", 1, "bad", "gossip", "stated", "high", "supported")],
                                   "episode_id string, idx long, claim string, kind string, support string, confidence string, verification string")
    quotes = spark.createDataFrame([("e", 0, "made up", "00:00:00", "00:00:05", [1]), ("e", 1, "SHIP on  friday", "00:00:00", "09:00:00", [1])],
                                   "episode_id string, idx long, text string, start string, end string, segment_ids array<long>")
    refs = spark.createDataFrame([("e", "claims", 0, 0, "00:00:00", "00:00:04", [1]), ("e", "claims", 1, 0, "00:00:17", "00:00:18", [1, 9])],
                                 "episode_id string, collection string, idx long, ref_no long, start string, end string, segment_ids array<long>")
    found = evidence.evidence_audit(segments, transcripts.durations(segments), claims=claims, quotes=quotes, refs=refs)
    assert {(r.collection, r.idx, r.rule) for r in found.collect()} == {
        ("claims", 1, "invalid_kind"), ("claims", 1, "unknown_segment_ids"), ("claims", 1, "apart_from_segments"),
        ("quotes", 0, "not_in_transcript"), ("quotes", 1, "beyond_duration")}


def test_report(spark):
    segments = spark.createDataFrame([("e", 1, 0.0, 5.0, "A", "We ship on Friday"), ("e", 2, 5.0, 18.0, "B", "Never again")], SEG)
    good = '# T\n\n- Source: x\n\n## 核心结论\nyes\n\n## 时间线\n- [00:00:01–00:00:05] a\n\n> “never again” [00:00:06]\n\n## 限制\nnone\n'
    reports = spark.createDataFrame([("good", "e", good), ("bad", "e", good.replace("[00:00:06]", "[09:00:00]").replace("yes", "TODO"))],
                                    "report_id string, episode_id string, text string")
    checks = evidence.report_checks(reports, segments, transcripts.durations(segments))
    got = {r.report_id: (r.valid, sorted(r.failures)) for r in evidence.report_audit(checks).collect()}
    assert got == {"good": (True, []), "bad": (False, ["no_placeholders", "quotes_match_transcript", "timestamp_ranges_valid"])}


def test_report_without_a_transcript(spark):
    segments = spark.createDataFrame([("e", 1, None, None, "A", "no times")], SEG)
    text = '# T\n\n- Source: x\n\n## Summary\nyes\n\n> “never again”\n'
    reports = spark.createDataFrame([("there", "e", text), ("gone", "f", text), ("null", "e", None)], "report_id string, episode_id string, text string")
    checks = evidence.report_checks(reports, segments, transcripts.durations(segments))
    loose = {r.report_id: r for r in evidence.report_audit(checks, strict=False).collect()}
    assert loose["there"].failures == [] and loose["gone"].failures == ["transcript_unreadable"]
    assert loose["there"].warnings == loose["gone"].warnings == ["evidence_timestamps", "limitations", "quotes_are_timestamped"]
    free = {r.report_id: r for r in evidence.report_audit(checks, strict=False, grounded=False).collect()}
    assert free["gone"].valid and loose["there"].valid and not loose["gone"].valid
    strict = {r.report_id: r.failures for r in evidence.report_audit(checks).collect()}
    assert strict["gone"] == [*strict["there"], "transcript_unreadable"]


def test_glossary_evidence_is_a_list(spark):
    segments = spark.createDataFrame([("e", 1, 0.0, 5.0, "A", "We ship on Friday")], SEG)
    entry = "array<struct<start:string>>"
    glossary = spark.createDataFrame([("e", 0, "term", None), ("e", 1, "term", []), ("e", 2, " ", None)], f"episode_id string, idx long, source_term string, evidence {entry}")
    found = evidence.evidence_audit(segments, transcripts.durations(segments), glossary=glossary)
    assert {(r.collection, r.idx, r.rule) for r in found.collect()} == {("glossary", 0, "evidence_not_a_list"), ("glossary", 2, "source_term_required")}


def test_track_plan(spark):
    media = spark.createDataFrame([(1, "zh-Hans,en", "en")], "media_id long, requested string, language string")
    have = [("human", "zh-CN"), ("human", "en"), ("automatic", "zh-Hans"), ("automatic", "en-orig")]
    df = spark.createDataFrame([(1, *t) for t in have], "media_id long, kind string, language string")
    rows = tracks.rank_tracks(media, df).orderBy("place").collect()
    assert [(r.kind, r.language) for r in rows] == [("human", "zh-CN"), ("human", "en"), ("automatic", "en-orig"), ("automatic", "zh-Hans")]


def test_durations_and_timeline(spark):
    df = spark.createDataFrame([(5899.52, 5900.0), (1069.952, 5900.0), (1.0, None), (0.0, None)], "a double, e double")
    assert [r[0] for r in df.select(timeline.duration_complete(F.col("a"), F.col("e"))).collect()] == [True, False, True, False]
    windows = spark.createDataFrame([("e", "c1", 1, 0.0), ("e", "c2", 2, 10.0), ("e", "c3", 3, 20.0)],
                                    "episode_id string, chunk_key string, sequence long, global_offset_seconds double")
    parts = spark.createDataFrame([("e", "c1", 1.0, 2.0, "a"), ("e", "c2", 1.0, None, "b")],
                                  "episode_id string, chunk_key string, start_seconds double, end_seconds double, text string")
    rows = timeline.global_timeline(parts, windows).orderBy("chunk_sequence").collect()
    assert [(r.start_seconds, r.end_seconds) for r in rows] == [(1.0, 2.0), (11.0, None)]
    assert timeline.timeline_status(windows, parts).first().status == "partial"


def test_shared_files_and_redaction(spark):
    names = ["analysis.md", "transcript.md", "chunks.json", "frames/1.jpg", "x.part", ".invalid-cache/a", "notes.txt"]
    df = spark.createDataFrame([("e", n, "t") for n in names], "episode_id string, path string, text string")
    pick = lambda *a: {r.path for r in episodes.shared_files(df, *a).collect()}
    assert pick("share") == {"analysis.md", "frames/1.jpg"}
    assert pick("portable", True) == {"analysis.md", "frames/1.jpg", "transcript.md", "chunks.json"}
    assert pick("archive") == {"analysis.md", "frames/1.jpg", "notes.txt"}
    js = '{"u":"https://a.example/x?utm_source=1&token=s","p":"/home/me/show/a/b.wav","q":"/srv/x/c.wav"}'
    out = spark.createDataFrame([(js,)], "j string").select(episodes.sanitize_json(F.col("j"), F.lit("/home/me/show"))).first()[0]
    assert out == '{"u":"https://a.example/x?token=%5BREDACTED%5D","p":"a/b.wav","q":"[LOCAL_PATH_REDACTED]/c.wav"}'


def test_quality_of_pathological_repetition(spark):
    rows = [("e", 1, 0.0, 1.0, None, "fine words"), ("e", 2, 1.0, 2.0, None, "嗯 " * 40), ("e", 3, 2.0, 3.0, None, "45,000,000" * 12)]
    df = spark.createDataFrame(rows, SEG).withColumn("confidence", F.lit(None).cast("double"))
    r = transcripts.quality(df).first()
    assert (r.status, r.score, r.pathological_segments, r.warnings) == ("warn", 80, 2, ["repeated_tokens", "repeated_pattern"])
    assert {x.segment_id for x in transcripts.repeated_spans(df).collect()} == {2, 3}


def test_collection_csv_has_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("主张", "00:01–00:02")], "claim string, evidence string")
    evidence.write_collection(df.coalesce(1), str(tmp_path / "claims"))
    part = next((tmp_path / "claims").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿claim,evidence".encode()) and "主张" in part.decode()
