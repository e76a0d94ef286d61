"""Files on disk, read through the sources."""

import json

import pytest
from pyspark.sql import functions as F

from earmark.operators import transcripts
from earmark.operators.chunking import chunk_ranges, chunk_rows, split_oversized
from earmark.sources import captions, feeds, files, pages

FILES = {
    "a/talk.srt": "1\n00:00:01,000 --> 00:00:03,500\nAnn: Welcome to the show\n\n2\n00:00:04,000 --> 00:00:06,000\n李雷： 谢谢\n大家\n\n3\n00:00:07,000 --> 00:00:08,000\n\n",
    "b/talk.vtt": "WEBVTT\n\n00:01.000 --> 00:04.000 align:start\n<v Ann>Hello there</v>\n\n00:04.000 --> 00:08.000\n<v Bo>Same words</v>\n\n00:08.000 --> 00:10.000\n<v Bo>Same words</v>\n",
    "c/notes.md": "# Title\n[0:05] Bo: first\nloose line\n[1:00:00.5] second\n",
    "d/plain.txt": "# Head\none line\n\nand another\n",
    "e/talk.ass": "[Events]\nDialogue: 0,0:00:01.50,0:00:02.50,Default,Cy,0,0,0,,{\\i1}Yes, and\\Nno\nDialogue: 0,bad\n",
    "f/talk.ttml": '<tt xmlns="http://www.w3.org/ns/ttml"><body><p begin="1.5s" dur="500ms" voice="Di">x <b>y</b> z &amp; w</p><p begin="2s" end="3s"/></body></tt>',
    "g/talk.json3": json.dumps({"events": [{"tStartMs": 1000, "dDurationMs": 2000, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 5000, "segs": [{"utf8": "c"}]}, {"tStartMs": 1}]}),
    "h/talk.json": json.dumps({"transcript": {"utterances": [{"transcript": "hey", "start_ms": 1500, "start": 9, "end": "0:03", "speaker_label": "E"}, {"text": ""}, 5]}}),
    "i/talk.lrc": "00:00:01.000 --> 00:00:02.000\nsniffed\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "a" / "source.json").write_text("{}")
    (root / "a" / "frames").mkdir()
    (root / "a" / "frames" / "1.jpg").write_bytes(b"x")
    (root / "a" / "half.mp3.part").write_bytes(b"y")
    return str(root)


def test_every_format(spark, folder):
    found = files.read_texts(spark, folder).where("path not like '%source.json' and path not like '%part' and path not like '%jpg'")
    rows = captions.parse_files(found).orderBy("episode_id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.episode_id, []).append((r.start_seconds, r.end_seconds, r.speaker, r.text))
    assert got == {
        "a": [(1.0, 3.5, "Ann", "Welcome to the show"), (4.0, 6.0, "李雷", "谢谢 大家")],
        "b": [(1.0, 4.0, "Ann", "Hello there"), (4.0, 8.0, "Bo", "Same words"), (8.0, 10.0, "Bo", "Same words")],
        "c": [(5.0, 3600.5, "Bo", "first"), (3600.5, None, None, "second")],
        "d": [(None, None, None, "one line and another")],
        "e": [(1.5, 2.5, "Cy", "Yes, and no")],
        "f": [(1.5, 2.0, "Di", "x y z & w")],
        "g": [(1.0, 3.0, None, "a b"), (5.0, None, None, "c")],
        "h": [(1.5, 3.0, "E", "hey")],
        "i": [(1.0, 2.0, None, "sniffed")],
    }


def test_normalize_merges_and_numbers(spark, folder):
    cues = captions.parse_files(files.read_texts(spark, folder).where("suffix = '.vtt'"))
    rows = transcripts.normalize(cues, "en").orderBy("segment_id").collect()
    assert [(r.segment_id, r.start, r.end, r.speaker, r.language, r.text) for r in rows] == [
        (1, "00:00:01", "00:00:04", "Ann", "en", "Hello there"), (2, "00:00:04", "00:00:10", "Bo", "en", "Same words")]


def test_rendered_files_read_back(spark, folder, tmp_path):
    cues = captions.parse_files(files.read_texts(spark, folder).where("suffix = '.srt'"))
    segments = transcripts.normalize(cues)
    transcripts.write_rendered(transcripts.render_srt(segments), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.lit("a").alias("episode_id"), F.col("value").alias("text"))
    again = captions.parse_captions(back).select("start_seconds", "end_seconds", "speaker", "text")
    assert again.orderBy("start_seconds").collect() == cues.select("start_seconds", "end_seconds", "speaker", "text").orderBy("start_seconds").collect()


def test_inventory(spark, folder):
    rows = files.inventory(files.read_inventory(spark, folder)).where("episode_id = 'a'").orderBy("path").collect()
    assert [(r.path, r.category) for r in rows] == [("frames/1.jpg", "visual"), ("source.json", "metadata"), ("talk.srt", "transcripts")]


def test_long_untimed_text_is_really_cut(spark):
    text = "".join(f"Sentence number {i} goes here. " for i in range(500))
    df = spark.createDataFrame([("e", 1, text, 0.0, 100.0, None, "s")],
                               "episode_id string, segment_id long, text string, start_seconds double, end_seconds double, start string, speaker string")
    parts = split_oversized(df.withColumn("end", F.lit(None).cast("string")), 500)
    rows = parts.orderBy("part").collect()
    assert len(rows) > 10 and all(len(r.text) <= 500 for r in rows)
    assert " ".join(r.text for r in rows) == text.strip()
    assert rows[0].segment_id == "1.1" and rows[0].start_seconds == 0.0 and abs(rows[-1].end_seconds - 100) < 1e-9
    placed = parts.withColumn("pos", F.col("part") - 1)
    chunks = chunk_rows(placed, chunk_ranges(placed, 500, 300.0, 0)).collect()
    assert len(chunks) == len(rows) and all(c.char_count <= 500 for c in chunks)


def test_feed_fixture(spark):
    rss = """<rss xmlns:podcast="p"><channel><title>Show</title>
      <item><title>One</title><guid>g1</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><enclosure url="/a/1.mp3" type="audio/mpeg"/>
        <podcast:transcript url="t1.vtt"/><link href="e1"/><description><![CDATA[<p>Hi &amp; bye</p>]]></description></item>
      <item><title>Two</title><guid>g2</guid><pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate><enclosure url="x.pdf"/></item></channel></rss>"""
    items = feeds.parse_feeds(spark.createDataFrame([("https://h.example/s/feed.xml", rss)], "feed_url string, text string"))
    a, b = items.orderBy("position").collect()
    assert (a.title, a.guid, a.audio_url, a.transcript_urls, a.episode_url, a.description) == (
        "One", "g1", "https://h.example/a/1.mp3", ["https://h.example/s/t1.vtt"], "https://h.example/s/e1", "Hi & bye")
    assert (b.audio_url, b.episode_url, b.transcript_urls) == (None, None, [])
    assert feeds.latest_items(items).first().guid == "g2"
    asked = spark.createDataFrame([("https://h.example/s/feed.xml", q) for q in ("G1", "o", "zzz", None)], "feed_url string, query string")
    got = {r.query: (r.matches, r.position, r.status) for r in feeds.selection_status(items, asked).collect()}
    assert got == {"G1": (1, 0, "selected"), "o": (2, None, "ambiguous"), "zzz": (0, None, "no_match"), None: (0, None, "open")}


def test_page_fixture(spark):
    html = """<html><head><title>Plain</title><meta content="Shown &amp; told" property="og:title"><meta property="og:audio" content="/a.mp3">
      <link type="application/rss+xml" href="feed.xml"><link href="t.vtt" rel="x"><!-- <audio src="no.mp3"> --></head>
      <body><audio src="/a.mp3"></audio><script>var s='<audio src="no2.mp3">';</script>
      <script type="application/ld+json">{"@type": "Episode", "duration": "PT5M", "contentUrl": "b.mp3"}</script>
      <script type="application/ld+json">{broken</script></body></html>"""
    r = pages.parse_pages(spark.createDataFrame([(1, "https://h.example/e/1", html)], "page_id long, url string, html string")).first()
    assert (r.title, r.duration, r.audio_candidates, r.feed_candidates, r.transcript_candidates) == (
        "Shown & told", "PT5M", ["https://h.example/a.mp3", "https://h.example/e/b.mp3"], ["https://h.example/e/feed.xml"], ["https://h.example/e/t.vtt"])


def test_json_segments_at_any_depth(spark):
    import json

    from earmark.sources import captions

    one, two = [{"start": 1, "text": "one"}], [{"start": 2, "text": "two"}]
    deep = one
    for k in range(20):
        deep = {("segments", "utterances", "cues", "transcript")[k % 4]: deep, "meta": {"cues": two}}
    docs = {"deep": deep, "list": one, "three": {"transcript": {"cues": {"segments": one}}}, "order": {"cues": two, "segments": {"cues": one}},
            "empty": {"segments": [], "cues": two}, "empty inside": {"segments": {"segments": [], "cues": two}, "cues": one},
            "none inside": {"segments": {"x": 1}, "utterances": "said", "cues": {"cues": None}, "transcript": one},
            "many": {"segments": [{"start": i, "text": "w", "transcript": {"cues": []}} for i in range(5000)]}, "scalar": 7}
    files = [(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "{"), ("null", None), ("blank", "")]
    rows = captions.parse_json(spark.createDataFrame(files, "episode_id string, text string")).collect()
    said = {k: [r.text for r in rows if r.episode_id == k] for k, _ in files}
    assert len(said.pop("many")) == 5000
    assert said == {"deep": ["one"], "list": ["one"], "three": ["one"], "order": ["one"], "empty": [], "empty inside": ["one"], "none inside": ["one"],
                    "scalar": [], "broken": [], "null": [], "blank": []}
