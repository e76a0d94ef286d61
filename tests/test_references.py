"""Character references, long cue blocks, deep JSON-LD, queries without hits, episodes without segments."""

import html
import json

from pyspark.sql import functions as F

from earmark.functions.text import unescape
from earmark.operators import search, transcripts
from earmark.sources import captions, pages


def test_references_resolve_as_in_html(spark):
    texts = ["&Eacute; &frac12; &sup2; &AMP;lt; &lt;", "&#39 &#0000039; x", "&#146; &#x81; &#0; &#xD800; &#99999999999; &#x10FFFF; &#1;a",
             "&amp;amp; &#38;amp; &notit; &notin; &bogus; & &; &#; a&", "", "&nbsp;&copy2024 &#x1F600;&NotEqualTilde;", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(unescape(F.col("x")).alias("u"))
    assert [r.u for r in rows.collect()] == [html.unescape(t) for t in texts]
    assert spark.createDataFrame([(None,)], "x string").select(unescape(F.col("x"))).first()[0] is None


def test_a_cue_of_many_lines(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n" + "word\n" * 100_000 + "\n2\n00:00:03,000 --> 00:00:04,000\nend\n"
    rows = captions.parse_captions(spark.createDataFrame([("e", text)], "episode_id string, text string")).orderBy("pos").collect()
    assert [len(r.text) for r in rows] == [499_999, 3]


def test_json_ld_of_any_depth(spark):
    node = {"@type": "PodcastEpisode", "name": "deep"}
    for i in range(20):
        node = {"part": node} if i % 2 else [node]
    body = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    found = pages.jsonld_nodes(spark.createDataFrame([("p", body), ("q", "<p>none</p>")], "page_id string, html string")).collect()
    assert [(r.page_id, r.name, len(r.path)) for r in found] == [("p", "deep", 21)]


def test_queries_without_hits_are_low(spark):
    hits = spark.createDataFrame([("a", 1, 9.0)], "query_id string, rank int, score double")
    asked = spark.createDataFrame([("a",), ("b",)], "query_id string")
    assert {tuple(r) for r in search.confidence(hits, asked).collect()} == {("a", "high"), ("b", "low")}


def test_episodes_without_segments_fail(spark):
    kinds = "episode_id string, start_seconds double, end_seconds double, confidence double, text string"
    segments = spark.createDataFrame([("a", 0.0, 1.0, 0.9, "some words here")], kinds)
    episodes = spark.createDataFrame([("a",), ("b",), ("b",)], "episode_id string")
    found = {r.episode_id: (r.status, r.score, r.errors, r.warnings) for r in transcripts.quality(segments, episodes).collect()}
    assert found == {"a": ("pass", 100, [], []), "b": ("fail", 0, ["no_segments"], [])}
