"""Cases that once gave a wrong answer, and substring search by automata."""

import json
import random

from pyspark.sql import functions as F

from earmark.functions.urls import unsafe_reason
from earmark.operators import episodes, search
from earmark.operators.substring import containing, found_in
from earmark.sources import feeds, pages


def test_needles_in_texts_as_by_hand(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "a.b*c"]
    needles = ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 5))) for _ in range(80)] + ["", None, ".b*", "zz", "a.b*c"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, body string, needles string")
    wanted = spark.createDataFrame([(n,) for n in [*needles, *needles]], "n string")
    want = sorted((i, n) for i, t in enumerate(texts) for n in {x for x in needles if x} if t and n in t)
    for size in (1 << 19, 40):  # one automaton, and several
        got = found_in(rows, "body", wanted, "n", needle_chars=size)
        assert got.columns == ["id", "body", "needles", "needle"]
        assert sorted((r.id, r.needle) for r in got.collect()) == want
    pairs = containing(rows, "body", wanted, "n").collect()
    assert sorted((r.text, r.needle) for r in pairs) == sorted({(texts[i], n) for i, n in want})
    assert found_in(rows, "body", wanted.limit(0), "n").collect() == []
    assert found_in(rows.limit(0), "body", wanted, "n").collect() == []
    plan = found_in(rows, "body", wanted, "n")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_only_direct_children_of_a_feed_item(spark):
    text = """<rss><channel><item>
      <media:group><media:title>inner</media:title><media:description>no</media:description></media:group>
      <source url="u"><title>s</title><guid>g0</guid></source>
      <title>Own</title><guid isPermaLink="false">own</guid>
      <description><![CDATA[<p>About <title>it</title></p>]]></description>
      <enclosure url="a.mp3" type="audio/mpeg"/></item>
      <item><title/><title>Second</title><guid>2</guid><enclosure url="b.mp3" type="audio/mpeg"></enclosure></item></channel></rss>"""
    got = feeds.parse_feeds(spark.createDataFrame([("https://h/f.rss", text)], "feed_url string, text string")).orderBy("position").collect()
    assert [(r.title, r.guid, r.audio_url) for r in got] == [("Own", "own", "https://h/a.mp3"), ("Second", "2", "https://h/b.mp3")]
    assert got[0].description.startswith("About")


def test_json_ld_in_comments_and_other_scripts_does_not_count(spark):
    node = '<script type="application/ld+json">{"@type":"PodcastEpisode","name":"%s"}</script>'
    html = f"<!-- {node % 'ghost'} --><script>var a = '{node % 'text'}'</script>{node % 'one'}<script>// <!-- </script>{node % 'two'}"
    html = html.replace("</script>'", "'", 1)
    rows = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.name for r in pages.jsonld_nodes(rows).orderBy("path").collect()] == ["one", "two"]


def test_mapped_addresses_follow_the_ipv4_rule(spark):
    cases = {"http://[::ffff:8.8.8.8]/": None, "http://[::ffff:808:808]/": None, "http://[::ffff:10.0.0.1]/": "private_address",
             "http://[::ffff:7f00:1]/": "private_address", "http://[::ffff:c0a8:1]/": "private_address", "http://[::127.0.0.1]/": "private_address",
             "http://[::1]/": "private_address", "http://8.8.8.8/": None, "http://[0:0:0:0:0:ffff:a00:1]/": "private_address"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", unsafe_reason(F.col("u")).alias("why")).collect()
    assert {r.u: r.why for r in rows} == cases


def test_shared_json_keeps_every_character(spark):
    values = [" private use", "back\\slash", "a\\/b", "\\u0041", "dollar $1", "café", "quote \" and \\\" more", "tab\t"]
    texts = [json.dumps({"v": v}) for v in values] + [json.dumps({"v": v}, ensure_ascii=False) for v in values]
    texts += [r'{"v":"A$/\/x"}', r'{"v":"\\A\\u0041"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", episodes.sanitize_json(F.col("t")).alias("safe"), episodes.plain_escapes(F.col("t")).alias("plain")).collect():
        assert json.loads(r.plain) == json.loads(r.t) == json.loads(r.safe)
    hidden = spark.createDataFrame([(r'{"u":"https:\/\/h\/x?token=SECRET"}',)], "t string")
    assert "SECRET" not in hidden.select(episodes.sanitize_json(F.col("t"))).first()[0]


def test_questions_without_a_hit_are_low(spark):
    hits = spark.createDataFrame([(1, 1, 9.0), (1, 2, 2.0)], "query_id int, rank int, score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r.query_id: r.confidence for r in search.confidence(hits, asked).collect()} == {1: "high", 2: "low"}
