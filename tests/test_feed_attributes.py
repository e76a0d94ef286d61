"""Attributes of a feed's tags are looked for once each."""

from earmark.sources import feeds


def test_an_attribute_is_looked_for_once(spark):
    """Each attribute took three searches, and the link of a tag was worked out for each of its uses."""
    text = ("<rss><channel><item><title type='x'>T &amp; <b>U</b></title><a:GUID>g</a:GUID><empty/><link href='p?a=1&amp;b=2'/>"
            '<enclosure url="a.mp3" type=audio/mpeg /><enclosure href="" url="n.pdf"/><description/></item></channel></rss>')
    rows = feeds.parse_feeds(spark.createDataFrame([("https://x.example/s/feed.xml", text)], "feed_url string, text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("href\\s*=") == 1 and plan.count("type\\s*=") == 1
    r = rows.first()
    assert (r.title, r.guid, r.episode_url, r.audio_url) == ("T & U", "g", "https://x.example/s/p?a=1&b=2", "https://x.example/s/a.mp3")
