"""Escaped addresses, odd hosts, inner steps and dates without a zone."""

import json

from pyspark.sql import functions as F

from earmark.functions.times import published_at
from earmark.functions.urls import unsafe_reason
from earmark.operators import episodes


def test_escaped_addresses_lose_their_token(spark):
    texts = [r'{"u": "https:\/\/h\/x?token=SECRET&a=1"}', r'{"u": "https://h/x?a=1\u0026token=SECRET"}', r'{"u": "https://h/x?\u0074oken=SECRET"}']
    kept = r'{"a": "c:\\u0026 \\/ \u0022q\u005c \u00e9"}'
    rows = spark.createDataFrame([(t,) for t in [*texts, kept]], "t string").select(episodes.sanitize_json(F.col("t")).alias("s")).collect()
    assert not any("SECRET" in r.s for r in rows[:3]) and all(json.loads(r.s)["u"].startswith("https://h/x") for r in rows[:3])
    assert json.loads(rows[3].s) == json.loads(kept)


def test_addresses_with_other_characters_lose_their_token(spark):
    texts = [r'{"u": "https://h/caf\u00e9?token=SECRET"}', r'{"u": "https://h/x\"y?token=SECRET"}', r'{"u": "https://h/x?token=SECRET and more"}',
             r'{"u": "https://h/a\\b?token=SECRET\n"}', '{"u": "https://h/caf\u00e9 x?a=1&token=SECRET"}']
    kept = r'{"a": "say \"https://h/x\" \u00e9", "b": ["https://h/x", "no"]}'
    rows = spark.createDataFrame([(t,) for t in [*texts, kept]], "t string").select(episodes.sanitize_json(F.col("t")).alias("s")).collect()
    assert not any("SECRET" in r.s for r in rows) and all(json.loads(r.s)["u"].startswith("https://h/") for r in rows[:-1])
    assert json.loads(rows[-1].s) == json.loads(kept)


def test_steps_that_stay_inside(spark):
    paths = ["frames/../a.md", "../a.md", "a/../../b", "a/./b/../..", "/x", "C:/x"]
    listed = spark.createDataFrame([("e", p) for p in paths], "episode_id string, path string")
    out = episodes.dangling_artifacts(listed, listed).where("problem = 'escapes_episode'").collect()
    assert {r.path for r in out} == {"../a.md", "a/../../b", "/x", "C:/x"}


def test_hosts_that_hide_an_address(spark):
    bad = ["http://[::ffff:10.0.0.1]/", "http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://127.0.0.1/"]
    good = ["http://example.com/", "http://8.8.8.8/", "http://1.example.com/"]
    out = spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", unsafe_reason(F.col("u")).alias("r")).collect()
    assert {r.u for r in out if r.r == "private_address"} == set(bad) and {r.u for r in out if r.r is None} == set(good)


def test_dates_without_a_zone_are_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        texts = ["2024-03-01", "2024-03-01T10:00:00", "2024-03-01 10:00:00+01:00", "2024-03-01T10:00:00Z"]
        out = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(published_at(F.col("t")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in out] == [1709251200, 1709287200, 1709283600, 1709287200]
