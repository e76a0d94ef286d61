"""Column functions on small hand-worked values."""

import pytest
from pyspark.sql import functions as F

from earmark.functions import text, times, urls


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize("value,expected", [
    ("1:02:03.5", 3723.5), ("02:03,5", 123.5), ("90", 90.0), ("1500ms", 1.5), ("1.5s", 1.5), ("x", None), ("", None), ("1:2:3:4", None)])
def test_to_seconds(spark, value, expected):
    assert one(spark, times.to_seconds(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,expected", [("00:01:02", 62.0), ("1:02.5", 62.5), ("62", None), ("a:b", None)])
def test_stamp_seconds(spark, value, expected):
    assert one(spark, times.stamp_seconds(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,short,long", [
    (3723.4567, "01:02:03", "01:02:03,457"), (0.9996, "00:00:00", "00:00:01,000"), (-3.0, "00:00:00", "00:00:00,000"),
    (360000.0, "100:00:00", "100:00:00,000")])
def test_clock(spark, value, short, long):
    assert one(spark, times.clock(F.col("v")), v=value) == short
    assert one(spark, times.clock_ms(F.col("v"), ","), v=value) == long


@pytest.mark.parametrize("value,expected", [
    ("Tue, 02 Jan 2024 03:04:05 GMT", 1704164645), ("2 Jan 2024 03:04:05 +0100", 1704161045), ("2 Jan 2024 03:04", 1704164640),
    ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02 03:04:05", 1704164645), ("soon", None)])
def test_published(spark, value, expected):
    assert one(spark, F.unix_seconds(times.published_at(F.col("v"))), v=value) == expected


@pytest.mark.parametrize("value,expected", [
    ("a &amp;lt; b", "a &lt; b"), ("&#39;x&#x27; &lt;i&gt;y", "'x' y"), ("<c.yellow>hi</c> <b>you</b>", "hi you"),
    (" a　​b﻿ ", "a b"), ("caf&eacute; &#233;", "café é")])
def test_clean_text(spark, value, expected):
    assert one(spark, text.clean_text(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,speaker,said", [
    ("<v.loud Ann Lee>Hello <i>there</i></v>", "Ann Lee", "Hello there"), ("李雷： 你好", "李雷", "你好"), ("Ann: hi", "Ann", "hi"),
    ("at 10:30 we met", None, "at 10:30 we met"), ("a b c d e f g h i: no", None, "a b c d e f g h i: no")])
def test_speaker(spark, value, speaker, said):
    row = one(spark, text.speaker_and_text(F.col("v")), v=value)
    assert (row.speaker, row.text) == (speaker, said)


@pytest.mark.parametrize("value,expected", [
    ("Spark C++ x spark", ["spark", "c++"]), ("人工智能", ["人工", "工智", "智能", "人工智能"]), ("我", ["我"]),
    ("机器学习模型 ab", ["ab", "机器", "器学", "学习", "习模", "模型"])])
def test_query_terms(spark, value, expected):
    assert one(spark, text.query_terms(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,expected", [
    ("嗯 " * 40, 40), ("45,000,000" * 12, 120), ("all quiet here", 0), ("ab" * 7, 0), ("ab" * 8, 16), ("x" * 11, 0)])
def test_longest_repeat(spark, value, expected):
    assert one(spark, text.longest_repeat(F.col("v")), v=value) == expected


def test_flattening(spark):
    row = spark.sql("select named_struct('start','00:01','end','00:02','label','x') a, named_struct('start','00:01','end','00:01','label','') b,"
                    " array('p', null, 'q') l, true t")
    got = row.select(text.flat_span(F.col("a")), text.flat_span(F.col("b")), text.flat_list(F.col("l")), text.flat_bool(F.col("t"))).first()
    assert list(got) == ["00:01–00:02 (x)", "00:01", "p; ; q", "true"]


@pytest.mark.parametrize("a,b", [
    ("https://youtu.be/abc?si=1", "https://youtu.be/abc"), ("https://www.youtube.com/watch?v=a&utm_source=x&t=9", "HTTPS://www.youtube.com/watch?v=a"),
    ("https://www.bilibili.com/video/BV1/?p=2&spm=1", "https://www.bilibili.com/video/BV1?p=2"),
    ("https://a.example/x/?utm_campaign=1&k=2&fbclid=3#f", "https://a.example/x?k=2")])
def test_same_source_key(spark, a, b):
    assert one(spark, urls.source_key(F.col("v")), v=a) == one(spark, urls.source_key(F.col("v")), v=b)


def test_sanitized_urls(spark):
    u = "https://me:pw@H.example:8080/a?token=s3cret&q=a%20b&Signature=x#frag"
    assert one(spark, urls.sanitize_url(F.col("v")), v=u) == "https://h.example:8080/a?token=%5BREDACTED%5D&q=a+b&Signature=%5BREDACTED%5D"
    assert one(spark, urls.sanitize_url(F.col("v"), strip_query=True), v=u) == "https://h.example:8080/a"
    assert one(spark, urls.sanitize_url(F.col("v")), v="/local/file") == "/local/file"


@pytest.mark.parametrize("value,expected", [
    ("https://www.youtube.com/watch?v=a&t=3", "https://www.youtube.com/watch?v=a&t=90s"), ("https://www.bilibili.com/video/BV1", "https://www.bilibili.com/video/BV1?t=90"),
    ("https://a.example/e?x=1", "https://a.example/e?x=1#t=90"), ("/data/x.mp3", None)])
def test_seek(spark, value, expected):
    assert one(spark, urls.seek_url(F.col("v"), F.lit(90.6)), v=value) == expected


@pytest.mark.parametrize("base,link,expected", [
    ("https://a.example/x/y?q=1#f", "z.mp3", "https://a.example/x/z.mp3"), ("https://a.example/x/y", "../z", "https://a.example/z"),
    ("https://a.example", "z", "https://a.example/z"), ("https://a.example/x/", "/r?k=1", "https://a.example/r?k=1"),
    ("https://a.example/x/y?q", "?k=2", "https://a.example/x/y?k=2"), ("https://a.example/x", "//b.example/c", "https://b.example/c"),
    ("https://a.example/x", "mailto:me", "mailto:me"), ("https://a.example/x/y", "./w/../v", "https://a.example/x/v")])
def test_absolute_url(spark, base, link, expected):
    assert one(spark, urls.absolute_url(F.col("b"), F.col("l")), b=base, l=link) == expected


@pytest.mark.parametrize("value,expected", [
    ("ftp://x", "scheme"), ("http://u:p@h/", "credentials"), ("http://localhost/", "loopback_name"), ("http://172.20.0.1/", "private_address"),
    ("http://172.32.0.1/", None), ("http://[::1]/", "private_address"), ("https:///x", "no_host"), ("https://a.example/", None)])
def test_unsafe(spark, value, expected):
    assert one(spark, urls.unsafe_reason(F.col("v")), v=value) == expected


def test_names(spark):
    assert one(spark, text.slug(F.col("v")), v=' A/b: "c" d. ') == "A-b---c--d"
    assert one(spark, text.language_slug(F.col("v")), v="zh Hans!") == "zh-Hans"
    assert one(spark, text.redact_paths(F.col("v"), F.lit("/home/me/show")), v="see /home/me/show/a.md and /Users/x/b") == "see ./a.md and [LOCAL_PATH_REDACTED]"
