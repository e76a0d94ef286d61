"""Costly steps stand once in a plan, however often their value is used."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from earmark.functions import fixed
from earmark.functions.text import speaker_and_text, unescape
from earmark.functions.times import to_seconds


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_caption_text_is_cleaned_once(spark):
    """A cue's text was cleaned for its speaker, for its length and for each use of its name."""
    rows = spark.createDataFrame([("Ann: hello &amp; <b>bye</b>",), ("<v Bob>so</v>",), ("a:b",), (None,)], "t string")
    said = rows.select(speaker_and_text(F.col("t")).alias("s")).select("s.*")
    # The two parts of a voice tag, and the text of all others.
    assert planned(said).count(fixed.CLASS_TAG) <= 3
    assert [tuple(r) for r in said.collect()] == [("Ann", "hello & bye"), ("Bob", "so"), (None, "a:b"), (None, None)]


def test_a_clock_is_stripped_once(spark):
    times = spark.createDataFrame([("1:02:03,5",), ("90",), (" 1500ms ",), ("1.5s",), ("x",), (None,)], "t string").select(to_seconds(F.col("t")).alias("s"))
    assert planned(times).count("\\x1c-\\x1f]+$") <= 1
    assert [r.s for r in times.collect()] == [3723.5, 90.0, 1.5, 1.5, None, None]


def test_all_names_are_resolved_without_a_map_in_each_task(spark):
    texts = [f"a &{name}{more} b" for name in html5 for more in ("", "x")] + ["&", "&;", "&zz;", "&amp;lt;", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u"))
    assert "CounterClockwiseContourIntegral;," not in planned(got)
    assert all(r.u == html.unescape(r.t) for r in got.collect())
