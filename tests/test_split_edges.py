"""Long texts with white space at the edges of hard cuts are packed as by a plain loop."""

import re

from pyspark.sql import functions as F

from earmark.functions import fixed
from earmark.operators.chunking import split_oversized


def plain(text, limit):
    strip = lambda s: s.strip(" \t\n\r")
    units = [s[i:i + limit] for s in (strip(x) for x in re.split(fixed.SENTENCE_BREAK.replace("(?U)", ""), strip(text))) if s for i in range(0, len(s), limit)]
    done, now = [], ""
    for unit in units:
        joined = strip(f"{now} {unit}")
        if now and len(joined) > limit:
            done, now = [*done, now], unit
        else:
            now = joined
    return [*done, now] if now else done


def test_edges(spark):
    texts = ["one two. " * 30, ("x" * 19 + " ") * 9, " " * 3 + "y " * 70 + "\t", "a" * 20 + " " * 45 + "b" * 20, ("word" * 6 + " ") * 8 + ". end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "episode_id int, text string").select(
        "episode_id", F.lit(1).cast("long").alias("segment_id"), "text", F.lit(0.0).alias("start_seconds"), F.lit(9.0).alias("end_seconds"),
        F.lit("").alias("start"), F.lit("").alias("end"))
    got = {}
    for r in split_oversized(rows, 20).orderBy("episode_id", "part").collect():
        got.setdefault(r.episode_id, []).append(r.text)
    assert got == {i: plain(t, 20) for i, t in enumerate(texts)}
