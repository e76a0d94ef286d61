"""Repeated spans where one run's end is the next one's beginning, against a plain loop."""

import random
import time

from pyspark.sql import functions as F

from earmark.functions.text import longest_repeat
from earmark.operators import transcripts


def plain(text):
    best = 0
    for width in range(1, 13):
        run = 0
        for i in range(width, len(text) + 1):
            run = run + 1 if i < len(text) and text[i] == text[i - width] else 0
            span = (run + width) // width * width
            if span >= (12 if width == 1 else 8 * width):
                best = max(best, span)
    return best


def test_a_run_keeps_the_characters_it_shares_with_the_one_before(spark):
    rng = random.Random(3)
    texts = ["of" * 44 + "ofthheonea" * 44, "ab" * 8 + "acadacad" + "bc" * 9, "abcdefghij" * 8 + "jabcdefghi" * 8 + "j" * 11, "xy" * 8 + "yz" * 9, "ab" * 8 + "a" + "ca" * 8 + "c"]
    units = ["ab", "ba", "aab", "ab\U0001f600", "b", "\U0001f600"]
    texts += ["".join(rng.choice(units) * rng.randint(1, 13) for _ in range(6)) for _ in range(300)]
    texts += ["ab" * 8 + x + "bc" * n for x in ("", "a", "b") for n in (7, 8, 9)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(rows.select("i", longest_repeat(F.col("text")).alias("span")).collect())
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_long_runs_of_any_character_are_looked_at_once(spark):
    began = time.monotonic()
    rows = spark.createDataFrame([("\U0001f600" * 20_000,), ("ab" * 10_000,)], "text string")
    assert [r[0] for r in rows.select(longest_repeat(F.col("text"))).collect()] == [20_000, 20_000]
    assert time.monotonic() - began < 30


def test_spans_begin_at_any_place(spark):
    """The test of every fifth place loses no run, of any width and wherever it begins, and lets texts without one go at once."""
    unit = "abcdéf𝄞hijkl"
    texts = [("zyxwvutsrq"[:lead] + unit[:w] * n + tail, (w * n if n >= (12 if w == 1 else 8) else 0))
             for w in range(1, 13) for n in (7, 8, 12) for lead in range(8) for tail in ("", "!?")]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")
    got = dict(rows.select("i", longest_repeat(F.col("text")).alias("span")).collect())
    assert [got[i] for i in range(len(texts))] == [span for _, span in texts]
    plan = rows.select(longest_repeat(F.col("text")))._jdf.queryExecution().toString()
    assert r"\A(?:.{5})*?(.{1,12}?)\1{3}" in plan


def test_quality_folds_each_text_once(spark):
    rows = [("a", 0.0, 1.0, None, x) for x in ("ho " * 7, " HO ho  \x1cHo ho ho ho ho ho hey", "ha " * 8 + "hum hey", "", "ab" * 16, "A b " * 8)]
    df = spark.createDataFrame(rows + [("b", 0.0, 1.0, None, "ho " * 7), ("b", 0.0, 1.0, None, "a b c d e f g a b")],
                               "episode_id string, start_seconds double, end_seconds double, confidence double, text string")
    out = transcripts.quality(df)
    got = {r.episode_id: (r.words, r.characters, r.warnings, r.pathological_segments, r.max_repeated_span) for r in out.collect()}
    assert got == {"a": (7 + 9 + 10 + 0 + 1 + 16, 20 + 27 + 31 + 0 + 32 + 31, ["repeated_tokens", "repeated_pattern"], 1, 32), "b": (16, 37, [], 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
