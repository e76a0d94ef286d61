"""Block-wise folds must equal a plain loop over each episode."""

import random

import pytest

from earmark.operators.captions import merge_captions
from earmark.operators.chunking import chunk_ranges, split_oversized, transcript_chunks
from earmark.operators.ordered import neighbours, position_block, scan
from pyspark.sql import functions as F


def plain_chunks(segments, max_chars, max_seconds, overlap):
    groups, current = [], []
    for s in segments:
        if current:
            until = s["end"] or s["start"]
            late = current[0]["start"] is not None and until is not None and until - current[0]["start"] > max_seconds
            if late or sum(x["chars"] for x in current) + s["chars"] > max_chars:
                groups.append(current)
                current = current[-overlap:] if overlap else []
                while current and sum(x["chars"] for x in current) + s["chars"] > max_chars:
                    current = current[1:]
        current = [*current, s]
    return [(g[0]["pos"], g[-1]["pos"]) for g in [*groups, current]]


@pytest.fixture(scope="module")
def timed(spark):
    rng, rows, episodes = random.Random(3), [], {}
    for episode, n in enumerate([1, 5, 700, 2000, 37, 3000]):
        t, segments = 0.0, []
        for pos in range(n):
            chars, length = rng.choice([1, 5, 9, 20, 33, 50]), rng.choice([0.5, 1.0, 3.0, 20.0])
            start = None if rng.random() < 0.05 else t
            end = None if rng.random() < 0.1 else t + length
            t += length
            segments.append({"pos": pos, "chars": chars, "start": start, "end": end})
            rows.append((str(episode), pos, "x" * chars, start, end))
        episodes[str(episode)] = segments
    schema = "episode_id string, pos long, text string, start_seconds double, end_seconds double"
    return spark.createDataFrame(rows, schema), episodes


@pytest.mark.parametrize("size,fan,overlap", [(60, 3, 2), (100, 2, 0), (32768, 1024, 2)])
def test_chunks_do_not_depend_on_node_size(timed, size, fan, overlap):
    df, episodes = timed
    found = {}
    for r in sorted(chunk_ranges(df, 50, 40.0, overlap, size=size, fan=fan).collect()):
        found.setdefault(r.episode_id, []).append((r.chunk_id, r.first_pos, r.last_pos))
    for episode, segments in episodes.items():
        assert [x[0] for x in found[episode]] == list(range(len(found[episode])))
        assert [x[1:] for x in found[episode]] == plain_chunks(segments, 50, 40.0, overlap)


def test_whole_transcripts_are_chunked_in_one_call(spark):
    rng, rows = random.Random(8), []
    for episode in ("one", "two", None):
        for i in range(0, 300, 3):  # numbers have gaps
            text = rng.choice([None, "", " \n", "short words", "A sentence here. " * rng.randint(1, 12), "x" * rng.choice([59, 60, 61, 500])])
            rows.append((episode, i, text, rng.choice(["A", None]), float(i), i + 2.5))
    df = spark.createDataFrame(rows, "episode_id string, segment_id long, text string, speaker string, start_seconds double, end_seconds double")
    got = sorted(transcript_chunks(df.where("episode_id IS NOT NULL"), 60, 40.0, 2).collect(), key=lambda r: (r.episode_id, r.chunk_id))
    parts = split_oversized(df.where("trim(translate(text, '\n', ' ')) <> ''"), 60).collect()
    for episode in ("one", "two"):
        own = sorted((p for p in parts if p.episode_id == episode), key=lambda p: (p.source_segment_id, p.part))
        assert all(0 < len(p.text.strip()) <= 60 for p in own) and any(p.part > 3 for p in own)
        plain = plain_chunks([{"pos": i, "chars": len(p.text), "start": p.start_seconds, "end": p.end_seconds} for i, p in enumerate(own)], 60, 40.0, 2)
        assert [(r.segment_ids, r.text) for r in got if r.episode_id == episode] == [
            ([p.segment_id for p in own[a:b + 1]], " ".join(p.text.strip() for p in own[a:b + 1])) for a, b in plain]
    assert transcript_chunks(df.limit(0)).count() == 0


def plain_merge(cues):
    kept = []
    for cue in cues:
        cue = {**cue, "n": 1}
        if kept and cue["text"].startswith(kept[-1]["text"]) and cue["speaker"] == kept[-1]["speaker"]:
            repeat, end = cue["text"] == kept[-1]["text"], kept[-1]["end"]
            if end is None or cue["start"] is None or cue["start"] <= end + (2 if repeat else 1):
                kept[-1]["text"], kept[-1]["n"] = cue["text"], kept[-1]["n"] + 1
                kept[-1]["end"] = end if cue["end"] is None else cue["end"]
                continue
        kept.append(cue)
    return [(k["pos"], k["text"], k["speaker"], k["start"], k["end"], k["n"]) for k in kept]


@pytest.mark.parametrize("size", [4, 7, 32768])
def test_caption_merge_does_not_depend_on_block_size(spark, size):
    rng, rows, expected = random.Random(11), [], {}
    for episode in range(40):
        t, cues = 0.0, []
        for pos in range(rng.choice([1, 10, 60])):
            text = "abcdefgh"[: rng.choice([1, 1, 1, 2, 2, 3])]
            speaker = rng.choice(["A", "A", "A", None]) if episode % 2 else None
            t += rng.choice([0, 0, 0.5, 1, 1.5, 2, 2.5])
            start = None if rng.random() < 0.1 else t
            end = None if rng.random() < (0.5 if episode % 3 else 0.1) else t + 0.5
            t += 0.5
            cues.append({"pos": pos, "text": text, "speaker": speaker, "start": start, "end": end})
            rows.append((str(episode), pos, text, speaker, start, end))
        expected[str(episode)] = plain_merge(cues)
    df = spark.createDataFrame(
        rows, "episode_id string, pos long, text string, speaker string, start_seconds double, end_seconds double")
    found = {}
    for r in sorted(merge_captions(df, size).collect(), key=lambda r: (r.episode_id, r.pos)):
        found.setdefault(r.episode_id, []).append((r.pos, r.text, r.speaker, r.start_seconds, r.end_seconds, r.merged_rows))
    assert found == expected


@pytest.mark.parametrize("size", [3, 1000])
def test_scan_equals_plain_running_values(spark, size):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, 1, 2, 3])) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    v = F.col("v")
    out = scan(df, ["g"], ["i"], position_block("i", size), lag={"back": v}, lead={"ahead": v},
               total={"total": v}, highest={"high": v}, latest={"last": v})
    near = {(r.g, r.i): (r.b, r.a) for r in neighbours(df, ["g"], "i", lag={"b": v}, lead={"a": v}, size=size).collect()}
    for r in out.collect():
        values = [x[2] for x in rows if x[0] == r.g]
        before = [x for x in values[: r.i] if x is not None]
        assert r.total == (sum(before) if before else None)
        assert r.high == max(before, default=None) and r.last == (before[-1] if before else None)
        assert r.back == (values[r.i - 1] if r.i else None) == near[(r.g, r.i)][0]
        assert r.ahead == (values[r.i + 1] if r.i + 1 < 50 else None) == near[(r.g, r.i)][1]
