"""Retrieval chunks: oversized splits, bounded overlapping chunks, chunk rows.

The chunker is greedy, so where a chunk starts depends on every chunk before
it. To keep one long episode from running in one task, episodes are cut into
nodes of ``size`` segments. A chunk's state is (first segment, first segment
that may not be flushed); from any state the next one follows from a few
thousand segments ahead at most. So each node can say, for the few states that
may enter it, which state leaves it. These maps are composed ``fan`` nodes at a
time, the whole-episode walk only sees composed nodes, and the found entry
states are handed back down. Only segment lengths and times reach Python; texts
are put together by joins and aggregates.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from earmark.functions import fixed
from earmark.functions.text import keyword_tokens, let, search_text, strip
from earmark.functions.times import clock, end_or_start
from earmark.operators.ordered import position_block, scan
from earmark.session import materialize

# Executors need not have this package installed: the group functions below are
# sent with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = 32768
FAN = 1024


def split_oversized(segments: DataFrame, max_chars: int = fixed.MAX_CHARS) -> DataFrame:
    """Cut texts longer than ``max_chars`` at sentences, then hard, and repack.

    Parts are named ``n.1``, ``n.2``, …; their times are shared out by length.
    Adds ``source_segment_id`` and ``part`` (0 where a segment was left whole).
    """
    text = strip(F.col("text"))
    sentences = F.filter(F.transform(F.split(text, fixed.SENTENCE_BREAK), strip), lambda s: s != "")
    units = F.flatten(F.transform(sentences, lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_chars).cast("int")),
        lambda i: F.substring(s, i * max_chars + 1, F.lit(max_chars)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def trimmed(joined: Column) -> Column:
        # Nearly all are trimmed already; their two edges say so without a search of the whole text.
        edges = F.concat(F.substring(joined, 1, 1), F.substring(joined, -1, 1))
        return F.when(F.regexp_like(edges, F.lit(f"(?U){fixed.WS}")), strip(joined)).otherwise(joined)

    def pack(state: Column, unit: Column) -> Column:
        def added(joined: Column) -> Column:
            full = (state["open"] != "") & (F.length(joined) > max_chars)
            return F.when(full, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), unit.alias("open"))).otherwise(
                F.struct(state["done"].alias("done"), joined.alias("open")))

        return let(let(F.concat(state["open"], F.lit(" "), unit), trimmed), added)

    parts = F.aggregate(units, empty, pack, lambda s: F.when(
        s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    big = F.length(text) > max_chars
    lengths = F.transform(F.col("_parts"), lambda p: F.length(p))
    rows = segments.withColumn("_parts", F.when(big, parts))
    add = lambda a, b: a + b
    rows = rows.withColumn("_all", F.greatest(F.lit(1), F.aggregate(lengths, F.lit(0), add)))
    keep = [c for c in segments.columns if c not in ("segment_id", "start", "end", "start_seconds", "end_seconds", "text")]
    rows = rows.select(
        *keep, "segment_id", "start_seconds", "end_seconds", "_parts", "_all", F.col("text").alias("_text"),
        F.posexplode(F.coalesce("_parts", F.array("text"))).alias("_i", "_part"))
    split = F.col("_parts").isNotNull()
    used = F.aggregate(F.transform(F.slice("_parts", F.lit(1), F.col("_i")), lambda p: F.length(p)), F.lit(0), add)
    span = F.col("end_seconds") - F.col("start_seconds")
    shared = split & (span > 0)
    part_at = lambda n: F.col("start_seconds") + span * n / F.col("_all")
    rows = rows.select(
        *keep,
        F.when(split, F.concat(F.col("segment_id").cast("string"), F.lit("."), F.col("_i") + 1))
        .otherwise(F.col("segment_id").cast("string")).alias("segment_id"),
        F.col("segment_id").cast("long").alias("source_segment_id"),
        F.when(split, F.col("_i") + 1).otherwise(F.lit(0)).cast("long").alias("part"),
        F.when(shared, part_at(used)).otherwise(F.col("start_seconds")).alias("start_seconds"),
        F.when(shared, part_at(used + F.length("_part"))).otherwise(F.col("end_seconds")).alias("end_seconds"),
        F.col("_part").alias("text"))
    return rows.withColumns({"start": clock(F.col("start_seconds")), "end": clock(F.col("end_seconds"))})


class _Walker:
    """Follows chunk states over a run of segments held as plain lists."""

    def __init__(self, table: pa.Table, limits: tuple[int, float, int]) -> None:
        table = table.sort_by("pos")
        self.first = table["pos"][0].as_py()
        self.chars = table["chars"].to_pylist()
        self.starts = table["starts_at"].to_pylist()
        self.ends = table["ends_at"].to_pylist()
        self.stop = self.first + len(self.chars)
        self.max_chars, self.max_seconds, self.overlap = limits

    def flush(self, begin: int, sure: int) -> int | None:
        """First segment after ``sure`` that does not fit a chunk from ``begin``."""
        o = self.first
        size, t0 = sum(self.chars[begin - o: sure + 1 - o]), self.starts[begin - o]
        for k in range(sure + 1, self.stop):
            size += self.chars[k - o]
            t1 = self.ends[k - o]
            if size > self.max_chars or (t0 is not None and t1 is not None and t1 - t0 > self.max_seconds):
                return k
        return None

    def carry(self, begin: int, at: int) -> int:
        """Where the chunk flushed before ``at`` hands over to the next one."""
        o = self.first
        begin = max(begin, at - self.overlap)
        size = sum(self.chars[begin - o: at + 1 - o])
        while begin < at and size > self.max_chars:
            size -= self.chars[begin - o]
            begin += 1
        return begin


def _compose(maps: dict[tuple[int, int], tuple], state: tuple[int, int]) -> tuple:
    """Follow state maps until they lead out; ``(begin, sure, chunks)``."""
    chunks, here = 0, state
    while here in maps:
        begin, sure, n = maps[here]
        chunks += n
        if begin is None:
            return None, None, chunks
        here = (begin, sure)
    return (*here, chunks)


_MAP = "episode_id string, node long, begin long, sure long, to_begin long, to_sure long, chunks long"
_MAP_ARROW = pa.schema([("episode_id", pa.string()), ("node", pa.int64()), ("begin", pa.int64()), ("sure", pa.int64()),
                        ("to_begin", pa.int64()), ("to_sure", pa.int64()), ("chunks", pa.int64())])
_ENTRY = "episode_id string, node long, begin long, sure long, chunk_id long"
_ENTRY_ARROW = pa.schema([("episode_id", pa.string()), ("node", pa.int64()), ("begin", pa.int64()),
                          ("sure", pa.int64()), ("chunk_id", pa.int64())])
_RANGE = "episode_id string, chunk_id long, first_pos long, last_pos long"
_RANGE_ARROW = pa.schema([("episode_id", pa.string()), ("chunk_id", pa.int64()),
                          ("first_pos", pa.int64()), ("last_pos", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def chunk_ranges(
    segments: DataFrame,
    max_chars: int = fixed.MAX_CHARS,
    max_seconds: float = fixed.MAX_SECONDS,
    overlap: int = fixed.OVERLAP_SEGMENTS,
    size: int = NODE,
    fan: int = FAN,
) -> DataFrame:
    """``episode_id, chunk_id, first_pos, last_pos`` of the greedy chunks.

    Input: ``episode_id, pos`` (0, 1, 2, … without gaps), non-empty ``text``
    of at most ``max_chars`` characters, ``start_seconds``, ``end_seconds``.
    """
    if max_chars < 1 or overlap < 0 or size <= max_chars + overlap + 4:
        raise ValueError("a node must be larger than the longest possible chunk")
    limits = (max_chars, float(max_seconds), overlap)
    ahead = max_chars + 4          # every text has at least one character

    lengths = segments.select(
        F.col("episode_id").cast("string").alias("episode_id"), F.col("pos").cast("long").alias("pos"),
        F.length("text").cast("long").alias("chars"), F.col("start_seconds").alias("starts_at"),
        end_or_start(F.col("end_seconds"), F.col("start_seconds")).alias("ends_at"))
    own = F.floor(F.col("pos") / size)
    inside = F.col("pos") % size
    rows = lengths.withColumn("node", F.explode(F.array_compact(F.array(
        own,
        F.when((inside < ahead) & (own > 0), own - 1),
        F.when(inside >= size - overlap, own + 1)))))

    def node_map(table: pa.Table) -> pa.Table:
        episode, node = table["episode_id"][0].as_py(), table["node"][0].as_py()
        walk, low, high = _Walker(table, limits), node * size, (node + 1) * size
        memo: dict[tuple[int, int], tuple] = {}

        def leave(state: tuple[int, int]) -> tuple:
            path = []
            while state not in memo and state[1] < high:
                at = walk.flush(*state)
                path.append(state)
                if at is None:
                    state = None
                    break
                state = (walk.carry(state[0], at), at)
            result = (None, None, 0) if state is None else memo.get(state, (*state, 0))
            for known in reversed(path):
                result = (result[0], result[1], result[2] + 1)
                memo[known] = result
            return memo[path[0]] if path else result

        if node == 0:
            entries = [(0, 0)]
        else:
            entries, total, sure = [], 0, low
            while sure < min(high, walk.stop):
                entries += [(b, sure) for b in range(max(walk.first, sure - overlap), sure + 1)]
                total += walk.chars[sure - walk.first]
                if total > max_chars:
                    break
                sure += 1
        out = [(episode, node, *e, *leave(e)) for e in entries]
        return _table(out, _MAP_ARROW)

    def group_map(table: pa.Table) -> pa.Table:
        """One map for ``fan`` neighbouring nodes."""
        rows_ = table.select(_MAP_ARROW.names).to_pylist()
        maps = {(r["begin"], r["sure"]): (r["to_begin"], r["to_sure"], r["chunks"]) for r in rows_}
        lowest = min(r["node"] for r in rows_)
        out = [(r["episode_id"], r["node"] // fan, *s, *_compose(maps, s))
               for r in rows_ if r["node"] == lowest for s in [(r["begin"], r["sure"])]]
        return _table(out, _MAP_ARROW)

    def entries_of(table: pa.Table) -> pa.Table:
        """Walk the maps of one group from its known entry state."""
        rows_ = table.to_pylist()
        maps = {(r["begin"], r["sure"]): r for r in rows_}
        here, chunk_id, out = (rows_[0]["in_begin"], rows_[0]["in_sure"]), rows_[0]["in_chunk"], []
        while here in maps:
            r = maps[here]
            out.append((r["episode_id"], r["node"], *here, chunk_id))
            if r["to_begin"] is None:
                break
            chunk_id += r["chunks"]
            here = (r["to_begin"], r["to_sure"])
        return _table(out, _ENTRY_ARROW)

    def node_ranges(table: pa.Table) -> pa.Table:
        episode, node = table["episode_id"][0].as_py(), table["node"][0].as_py()
        walk, high = _Walker(table, limits), (node + 1) * size
        begin, sure = table["in_begin"][0].as_py(), table["in_sure"][0].as_py()
        chunk_id, out = table["in_chunk"][0].as_py(), []
        while sure < high:
            at = walk.flush(begin, sure)
            out.append((episode, chunk_id, begin, (walk.stop if at is None else at) - 1))
            if at is None:
                break
            begin, sure, chunk_id = walk.carry(begin, at), at, chunk_id + 1
        return _table(out, _RANGE_ARROW)

    # Only episodes that reach a second node need maps at all.
    long_episodes = lengths.where(F.col("pos") == size).select("episode_id")
    long_rows = rows.join(long_episodes, "episode_id", "left_semi")
    maps = long_rows.groupBy("episode_id", "node").applyInArrow(node_map, _MAP)
    grouped = maps.withColumn("group", F.floor(F.col("node") / fan))
    top = grouped.groupBy("episode_id", "group").applyInArrow(group_map, _MAP)
    start = {"in_begin": F.lit(0).cast("long"), "in_sure": F.lit(0).cast("long"), "in_chunk": F.lit(0).cast("long")}
    renamed = [F.col("begin").alias("in_begin"), F.col("sure").alias("in_sure"), F.col("chunk_id").alias("in_chunk")]
    top_entries = top.withColumns(start).groupBy("episode_id").applyInArrow(entries_of, _ENTRY)
    inner = grouped.join(top_entries.select("episode_id", F.col("node").alias("group"), *renamed), ["episode_id", "group"])
    entries = inner.drop("group").withColumn("group", F.floor(F.col("node") / fan)) \
        .groupBy("episode_id", "group").applyInArrow(entries_of, _ENTRY)
    later = entries.where("node > 0").select("episode_id", "node", *renamed)

    first = rows.where("node = 0").withColumns(start)
    rest = rows.where("node > 0").join(later, ["episode_id", "node"])
    return first.unionByName(rest).groupBy("episode_id", "node").applyInArrow(node_ranges, _RANGE)


def chunk_members(ranges: DataFrame) -> DataFrame:
    """One row per (chunk, segment position)."""
    return ranges.select("episode_id", "chunk_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))


def chunk_rows(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunk records; a chunk holds at most ``max_chars`` characters of text."""
    members = chunk_members(ranges).join(
        segments.withColumn("episode_id", F.col("episode_id").cast("string")), ["episode_id", "pos"])
    item = F.struct("pos", F.col("segment_id").cast("string").alias("segment_id"), "start", "end",
                    "start_seconds", "end_seconds", "speaker", strip(F.col("text")).alias("text"))
    chunks = members.groupBy("episode_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("_m"))
    field = lambda name: F.transform("_m", lambda m: m[name])
    head, tail = F.element_at("_m", 1), F.element_at("_m", -1)
    text = strip(F.array_join(field("text"), " "))
    chunks = chunks.select(
        "episode_id", "chunk_id",
        field("segment_id").alias("segment_ids"),
        head["start"].alias("start"), F.coalesce(tail["end"], tail["start"]).alias("end"),
        head["start_seconds"].alias("start_seconds"),
        end_or_start(tail["end_seconds"], tail["start_seconds"]).alias("end_seconds"),
        F.array_distinct(F.filter(field("speaker"), lambda s: s.isNotNull() & (s != ""))).alias("speakers"),
        text.alias("text"))
    return chunks.select(
        "*", F.length("text").cast("long").alias("char_count"),
        search_text(F.col("text")).alias("search_text"), keyword_hints(F.col("text")).alias("keyword_hints"))


def keyword_hints(text: Column, limit: int = fixed.KEYWORD_LIMIT) -> Column:
    """Most frequent tokens of one bounded text, ties by first appearance."""
    def ranked(tokens: Column) -> Column:
        counted = F.transform(F.array_distinct(tokens), lambda t: F.struct(
            (F.size(F.array_remove(tokens, t)) - F.size(tokens)).alias("n"), F.array_position(tokens, t).alias("at"), t.alias("t")))
        return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda s: s["t"])

    return let(keyword_tokens(text), ranked)


def transcript_chunks(
    segments: DataFrame,
    max_chars: int = fixed.MAX_CHARS,
    max_seconds: float = fixed.MAX_SECONDS,
    overlap: int = fixed.OVERLAP_SEGMENTS,
) -> DataFrame:
    """Chunk records of whole transcripts in one call.

    ``segments``: ``episode_id, segment_id`` (whole numbers in order, gaps
    allowed), ``start_seconds, end_seconds, speaker, text``. Segments without
    text are left out, longer ones than ``max_chars`` split, the rest numbered
    and cut into chunks.
    """
    spoken = segments.where(strip(F.coalesce("text", F.lit(""))) != "").select(
        F.col("episode_id").cast("string").alias("episode_id"), "segment_id", "start_seconds", "end_seconds", "speaker", "text")
    parts = split_oversized(spoken, max_chars)
    numbered = scan(parts, ["episode_id"], ["source_segment_id", "part"], position_block("source_segment_id"),
                    total={"_before": F.lit(1).cast("long")})
    rows = numbered.withColumn("pos", F.coalesce("_before", F.lit(0)).cast("long")).drop("_before")
    # Lengths, then texts are read: the split is worked out once.
    rows = materialize(rows, "chunk-parts")
    return chunk_rows(rows, chunk_ranges(rows, max_chars, max_seconds, overlap, size=max(NODE, 2 * (max_chars + overlap + 4))))


def write_chunks(chunks: DataFrame, path: str, buckets: int = 256, salts: int = 16) -> None:
    """Chunk index partitioned by episode hash; a large episode is spread over
    ``salts`` files of its bucket."""
    (chunks
     .withColumn("bucket", F.pmod(F.xxhash64("episode_id"), F.lit(buckets)).cast("int"))
     .withColumn("_salt", F.pmod(F.col("chunk_id"), F.lit(salts)))
     .repartition("bucket", "_salt").drop("_salt")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))
