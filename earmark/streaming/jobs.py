"""Transcripts that arrive chunk by chunk.

File streams do not keep the order of segments, so everything that folds in
order waits for the next expected position in its state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from earmark.functions import fixed
from earmark.operators import episodes, timeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_SEGMENT = ("episode_id string, chunk_key string, pos long, start_seconds double, end_seconds double, "
                 "speaker string, language string, confidence double, text string")
_EP = "episode_id"
#: An episode of which no row came for so long in event time is over.
PATIENCE_MS = 3600 * 1000


def read_chunk_segments(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of per-chunk transcript rows written as JSON lines."""
    reader = spark.readStream.schema(CHUNK_SEGMENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def publish_timeline(segments: DataFrame, windows: DataFrame, out: str, log: str, checkpoint: str):
    """Append rebased segments as their chunks arrive.

    The rebasing is a stream-static join on (episode, chunk). Besides the
    segments each batch leaves one small row per finished chunk in ``log``, so
    the status never needs the segments again. A replayed batch overwrites its
    own folder.
    """
    def batch(rows: DataFrame, number: int) -> None:
        rows.select(_EP, "chunk_key").distinct().write.mode("overwrite").parquet(f"{log}/batch={number}")
        timeline.global_timeline(rows, windows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def published_status(windows: DataFrame, log: str) -> DataFrame:
    """``partial`` or ``complete`` per episode, from the finished chunks so far."""
    return timeline.timeline_status(windows, windows.sparkSession.read.parquet(log))


def live_progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running completed/total/percent/ETA per episode, for update mode.

    ``events``: ``episode_id, at`` (timestamp), ``done``.
    """
    at = F.unix_micros("at")
    rows = events.withWatermark("at", late).groupBy(_EP).agg(
        F.count_if("done").alias("completed"), F.count("*").alias("total"),
        ((F.max(at) - F.min(at)) / 1000000).alias("elapsed"))
    return timeline.with_eta(rows)


ARRIVAL = [_EP, "chunk_key", "modified", "sha256"]


def log_arrivals(arrivals: DataFrame, log: str, held: str, checkpoint: str, late: str = "1 hour"):
    """Every delivery goes to exactly one of two tables: ``log`` or ``held``.

    ``arrivals``: ``episode_id, chunk_key, at`` (timestamp), ``settings,
    size_bytes, modified, sha256``. ``held`` has a ``reason`` besides:
    ``bad`` (no episode, chunk or time), ``late`` (before the watermark: the
    newest time of all earlier batches less ``late``) or ``repeated`` (the first
    one with its episode, chunk, modification and digest is in ``log``, and the
    watermark hasn't passed its time by ``late`` yet). Lateness is told before
    repeats are.

    Both tables have a folder a batch (the column ``batch``). A batch reads only
    what earlier batches left, so a replayed one overwrites its folders with the
    same rows. Of each batch its numbered rows are kept beside ``held``, as
    equal rows need a name to be told apart.
    """
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        taken = f"{held}-taken/batch={number}"
        rows.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(taken)
        rows = spark.read.parquet(taken)
        mark = earlier(spark, f"{held}-marks", number, "newest timestamp").agg(
            F.expr(f"max(newest) - INTERVAL {late}").alias("mark"))
        bad = F.col(_EP).isNull() | F.col("chunk_key").isNull() | F.col("at").isNull()
        mark = mark.scalar()
        told = rows.withColumn("reason", F.when(bad, "bad").when(F.col("at") < mark, "late"))
        usable = told.where("reason IS NULL")
        known = earlier(spark, log, number, _ddl(rows.drop("_row"))).where(
            mark.isNull() | (F.col("at") + F.expr(f"INTERVAL {late}") >= mark))
        same = _null_safe(usable, known, ARRIVAL)
        # The first of each by time, counted before the shuffle; found again by its own number.
        first = usable.join(known.select([F.col(c).alias(f"_{c}") for c in ARRIVAL]), same, "left_anti").groupBy(*ARRIVAL).agg(
            F.min(F.struct("at", "_row"))["_row"].alias("_row"))
        told = told.join(first.select("_row", F.lit(True).alias("_first")), "_row", "left")
        told = told.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_first").isNull(), "repeated").otherwise(F.col("reason")))
        told = told.drop("_first", "_row")
        told.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{log}/batch={number}")
        told.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{held}/batch={number}")
        rows.agg(F.max("at").alias("newest")).write.mode("overwrite").parquet(f"{held}-marks/batch={number}")

    return (arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def earlier(spark: SparkSession, path: str, number: int, ddl: str) -> DataFrame:
    """What the batches before ``number`` wrote below ``path``; the first one has no folder to read."""
    if number == 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl + ", batch long").parquet(path).where(F.col("batch") < number).drop("batch")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def _null_safe(rows: DataFrame, known: DataFrame, names: list[str]):
    return reduce(lambda a, b: a & b, [rows[c].eqNullSafe(F.col(f"_{c}")) for c in names])


def current_chunks(logged: DataFrame) -> DataFrame:
    """The newest delivery of every chunk."""
    key = [_EP, "chunk_key"]
    order = F.struct("at", "sha256")
    return logged.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in logged.columns if c not in key])


def replaced_chunks(logged: DataFrame, current: DataFrame) -> DataFrame:
    """Older deliveries whose fingerprint or settings differ, with the reason.

    Each older delivery is its own item, so a chunk delivered often is spread.
    """
    key = [_EP, "chunk_key"]
    older = logged.join(current.select(*key, F.col("at").alias("_newest")), key).where("at < _newest")
    versions = older.select(*key, "at", "settings", "size_bytes", "modified", "sha256")
    now = current.drop("at").join(versions.select(*key, "at"), key)
    return episodes.stale_items(versions, now, [*key, "at"])


MERGED = "episode_id string, pos long, start_seconds double, end_seconds double, speaker string, text string, merged_rows long"
RANGES = "episode_id string, chunk_id long, first_pos long, last_pos long"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _value(v):
    return None if v is None or (isinstance(v, float) and v != v) or v is pd.NA else v


class _InOrder(StatefulProcessor):
    """Holds rows back until their position is the next one.

    With ``patience`` (milliseconds) an episode is given up when the watermark
    is that far past its newest row: what waits is then folded in order over
    the positions that never came, what is open is let go, and nothing stays in
    the state.
    """

    patience: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "pos long", self.row_schema)
        self.next_pos = handle.getValueState("next_pos", "pos long")

    def due(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Rows whose turn has come, in order; of each batch of rows only those that are still early go to the state."""
        names = _names(self.row_schema)
        at, stored = self.next_pos.get()[0] if self.next_pos.exists() else 0, self.waiting.exists()
        for frame in rows:
            if self.patience is not None and len(frame):
                self.newest = max(self.newest, int(frame["at_ms"].max()))
            early = {}
            for row in frame[["pos", *names]].sort_values("pos").itertuples(index=False):
                pos, values = int(row[0]), tuple(_value(v) for v in row[1:])
                if pos > at:
                    early[pos] = values
                # A row from before (a replayed file) has had its turn.
                while pos == at:
                    yield at, *values
                    at += 1
                    if stored and self.waiting.containsKey((at,)):
                        pos, values = at, tuple(self.waiting.getValue((at,)))
                        self.waiting.removeKey((at,))
            for pos, values in early.items():
                if pos >= at:
                    self.waiting.updateValue((pos,), values)
                    stored = True
        self.next_pos.update((at,))

    def rest(self) -> Iterator[tuple]:
        """Rows that still wait, in order."""
        for pos in sorted(k[0] for k in self.waiting.keys()):
            yield pos, *tuple(self.waiting.getValue((pos,)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.newest = 0
        out = self.fold(key, self.due(rows), False)
        if self.patience is not None:
            until, timers = self.newest + self.patience, list(self.handle.listTimers())
            if not timers or until > max(timers):
                for old in timers:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(until)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.fold(key, self.rest(), True)
        self.waiting.clear()
        self.next_pos.clear()
        yield out

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, processor: _InOrder, output: str, late: str | None, patience_ms: int) -> DataFrame:
    """``processor`` over each episode; with ``late`` episodes end by the event time ``at`` too."""
    if late is not None:
        processor.patience = patience_ms
        rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy(_EP).transformWithStateInPandas(
        processor, outputStructType=output, outputMode="Append", timeMode="None" if late is None else "EventTime")


class MergeCaptions(_InOrder):
    """Caption merge with the last kept caption as state.

    A row marked ``last`` ends its episode and lets the open caption go.
    """

    row_schema = "start_seconds double, end_seconds double, speaker string, text string, last boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState(
            "kept", "pos long, start_seconds double, end_seconds double, speaker string, text string, n long")

    def fold(self, key, rows: Iterator[tuple], ended: bool) -> pd.DataFrame:
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        out = []
        for pos, start, end, speaker, text, last in rows:
            merged = False
            if kept is not None and kept[3] == speaker and text.startswith(kept[4]):
                repeat, open_end = text == kept[4], kept[2]
                gap = fixed.REPEAT_GAP_SECONDS if repeat else fixed.GROWING_GAP_SECONDS
                merged = open_end is None or start is None or start <= open_end + gap
                if merged:
                    grown = end if (end is not None and (repeat or end != 0)) else open_end
                    kept = (kept[0], kept[1], grown, speaker, text, kept[5] + 1)
            if not merged:
                if kept is not None:
                    out.append((key[0], *kept))
                kept = (pos, start, end, speaker, text, 1)
            if last:
                out.append((key[0], *kept))
                kept = None
        if ended and kept is not None:
            out.append((key[0], *kept))
            kept = None
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(kept)
        return pd.DataFrame(out, columns=_names(MERGED))


def merge_captions_stream(cues: DataFrame, late: str | None = None, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Merged captions of a stream of cues (``last`` marks an episode's end).

    With ``late`` the cues have a time ``at``: rows older than the newest one
    less ``late`` are dropped by Spark, and an episode ends without its ``last``
    row, or with rows missing, when the watermark is ``patience_ms`` past it.
    """
    return _in_order(cues, MergeCaptions(), MERGED, late, patience_ms)


class CutChunks(_InOrder):
    """Greedy chunker that lets a chunk go when the next one begins."""

    row_schema = "start_seconds double, end_seconds double, chars long, last boolean"
    limits = (fixed.MAX_CHARS, fixed.MAX_SECONDS, fixed.OVERLAP_SEGMENTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "pos long, start_seconds double, chars long")
        self.number = handle.getValueState("number", "n long")

    def fold(self, key, rows: Iterator[tuple], ended: bool) -> pd.DataFrame:
        max_chars, max_seconds, overlap = self.limits
        group = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        number = self.number.get()[0] if self.number.exists() else 0
        out = []
        for pos, start, end, chars, last in rows:
            if group:
                until = end or start
                late = group[0][1] is not None and until is not None and until - group[0][1] > max_seconds
                if late or sum(g[2] for g in group) + chars > max_chars:
                    out.append((key[0], number, group[0][0], group[-1][0]))
                    number += 1
                    group = group[-overlap:] if overlap else []
                    while group and sum(g[2] for g in group) + chars > max_chars:
                        group = group[1:]
            group = [*group, (pos, start, chars)]
            if last:
                out.append((key[0], number, group[0][0], group[-1][0]))
                group, number = [], 0
        if ended and group:
            out.append((key[0], number, group[0][0], group[-1][0]))
            group = []
        if group:
            self.open.put(group)
        else:
            self.open.clear()
        if ended:
            self.number.clear()
        else:
            self.number.update((number,))
        return pd.DataFrame(out, columns=_names(RANGES))


def chunk_ranges_stream(segments: DataFrame, max_chars: int = fixed.MAX_CHARS, max_seconds: float = fixed.MAX_SECONDS,
                        overlap: int = fixed.OVERLAP_SEGMENTS, late: str | None = None, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Chunk ranges of a stream of segments, as in the batch chunker; ``late`` as in ``merge_captions_stream``."""
    cutter = CutChunks()
    cutter.limits = (max_chars, float(max_seconds), overlap)
    rows = segments.withColumn("chars", F.length("text").cast("long"))
    return _in_order(rows, cutter, RANGES, late, patience_ms)
