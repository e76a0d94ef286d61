"""Caption cleanup: merging of repeated and growing captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark.functions import fixed
from earmark.operators.ordered import BLOCK, neighbours, position_block, scan


def merge_captions(cues: DataFrame, size: int = BLOCK) -> DataFrame:
    """Join rolling captions into the caption they grew into.

    Input: ``episode_id, pos`` (0, 1, 2, … without gaps), cleaned non-empty
    ``text``, ``speaker, start_seconds, end_seconds`` and further columns,
    which are taken from the first row of each merged run.

    A row merges into the caption before it when the speaker is the same and
    its text repeats that text (gap up to 2 s) or begins with it (up to 1 s).
    The text compared with is always the text of the row just before; what is
    carried along is only the caption's end so far. That end is the row's own
    end wherever one is known, so only rows without an end look further back,
    and they do so through a maximum, which can be scanned in blocks.
    """
    key = ["episode_id"]
    block = position_block("pos", size)
    rows = neighbours(cues, key, "pos", size=size,
                      lag={"_text": F.col("text"), "_speaker": F.col("speaker")})
    same = F.col("_text").isNotNull() & F.col("speaker").eqNullSafe(F.col("_speaker")) & F.startswith("text", "_text")
    repeat = F.col("text") == F.col("_text")
    end, start = F.col("end_seconds"), F.col("start_seconds")
    # Growing captions ignore an end of exactly zero; all others take it.
    known = end.isNotNull() & ~(F.col("_same") & ~F.col("_repeat") & (end == 0))
    rows = (
        rows.withColumns({"_same": same, "_repeat": F.coalesce(repeat, F.lit(False))})
        .withColumn("_anchor", ~F.col("_same") | known)
    )
    rows = scan(rows, key, ["pos"], block,
                latest={"_from": F.when(F.col("_anchor"), F.struct("pos", end.alias("end")))})
    # Starts of the rows since that anchor; the larger position wins in a struct.
    since = F.coalesce(F.col("_from.pos"), F.lit(-1))
    rows = scan(rows, key, ["pos"], block, highest={
        "_hi2": F.when(~F.col("_anchor") & F.col("_repeat"), F.struct(since.alias("at"), start.alias("s"))),
        "_hi1": F.when(~F.col("_anchor") & ~F.col("_repeat"), F.struct(since.alias("at"), start.alias("s"))),
    })
    base = F.col("_from.end")

    def held(name: str, gap: float) -> F.Column:
        late = F.col(name).isNotNull() & (F.col(f"{name}.at") == since) & F.col(f"{name}.s").isNotNull()
        return ~late | (F.col(f"{name}.s") <= base + gap)

    so_far = F.when(held("_hi2", fixed.REPEAT_GAP_SECONDS) & held("_hi1", fixed.GROWING_GAP_SECONDS), base)
    gap = F.when(F.col("_repeat"), fixed.REPEAT_GAP_SECONDS).otherwise(fixed.GROWING_GAP_SECONDS)
    near = F.col("_open").isNull() | start.isNull() | (start <= F.col("_open") + gap)
    rows = rows.withColumn("_open", so_far).withColumn("_head", ~(F.col("_same") & near))
    rows = scan(rows, key, ["pos"], block, latest={"_head_before": F.when(F.col("_head"), F.col("pos"))})
    rows = rows.withColumns({
        "_run": F.when(F.col("_head"), F.col("pos")).otherwise(F.col("_head_before")),
        "_end": F.when(F.col("_head") | F.col("_repeat"), F.coalesce(end, F.when(~F.col("_head"), F.col("_open"))))
        .otherwise(F.coalesce(F.nullif(end, F.lit(0.0)), F.col("_open"))),
    })
    first = [c for c in cues.columns if c not in ("episode_id", "pos", "text", "end_seconds")]
    merged = rows.groupBy("episode_id", F.col("_run").alias("pos")).agg(
        F.max_by("text", "pos").alias("text"),
        F.max_by("_end", "pos").alias("end_seconds"),
        *[F.min_by(c, "pos").alias(c) for c in first],
        F.count("*").alias("merged_rows"),
    )
    return merged.select(*cues.columns, "merged_rows")


def number_segments(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Renumber what cleanup left as ``segment_id`` 1, 2, 3, … per episode."""
    numbered = scan(rows, ["episode_id"], ["pos"], position_block("pos", size), total={"_n": F.lit(1)})
    return numbered.withColumn("segment_id", (F.coalesce("_n", F.lit(0)) + 1).cast("long")).drop("_n")
