"""Ordered work over groups of any size.

A plain window ``partitionBy(episode)`` sends one episode to one task. Here
each group is cut into blocks along its order: windows run inside a block, one
small row per block carries the running state on, and a join on (keys, block)
brings it back. The large side is shuffled once, on (keys, block), so a group
that holds a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 32768


def position_block(pos: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / size)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over the rows *before* each row of its group.

    ``order`` must be unique inside a group and ``block`` must not decrease
    along it. ``total`` adds up, ``highest`` keeps the maximum, ``latest`` the
    last value that is not null; ``lag``/``lead`` take the neighbouring row.
    """
    lag, lead, total, highest, latest = (x or {} for x in (lag, lead, total, highest, latest))
    keys, order = list(keys), list(order)
    inputs = {f"_in_{n}": c for group in (total, highest, latest) for n, c in group.items()}
    back = F.struct(*[c.alias(n) for n, c in lag.items()]) if lag else None
    ahead = F.struct(*[c.alias(n) for n, c in lead.items()]) if lead else None
    if lag:
        inputs["_in_lag"] = back
    if lead:
        inputs["_in_lead"] = ahead
    rows = df.withColumns({**inputs, "_blk": block})

    at = F.struct(*order)
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local, sums, carry = {}, [], {}
    across = Window.partitionBy(*keys).orderBy("_blk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    for n in total:
        v = F.col(f"_in_{n}")
        local[f"_l_{n}"] = F.sum(v).over(before)
        sums.append(F.sum(v).alias(f"_s_{n}"))
        carry[f"_c_{n}"] = F.sum(f"_s_{n}").over(earlier)
    for n in highest:
        v = F.col(f"_in_{n}")
        local[f"_l_{n}"] = F.max(v).over(before)
        sums.append(F.max(v).alias(f"_s_{n}"))
        carry[f"_c_{n}"] = F.max(f"_s_{n}").over(earlier)
    for n in latest:
        v = F.col(f"_in_{n}")
        local[f"_l_{n}"] = F.last(v, True).over(before)
        sums.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_s_{n}"))
        carry[f"_c_{n}"] = F.last(f"_s_{n}", True).over(earlier)
    if lag:
        local["_l_lag"] = F.lag("_in_lag").over(inside)
        sums.append(F.max_by("_in_lag", at).alias("_s_lag"))
        carry["_c_lag"] = F.lag("_s_lag").over(across)
    if lead:
        local["_l_lead"] = F.lead("_in_lead").over(inside)
        sums.append(F.min_by("_in_lead", at).alias("_s_lead"))
        carry["_c_lead"] = F.lead("_s_lead").over(across)

    carried = rows.groupBy(*keys, "_blk").agg(*sums).withColumns(carry).select(*keys, "_blk", *carry)
    joined = rows.withColumns(local).join(carried, [*keys, "_blk"])
    out = [F.col(c) for c in df.columns]
    for n in total:
        zero = F.lit(0)
        out.append(F.when(F.col(f"_l_{n}").isNotNull() | F.col(f"_c_{n}").isNotNull(),
                          F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n))
    out += [F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in highest]
    out += [F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in latest]
    out += [F.coalesce("_l_lag", "_c_lag")[n].alias(n) for n in lag]
    out += [F.coalesce("_l_lead", "_c_lead")[n].alias(n) for n in lead]
    return joined.select(*out)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Values of the previous and next row where ``pos`` counts without gaps.

    The rows at a block edge are copied into the block next door, so one
    shuffle is enough and nothing is joined.
    """
    lag, lead = lag or {}, lead or {}
    own = position_block(pos, size)
    p = F.col(pos)
    copies = [own]
    if lag:
        copies.append(F.when((p + 1) % size == 0, own + 1))
    if lead:
        copies.append(F.when(p % size == 0, own - 1))
    wide = df.withColumn("_own", own).withColumn("_blk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    added = {n: F.lag(c).over(w) for n, c in lag.items()} | {n: F.lead(c).over(w) for n, c in lead.items()}
    return wide.withColumns(added).where("_own = _blk").drop("_own", "_blk")
