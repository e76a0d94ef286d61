"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. Raking finds a factor
for each source, language and topic so that the cells' tokens, times their
three factors, have the wanted marginals; a document is then kept with a
probability in proportion to its cell's factors, scaled so that none exceeds 1
(so the expected tokens keep exactly the raked marginals) and that
``rate`` of all tokens are kept at most. So the cell with the largest factor
decides how much is kept. ``fill`` (the query and the pipeline set it) keeps
``rate`` of the tokens instead: values and cells that are too small for their
target are kept whole, and the others are raked again to what is left.

The state is three small tables of factors. Each step reads the cells, with
sums taken before the shuffle, and writes one dimension's new factors, so the
plan doesn't grow. Cells are far fewer than documents and stay distributed.

Null sources, languages and topics are values of their own. Texts without a
word weigh nothing; a value whose documents have no token has probability 0.
The same id and seed always draw alike, so repeated rows stay or go together;
null ids draw as the empty text. An empty table gives no row.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, key_of

#: Topics by the first pattern that a text matches, in this order; else OTHER.
TOPICS = (
    ("legal", "(?i)licensed under|all rights reserved|public license"),
    ("contact", "[0-9A-Za-z._]@[0-9A-Za-z.]"),
    ("secret", "AKIA[0-9A-Z]{16}|token ="),
    ("listing", " \\| |###|%%%|&&&"),
)
OTHER = "prose"
ROUNDS, RATE, TEMPER, SEED = 6, 0.8, 0.9, "mix"
#: A value's share counts as missed beyond this, in parts of its target.
MISS = 0.01
#: Filling ends when no value is further from its goal than this, in parts of it. Where that can't be reached, it ends when
#: the worst value came nearer by less than a hundredth in ten rounds, or at MOST_ROUNDS; either is logged.
TOLERANCE, MOST_ROUNDS = 1e-3, 500
#: A cell is held as kept whole from this factor on: just below 1, so that the last digit of a sum doesn't decide.
WHOLE = 1 - 1e-9
DIMENSIONS = ("source", "lang", "topic")
LOG = logging.getLogger(__name__)


def topic_of(text: Column | str, topics: tuple = TOPICS) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    whens = reduce(lambda so_far, t: so_far.when(text.rlike(t[1]), t[0]) if so_far is not None else F.when(text.rlike(t[1]), t[0]), topics, None)
    return F.lit(OTHER) if whens is None else whens.otherwise(OTHER)


def tokens_of(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw_of(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number in [0, 1) from an id: the first 52 bits of a digest."""
    name = F.concat(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string"), F.lit(":" + seed))
    digest = F.md5(F.coalesce(name, F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Target shares of a dimension: its shares of the tokens to the power ``temper``, normalised."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens"))
    whole = sums.agg(F.sum(F.pow("tokens", F.lit(temper)))).first()[0] or 1.0
    return sums.select(dimension, (F.pow("tokens", F.lit(temper)) / whole).alias("share"))


def fit(slim: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, rate: float = RATE, temper: float = TEMPER,
        fill: bool = False) -> DataFrame:
    """``source``, ``lang``, ``topic`` (keys) and ``probability`` of every cell.

    ``slim`` has the three keys and ``n_tokens``. ``targets`` may give a table
    (key, share) for a dimension; the default is its own shares, tempered.
    Values without a target have probability 0; targets of absent values are
    left out.
    """
    cells = scratch.table(slim.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    wanted = {d: scratch.table((targets or {}).get(d, tempered(cells, d, temper)).toDF(d, "share"), d) for d in DIMENSIONS}
    if fill:
        return filled(cells, wanted, scratch, rate)
    factors = {d: wanted[d].select(d, F.lit(1.0).alias(f"f_{d}")) for d in DIMENSIONS}
    for _ in range(rounds):
        for d in DIMENSIONS:
            others = [o for o in DIMENSIONS if o != d]
            rows = reduce(lambda rows, o: rows.join(factors[o], o), others, cells)
            weight = reduce(lambda a, b: a * b, [F.col(f"f_{o}") for o in others], F.col("tokens").cast("double"))
            sums = rows.groupBy(d).agg(F.sum(weight).alias("now"))
            raked = F.coalesce(F.col("share") / F.when(F.col("now") > 0, F.col("now")), F.lit(0.0))
            old, factors[d] = factors[d], scratch.table(wanted[d].join(sums, d).select(d, raked.alias(f"f_{d}")), f"factors-{d}")
            if hasattr(old, "_scratch"):
                scratch.drop(old)
    raked = reduce(lambda rows, d: rows.join(factors[d], d, "left"), DIMENSIONS, cells)
    factor = reduce(lambda a, b: a * b, [F.coalesce(f"f_{d}", F.lit(0.0)) for d in DIMENSIONS])
    raked = scratch.table(raked.select(*DIMENSIONS, "tokens", factor.alias("factor")), "raked")
    # Factors sum the tokens up to 1: so rate * all tokens * factor is the share of a cell that is kept.
    whole, most = raked.agg(F.sum("tokens").cast("double"), F.max("factor")).first()
    scale = min(rate * whole, 1.0 / most) if most else 0.0
    return raked.select(*DIMENSIONS, F.least(F.col("factor") * scale, F.lit(1.0)).alias("probability"))


def reachable(cells: DataFrame, wanted: DataFrame, dimension: str, keep: float) -> DataFrame:
    """``dimension`` and ``goal``, the tokens to keep of each value: in proportion to ``share``, but no more than there are; ``keep`` in all."""
    values = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("there")).join(wanted, dimension)
    level, held = 0.0, -1
    while True:  # values that are kept whole leave more to the others, until none is added
        full = F.col("share") * level >= F.col("there")
        n, there, share = values.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("there")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        if n == held or not share:
            break
        held, level = n, max(level, (keep - there) / share)
    return values.select(dimension, "share", "there", F.least(F.col("share") * level, F.col("there")).alias("goal"))


def filled(cells: DataFrame, wanted: dict[str, DataFrame], scratch: Scratch, rate: float, tolerance: float = TOLERANCE) -> DataFrame:
    """As ``fit``, with ``rate`` of the tokens kept: a cell's probability is its three factors' product, 1 at most.

    Each step moves a dimension's factors so that its values keep their goals,
    with the cells at probability 1 held, until all values are within
    ``tolerance``. What is kept and missed is logged.
    """
    wanted = {d: t.where("share > 0") for d, t in wanted.items()}
    usable = reduce(lambda rows, d: rows.join(wanted[d].select(d), d, "left_semi"), DIMENSIONS, cells.where("tokens > 0"))
    usable = scratch.table(usable, "usable")
    whole, there = (t.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).first()[0] for t in (cells, usable))
    if not there:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("probability"))
    keep = min(rate * whole, there)
    goals = {d: scratch.table(reachable(usable, wanted[d], d, keep), f"goals-{d}") for d in DIMENSIONS}
    factors = {d: goals[d].select(d, F.lit(keep / there if d == DIMENSIONS[0] else 1.0).alias(f"f_{d}")) for d in DIMENSIONS}
    factor = reduce(lambda a, b: a * b, [F.col(f"f_{d}") for d in DIMENSIONS])
    worst: list[float] = []
    while len(worst) < MOST_ROUNDS:
        for d in DIMENSIONS:
            rows = reduce(lambda rows, o: rows.join(factors[o], o), DIMENSIONS, usable)
            held = F.sum(F.when(factor >= WHOLE, F.col("tokens")).otherwise(0)).cast("double")
            free = F.sum(F.when(factor < WHOLE, F.col("tokens") * factor).otherwise(0.0))
            sums = rows.groupBy(d).agg(held.alias("held"), free.alias("free"), F.first(f"f_{d}").alias("old")).join(goals[d], d)
            now = F.col("held") + F.col("free")
            # With the held cells fixed; where those alone are too much, all of the value's cells come down.
            move = F.when((F.col("goal") > F.col("held")) & (F.col("free") > 0), (F.col("goal") - F.col("held")) / F.col("free")).otherwise(F.least(F.col("goal") / now, F.lit(1.0)))
            old, factors[d] = factors[d], scratch.table(sums.select(d, (F.col("old") * move).alias(f"f_{d}"), F.abs(now / F.col("goal") - 1).alias(f"off_{d}")), f"factors-{d}")
            if hasattr(old, "_scratch"):
                scratch.drop(old)
        # How far each dimension was from its goals when its turn came.
        offs = reduce(DataFrame.unionAll, [factors[d].select(F.col(f"off_{d}").alias("off")) for d in DIMENSIONS])
        worst.append(offs.agg(F.max("off")).first()[0])
        if worst[-1] <= tolerance:
            break
        if len(worst) > 10 and worst[-1] > 0.99 * worst[-11]:
            break
    if worst[-1] > tolerance:
        LOG.warning("raking: stopped after %d rounds with a value %.4f off its goal, %g wanted", len(worst), worst[-1], tolerance)
    raked = reduce(lambda rows, d: rows.join(factors[d], d, "left"), DIMENSIONS, cells)
    raked = scratch.table(raked.select(*DIMENSIONS, "tokens", F.least(F.coalesce(factor, F.lit(0.0)), F.lit(1.0)).alias("probability")), "raked")
    kept = raked.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    LOG.warning("raking: %.4f of the tokens kept, %.4f wanted; %d rounds", kept / whole, rate, len(worst))
    for d in DIMENSIONS:
        short = raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("now")).join(wanted[d], d)
        miss = F.abs(F.col("now") / kept / F.col("share") - 1)
        most, n = short.agg(F.max(miss), F.count(F.when(miss > MISS, 1))).first()
        LOG.warning("raking: %s: %d values miss their share by over %g, the worst by %.4f of it", d, n, MISS, most or 0.0)
    return raked.select(*DIMENSIONS, "probability")


def mix_table(docs: DataFrame, topic: Column | None = None, seed: str = SEED, **settings) -> DataFrame:
    """``doc_id``, the cell, ``n_tokens``, ``probability`` and ``kept`` of every row.

    Needs ``doc_id``, ``text``, ``source`` and ``lang``; no other column is read.
    """
    scratch = Scratch(docs.sparkSession, "raking")
    topic = topic_of("text") if topic is None else topic
    slim = docs.select("doc_id", key_of("source").alias("source"), key_of("lang").alias("lang"), key_of(topic).alias("topic"), tokens_of("text").alias("n_tokens"))
    slim = scratch.table(slim, "slim")
    cells = scratch.table(fit(slim, scratch, **settings), "probabilities")
    value = lambda c: F.when(F.col(c) != "n", F.substr(c, F.lit(2))).alias(c)
    rows = slim.join(cells, list(DIMENSIONS))
    return rows.select("doc_id", *map(value, DIMENSIONS), "n_tokens", "probability", (draw_of("doc_id", seed) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, topic: Column | None = None, seed: str = SEED, **settings) -> DataFrame:
    """The rows drawn with their cell's probability; same columns."""
    scratch = Scratch(docs.sparkSession, "raking")
    topic = topic_of("text") if topic is None else topic
    keys = {"source": key_of("source"), "lang": key_of("lang"), "topic": key_of(topic)}
    slim = scratch.table(docs.select(*[c.alias(d) for d, c in keys.items()], tokens_of("text").alias("n_tokens")), "slim")
    cells = scratch.table(fit(slim, scratch, **settings), "probabilities")
    named = {d: "_".join([*docs.columns, d]).replace(".", "_") for d in (*DIMENSIONS, "probability")}
    cells = cells.select(*[F.col(d).alias(n) for d, n in named.items()])
    drawn = draw_of("doc_id", seed) < F.col(f"`{named['probability']}`")
    rows = docs.withColumns({named[d]: c for d, c in keys.items()}).join(cells, [named[d] for d in DIMENSIONS])
    return rows.where(drawn).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sql(rate: float = RATE, temper: float = TEMPER, seed: str = SEED, topics: tuple = TOPICS, tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> str:
    """What ``mix_table`` with ``fill`` gives over ``documents``, in SQL: the rounds are a recursive query over the cells."""
    quoted = [(t, p.replace("'", "''")) for t, p in topics]
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in quoted) + f" ELSE '{OTHER}' END"
    parts = [f"""slim AS MATERIALIZED (SELECT doc_id, coalesce('v' || source, 'n') AS source, coalesce('v' || lang, 'n') AS lang, 'v' || {topic} AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents)""",
             "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM slim GROUP BY ALL HAVING sum(n_tokens) > 0)",
             f"keep AS MATERIALIZED (SELECT least({rate}, 1.0) * sum(tokens) AS keep FROM cells)"]
    for d in DIMENSIONS:
        # The level to which all values are filled: the highest of those at which the first values are whole and the others share what is left.
        parts.append(f"""sums_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS there FROM cells GROUP BY ALL),
shares_{d} AS MATERIALIZED (SELECT {d}, there, pow(there, {temper}) / (SELECT sum(pow(there, {temper})) FROM sums_{d}) AS share FROM sums_{d}),
steps_{d} AS (SELECT *, sum(there) OVER (ORDER BY there / share, {d} ROWS UNBOUNDED PRECEDING) - there AS whole,
  sum(share) OVER (ORDER BY there / share DESC, {d} DESC ROWS UNBOUNDED PRECEDING) AS others FROM shares_{d}),
goals_{d} AS MATERIALIZED (SELECT {d}, least(share * (SELECT max((keep - whole) / others) FROM steps_{d}, keep), there) AS goal_{d} FROM shares_{d})""")
    goals = " ".join(f"JOIN goals_{d} USING ({d})" for d in DIMENSIONS)
    step = f"rake WHERE k = 0 OR (off > {tolerance} AND k < {rounds} AND NOT (k > 10 AND off > 0.99 * worst[k - 10]))"
    for d in DIMENSIONS:
        step = f"""(SELECT * EXCLUDE (held, free) REPLACE (f * CASE WHEN goal_{d} > held AND free > 0 THEN (goal_{d} - held) / free ELSE least(goal_{d} / (held + free), 1) END AS f,
  greatest({'0' if d == DIMENSIONS[0] else 'off'}, abs((held + free) / goal_{d} - 1)) AS off) FROM
 (SELECT *, sum(CASE WHEN f >= {WHOLE!r} THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS held, sum(CASE WHEN f < {WHOLE!r} THEN tokens * f ELSE 0 END) OVER (PARTITION BY {d}) AS free FROM {step}))"""
    named = ", ".join(f"goal_{d}" for d in DIMENSIONS)
    parts.append(f"""rake AS (SELECT 0 AS k, source, lang, topic, tokens, {named}, keep / sum(tokens) OVER () AS f, 0::DOUBLE AS off, []::DOUBLE[] AS worst FROM cells {goals}, keep
 UNION ALL SELECT k + 1, source, lang, topic, tokens, {named}, f, max(off) OVER (), list_append(worst, max(off) OVER ()) FROM {step})""")
    parts.append("raked AS MATERIALIZED (SELECT source, lang, topic, least(f, 1.0) AS p FROM rake WHERE k = (SELECT max(k) FROM rake))")
    value = ", ".join(f"CASE WHEN {d} <> 'n' THEN substr({d}, 2) END AS {d}" for d in DIMENSIONS)
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, {value}, n_tokens::BIGINT AS n_tokens, round(coalesce(p, 0), 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)!r} < coalesce(p, 0) AS kept
FROM slim LEFT JOIN raked USING (source, lang, topic)"""
