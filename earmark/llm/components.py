"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of links held in memory, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all() and (new[left] == new[right]).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links`` (a, b).

    Repeated links, both directions and a node with itself are fine; no link
    gives no row. Each round hangs every node's neighbours on the smallest of
    them (large star), then flattens the chains (small star). Minima are taken
    before the shuffle, so that a node with very many links is no hot spot in
    the aggregates; the joins are plain equi-joins that Spark can split. The
    links are a new table after every round.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = scratch.table(pairs, "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.table(stars, "links")
        scratch.drop(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple[int, int]:
    """Count and a checksum; equal for equal sets of links."""
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
