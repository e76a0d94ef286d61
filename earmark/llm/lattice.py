"""Near-duplicate vectors by E8 lattice hashing.

A table projects a unit vector onto ``BLOCKS`` random spaces of eight
dimensions and decodes each projection to the nearest point of the E8 lattice;
the points together name the vector's cell. A vector lives in its own cell and
visits the ``PROBES`` neighbouring cells whose lattice step (one of the 240
shortest vectors) points most towards it. Vectors that meet in a cell, at least
one of them living there, are compared by cosine in double precision.

Equal vectors are one class first, so copies are never compared. A cell with
many classes is cut into blocks of ``BLOCK`` and every pair of blocks is a task
of its own; pairs are never sent anywhere: a task adds up each class's links
and keeps a spanning forest. A pair that meets in several cells is counted only
in the first one, which both classes' cell lists tell.

With the default tables a pair at cosine 0.93 is found with a probability of
about 0.995, nearer ones more surely; pairs below the threshold never link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch
from earmark.llm.components import components, forest

COSINE = 0.93
TABLES, BLOCKS, PROBES, SCALE, SEED = 9, 2, 6, 0.5, 8
BLOCK = 1024
#: Linked pairs looked at together, for memory.
PAIRS = 50_000
KEY = ["label", "dim", "table", "cell"]


@cache
def steps() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1.0, -1.0), repeat=2)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and undo the least sure rounding where the sum is odd."""
    point = np.round(y)
    error = y - point
    odd = np.flatnonzero(point.sum(axis=-1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(axis=-1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the better of D8 and D8 shifted by a half."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=-1) <= ((y - b) ** 2).sum(axis=-1)
    return np.where(near[:, None], a, b)


@cache
def projections(dim: int, tables: int, blocks: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random maps (tables, blocks, 8, dim) and odd multipliers that fold a cell's coordinates into 64 bits."""
    rng = np.random.default_rng([seed, dim])
    maps = rng.normal(size=(tables, blocks, 8, dim)) * scale
    return maps, rng.integers(0, 1 << 62, size=8 * blocks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cells of unit vectors: (vectors, tables, 1 + probes), the own cell first."""
    maps, fold = projections(unit.shape[1], tables, blocks, scale, seed)
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.uint64)
    for t in range(tables):
        points, toward = [], []
        for b in range(blocks):
            y = unit @ maps[t, b].T
            points.append(nearest_e8(y))
            toward.append((y - points[-1]) @ steps().T)
        point = np.concatenate(points, axis=1)
        toward = np.concatenate(toward, axis=1)
        best = np.argpartition(-toward, probes, axis=1)[:, :probes]
        # Twice the coordinates are whole numbers; a step changes those of one block.
        twice = (2 * point).astype(np.int64).view(np.uint64)
        own = (twice * fold).sum(axis=1, dtype=np.uint64)
        step = (2 * steps()).astype(np.int64).view(np.uint64)
        change = np.concatenate([(step * fold[8 * b:8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(blocks)])
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + change[best]
    return out


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares stay in range
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _links(unit: np.ndarray, own: np.ndarray, seen: np.ndarray, table: int, side: np.ndarray, ids: np.ndarray, threshold: float):
    """Linked pairs (i, j) that meet here, and which of them meet here first. ``side`` 0 or 1: only pairs across; 2: all."""
    left, right = (np.arange(len(ids)),) * 2 if side[0] == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for rows in np.array_split(left, max(1, -(-len(left) * len(right) // 2_000_000))):
        near = unit[rows] @ unit[right].T >= threshold
        if side[0] == 2:
            near &= rows[:, None] < right
        near &= own[rows][:, None] | own[right]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        for at in range(0, len(i), PAIRS):
            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
            before = np.zeros(len(a), dtype=bool)
            for t in range(table):
                before |= (seen[b, t] == seen[a, t, :1]).any(axis=1) | (seen[a, t, 1:] == seen[b, t, :1]).any(axis=1)
            # In this table too, two can meet in either's cell: the smaller id's counts.
            host, guest = np.where(own[a], a, b), np.where(own[a], b, a)
            apart = ~(own[a] & own[b])
            mutual = (seen[host, table, 1:] == seen[guest, table, :1]).any(axis=1)
            yield a, b, ~before & ~(apart & mutual & (ids[host] > ids[guest]))


def link_classes(classes: DataFrame, scratch: Scratch, threshold: float = COSINE, block: int = BLOCK, **tables) -> DataFrame:
    """(class_id, other, links): links to add to a class, and with ``other`` not null a link of the forest.

    ``classes`` has one row each with ``class_id``, ``label``, ``embedding`` and ``copies``.
    """
    number, probes = tables.get("tables", TABLES), tables.get("probes", PROBES)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            codes: list[bytes] = [b""] * len(vectors)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 2_000)):
                    unit = unit_vectors(np.array([vectors[k] for k in part], dtype=np.float64))
                    for k, found in zip(part, cells(unit, **tables), strict=True):
                        codes[k] = found.tobytes()
            columns = [batch.column(c) for c in ("class_id", "label", "copies")]
            flat = [np.asarray(v, dtype=np.float64).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dims.astype(np.int32)), pa.array(flat, type=pa.binary()), pa.array(codes, type=pa.binary())],
                                             names=["class_id", "label", "copies", "dim", "vector", "codes"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = number * (1 + probes)
        for batch in batches:
            n = batch.num_rows
            repeat = np.repeat(np.arange(n), each)
            cell = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(repeat)) for c in ("class_id", "label", "dim")] + [
                pa.array(np.tile(np.repeat(np.arange(number, dtype=np.int32), 1 + probes), n)), pa.array(cell),
                pa.array(np.tile(np.arange(1 + probes) == 0, n * number))], names=["class_id", "label", "dim", "table", "cell", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and pair of blocks, so a group is done when the next one begins."""
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) < 2:
                return
            rows = pa.Table.from_batches(held)
            ids, copies = rows["class_id"].to_numpy(), rows["copies"].to_numpy()
            unit = unit_vectors(np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=np.float64).reshape(len(ids), -1))
            seen = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint64).reshape(len(ids), number, 1 + probes)
            own, side, table = rows["own"].to_numpy(), rows["side"].to_numpy(), rows["table"][0].as_py()
            total, a, b = np.zeros(len(ids), dtype=np.int64), [], []
            for i, j, first in _links(unit, own, seen, table, side, ids, threshold):
                total += np.bincount(i[first], copies[j[first]], len(ids)).astype(np.int64) + np.bincount(j[first], copies[i[first]], len(ids)).astype(np.int64)
                small, large = forest(ids[i], ids[j])
                a.append(small)
                b.append(large)
            if not a:
                return
            node, least = forest(np.concatenate(a), np.concatenate(b))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], node])), pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), least]), mask=np.arange(len(some) + len(node)) < len(some)),
                                              pa.array(np.concatenate([total[some], np.zeros(len(node), dtype=np.int64)]))], names=["class_id", "other", "links"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if group[a] != last:
                    yield from done()
                    held, last = [], group[a]
                held.append(batch.slice(a, b - a))
        yield from done()

    kind = dict(classes.dtypes)["label"]
    coded = scratch.table(classes.mapInArrow(code, f"class_id bigint, label {kind}, copies bigint, dim int, vector binary, codes binary"), "coded")
    members = coded.select("class_id", "label", "dim", "codes").mapInArrow(enter, f"class_id bigint, label {kind}, dim int, table int, cell bigint, own boolean")
    # Only cells where two meet, one of them at home; each in as many blocks as its size needs.
    full = members.groupBy(*KEY).agg(F.count("*").alias("m"), F.max("own").alias("lived")).where("m >= 2 AND lived")
    full = full.select(*KEY, F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    met = members.join(full, KEY).withColumn("at", F.pmod(F.xxhash64("class_id"), "blocks").cast("int"))
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = met.select("class_id", *KEY, "own", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"),
                      F.when(F.col("at") == F.col("to"), 2).when(F.col("at") < F.col("to"), 0).otherwise(1).alias("side"))
    rows = pair.join(coded.select("class_id", "copies", "vector", "codes"), "class_id")
    # Groups are told apart by a digest of their key; the sort keeps them together.
    key = [*KEY, "i", "j"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "class_id")
    return rows.select("class_id", "copies", "vector", "codes", "own", "side", "table",
                       F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in key]), 256).alias("group")).mapInArrow(compare, "class_id bigint, other bigint, links bigint")


def near_vectors(vectors: DataFrame, threshold: float = COSINE, **settings) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is ``threshold`` or
    more. A null label, a null, empty or zero vector, one with a null, infinite
    or undefined component, or one of another length, links with nothing: such a row
    has no links and is its own component. ``component_id`` is the smallest id
    reachable, null ids apart; a row with a null id is never ``kept``. Repeated
    rows are vectors of their own, linked with each other. An empty table gives
    no row.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "lattice")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    # Adding zero makes the two zeros one, so that equal vectors have equal digests.
    clean = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = clean.withColumn("sound", F.coalesce(sound, F.lit(False)))
    digest = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", "label", F.lit(1)).alias("h2")]
    distinct = clean.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.table(distinct.select(F.monotonically_increasing_id().alias("class_id"), "label", "embedding", "first", "copies", *digest), "classes")
    found = scratch.table(link_classes(classes.select("class_id", "label", "embedding", "copies"), scratch, threshold, **settings), "links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    reached = components(found.where("other IS NOT NULL").select(F.col("class_id").alias("a"), F.col("other").alias("b")), scratch)
    reached = reached.withColumnRenamed("node", "class_id")
    whole = classes.select("class_id", "first", "copies", "h1", "h2").join(links, "class_id", "left").join(reached, "class_id", "left")
    whole = whole.withColumn("component", F.coalesce("component", "class_id"))
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = whole.join(least, "component").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = scratch.table(whole, "whole")
    # Rows that link with nothing get a digest that no class has: null.
    rows = clean.select("vec_id", *[F.when(F.col("sound"), h).alias(h_name) for h, h_name in zip(digest, ("h1", "h2"), strict=True)])
    out = rows.join(whole, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
