"""Packing documents into sequences of a fixed length by swap-based local search.

Texts are encoded, an end id is added, and what is longer than a sequence is
cut so that only the first piece may be short. The pieces are dealt into shards
of some ``SHARD`` pieces. A shard starts from best fit, then improves its
underfull bins: the fullest one takes from the others, by one exchange after
the other, what fills it best. An exchange moves a piece, swaps one for one, or
swaps two for one, always so that the sum of squared fills grows; so the
emptier bins run empty. Bins that are still underfull are dealt anew, whole,
into fewer shards and searched again from what they hold, until one shard holds
them all or they no longer get much fewer. What a task holds is bounded by
``SHARD``, nothing is collected, and every round is a written table.

A null text is empty: a piece of the end id alone. Repeated rows are packed one
by one; ids may be null. An empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, give_back, slices, vocabulary_path

LENGTH, END = 2048, 0
#: The ranks of byte_bpe_50k.json and its one special token, which that file's tokenizer finds in texts, too.
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
#: Pieces of a shard, on average.
SHARD = 1 << 16
#: Emptiest bins that are asked for two pieces at once; passes over the underfull bins of a shard.
DONORS, PASSES = 24, 3


@cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes-50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str | None, path: str, end: int = END) -> np.ndarray:
    """The ids of a whole text and the end id."""
    return np.append(encoder(path).encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.array([end], dtype="<u4"))


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Begin and end of each piece of ``n`` ids: all of full length but the first."""
    first = (n - 1) % length + 1
    ends = range(first, n + 1, length)
    return [(max(0, e - length), e) for e in ends]


def pieces(docs: DataFrame, scratch: Scratch, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``row`` (unique), ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece, and ``ids`` if asked for."""
    path = path or vocabulary_path(RANKS)
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * with_ids + ">>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, counts = [], [0]
            for texts in slices(batch, 2 << 20):
                for text in texts:
                    ids = encode(text, path)
                    some = cuts(len(ids), length)
                    for k, (a, b) in enumerate(some):
                        rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *[ids[a:b].astype(np.int32)] * with_ids))
                    counts.append(len(some))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            values = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(counts), type=pa.int32()), values)
        give_back()

    found = docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")
    return scratch.table(found.select(F.monotonically_increasing_id().alias("row"), *found.columns), "pieces")


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins (lists of places in ``sizes``), each piece where the least room is left, the longest first."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has room r
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(at)
        else:
            room, b = length, len(bins)
            bins.append([at])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class Search:
    """The underfull bins of a shard and where their pieces of each size are."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], length: int):
        self.length, self.sizes = length, sizes
        self.held: list[dict[int, list[int]]] = []  # of each bin, by size
        self.fill: list[int] = []
        self.where: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of a size: heap of (fill then, bin); may be out of date
        self.there: Counter[int] = Counter()
        self.sizes_there = 0  # bit s: a bin that may give has a piece of size s
        self.open: list[bool] = []
        for one in bins:
            held: dict[int, list[int]] = defaultdict(list)
            for at in one:
                held[int(sizes[at])].append(at)
            self.held.append(held)
            self.fill.append(int(sizes[one].sum()))
            self.open.append(True)
        self.reopen(range(len(bins)))

    def reopen(self, some) -> None:
        self.where.clear()
        self.there.clear()
        self.sizes_there = 0
        for b in some:
            self.open[b] = True
            for size, pieces_ in self.held[b].items():
                self._come(b, size, len(pieces_))

    def _come(self, b: int, size: int, n: int = 1) -> None:
        if not self.there[size]:
            self.sizes_there |= 1 << size
        self.there[size] += n
        heapq.heappush(self.where[size], (self.fill[b], b))

    def _go(self, size: int, n: int = 1) -> None:
        self.there[size] -= n
        if not self.there[size]:
            self.sizes_there &= ~(1 << size)

    def close(self, b: int) -> None:
        self.open[b] = False
        for size, pieces_ in self.held[b].items():
            self._go(size, len(pieces_))

    def giver(self, size: int, most: int) -> int | None:
        """An open bin with a piece of this size, about the emptiest, that is filled less than ``most``."""
        heap = self.where[size]
        while heap:
            fill, b = heap[0]
            if not self.open[b] or size not in self.held[b]:
                heapq.heappop(heap)
            elif fill != self.fill[b]:
                heapq.heapreplace(heap, (self.fill[b], b))
            else:
                return b if fill < most else None
        return None

    def best(self, b: int, donors: list[int]) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(gain of the fill, giver, sizes that come, sizes that go) of the exchange that fills ``b`` best; b itself is closed."""
        room, fill = self.length - self.fill[b], self.fill[b]
        own = list(self.held[b])
        leaving = [(0, ())] + [(x, (x,)) for x in own]
        leaving += [(x + y, (x, y)) for i, x in enumerate(own) for y in own[i:] if x != y or len(self.held[b][x]) > 1]
        found, gain = None, 0
        for total, out in leaving:
            window = (self.sizes_there >> (total + gain + 1)) & ((1 << (room - gain)) - 1)
            while window:  # the largest piece that comes first
                more = window.bit_length() + gain
                giver = self.giver(total + more, fill + more)
                if giver is not None:
                    found, gain = (more, giver, (total + more,), out), more
                    break
                window &= (1 << (window.bit_length() - 1)) - 1
            if gain == room:
                return found
        for a in donors:
            if a == b or not self.open[a]:
                continue
            theirs = list(self.held[a])
            for i, x in enumerate(theirs):
                for y in theirs[i:]:
                    if x == y and len(self.held[a][x]) < 2:
                        continue
                    for total, out in leaving[:len(own) + 1]:
                        more = x + y - total
                        if gain < more <= room and self.fill[a] < fill + more:
                            found, gain = (more, a, (x, y), out), more
            if gain == room:
                break
        return found

    def exchange(self, b: int, giver: int, come: tuple[int, ...], go: tuple[int, ...]) -> None:
        moved = [(size, self._take(giver, size)) for size in come], [(size, self._take(b, size)) for size in go]
        self.fill[b] += sum(come) - sum(go)
        self.fill[giver] -= sum(come) - sum(go)
        for size in come:
            self._go(size)
        for size, at in moved[0]:
            self.held[b][size].append(at)
        for size, at in moved[1]:
            self.held[giver][size].append(at)
            self._come(giver, size)

    def _take(self, b: int, size: int) -> int:
        at = self.held[b][size].pop()
        if not self.held[b][size]:
            del self.held[b][size]
        return at

    def improve(self) -> bool:
        """One pass from the fullest bin down; whether anything was exchanged."""
        order = sorted((b for b in range(len(self.fill)) if 0 < self.fill[b] < self.length), key=lambda b: -self.fill[b])
        self.reopen(order)
        changed, closed, donors = False, 0, []
        heap = [(-self.fill[b], b) for b in order]
        heapq.heapify(heap)
        while heap:
            fill, b = heapq.heappop(heap)
            if not self.open[b] or not self.fill[b]:
                continue
            if -fill != self.fill[b]:  # it gave since
                heapq.heappush(heap, (-self.fill[b], b))
                continue
            self.close(b)
            if closed % 64 == 0:
                donors = [a for a in reversed(order) if self.open[a] and self.fill[a]][:DONORS]
            closed += 1
            while self.fill[b] < self.length:
                step = self.best(b, donors)
                if step is None:
                    break
                self.exchange(b, step[1], step[2], step[3])
                changed = True
        return changed

    def bins(self) -> list[list[int]]:
        return [[at for some in held.values() for at in some] for held, fill in zip(self.held, self.fill, strict=True) if fill]


def pack(sizes: np.ndarray, length: int = LENGTH, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of places in ``sizes``; with ``bins``, never more than those."""
    fresh = best_fit(sizes, length)
    start = fresh if bins is None or len(fresh) < len(bins) else bins
    fills = [int(sizes[b].sum()) for b in start]
    full = [b for b, f in zip(start, fills, strict=True) if f == length]
    search = Search(sizes, [b for b, f in zip(start, fills, strict=True) if f < length], length)
    for _ in range(PASSES):
        if not search.improve():
            break
    return full + search.bins()


def _packer(length: int, round_: int, columns: list[str]):
    def place(table: pa.Table) -> pa.Table:
        """One shard's rows with their bins."""
        sizes, shard = table["length"].to_numpy(), table["shard"][0].as_py()
        old = None
        if round_:
            at, old = table["sequence_id"].to_numpy(), []
            order = np.argsort(at, kind="stable")
            old = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]
        bins = pack(sizes, length, old)
        number, offset, full = np.zeros((3, len(sizes)), dtype=np.int64)
        for k, one in enumerate(bins):
            number[one] = (round_ << 56) | (shard << 24) | k
            ends = np.cumsum(sizes[one])
            offset[one] = ends - sizes[one]
            full[one] = ends[-1] == length
        return table.select(columns).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("full", pa.array(full.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the shard that is being read; they come in order of shards
        for batch in batches:
            if not len(batch):
                continue
            shards = batch.column("shard").to_numpy()
            if held and held[0].column("shard")[0].as_py() != shards[0]:
                yield from place(pa.Table.from_batches(held)).to_batches()
                held = []
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a:
                    yield from place(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from place(pa.Table.from_batches(held)).to_batches()
        give_back()

    return run


def assign(rows: DataFrame, scratch: Scratch, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``rows`` (with ``row``, unique, and ``length``, at most ``length``) with ``sequence_id`` and ``offset``."""
    columns, done, round_ = rows.columns, [], 0
    n = rows.count()
    shards, deal = max(1, -(-n // shard)), "row"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint, full boolean"
    while True:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64(deal, F.lit(round_)), F.lit(shards)))
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
        packed = scratch.table(dealt.mapInArrow(_packer(length, round_, columns), kinds), f"packed-{round_}")
        left = packed.where("NOT full").count()
        fewer = max(1, -(-left // shard))
        # Less than a quarter is gained by going on where that many bins stay underfull.
        if shards == 1 or not left or 4 * fewer > 3 * shards:
            done.append(packed)
            break
        done.append(packed.where("full"))
        rows, shards, deal, round_ = packed.where("NOT full").drop("offset", "full"), fewer, "sequence_id", round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def pack_table(docs: DataFrame, length: int = LENGTH, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece; ``docs`` has ``doc_id`` and ``text``."""
    scratch = Scratch(docs.sparkSession, "packing")
    placed = assign(pieces(docs, scratch, length, path), scratch, length, shard)
    return placed.drop("row")


def sequences(docs: DataFrame, length: int = LENGTH, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row a sequence: ``sequence_id``, ``token_ids`` and ``spans`` (doc_id, piece, offset, length) in order of place."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, scratch, length, path, with_ids=True)
    placed = assign(cut.drop("ids"), scratch, length, shard)
    parts = placed.join(cut.select("row", "ids"), "row")
    listed = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return parts.groupBy("sequence_id").agg(listed.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("spans"))

