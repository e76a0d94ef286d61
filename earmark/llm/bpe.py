"""Byte-level BPE by a hierarchical-bitmap rank queue.

The pre-tokens that a task hasn't met before are laid out one after the other
as one linked list of byte tokens. Every adjacent pair that can merge puts its
position into the bucket of its merge rank; a bitmap of three levels marks the
buckets in use, so that the lowest rank is found by three find-first-set steps
however many ranks there are. A bucket is emptied at once: positions whose pair
has changed meanwhile are stale and are skipped, and in a chain of overlapping
pairs every second one, from the left, is merged. Work is in proportion to the
bytes, so a pre-token of megabytes costs no more a byte than a short word.

Emptying a bucket at once gives the result of one-by-one merging if no merge
makes a pair of lower rank than its own. That holds where each token is what
its own bytes encode to; ``Vocabulary`` checks the tokens for which it isn't
plain from the ranks, and merges one pair a pre-token at a time otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import give_back, kept, read_ranks, slices, vocabulary_path

MULTI_50K = "byte_bpe_multi_50k.tiktoken"
#: Runs between spaces whose ids a task remembers, and characters of one that it remembers at most. Neither changes a result.
REMEMBERED, REMEMBERED_BYTES = 400_000, 200
#: Bytes that go through one queue, but for a single longer pre-token.
QUEUE_BYTES = 1 << 20
#: Ids that are decoded together.
DECODED = 1 << 18


class RankQueue:
    """Buckets of positions by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.words = [[0] * (-(-ranks // 64 ** (k + 1))) for k in range(3)]
        self.words.append([0])  # its bits are the words of the third level
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.words:
            if len(level) == 1 and level is self.words[-1]:
                level[0] |= 1 << at
                break
            level[at >> 6] |= 1 << (at & 63)
            at >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, some maybe stale or there twice."""
        top = self.words[-1][0]
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        for level in self.words[-2::-1]:
            word = level[at]
            at = at << 6 | (word & -word).bit_length() - 1
        rank, left = at, at
        for level in self.words:
            if level is self.words[-1]:
                level[0] &= ~(1 << left)
                break
            level[left >> 6] &= ~(1 << (left & 63))
            if level[left >> 6]:
                break
            left >>= 6
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class Vocabulary:
    """Ranks of byte tokens, with all pairs of tokens that make a token."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        size = np.array([len(t) for t in self.tokens])
        self.layout = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.tokens), dtype=np.uint8)  # all tokens' bytes, one after the other
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, doubtful = {}, set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
                    if cut > 1 and left > rank or len(token) - cut > 1 and right > rank:
                        doubtful.add(token)
        # A hash table of the pairs, a quarter full at most.
        bits = max(4, (4 * len(pairs)).bit_length())
        self.spread, self.mask, self.shift = np.int64(0x2545F4914F6CDD1D), np.int64((1 << 62) - 1), np.int64(62 - bits)
        self.slots, self.made = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        for key, at in zip(pairs, ((np.array([*pairs], dtype=np.int64) * self.spread & self.mask) >> self.shift).tolist(), strict=True):
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.slots[at], self.made[at] = key, pairs[key]
        order = [bytes([a, b]) for a in range(256) for b in range(256)]
        self.byte_pairs = np.array([ranks.get(pair, self.size) for pair in order], dtype=np.int32)
        self.at_once = False
        self.at_once = all(len(ids) == 4 for ids in self.encode_pieces(sorted(doubtful)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, ``size`` if none."""
        keys = left.astype(np.int64) * self.size + right
        at = (keys * self.spread & self.mask) >> self.shift
        out = np.full(len(keys), self.size, dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):  # linear probing; an empty slot ends the search
            there = self.slots[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.made[at[hit]]
            on = ~hit & (there >= 0)
            open_, at = open_[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token by itself, packed as 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(pieces):
            to, total = at, 0
            while to < len(pieces) and (to == at or total + len(pieces[to]) <= QUEUE_BYTES):
                total += len(pieces[to])
                to += 1
            out += self._encode(pieces[at:to])
            at = to
        return out

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n, none = len(data), self.size
        ends = np.cumsum([len(p) for p in pieces])
        if not n:
            return [b"" for _ in pieces]
        ids = self.bytes[data]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0))
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # n and -1: no neighbour
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        after[last] = n
        before[np.append(0, last[:-1] + 1)] = -1
        rank = np.full(n + 1, none, dtype=np.int32)  # of the pair that begins at each place
        small = np.uint16 if none < 1 << 16 else np.int32
        alive = np.ones(n, dtype=bool)
        queue = RankQueue(self.size)

        def enqueue(places: np.ndarray) -> None:
            found = rank[places]
            some = found < none
            places, found = places[some], found[some]
            if not len(places):
                return
            order = np.argsort(found.astype(small), kind="stable")
            places, found = places[order], found[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(places)]
            for a, b, r in zip(cuts, cuts[1:], found[cuts[:-1]].tolist(), strict=False):
                queue.push(r, places[a:b])

        inner = np.flatnonzero(after < n).astype(np.int32)
        rank[inner] = self.byte_pairs[data[inner].astype(np.int64) << 8 | data[inner + 1]]
        enqueue(inner)
        while (popped := queue.pop()) is not None:
            r, places = popped
            places = places[alive[places] & (rank[places] == r)]
            if not len(places):
                continue
            if len(places) > 1:
                places.sort()
                places = places[np.append(True, places[1:] != places[:-1])]
            if self.at_once:
                # Overlapping pairs follow on each other: take every second of a chain.
                chained = np.zeros(len(places), dtype=bool)
                chained[1:] = after[places[:-1]] == places[1:]
                if chained.any():
                    index = np.arange(len(places))
                    start = np.maximum.accumulate(np.where(chained, 0, index))
                    places = places[(index - start) % 2 == 0]
            else:
                first = np.append(True, piece[places[1:]] != piece[places[:-1]])
                if not first.all():
                    queue.push(r, places[~first])
                places = places[first]
            gone = after[places]
            ids[places] = r
            alive[gone] = False
            behind = after[gone]
            after[places] = behind
            inside = behind < n
            before[behind[inside]] = places[inside]
            rank[places] = none
            with_next = places[inside]
            rank[with_next] = self.pair_ranks(ids[with_next], ids[after[with_next]])
            ahead = before[places]
            with_last = ahead[ahead >= 0]
            with_last = with_last[alive[with_last]]
            rank[with_last] = self.pair_ranks(ids[with_last], ids[after[with_last]])
            enqueue(np.concatenate([with_next, with_last]))
        left = np.flatnonzero(alive)
        cuts = np.cumsum(4 * np.bincount(piece[left], minlength=len(pieces))).tolist()
        packed = ids[left].astype(np.int32).tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


@kept
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


#: A space between two characters that are none always ends a pre-token: the pattern takes it with what follows.
alone = re.compile(r"(?<=\S) (?=\S)").split


class Encoder:
    """Encodes texts and remembers the runs between single spaces that it has met."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.runs: dict[str, bytes] = {}  # ids of a run with the space before it
        self.last: list[list[str]] = []

    def encode_all(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens; those that are no token themselves go through one queue."""
        ranks, found, hard = self.vocabulary.ranks, {}, []
        for piece in pieces:
            whole = ranks.get(piece.encode())
            if whole is None:
                hard.append(piece)
            else:
                found[piece] = whole.to_bytes(4, "little")
        found.update(zip(hard, self.vocabulary.encode_pieces([p.encode() for p in hard]), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as 32-bit integers; null has none."""
        split, runs = self.split, self.runs
        cut = [alone(t) if t else [""] for t in texts]
        # Runs after the first have a space before them.
        look = [list(map(runs.get, one)) for one in cut]
        new = {r: split(" " + r) for r in {r for one, ids in zip(cut, look, strict=True) if None in ids for r, i in zip(one, ids, strict=True) if i is None}}
        first = [split(one[0]) for one in cut]
        known = self.encode_all(set().union(*new.values(), *first)).__getitem__
        if len(runs) + len(new) > REMEMBERED:  # keep what this slice uses
            used = set().union(*cut)
            runs = self.runs = {r: ids for r, ids in runs.items() if r in used}
        runs.update((r, b"".join(map(known, pieces))) for r, pieces in new.items())
        out = []
        for one, ids, begin in zip(cut, look, first, strict=True):
            if None in ids:
                ids = list(map(runs.__getitem__, one))
            ids[0] = b"".join(map(known, begin))
            out.append(b"".join(ids))
        for r in new:
            if len(r) > REMEMBERED_BYTES:
                del runs[r]
        self.last = cut
        return out

    def rest(self) -> None:
        """Between tasks, only what the last slice used is remembered: workers live on, and other operators run in them."""
        used = set().union(*self.last)
        self.runs, self.last = {r: ids for r, ids in self.runs.items() if r in used}, []
        give_back()


@kept
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path)


def packed_lists(packed: list[bytes]) -> pa.Array:
    """Lists of 32-bit integers from their packed bytes."""
    ends = np.cumsum([0, *map(len, packed)]) // 4
    values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def encode(text: Column | str, path: str | None = None) -> Column:
    """Token ids (array of int) of a string column; null and empty texts have none.

    Special tokens are ordinary text. ``path`` names a rank file on every
    executor and defaults to the public multilingual one.
    """
    path = path or vocabulary_path(MULTI_50K)

    @F.arrow_udf("array<int>")
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path)
        for batch in batches:
            parts = [packed_lists(coder.encode(texts)) for texts in slices(batch, 2 << 20)]
            yield pa.concat_arrays(parts) if parts else packed_lists([])
        coder.rest()

    return token_ids(text)


def decoded_bytes(ids: pa.Array, words: Vocabulary) -> pa.Array:
    """Bytes of each list of ids."""
    size, begin, data = words.layout
    parts, step = [], max(1, DECODED * len(ids) // max(len(ids.values), 1))
    for at in range(0, len(ids), step):
        some = ids.slice(at, step).fill_null([])
        every = some.flatten().to_numpy(zero_copy_only=False)
        if every.dtype.kind != "i" or len(every) and (every.min() < 0 or every.max() >= len(size)):
            raise ValueError("an id outside the vocabulary")
        length = size[every]
        ends = np.concatenate([[0], np.cumsum(length)])
        taken = data[np.repeat(begin[every] - ends[:-1], length) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(some).to_numpy())])]
        parts.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(taken)]))
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.binary())


def encode_and_decode(text: Column | str, path: str | None = None) -> Column:
    """A struct of ``token_ids`` and ``round_trip``: whether the ids decode to the text's bytes. Null counts as empty."""
    path = path or vocabulary_path(MULTI_50K)

    @F.arrow_udf("token_ids array<int>, round_trip boolean")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path)
        for batch in batches:
            ids, same = [packed_lists([])], [pa.array([], type=pa.bool_())]
            for texts in slices(batch, 2 << 20):
                ids.append(packed_lists(coder.encode(texts)))
                same.append(pc.equal(decoded_bytes(ids[-1], coder.vocabulary), pa.array([(t or "").encode() for t in texts], type=pa.binary())))
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(same)], names=["token_ids", "round_trip"])
        coder.rest()

    return both(text)


def decode(ids: Column | str, path: str | None = None) -> Column:
    """Bytes of an array of token ids; null and empty arrays give no bytes.

    An id outside the vocabulary (or null) is an error, not a guess.
    """
    path = path or vocabulary_path(MULTI_50K)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(path)
        for batch in batches:
            yield decoded_bytes(batch, words)

    return decoded(ids)


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``token_ids`` of every row of ``docs`` (repeated rows stay).

    Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    return docs.select("doc_id", encode(F.coalesce("text", F.lit("")), path).alias("token_ids"))
