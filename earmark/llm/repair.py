"""Token ids in files, packed by Re-Pair grammars.

A shard is a run of documents in id order, some ``SHARD_TOKENS`` tokens. Its ids
are packed by replacing frequent adjacent pairs by new symbols, round after
round, until no pair is there ``LEAST`` times: each round takes all pairs that
are at least a tenth (``DOWN``) as frequent as the most frequent one, the more
frequent pair first where two overlap. No pair crosses from one document into the next, so a document can be decoded alone.

A shard file is binary: a magic word, six counts, then as 32-bit integers the
rules (left and right symbol), each rule's expansion length, each document's
end in symbols, each document's tokens, and the sequence of symbols. Shards are
the rows of a Parquet folder, beside the ids of their documents, so that they
can be in any store and lost tasks are written anew.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from earmark.llm.common import SLICE_BYTES, Scratch, give_back, vocabulary_path

WORD_49K, END = "word_bpe_49k.json", 1
SHARD_TOKENS = 1 << 20
#: A pair that is there less often is left as it is.
LEAST, DOWN = 8, 10
#: Words and pieces whose ids a task remembers; doesn't change a result.
REMEMBERED = 500_000
#: How the vocabulary lowers and cuts words, and the same for words of characters that are never composed or white space.
RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
PLAIN = "[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+"
MAGIC = b"RPAIR001"
SHARDS = "part int, seq int, tokens bigint, doc_ids array<bigint>, shard binary"


class Words:
    """Encodes texts with the tokenizers library, each distinct piece of a word once.

    The vocabulary drops white space and never merges across it, so a text's
    ids are those of its words one after the other. A word of printable ASCII and
    Latin-1 letters is what `RULES` make of it: lower case, cut into pieces that are
    merged each for itself. So words that differ by case or punctuation share
    their pieces, and what was met before needn't be encoded again. Other words go to the library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        parts = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.cuts = all(parts) and [json.loads(x.__getstate__()) for x in parts] == RULES
        self.of_cut = Tokenizer(self.tokenizer.model)  # for what is lowered and cut already
        self.of_cut.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids, ends = _flat(self.of_words(coded.dictionary).take(coded.indices))
        return np.split(ids, ends[split.offsets.to_numpy()[1:-1]])

    def of_words(self, some: pa.Array) -> pa.Array:
        """The ids of words, as bytes."""
        alone = set()
        if self.cuts:
            plain = pc.match_substring_regex(some, f"^{PLAIN}$")
            for content in self.added:
                plain = pc.and_not(plain, pc.match_substring(some, content))
            cut = pc.replace_substring_regex(pc.utf8_lower(some), PIECE, r"\0 ")
            alone.update(some.filter(pc.invert(plain)).to_pylist())
            some = pc.if_else(plain, pc.ascii_rtrim_whitespace(cut), some)
        split = pc.ascii_split_whitespace(some)
        coded = split.flatten().dictionary_encode()
        found = self.of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), lambda p: not self.cuts or p in alone)
        pieces = pa.array(found, type=pa.large_binary()).take(coded.indices)
        # A word's ids are those of its pieces, one after the other.
        ids, ends = _flat(pieces)
        begins = (4 * ends[split.offsets.to_numpy()]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(begins), pa.py_buffer(ids)])

    def of_pieces(self, some: list[str], uncut: Callable[[str], bool]) -> list[bytes]:
        """The ids of distinct pieces, and of words that are ``uncut``."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known = self.known
        found = list(map(known.get, some))
        new = [p for p, ids in zip(some, found, strict=True) if ids is None]
        if not new:
            return found
        if self.older:
            before = list(map(self.older.get, new))
            known.update((p, ids) for p, ids in zip(new, before, strict=True) if ids is not None)
            new = [p for p, ids in zip(new, before, strict=True) if ids is None]
        whole = list(filter(uncut, new))
        pieces = list(filterfalse(uncut, new)) if whole else new
        for at in range(0, len(pieces), 1000):  # many in one text
            part = pieces[at:at + 1000]
            one = self.of_cut.encode(" ".join(part), add_special_tokens=False)
            ends = (4 * np.cumsum(np.bincount(one.word_ids, minlength=len(part)))).tolist()
            packed = np.array(one.ids, dtype=np.uint32).tobytes()
            known.update(zip(part, [packed[a:b] for a, b in pairwise([0, *ends])], strict=True))
        for at in range(0, len(whole), 10_000):
            part = whole[at:at + 10_000]
            known.update((p, np.array(x.ids, dtype=np.uint32).tobytes()) for p, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return list(map(known.__getitem__, some))


def _flat(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of packed ids, and where each value begins in them, with the end of the last."""
    _, ends, data = packed.buffers()
    return np.frombuffer(data or b"", dtype=np.uint32), np.frombuffer(ends, dtype=np.int64)[:len(packed) + 1] // 4


@cache
def words(path: str) -> Words:
    return Words(path)


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by their pair of symbols of so many bits, and how many there are of each pair."""
    wide, left = int(at.max(initial=0)).bit_length(), left.astype(np.int64)
    if 2 * bits + wide < 64:  # pair and place fit one number
        packed = np.sort((left << bits | right) << wide | at)
        pair, at = packed >> wide, packed & (1 << wide) - 1
    else:
        pair = left << 32 | right
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
    edges = np.ones(len(pair) + 1, dtype=bool)
    edges[1:-1] = pair[1:] != pair[:-1]
    return at, np.diff(np.flatnonzero(edges))


def replace_pairs(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Re-Pair: rules (n, 2), the sequence, each document's end in it, each rule's length, and the first new symbol.

    ``ends`` are the documents' ends in ``symbols``, ascending.
    """
    n, base = len(symbols), int(symbols.max()) + 1 if len(symbols) else 0
    closes = np.zeros(n, dtype=bool)  # the last symbol of a document
    closes[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    symbols, rules, lengths = symbols.astype(np.uint32), np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    # A replaced pair is its first place, its second place is gone: those left are linked. Place n is none.
    after, before, gone = np.arange(1, n + 2), np.arange(-1, n), np.zeros(n + 1, dtype=bool)
    before[0] = n
    outside = np.iinfo(np.int32).max
    rank, kind = np.full(n + 1, outside, dtype=np.int32), np.empty(n, dtype=np.int32)

    def digests(places: np.ndarray) -> np.ndarray:
        return ((symbols[places] * np.uint32(0x9E3779B1) ^ symbols[after[places]] * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.intp)

    # Rough counts by a small digest: only pairs that may be frequent are counted exactly. Both are kept up to date.
    none = 1 << 18
    digest, inside = np.full(n, none), np.flatnonzero(~closes)
    digest[inside] = digests(inside)
    rough = np.bincount(digest, minlength=none + 1)
    rough[none] = 0
    open_ = None  # the places of pairs that can still be frequent, once all that are there LEAST times are taken
    while True:
        enough = max(LEAST, rough.max() // DOWN)
        while True:
            at = np.flatnonzero((rough >= enough)[digest]) if open_ is None else open_
            at, counts = _grouped(symbols[at], symbols[after[at]], at, (base + len(rules)).bit_length())
            # Pairs that share a digest make it look frequent: where none is, all that may be are counted.
            if open_ is not None or enough == LEAST or (len(counts) and counts.max() >= enough):
                break
            enough = LEAST
        if not len(counts) or counts.max() < LEAST:
            break
        least = max(LEAST, counts.max() // DOWN)
        firsts = at[np.cumsum(counts) - counts]
        left, right = symbols[firsts].astype(np.int64), symbols[after[firsts]].astype(np.int64)
        # The more frequent pair first; alike ones by key. Of overlapping places the better one wins, from the left.
        order, chosen = np.argsort(-counts, kind="stable"), counts >= least
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        at = at[np.repeat(chosen, counts)]
        rank[at] = kind[at] = np.repeat(place[chosen], counts[chosen])
        every = at = np.sort(at)  # neighbours in memory are read together
        taken = []
        while len(at):
            own, ahead = rank[at], rank[before[at]]
            win = (own < ahead) & (own <= rank[after[at]])
            if not win.any():  # a run of one pair: its first places, those after no open place
                win = ahead == outside
            won = at[win]
            taken.append(won)
            for over in (before[won], won, after[won]):
                rank[over] = outside
            at = at[rank[at] < outside]
        won = np.concatenate(taken)
        pairs = order[kind[won]]
        used = np.zeros(len(order), dtype=bool)
        used[pairs] = True
        new = np.stack([left[used], right[used]], axis=1)
        size = np.where(new < base, 1, lengths[np.maximum(new - base, 0)] if len(lengths) else 1).sum(axis=1)
        symbols[won] = base + len(rules) + (np.cumsum(used) - 1)[pairs]
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size])
        second, first = after[won], before[won]
        gone[second] = True
        first = first[(first < n) & ~gone[first]]
        closes[won] = closes[second]
        after[won] = after[second]
        before[after[won]] = won
        # Only the pairs at a replaced place and before it are new.
        touched = np.concatenate([won, first])
        if open_ is not None or enough == least == LEAST:
            # A pair that wasn't chosen is there less than LEAST times and won't be more: symbols of before aren't made again.
            open_ = np.unique(np.concatenate([touched, every[~gone[every]]]))
            open_ = open_[~closes[open_]]
        else:
            rough -= np.bincount(digest[touched], minlength=none + 1) + np.bincount(digest[second], minlength=none + 1)
            digest[second] = digest[touched] = none
            inside = touched[~closes[touched]]
            digest[inside] = digests(inside)
            rough += np.bincount(digest[inside], minlength=none + 1)
            rough[none] = 0
    left_over = ~gone[:n]
    symbols, closes = symbols[left_over], closes[left_over]
    closed = np.concatenate([[0], np.flatnonzero(closes) + 1])
    full = np.cumsum(np.diff(ends, prepend=0) > 0)  # documents without ids end where the one before does
    return rules, symbols, closed[full], lengths, base


def pack(texts_ids: list[np.ndarray]) -> bytes:
    """A shard of documents' ids."""
    tokens = np.array([len(x) for x in texts_ids], dtype=np.int64)
    every = np.concatenate(texts_ids) if texts_ids else np.zeros(0, dtype=np.uint32)
    rules, symbols, ends, lengths, base = replace_pairs(every, np.cumsum(tokens))
    counts = np.array([1, base, len(rules), len(tokens), len(symbols), len(every)], dtype="<i8")
    return MAGIC + counts.tobytes() + b"".join(x.astype("<u4").tobytes() for x in (rules.ravel(), lengths, ends, tokens, symbols))


class Shard:
    """A packed shard, read for whole or for single documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        _, self.base, n_rules, n_docs, n_symbols, self.n_tokens = np.frombuffer(data, "<i8", 6, 8).tolist()
        every = np.frombuffer(data, "<u4", offset=56).astype(np.int64)
        sizes = np.cumsum([2 * n_rules, n_rules, n_docs, n_docs, n_symbols])
        rules, self.lengths, self.ends, self.tokens, self.symbols = np.split(every, sizes)[:5]
        self.rules = rules.reshape(-1, 2)
        # Where each rule's expansion begins in one table of all of them.
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.table = np.zeros(int(self.lengths.sum()), dtype="<u4")
        # A rule is expanded once both its symbols are: level by level.
        inner, level = np.maximum(self.rules - self.base, 0), np.zeros(n_rules, dtype=np.int64)
        while n_rules:
            next_level = 1 + np.where(self.rules < self.base, 0, level[inner]).max(axis=1)
            if np.array_equal(next_level, level):
                break
            level = next_level
        order = np.argsort(level, kind="stable")
        for rules in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            size = self.lengths[rules]
            at = np.repeat(self.begins[rules] - np.cumsum(size) + size, size) + np.arange(size.sum())
            self.table[at] = self.expand(self.rules[rules].ravel())

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.base
        if not len(self.lengths):
            return symbols.astype("<u4")
        plain, rule = rule < 0, np.maximum(rule, 0)
        length = np.where(plain, 1, self.lengths[rule])
        starts = np.cumsum(length) - length
        at = np.repeat(np.where(plain, 0, self.begins[rule]) - starts, length)
        at += np.arange(len(at))
        out = self.table[at]
        out[starts[plain]] = symbols[plain]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of one document; only its own symbols are expanded."""
        return self.expand(self.symbols[self.ends[k - 1] if k else 0:self.ends[k]])

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), np.cumsum(self.tokens)[:-1])


def write(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``doc_id`` and ``text`` of ``docs`` and write shards in ascending id order into ``folder``.

    Null texts are empty; each document ends with id ``END``. Rows of one id lie
    together, in the order of a digest of their text; null ids come first. A
    document is never cut, so a shard holds at least one whole.
    """
    path = path or vocabulary_path(WORD_49K)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def done() -> pa.RecordBatch:
            columns = [[part], [seq], [size], [ids], [pack(held)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "seq", "tokens", "doc_ids", "shard"])

        end = np.array([END], dtype=np.uint32)
        for batch in batches:
            doc_ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
            step = max(1, SLICE_BYTES * len(texts) // max(texts.nbytes, 1))
            for begin in range(0, len(texts), step):
                for found in words(path).encode(texts.slice(begin, step)):
                    if held and size + len(found) >= shard_tokens:
                        yield done()
                        seq, ids, held, size = seq + 1, [], [], 0
                    ids.append(doc_ids[at])
                    held.append(np.concatenate([found, end]))
                    size, at = size + len(held[-1]), at + 1
        if held:
            yield done()
        give_back()

    order = ["doc_id", "digest"]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("digest"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(shards, SHARDS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, place, doc_id, n_tokens, ids_crc32, token_ids) of every document in the shards of ``folder``."""
    return _decode(spark.read.schema(SHARDS).parquet(folder), with_ids=True).drop("before")


def _decode(shards: DataFrame, with_ids: bool) -> DataFrame:
    names = ["part", "seq", "place", "doc_id", "before", "n_tokens", "ids_crc32", "token_ids"][:7 + with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = Shard(batch.column("shard")[k].as_py()).documents()
                n, sizes = len(found), np.array([len(x) for x in found], dtype=np.int64)
                columns = [pa.array(np.full(n, batch.column(c)[k].as_py(), dtype=np.int32)) for c in ("part", "seq")]
                columns += [pa.array(np.arange(n, dtype=np.int32)), batch.column("doc_ids")[k].values, pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                            pa.array([zlib.crc32(x) for x in found], type=pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, seq int, place int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids
    return shards.mapInArrow(decode, schema)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, token_ids) of some documents; only their own symbols are expanded."""
    wanted = set(doc_ids)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("doc_ids")[k].as_py()
                places = [p for p, i in enumerate(ids) if i in wanted]
                shard = Shard(batch.column("shard")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([ids[p] for p in places], type=pa.int64()),
                                                  pa.array([shard.document(p).astype(np.int32) for p in places], type=pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    shards = spark.read.schema(SHARDS).parquet(folder).where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in doc_ids])))
    return shards.mapInArrow(some, "doc_id bigint, token_ids array<int>")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` sums the tokens before it: of earlier parts (one row a part), of
    earlier shards in its part, and of earlier documents in its shard, which is
    summed where the shard is decoded.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)
    sizes = shards.select("part", "seq", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))
    # One row for each task that wrote.
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before_part"))
    in_part = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    begins = sizes.select("part", "seq", in_part.alias("before_shard")).join(parts, "part")
    rows = _decode(shards, with_ids=False).join(begins, ["part", "seq"])
    return rows.select("doc_id", (F.col("before_part") + F.col("before_shard") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and index the files. An empty table gives no row."""
    folder = Scratch(docs.sparkSession, "repair").path("shards")
    write(docs, folder, path)
    return index(docs.sparkSession, folder)
