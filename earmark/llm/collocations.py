"""Phrases that belong together, by dynamic itemset counting over cyclic shard scans.

Texts become runs of word ids in ``SHARDS`` shards, and words are counted on the
way. The shards are scanned in turn, round and round. A longer phrase is
counted from the step after which both its subphrases (without its last word,
without its first) have been seen often enough so far, however few shards that
took, until it has been through every shard once. So lengths interleave, and
the scans end when nothing has become frequent for a full cycle: what could
have been activated has been seen everywhere by then.

Counters that stay behind are given up: one is kept while it has at least the part
of ``least`` that the shards it has been through are of all. Seen again, the phrase
begins anew. A phrase that is there ``least`` times has a shard, going round, from which it
never stays behind, so it is counted through a whole cycle from there or from
before. For that, what begins in its first cycle is followed for another one.

A scan must not make every phrase of its shard. Bitmaps of fixed size hold a
digest's bit for each phrase that is frequent so far, where bits are only ever
set, and for each open counter. A phrase is activated when the bits of both its subphrases are set (and
theirs, down to its words), and is counted in the steps where that is so but
was not yet so a cycle ago, and later while its counter is open. A bit that two phrases share at most counts a
phrase in vain; a counter that is through doesn't change. Counts live in a table that each step merges with
the shard's counts in one aggregate, with sums taken before the shuffle.

A word's id is half of a digest of its language and itself; should two frequent words
have one id, the other half tells, and all is done again with another seed. A phrase is the bytes of its ids.
In the end the texts are read once more for the words of phrases that may be returned.

Null texts have no words, a null language is ``und``, repeated rows count again,
an empty table gives no row, and other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, give_back, slices, without_old_shuffles

LEAST, LONGEST, TOP = 100, 5, 2_000
SHARDS = 2
#: Bits of a bitmap.
BITS = 1 << 25
#: Ids of a row of a shard, and ids worked on at a time; words a task remembers.
ROW, CHUNK, REMEMBERED = 1 << 15, 1 << 20, 200_000
#: Bytes of a dictionary in the files of shards. Ids are digests, which pack as numbers of a dictionary only; by default one has no room for the words of a file.
DICTIONARY = 16 << 20
#: Parts in which the best of a language are found before they are ranked.
PARTS = 64
#: What ends a piece, as a byte that no UTF-8 text has.
BREAK = b"\xff"
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
#: Shards of totals and of words.
TOTALS, WORDS = -1, -2
TOKENS = "shard int, ids array<bigint>, checks array<bigint>, counts array<bigint>, code bigint, lang string, n bigint"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, with ``BREAK`` where a piece ends."""
    return (text or "").encode().lower().translate(_BREAKS).replace(BREAK, b" \xff ").split()


def digest(lang: bytes, word: bytes, seed: int) -> bytes:
    """A word's id and a second number to tell it from another word with that id, eight bytes each."""
    value = xxhash.xxh3_128_digest(lang + b"\0" + word, seed)
    return value if any(value[:8]) else b"\1" + value[1:]


class Numbers(dict):
    """Numbers by word of one language, whose digests go to ``digests``; 0 for the end of a piece."""

    def __init__(self, lang: str, seed: int, digests: bytearray):
        super().__init__({BREAK: 0})
        self.lang, self.seed, self.digests, self.places = lang.encode(), seed, digests, []

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self.digests) // 16
        self.digests += digest(self.lang, word, self.seed)
        self.places.append(value)
        return value


def code_of(lang: str, seed: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(lang.encode(), seed), "little", signed=True)


def _shards(shards: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        known: dict[str, Numbers] = {}
        digests = bytearray(16)  # of all words in ``known``
        counts = np.zeros(1, dtype=np.int64)
        totals: dict[str, int] = {}
        held: list[np.ndarray] = []

        def batch_of(shard: list[int], **given: list) -> pa.RecordBatch:
            types = {"ids": pa.list_(pa.int64()), "checks": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "code": pa.int64(), "lang": pa.string(), "n": pa.int64()}
            columns = [pa.array(given[c], type=t) if c in given else pa.nulls(len(shard), t) for c, t in types.items()]
            return pa.RecordBatch.from_arrays([pa.array(shard, type=pa.int32()), *columns], names=["shard", *types])

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number
            every = np.concatenate(held)
            held.clear()
            at = 0
            while at < len(every):  # a very long text is cut where a piece ends
                ends = np.flatnonzero(every[at + ROW:at + 2 * ROW] == 0) if len(every) - at > 2 * ROW else []
                cut = at + ROW + int(ends[0]) + 1 if len(ends) else len(every) if len(every) - at <= 2 * ROW else _next_end(every, at + ROW)
                yield batch_of([number % shards], ids=[every[at:cut]])
                number, at = number + 1, cut

        def words() -> Iterator[pa.RecordBatch]:
            nonlocal counts
            both = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 2)
            for lang, numbers in known.items():
                for at in range(0, len(numbers.places), ROW):
                    some = numbers.places[at:at + ROW]
                    yield batch_of([WORDS], ids=[both[some, 0]], checks=[both[some, 1]], counts=[counts[some]], code=[code_of(lang, seed)])
            known.clear()
            digests[16:] = b""
            counts = np.zeros(1, dtype=np.int64)

        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in slices(batch.column("text"), 1 << 20):
                found: list[np.ndarray] = []
                for text in texts:
                    lang, at = langs[at], at + 1
                    lang = "und" if lang is None else lang
                    numbers = known.get(lang)
                    if numbers is None:
                        numbers = known[lang] = Numbers(lang, seed, digests)
                    some = tokens(text)
                    one = np.fromiter(map(numbers.__getitem__, some), dtype=np.int64, count=len(some))
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(one))
                    found += [one, np.zeros(1, dtype=np.int64)]
                ids = np.frombuffer(bytes(digests), dtype="<i8")[::2]
                counts = np.pad(counts, (0, len(ids) - len(counts)))
                every = np.concatenate(found)
                counts += np.bincount(every, minlength=len(ids))
                for one in found:
                    held.append(ids[one])
                    if sum(map(len, held)) >= ROW:
                        yield from full()
                if len(ids) > REMEMBERED:
                    yield from words()
        if held:
            yield from full()
        yield from words()
        yield batch_of([TOTALS] * len(totals), lang=list(totals), n=list(totals.values()), code=[code_of(x, seed) for x in totals])
        give_back()

    return rows


def _names(wanted, seed: int):
    """The words whose ids may be wanted, once a task."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[bytes]] = {}
        said: dict[str, set[bytes]] = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in slices(batch.column("text"), 1 << 20):
                for text in texts:
                    lang, at = langs[at], at + 1
                    seen.setdefault("und" if lang is None else lang, set()).update(tokens(text))
                if sum(map(len, seen.values())) > REMEMBERED:
                    yield from named(seen, said)
        yield from named(seen, said)
        give_back()

    def named(seen: dict[str, set[bytes]], said: dict[str, set[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, some in seen.items():
            before = said.setdefault(lang, {BREAK})
            words, code = list(some - before), lang.encode()
            ids = np.frombuffer(b"".join(digest(code, w, seed) for w in words), dtype="<i8")[::2]
            there = np.flatnonzero(_has(wanted.value, mixed(np.full(len(ids), 1, dtype=np.uint64), ids)))
            found = [words[i] for i in there.tolist()]
            before.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array([w.decode() for w in found], type=pa.string())], names=["id", "word"])
        seen.clear()

    return names


def _next_end(every: np.ndarray, at: int) -> int:
    ends = np.flatnonzero(every[at:] == 0)
    return at + int(ends[0]) + 1 if len(ends) else len(every)


def mixed(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Digests of phrases that are one id longer than those of ``before``."""
    x = (before ^ ids.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _has(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    bit = digests & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _phrases(ids: np.ndarray, at: np.ndarray, digests: np.ndarray, k: int) -> pa.RecordBatch:
    """Phrases of ``k`` ids that begin at places ``at``, each once with its count."""
    _, first, which, n = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
    for j in range(k):
        if (ids[at + j] != ids[at[first][which] + j]).any():  # two phrases with one digest: left to the aggregate
            first, n = np.arange(len(at)), np.ones(len(at), dtype=np.int64)
            break
    matrix = np.stack([ids[at[first] + j] for j in range(k)], axis=1) if len(first) else np.zeros((0, k), dtype=np.int64)
    offsets = (np.arange(len(first) + 1) * 8 * k).astype(np.int32)
    phrase = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])
    return pa.RecordBatch.from_arrays([phrase, pa.array(n.astype(np.int64))], names=["phrase", "n"])


def counted(ids: np.ndarray, frequent: np.ndarray, before: np.ndarray, open_: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """The phrases of ``ids`` to count, by the bitmaps of now and of a cycle ago, and by that of open counters."""
    at = np.flatnonzero(ids)
    digests = mixed(np.full(len(at), 1, dtype=np.uint64), ids[at])
    were = np.ones(len(at), dtype=bool)  # whether they were counted a cycle ago
    for k in range(2, longest + 1):
        # Of the phrases one shorter, those frequent so far, and which of them were so a cycle ago.
        stay = _has(frequent, digests)
        at, digests = at[stay], digests[stay]
        old = were[stay] & _has(before, digests)
        # One begins where the other's second word is.
        both = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else np.array([], dtype=np.int64)
        both = both[ids[at[both] + k - 1] != 0]
        were = old[both] & old[both + 1]
        at, digests = at[both], mixed(digests[both], ids[at[both] + k - 1])
        count = ~were | _has(open_, digests)
        if count.any():
            yield _phrases(ids, at[count], digests[count], k)


def _scan(frequent, before, open_, longest: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for row in batch.column("ids"):
                held.append(np.append(row.values.to_numpy(), np.zeros(longest, dtype=np.int64)))
                if sum(map(len, held)) >= CHUNK:
                    yield from counted(np.concatenate(held), frequent.value, before.value, open_.value, longest)
                    held = []
        if held:
            yield from counted(np.concatenate(held), frequent.value, before.value, open_.value, longest)
        give_back()

    return scan


def _bits(bits: int):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("phrase").to_pylist()
            digests = np.full(len(rows), 1, dtype=np.uint64)
            lengths = np.array([len(r) // 8 for r in rows], dtype=np.int64)
            for k in range(int(lengths.max(initial=0))):
                some = np.flatnonzero(lengths > k)
                digests[some] = mixed(digests[some], np.frombuffer(b"".join(rows[i][8 * k:8 * k + 8] for i in some.tolist()), dtype=np.int64))
            bit = digests & np.uint64(bits - 1)
            mask = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array(mask)], names=["slot", "mask"])

    return slots


def bitmap_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bits of all ``phrase``; never more than ``bits`` / 64 rows come to the driver."""
    found = phrases.select("phrase").mapInArrow(_bits(bits), "slot int, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(shards: DataFrame, words: DataFrame, scratch: Scratch, n_shards: int, least: int, longest: int, bits: int) -> DataFrame:
    """``phrase`` and ``f`` of all phrases of 2 to ``longest`` words that are there ``least`` times; ``words`` has the ``phrase`` of frequent words."""
    spark = scratch.spark
    state, step, last = spark.createDataFrame([], "phrase binary, f bigint, since int, risen int"), 0, -1
    none = np.zeros(bits // 64, dtype=np.uint64)
    bitmaps, open_ = [*[none] * n_shards, bitmap_of(words, bits)], none  # those of the last cycle
    # What begins in the cycle after the last change is through a cycle later.
    while step <= last + n_shards or (open_.any() and step < last + 2 * n_shards):
        shared = [spark.sparkContext.broadcast(b) for b in (bitmaps[-1], bitmaps[0], open_)]
        here = shards.where(F.col("shard") == step % n_shards).select("ids")
        new = here.mapInArrow(_scan(*shared, longest), "phrase binary, n bigint")
        both = state.select("phrase", "f", F.lit(0).cast("long").alias("n"), "since", "risen").unionByName(
            new.select("phrase", F.lit(0).cast("long").alias("f"), "n", F.lit(step).alias("since"), F.lit(None).cast("int").alias("risen")))
        merged = both.groupBy("phrase").agg(F.sum("f").alias("f"), F.sum("n").alias("n"), F.min("since").alias("since"), F.min("risen").alias("risen"))
        # What was first seen a cycle ago has its whole count.
        merged = merged.withColumn("f", F.col("f") + F.when(F.col("since") + n_shards > step, F.col("n")).otherwise(0)).drop("n")
        merged = merged.withColumn("risen", F.coalesce("risen", F.when(F.col("f") >= least, step)))
        been = F.least(F.lit(step + 1) - F.col("since"), F.lit(n_shards))
        old, state = state, scratch.table(merged.where(F.col("f") * n_shards >= been * F.lit(least).cast("long")), f"state-{step}")
        if step:
            scratch.drop(old)
        for b in shared:
            b.destroy()
        risen = state.where((F.col("risen") == step) & (F.length("phrase") < 8 * longest))
        bitmaps = [*bitmaps[1:], bitmaps[-1] | bitmap_of(risen, bits)]
        open_ = bitmap_of(state.where(F.col("since") + n_shards > step + 1), bits)
        last = step if (bitmaps[-1] != bitmaps[-2]).any() else last
        step += 1
    return state.where("risen IS NOT NULL").select("phrase", "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's ``top`` phrases; ``docs`` has ``text`` and ``lang``."""
    spark = docs.sparkSession
    scratch, seed, done = Scratch(spark, "collocations"), 0, []
    while True:
        path = scratch.path("shards")
        write = docs.select("text", "lang").mapInArrow(_shards(shards, seed), TOKENS).write.partitionBy("shard")
        write.option("parquet.dictionary.page.size", DICTIONARY).option("compression", "zstd").parquet(path)
        every = spark.read.schema(TOKENS).parquet(path)
        totals = every.where(F.col("shard") == TOTALS).groupBy("code", "lang").agg(F.sum("n").alias("n"))
        words = every.where(F.col("shard") == WORDS).select("code", F.inline(F.arrays_zip("ids", "checks", "counts"))).groupBy("ids").agg(
            F.sum("counts").alias("f"), F.min("code").alias("code"), (F.min("checks") < F.max("checks")).alias("two")).where(F.col("f") >= least)
        without_old_shuffles(spark, lambda: done.append(scratch.table(words.select(_bytes("ids").alias("phrase"), "f", "code", "two"), "words")))
        words = done.pop()
        scratch.delete(f"{path}/shard={WORDS}")
        if words.where("two").isEmpty() and totals.groupBy("code").count().where("count > 1").isEmpty():
            break
        scratch.delete(path)
        scratch.drop(words)
        seed += 1
    without_old_shuffles(spark, lambda: done.append(frequent_phrases(every, words, scratch, shards, least, longest, bits)))
    found = done.pop()
    frequent = words.select("phrase", "f").unionByName(found)
    size = F.length("phrase")
    # Within a longer one that is there as often; one word more is enough to look at, as counts only fall with length.
    wider = found.where(size > 16).select(F.explode(F.array(F.substring("phrase", F.lit(1), size - 8), F.substring("phrase", F.lit(9), size - 8))).alias("phrase"), F.col("f").alias("wide"))
    wider = wider.groupBy("phrase").agg(F.max("wide").alias("wide"))
    alone = found.join(wider, "phrase", "left").where("wide IS NULL OR wide < f").select("phrase", F.col("f").alias("a"))
    cut = alone.select("phrase", "a", F.explode(F.sequence(F.lit(1), (size / 8).cast("int") - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.substring("phrase", F.lit(1), F.col("k") * 8).alias("head"), F.substring("phrase", F.col("k") * 8 + 1, size - F.col("k") * 8).alias("tail"))
    cut = cut.join(frequent.select(F.col("phrase").alias("head"), F.col("f").alias("l")), "head").join(frequent.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), "tail")
    first = words.select(F.col("phrase").alias("first"), "code")
    scored = cut.withColumn("first", F.substring("phrase", F.lit(1), F.lit(8))).join(first, "first").join(totals, "code")
    score = F.expr("(1000 * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(16,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    rows = scored.groupBy("phrase").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"), worst)
    rows = rows.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # Whatever its words, a phrase behind ``top`` better ones isn't returned, so it needs no name.
    for within in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= top)
    without_old_shuffles(spark, lambda: done.append(scratch.table(rows, "best")))
    rows = done.pop()
    # Names: one row a word of a phrase.
    places = rows.select("phrase", F.posexplode(F.transform(F.sequence(F.lit(1), size, F.lit(8)), lambda b: F.substring("phrase", b, F.lit(8)))).alias("at", "word_id"))
    shared = spark.sparkContext.broadcast(bitmap_of(places.select(F.col("word_id").alias("phrase")).distinct(), bits))
    names = docs.select("text", "lang").mapInArrow(_names(shared, seed), "id bigint, word string").distinct()
    names = scratch.table(names.select(_bytes("id").alias("word_id"), "word").join(places.select("word_id").distinct(), "word_id", "left_semi"), "names")
    shared.destroy()
    said = places.join(names, "word_id").groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("said"))
    rows = rows.join(said, "phrase").withColumn("phrase", F.col("said"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _bytes(column: str):
    """The eight bytes of a long, lowest first, as numpy writes them."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(column, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)]))
