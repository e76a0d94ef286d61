"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints within ``max_distance`` bits (an even number) have a word
halfway: at most half the distance from either. So every distinct fingerprint
emits all words within half the distance (2,081 for 4 bits), the words are
shuffled, and fingerprints that emit the same word are linked. That is complete
and, since both are within half the distance of that word, never wrong; the
links are checked by a bit count all the same. Within a word the links form a
star, so a word shared by many costs one link a fingerprint, not one a pair.

The words are dealt with in ``PASSES`` rounds, each with those of one linear
syndrome (a few parities of the word), and only that round's words are in the
shuffle at a time, packed by bucket. Which words a round needs follows from the
fingerprint's own syndrome, so that no word is made in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, give_back, slices, without_old_shuffles
from earmark.llm.components import components, forest

WORDS, SEED, MAX_DISTANCE = 4, 42, 4
PASSES = 8
#: Emitted words of a bucket, on average; bounds the memory of a task.
BUCKET = 2_000_000
#: Fingerprints whose words are made at a time.
CHUNK = 8_192
#: Parities that make the syndrome; any three independent masks do.
PARITIES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def fingerprint_of(text: str | None) -> int:
    """64 bits as a signed integer; a bit is 1 if set in over half of the shingles' hashes. No word: 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    data, n = b" ".join(words), max(len(words) - WORDS + 1, 1)
    begins, at = [], 0
    for w in words:
        begins.append(at)
        at += len(w) + 1
    ends = [*(b - 1 for b in begins[WORDS:]), len(data)] if len(words) >= WORDS else [len(data)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        some = np.array([digest(data[a:b], SEED) for a, b in zip(begins[at:min(at + (1 << 16), n)], ends[at:at + (1 << 16)], strict=False)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text column as a long; null counts as empty."""

    @F.arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t) for texts in slices(batch, 2 << 20) for t in texts], type=pa.int64())
        give_back()

    return fingerprints(text)


def as_hex(value: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def flips(distance: int) -> np.ndarray:
    """All words with up to ``distance`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(distance + 1) for bits in combinations(range(64), k)], dtype=np.uint64)


def syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for k, parity in enumerate(PARITIES):
        out |= (np.bitwise_count(words & parity).astype(np.int64) & 1) << k
    return out


def meet(distinct: DataFrame, scratch: Scratch, max_distance: int = MAX_DISTANCE) -> list[DataFrame]:
    """Tables of links (a, b) that connect all fingerprints within ``max_distance``; ``distinct`` has one row each."""
    if max_distance % 2:
        raise ValueError("the distance has to be even")
    radius = flips(max_distance // 2)
    by_syndrome = [radius[syndrome(radius) == s] for s in range(PASSES)]
    n = distinct.count()
    buckets = max(1, -(-n * len(radius) // (PASSES * BUCKET)))
    names = ["bucket", "words"]

    def emit(number: int):
        def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in batches:
                held.append(batch.column("fingerprint").to_numpy())
                while sum(map(len, held)) >= CHUNK:
                    every = np.concatenate(held)
                    yield pack(every[:CHUNK])
                    held = [every[CHUNK:]]
            if sum(map(len, held)):
                yield pack(np.concatenate(held))
            give_back()

        def pack(signed: np.ndarray) -> pa.RecordBatch:
            own = signed.view(np.uint64)
            kinds, parts = syndrome(own), []
            for s in range(PASSES):
                mine, masks = own[kinds == s], by_syndrome[s ^ number]
                parts.append(np.stack([(mine[:, None] ^ masks).ravel(), np.repeat(mine, len(masks))]))
            pairs = np.concatenate(parts, axis=1)
            bucket = ((pairs[0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))])
            words, owners = pairs[0][order], pairs[1][order]
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            # A word is its owner but for a few bits: what differs packs well.
            blobs = [np.concatenate([owners[cuts[k]:cuts[k + 1]], words[cuts[k]:cuts[k + 1]]]).tobytes() for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, type=pa.binary())], names=names)

        return emitted

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, words = [], []
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                both = np.frombuffer(blob, dtype=np.uint64)
                owners.append(both[:len(both) // 2])
                words.append(both[len(both) // 2:])
        a, b = np.zeros((2, 0), dtype=np.uint64)
        if owners:
            owner, word = np.concatenate(owners), np.concatenate(words)
            owners, words = [], []
            order = np.argsort(word)
            owner, word = owner[order], word[order]
            same = word[1:] == word[:-1]
            first = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(word))))
            a, b = owner[first[1:][same]], owner[1:][same]
            near = np.bitwise_count(a ^ b) <= max_distance
            a, b = forest(a[near], b[near])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        give_back()

    out = []
    for number in range(PASSES):
        packed = distinct.select("fingerprint").mapInArrow(emit(number), "bucket int, words binary")
        links = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(link, "a bigint, b bigint")
        path = scratch.path("links")
        without_old_shuffles(distinct.sparkSession, lambda: links.write.parquet(path))  # noqa: B023
        found = distinct.sparkSession.read.schema(links.schema).parquet(path)
        found._scratch = path
        out.append(found)
    return out


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id``, ``root`` and ``text_hash`` of every row.

    ``component_id`` is the smallest id of the rows whose fingerprints are
    reachable over links (null only if all of them have a null id) and ``root``
    a key of that group. Texts without a word (null ones too) have fingerprint
    0, which links like any other. Repeated rows are rows of one group. An
    empty table gives no row. Only ``doc_id`` and ``text`` are read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint("text").alias("fingerprint")), "fingerprints")
    distinct = scratch.table(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    links = meet(distinct, scratch, max_distance)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    reached = components(every, scratch).withColumnRenamed("node", "fingerprint")
    roots = distinct.join(reached, "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = scratch.table(roots.join(least, "root").select("fingerprint", "root", "component_id"), "classes")
    scratch.drop(*links)
    return rows.join(classes, "fingerprint").select("doc_id", as_hex("fingerprint").alias("fingerprint"), "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each group, the one with the smallest id; same columns.

    Rows that repeat an id and text count as one. Groups with no id at all keep
    one row as well.
    """
    found = groups(docs, max_distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count("*").alias("n"))
    chosen = Scratch(docs.sparkSession, "chosen").table(chosen.select("one.*", "n"), "chosen")
    free = "_".join(docs.columns).replace(".", "_")  # longer than any name there
    key, digest = f"{free}_id", f"{free}_hash"
    wanted = chosen.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest))
    kept = docs.join(wanted, same, "left_semi")
    if chosen.where("n > 1").limit(1).count():  # an id and text may be there twice
        kept = kept.withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return kept
