"""Spelling variants: words one edit apart, by dynamic programming over the sorted vocabulary.

Words are counted in tasks, then met in groups. Two words within one edit share
either their first half or their last, so a word goes into a group for each
half (of its own length, and of one less, where it may be the longer of a
pair). A group that is too large is split again: the part of the word where the
edit may be is halved, and what lies outside has to be equal. In the end such a
part is one character, and a group at most the letters in that place; so groups
stay bounded whatever the vocabulary, and each pair counts in one of them only.

A group's words are sorted. For each word the rows of the edit matrix, three
values wide, are worked out down the list: words with a common beginning (given
by the longest common prefixes of neighbours) share their rows, and a whole
range of words is skipped once its shared prefix is more than one edit away.
All words of a batch of groups take the steps together.

Words hold letters up to U+00FF, so a character is a byte of Latin-1. Null
texts have no words; a null id counts as the empty text in the digest; repeated
rows count again; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, give_back, slices

SHORTEST, LEAST, FACTOR, RARE = 7, 2, 10, 31
#: Letters of a group, above which it is split.
GROUP = 1 << 21
#: Distinct words a task counts before it hands them on; words that are looked up, and words in a batch of groups.
HELD, QUERIES, BATCH = 200_000, 4_096, 32_768


def words_of(text: str | None, doc_id: int | None, shortest: int = SHORTEST) -> Counter[str]:
    """The words of a text and how often they are there, after the deletions."""
    out: Counter[str] = Counter()
    if not text:
        return out
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_runs(shortest).findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), base)
        if h % RARE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def _runs(shortest: int) -> re.Pattern[str]:
    return re.compile(f"[a-z\\u00C0-\\u00FF]{{{shortest},}}")


def count_words(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``word`` and ``n`` of all words of ``text``, rows of ``docs`` with ``doc_id``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=pa.string()), pa.array(counts.values(), type=pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text")):
                for text in texts:
                    for word, n in words_of(text, ids[at], shortest).items():
                        counts[word] += n
                    at += 1
                if len(counts) > HELD:
                    yield flush()
        yield flush()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _key(word: Column, size: Column, begin: Column, end: Column) -> Column:
    """A group: pairs whose shorter word has ``size`` letters, alike outside [begin, end) of it."""
    after = size - end
    return F.xxhash64(size, begin, end, F.substring(word, F.lit(1), begin), F.substring(word, F.length(word) - after + 1, after))


def dealt(vocabulary: DataFrame, scratch: Scratch, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """``key``, ``size``, ``begin``, ``end``, ``word``, ``n``: every word in all its groups, none with much over ``group`` letters."""
    length, word = F.length("word"), F.col("word")
    size = F.explode(F.array(length, length - 1)).alias("size")
    sized = vocabulary.select("word", "n", size).where(F.col("size") >= shortest)
    half = F.floor(F.col("size") / 2).cast("int")
    parts = F.explode(F.array(F.struct(half.alias("begin"), F.col("size").alias("end")), F.struct(F.lit(0).alias("begin"), half.alias("end"))))
    rows = sized.select("word", "n", "size", parts.alias("p")).select("word", "n", "size", "p.begin", "p.end")
    keyed = scratch.table(rows.withColumn("key", _key(word, F.col("size"), F.col("begin"), F.col("end"))), "dealt")
    done = []
    while True:
        widths = keyed.groupBy("key", "size", "begin", "end").agg((F.count("*") * F.col("size")).alias("letters"))
        full = scratch.table(widths.where((F.col("letters") > group) & (F.col("end") - F.col("begin") > 1)).select("key"), "full")
        if full.isEmpty():
            break
        done.append(keyed.join(full, "key", "left_anti"))
        middle = F.floor((F.col("begin") + F.col("end")) / 2).cast("int")
        parts = F.explode(F.array(F.struct(F.col("begin"), middle.alias("end")), F.struct(middle.alias("begin"), F.col("end"))))
        split = keyed.join(full, "key", "left_semi").select("word", "n", "size", parts.alias("p")).select("word", "n", "size", "p.begin", "p.end")
        keyed = scratch.table(split.withColumn("key", _key(word, F.col("size"), F.col("begin"), F.col("end"))), "dealt")
    for more in done:
        keyed = keyed.unionByName(more)
    return keyed


def near(letters: np.ndarray, longer: np.ndarray, group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart, of sorted words of ``size`` letters and, where ``longer``, one more (a column; 0 where there is none).

    Rows are sorted by group and word; ``begin`` and ``end`` are those of a
    row's group. Pairs of two longer words, and pairs that another group has,
    aren't given.
    """
    n, size = len(letters), letters.shape[1] - 1
    differ = letters[1:] != letters[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), size + 1)
    common = np.append(-1, np.where(group[1:] == group[:-1], common, -1))
    # Where the ranges of words with the same first k letters begin, for each k, and which of them a row is in.
    starts = [np.flatnonzero(common < k) for k in range(size + 2)]
    found_a, found_b = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
    queries = np.flatnonzero(~longer)
    for at in range(0, len(queries), QUERIES):
        q = queries[at:at + QUERIES].astype(np.int32)
        low = starts[0][np.searchsorted(starts[0], q, side="right") - 1].astype(np.int32)
        # Three values of the matrix's row: one letter fewer of the word looked up, as many, one more.
        fewer, same, more = np.full(len(q), 2, np.uint8), np.zeros(len(q), np.uint8), np.ones(len(q), np.uint8)
        for depth in range(size + 1):
            if depth == size:  # words that end here
                done = (same == 1) & ~longer[low] & (low > q)
                found_a.append(q[done])
                found_b.append(low[done])
            # Into the ranges below: those of depth + 1 between a range's begin and the next of its depth.
            here, below = starts[depth], starts[depth + 1]
            after = np.searchsorted(here, low, side="right")
            high = np.where(after < len(here), here[np.minimum(after, len(here) - 1)], n)
            first, last = np.searchsorted(below, low), np.searchsorted(below, high)
            many = last - first
            row = np.repeat(np.arange(len(q)), many)
            low = below[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]].astype(np.int32)
            q, fewer, same, more = q[row], fewer[row], same[row], more[row]
            letter = letters[low, depth]
            there = letter > 0
            before = letters[q, depth - 1] != letter if depth else np.ones(len(q), bool)
            at_ = letters[q, depth] != letter
            behind = letters[q, depth + 1] != letter if depth < size else np.ones(len(q), bool)
            new_fewer = np.minimum(same + 1, fewer + before)
            new_same = np.minimum(np.minimum(more + 1, new_fewer + 1), same + at_)
            new_more = np.minimum(new_same + 1, more + behind)
            stay = there & (np.minimum(np.minimum(new_fewer, new_same), new_more) < 2)
            q, low, fewer, same, more = q[stay], low[stay], *(np.minimum(x[stay], 2).astype(np.uint8) for x in (new_fewer, new_same, new_more))
        done = fewer == 1  # longer words: one letter more than the word looked up
        found_a.append(q[done])
        found_b.append(low[done])
    a, b = np.concatenate(found_a).astype(np.int64), np.concatenate(found_b).astype(np.int64)
    # Alike up to the end of the part as well: the group of the part behind has this pair.
    stop = end[a]
    alike = np.zeros(len(a), dtype=bool)
    for k in np.unique(stop[stop < size]).tolist():
        some = stop == k
        alike[some] = (letters[a[some], :k] == letters[b[some], :k]).all(axis=1)
    return a[~alike], b[~alike]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word``, ``n``, ``n_near`` and the largest near word of each word of a group that has one there; rows come in order of size and key."""
    names = ["word", "n", "n_near", "near_n", "near"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        size = table["size"][0].as_py()
        words = table["word"].to_pylist()
        letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(size + 1, b"\0") for w in words), dtype=np.uint8).reshape(len(words), size + 1)
        n, key = table["n"].to_numpy(), table["key"].to_numpy()
        a, b = near(letters, letters[:, size] > 0, key, table["begin"].to_numpy(), table["end"].to_numpy())
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((b, -n[b], a))  # rows of a group are in order of words
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        count = np.diff(np.append(first, len(a)))
        own, best = a[first], b[first]
        take = pa.array(words, type=pa.string())
        return pa.RecordBatch.from_arrays([take.take(pa.array(own)), pa.array(n[own]), pa.array(count), pa.array(n[best]), take.take(pa.array(best))], names=names)

    held: list[pa.Table] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.concat_tables(held)
            held.clear()
            if len(table) > 1:
                yield solve(table)

    def whole_groups() -> Iterator[pa.Table]:
        """Groups in order, each whole."""
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys, sizes = batch.column("key").to_numpy(), batch.column("size").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(sizes) != 0)) + 1).tolist(), len(batch)]
            if open_ and (open_[0].column("key")[0].as_py() != keys[0] or open_[0].column("size")[0].as_py() != sizes[0]):
                yield pa.Table.from_batches(open_)
                open_ = []
            if len(edges) > 2:  # the groups that end in this batch at once
                yield pa.Table.from_batches([*open_, batch.slice(0, edges[1])])
                if len(edges) > 3:
                    inner = batch.slice(edges[1], edges[-2] - edges[1])
                    same = inner.column("size").to_numpy()
                    cut = [0, *(np.flatnonzero(np.diff(same)) + 1).tolist(), len(inner)]
                    for x, y in zip(cut, cut[1:], strict=False):
                        yield pa.Table.from_batches([inner.slice(x, y - x)])
                open_ = [batch.slice(edges[-2])]
            else:
                open_.append(batch)
        if open_:
            yield pa.Table.from_batches(open_)

    size = None
    for table in whole_groups():
        now = table["size"][0].as_py()
        if held and (now != size or sum(map(len, held)) + len(table) > BATCH):
            yield from flush()
        size = now
        held.append(table)
    yield from flush()
    give_back()


def group_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of at least ``shortest`` letters that is there ``least`` times.

    ``form`` is the near word of largest ``n`` if that is ``factor`` times the
    word's own, else null; ``root`` is where forms lead in the end.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    vocabulary = scratch.table(count_words(docs, shortest).where(F.col("n") >= least), "vocabulary")
    groups = dealt(vocabulary, scratch, shortest, group)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = groups.repartition(width, "key").sortWithinPartitions("size", "key", "word")
    met = scratch.table(placed.mapInArrow(_met, "word string, n bigint, n_near bigint, near_n bigint, near string"), "met")
    every = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    largest = F.min(F.when(F.col("near_n").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near"))))
    named = met.unionByName(every).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), largest.alias("best"))
    enough = -F.col("best.minus") >= factor * F.col("n")
    named = scratch.table(named.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "named")
    # Forms grow by the factor at every step, so chains are short; each round doubles the way that is known.
    known = scratch.table(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = scratch.table(longer, "roots")
        scratch.drop(known)
        known = new.select("word", "root")
        known._scratch = new._scratch
        if new.where("moved").isEmpty():
            break
    return named.join(known, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
