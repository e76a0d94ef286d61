"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A leaf holds ``LEAF`` pre-tokens or so: its characters and its tokens. Inner
nodes hold the sums of both. An edit descends by characters to the leaf it
touches, steps back ``CONTEXT`` pre-tokens (as far as an edit can change how
the text before it is split) and splits the text anew from there until a border
falls on an old leaf's end behind the edit. From such a border on the old split
holds, since the pattern never looks back. Only the leaves in between are
encoded again, and only the sums above them change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.bpe import vocabulary
from earmark.llm.common import slices, vocabulary_path

BYTE_50K = "byte_bpe_50k.tiktoken"
LEAF, CONTEXT = 64, 2
#: Pre-tokens whose counts a task remembers; doesn't change a result.
REMEMBERED = 400_000


class Counter:
    """Tokens of pre-tokens, by the vocabulary's merges."""

    def __init__(self, path: str):
        self.vocabulary, self.known = vocabulary(path), {}
        self.pattern = regex.compile(PATTERN)

    def learn(self, words: set[str]) -> None:
        """Count those not known yet, all in one go."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        hard = []
        for word in new:
            if word.encode() in self.vocabulary.ranks:
                self.known[word] = 1
            else:
                hard.append(word)
        self.known.update((w, len(ids) // 4) for w, ids in zip(hard, self.vocabulary.encode_pieces([w.encode() for w in hard]), strict=True))

    def count(self, words: list[str]) -> int:
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return sum([self.known[w] for w in words])


@cache
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """Characters and tokens of a document's leaves and their sums, as two heaps."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.build(leaves)

    def build(self, leaves: list[tuple[int, int]]) -> None:
        self.n, size = len(leaves), 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (chars, tokens) in enumerate(leaves):
            self.chars[size + i], self.tokens[size + i] = chars, tokens
        for i in range(size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> list[tuple[int, int]]:
        return list(zip(self.chars[self.size:self.size + self.n], self.tokens[self.size:self.size + self.n], strict=True))

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (or the last one), and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


class Document:
    """A text with its tree. ``reencoded`` counts the pre-tokens that edits made it encode again."""

    def __init__(self, text: str, count: Counter, leaves: list[tuple[int, int]] | None = None, words: list[str] | None = None):
        self.text, self.count, self.reencoded = text, count, 0
        self.tree = Tree(self._leaves(count.pattern.findall(text) if words is None else words) if leaves is None else leaves)

    def _leaves(self, words: list[str]) -> list[tuple[int, int]]:
        runs = [words[i:i + LEAF] for i in range(0, len(words), LEAF)]
        return [(sum(map(len, run)), self.count.count(run)) for run in runs]

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1]

    def edit(self, start: int, end: int, insert: str) -> None:
        """Replace the characters from ``start`` to ``end``; places outside the text are moved to its ends."""
        self.recount(*self.split_anew(start, end, insert))

    def split_anew(self, start: int, end: int, insert: str) -> tuple[int, int, list[str]]:
        """Edit the text; the leaves (first, behind the last) to replace and the pre-tokens that do."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if start == end and not insert:
            return 0, 0, []
        tree, pattern = self.tree, self.count.pattern
        old, self.text = self.text, self.text[:start] + insert + self.text[end:]
        if not tree.n:
            return 0, 0, pattern.findall(self.text)
        # The first leaf to split anew: with CONTEXT pre-tokens between its beginning and the one that the edit touches.
        first, begin = tree.find(max(start - 1, 0))
        while first and sum(1 for _ in pattern.finditer(old, begin, max(start - 1, begin))) < CONTEXT + 1:
            first -= 1
            begin -= tree.chars[tree.size + first]
        last, at = tree.find(max(end - 1, 0))
        border = at + tree.chars[tree.size + last]  # the end of ``last``, in the old text
        shift, words, done = len(insert) - (end - start), [], False
        for match in pattern.finditer(self.text, begin):
            words.append(match.group())
            here = match.end() - shift
            while border < here and last + 1 < tree.n:
                last += 1
                border += tree.chars[tree.size + last]
            if here == border and here >= end and match.end() >= start + len(insert) and border < size:
                done = True
                break
        if not done:
            last = tree.n - 1
        return first, last + 1, words

    def recount(self, first: int, behind: int, words: list[str]) -> None:
        """Put the leaves of ``words`` in the place of those from ``first`` to ``behind``."""
        if first == behind and not words:
            return
        self.reencoded += len(words)
        new = self._leaves(words)
        if len(new) == behind - first:
            for k, (chars, tokens) in enumerate(new):
                self.tree.put(first + k, chars, tokens)
        else:
            leaves = self.tree.leaves()
            leaves[first:behind] = new
            self.tree.build(leaves)


FIELDS = "tokens_before bigint, tokens_after bigint, reencoded bigint, leaf_chars array<int>, leaf_tokens array<int>, edited string"


def count_edited(text: Column | str, edits: Column | str, path: str | None = None) -> Column:
    """A struct of ``FIELDS``: the counts, the tree's leaves after the edits, and the edited text.

    ``edits`` is an array of (start, end, insert) in characters, applied in
    order, each to the text that the one before left; null places count as 0,
    null inserts as empty, null edits as none.
    """
    path = path or vocabulary_path(BYTE_50K)

    @F.arrow_udf(FIELDS)
    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = counter(path)
        for texts, changes in batches:
            columns: list[list] = [[] for _ in range(6)]
            at = 0
            for some in slices(texts):
                todo, at = changes.slice(at, len(some)).to_pylist(), at + len(some)
                split = [count.pattern.findall(t or "") for t in some]
                count.learn(set().union(*split))
                ones = [Document(t or "", count, words=w) for t, w in zip(some, split, strict=True)]
                before = [one.n_tokens for one in ones]
                todo = [[e for e in edits or () if e is not None] for edits in todo]
                for k in range(max(map(len, todo), default=0)):  # the k-th edits of all, so that new words are counted together
                    anew = [(one, one.split_anew(e[k]["start"] or 0, e[k]["end"] or 0, e[k]["insert"] or "")) for one, e in zip(ones, todo, strict=True) if k < len(e)]
                    count.learn(set().union(*[words for _, (_, _, words) in anew]))
                    for one, change in anew:
                        one.recount(*change)
                for one, n in zip(ones, before, strict=True):
                    leaves = one.tree.leaves()
                    for column, value in zip(columns, (n, one.n_tokens, one.reencoded, [x[0] for x in leaves], [x[1] for x in leaves], one.text), strict=True):
                        column.append(value)
            types = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    return counted(text, edits)


def count_table(docs: DataFrame, edits: Column) -> DataFrame:
    """``doc_id`` and ``FIELDS`` of every row of ``docs`` under the edits of its row.

    Null texts count as empty, repeated rows are documents of their own, and
    columns that aren't asked for aren't read.
    """
    return docs.select("doc_id", count_edited("text", edits).alias("c")).select("doc_id", "c.*")
