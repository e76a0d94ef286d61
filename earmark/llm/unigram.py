"""Language identification by unigrams summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, worked
out by the forward algorithm; a text's is the product over its words (runs of
letters, lower-cased, with the vocabulary's word mark in front). Characters the
vocabulary lacks are spelled with its byte pieces.

Fitting is expectation-maximisation on Spark: the words of a bounded sample
(``FIT_DOCS`` documents a language, drawn by a hash of the id) are counted by
language, and each round sums, over those counts, how often every piece is
expected. What reaches the driver and the tasks is one number a language and
piece, for all languages there are. Prediction reads every whole text.

Null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing could be learned (no rows, or no language given). Ties go to
the language first in code-point order. Repeated rows are predicted one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, give_back, kept, slices, vocabulary_path

PIECES = "piece_bpe_32k.model"
FIT_DOCS, ROUNDS = 2_000, 4
#: Words a task remembers when it predicts, and when it counts; words whose pieces are expected at a time. None changes a result.
REMEMBERED, COUNTED, AT_ONCE = 100_000, 50_000, 2_000
#: Weight, in pieces, of what all languages share in each one's probabilities.
SHARED = 200.0
#: Each character counts this much more likely while words are summed up, to stay within range; taken out again.
LIFT = 24.0
#: Words longer than this are summed up with a running scale.
LONG = 120
#: Where a sum falls below this at any place of a word, what was added to it may have vanished: the word is done again in logarithms.
TINY = 1e-200
#: Places of the words done in logarithms at a time.
PLACES = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary: a number for each piece, and all their beginnings."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.number, self.byte = {}, {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.number[piece] = i
        self.beginnings = {piece[:n] for piece in self.number for n in range(1, len(piece) + 1)}
        self.reach = max(map(len, self.number))
        state = {start: i + 1 for i, start in enumerate(sorted(self.beginnings))} | {"": 0}
        keys = sorted((state[start[:-1]] << 21 | ord(start[-1]), i) for start, i in state.items() if start)
        self.step_keys, self.step_to = np.array(keys, dtype=np.int64).T.copy()
        self.piece_of = np.full(len(state), -1)
        for piece, i in self.number.items():
            self.piece_of[state[piece]] = i
        self.length = np.ones(self.size)
        for piece, i in self.number.items():
            self.length[i] = len(piece)

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Every piece at every place of every word, as rows (word, end, length, piece) in order of end and length.

        All places walk down the tree of beginnings together, a character at a
        time. Pieces from ``size`` on are characters the vocabulary lacks; the
        list has the byte pieces of each.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        begins = np.diff(ends, prepend=0)
        word_of = np.repeat(np.arange(len(words)), begins)
        place = np.arange(len(chars)) - np.repeat(ends - begins, begins)
        left = np.repeat(ends, begins) - np.arange(len(chars))
        at, state, found, bare = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), [], None
        for length in range(1, self.reach + 1):
            near = left[at] >= length
            at, state = at[near], state[near]
            key = state << 21 | chars[at + length - 1]
            to = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            there = self.step_keys[to] == key
            here, state = at[there], self.step_to[to[there]]
            piece = self.piece_of[state]
            whole = piece >= 0
            if length == 1:
                bare = np.ones(len(chars), dtype=bool)
                bare[here[whole]] = False
            full = here[whole]
            found.append(np.array([word_of[full], place[full] + length, np.full(len(full), length), piece[whole]]))
            at = here
            if not len(at):
                break
        lacking, number = np.unique(chars[bare], return_inverse=True) if bare is not None else (np.array([], dtype=np.int64), np.array([], dtype=np.int64))
        if len(lacking):
            at = np.flatnonzero(bare)
            found.append(np.array([word_of[at], place[at] + 1, np.ones(len(at), dtype=np.int64), self.size + number]))
        rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
        rows = rows[:, np.argsort((rows[1] * 64 + rows[2]).astype(np.int16 if len(ends) and begins.max() < 500 else np.int64), kind="stable")]
        return rows, [[self.byte[b] for b in chr(c).encode()] for c in lacking.tolist()]


@kept
def pieces(path: str) -> Pieces:
    return Pieces(path)


def steps(rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The edges of each (end, length), in order: end, length, words, pieces. A word is there once."""
    key = rows[1] * 64 + rows[2]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
    return [(int(rows[1, a]), int(rows[2, a]), rows[0, a:b], rows[3, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def with_spelled(table: np.ndarray, spelled: list[list[int]]) -> np.ndarray:
    """``table`` (pieces x languages, lifted) with a row for each spelled character, lifted as one character."""
    return np.vstack([table, *[spell(table, one)[None] for one in spelled]]) if spelled else table


def spell(table: np.ndarray, byte_pieces: list[int]) -> np.ndarray:
    return table[byte_pieces].prod(axis=0) / LIFT ** (len(byte_pieces) - 1)


def with_spelled_logs(logs: np.ndarray, spelled: list[list[int]]) -> np.ndarray:
    """``logs`` (pieces x languages) with a row for each spelled character."""
    return np.vstack([logs, *[logs[one].sum(axis=0)[None] for one in spelled]]) if spelled else logs


def lowest(sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of ``sums`` (place, word, ...) over each word's own places."""
    own = (np.arange(len(sums))[:, None] <= ends).reshape(len(sums), len(ends), *[1] * (sums.ndim - 2))
    return sums.min(axis=0, where=own, initial=np.inf).reshape(len(ends), -1).min(axis=1)


def expected_by_logs(vocabulary: Pieces, words: list[str], lang: np.ndarray, weight: np.ndarray, logs: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` how often each piece is expected in words whose sums would leave the range of a double."""
    edges, spelled = vocabulary.edges(words)
    chance, order = with_spelled_logs(logs, spelled), steps(edges)
    ends, every = np.array([len(w) for w in words]), np.arange(len(words))
    forward, backward = np.full((2, ends.max() + 1, len(words)), -np.inf)
    forward[0], backward[ends, every] = 0.0, 0.0
    for end, length, at, piece in order:
        forward[end, at] = np.logaddexp(forward[end, at], forward[end - length, at] + chance[piece, lang[at]])
    whole = forward[ends, every]
    for end, length, at, piece in reversed(order):
        after = chance[piece, lang[at]] + backward[end, at]
        backward[end - length, at] = np.logaddexp(backward[end - length, at], after)
        found = np.exp(forward[end - length, at] + after - whole[at]) * weight[at]
        inside = piece < len(total)
        np.add.at(total, (piece[inside], lang[at[inside]]), found[inside])
        for p, w, amount in zip(piece[~inside], at[~inside], found[~inside], strict=True):
            np.add.at(total, (spelled[p - len(total)], lang[w]), amount)


@dataclass
class Model:
    """Languages in code-point order; probabilities by piece (row) and language."""

    languages: list[str]
    chances: np.ndarray
    path: str
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "chances": self.chances, "path": self.path, "known": {}, "rows": None}

    @property
    def lifted(self) -> np.ndarray:
        if not hasattr(self, "_lifted"):
            self._lifted = self.chances * LIFT ** pieces(self.path).length[:, None]
        return self._lifted

    @property
    def logs(self) -> np.ndarray:
        if not hasattr(self, "_logs"):
            self._logs = np.log(self.chances)
        return self._logs

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (with its word mark) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        short.sort(key=lambda i: len(words[i]))  # words of a length together: the tables are as long as the longest
        step = max(1, 40_000 // len(self.languages))
        for at in range(0, len(short), step):
            index = short[at:at + step]
            out[index] = self._short([words[i] for i in index])
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self._long(word)
        return out

    def _short(self, words: list[str]) -> np.ndarray:
        rows, spelled = pieces(self.path).edges(words)
        chances = with_spelled(self.lifted, spelled)
        ends = np.array([len(w) for w in words])
        forward = np.zeros((ends.max() + 1, len(words), len(self.languages)))
        forward[0] = 1.0
        for end, length, at, piece in steps(rows):
            forward[end, at] += forward[end - length, at] * chances[piece]
        low = np.flatnonzero(lowest(forward, ends) < TINY)
        forward = forward[ends, np.arange(len(words))]
        forward[low] = 1.0
        out = np.log(forward) - (ends * np.log(LIFT))[:, None]
        if len(low):
            out[low] = self._by_logs([words[i] for i in low])
        return out

    def _by_logs(self, words: list[str]) -> np.ndarray:
        rows, spelled = pieces(self.path).edges(words)
        chances = with_spelled_logs(self.logs, spelled)
        ends = np.array([len(w) for w in words])
        forward = np.full((ends.max() + 1, len(words), len(self.languages)), -np.inf)
        forward[0] = 0.0
        for end, length, at, piece in steps(rows):
            forward[end, at] = np.logaddexp(forward[end, at], forward[end - length, at] + chances[piece])
        return forward[ends, np.arange(len(words))]

    def _long(self, word: str) -> np.ndarray:
        vocabulary = pieces(self.path)
        number, beginnings = vocabulary.number, vocabulary.beginnings
        n = len(word)
        window = np.zeros((vocabulary.reach + 1, len(self.languages)))  # row k: k characters ahead of the place
        window[0], scale = 1.0, np.zeros(len(self.languages))  # a scale for each language: they drift apart
        for a in range(n):
            here = window[0]
            if word[a] not in number:
                window[1] += here * spell(self.lifted, [vocabulary.byte[b] for b in word[a].encode()])
            for b in range(a + 1, n + 1):
                part = word[a:b]
                if part in number:
                    window[b - a] += here * self.lifted[number[part]]
                elif part not in beginnings:
                    break
            window[:-1], window[-1] = window[1:].copy(), 0.0
            most = window.max(axis=0)
            window /= most
            scale += np.log(most)
        return np.log(window[0]) + scale - n * np.log(LIFT)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        distinct = set().union(*words)
        new = [w for w in distinct if w not in self.known]
        if self.rows is None or len(self.known) + len(new) > REMEMBERED:
            new, self.known, self.rows = list(distinct), {}, np.zeros((0, len(self.languages)))
        if new:
            self.known.update((w, len(self.rows) + i) for i, w in enumerate(new))
            self.rows = np.vstack([self.rows, self.word_logs(["▁" + w for w in new])])
        out = []
        for one in words:
            if not one:
                out.append(("und", 0.0))
                continue
            total = self.rows[np.fromiter(map(self.known.__getitem__, one), dtype=np.int64, count=len(one))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2. Null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the texts, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.string()),
                                              pa.array([counts[k] for k in keys], type=pa.int64())], names=["lang", "word", "n"])
            counts.clear()
            return out

        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in slices(batch.column("text")):
                for text in texts:
                    lang, at = langs[at], at + 1
                    for word, n in Counter(WORD.findall(text.lower())).items():
                        counts[lang, word] += n
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()
        give_back()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected(counts: DataFrame, languages: list[str], shared, path: str) -> DataFrame:
    """(language number, piece, how often it is expected) under the broadcast ``shared`` probabilities."""
    number = {name: i for i, name in enumerate(languages)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = shared.value * LIFT ** pieces(path).length[:, None], None
        total = np.zeros(table.shape)
        for batch in batches:
            every = list(zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True))
            rows, apart = [r for r in every if len(r[1]) < LONG], [r for r in every if len(r[1]) >= LONG]
            for at in range(0, len(rows), AT_ONCE):
                part = rows[at:at + AT_ONCE]
                words = ["▁" + r[1] for r in part]
                lang, weight = np.array([number[r[0]] for r in part]), np.array([r[2] for r in part], dtype=float)
                edges, spelled = pieces(path).edges(words)
                chance, order = with_spelled(table, spelled), steps(edges)
                ends = np.array([len(w) for w in words])
                forward, backward = np.zeros((2, ends.max() + 1, len(words)))
                forward[0] = 1.0
                backward[ends, np.arange(len(words))] = 1.0
                for end, length, at_words, piece in order:
                    forward[end, at_words] += forward[end - length, at_words] * chance[piece, lang[at_words]]
                whole = forward[ends, np.arange(len(words))]
                places, amounts, words_at = [], [], []
                share = np.where(whole > 0, weight / np.maximum(whole, 1e-300), 0.0)
                for end, length, at_words, piece in reversed(order):
                    after = chance[piece, lang[at_words]] * backward[end, at_words]
                    backward[end - length, at_words] += after
                    found = forward[end - length, at_words] * after * share[at_words]
                    places.append(piece * len(number) + lang[at_words])
                    amounts.append(found)
                    words_at.append(at_words)
                if places:
                    low = np.minimum(lowest(forward, ends), lowest(backward, ends)) < TINY
                    apart += [part[i] for i in np.flatnonzero(low)]
                    found = np.where(low[np.concatenate(words_at)], 0.0, np.concatenate(amounts))
                    sums = np.bincount(np.concatenate(places), found, minlength=chance.size).reshape(chance.shape)
                    total += sums[:len(total)]
                    for byte_pieces, sum_ in zip(spelled, sums[len(total):], strict=True):
                        for b in byte_pieces:
                            total[b] += sum_
            apart.sort(key=lambda r: len(r[1]))
            logs = np.log(shared.value) if apart and logs is None else logs
            while apart:  # the longest first, as many as fit
                cut = max(0, len(apart) - max(1, PLACES // (len(apart[-1][1]) + 2)))
                some, apart = apart[cut:], apart[:cut]
                lang, weight = np.array([number[r[0]] for r in some]), np.array([r[2] for r in some], dtype=float)
                expected_by_logs(pieces(path), ["▁" + r[1] for r in some], lang, weight, logs, total)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], names=["lang", "piece", "n"])
        give_back()

    found = counts.mapInArrow(expect, "lang int, piece int, n double")
    return found.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """A model of the languages in ``lang`` from ``doc_id``, ``lang`` and ``text``; every row given may be learned from."""
    path = path or vocabulary_path(PIECES)
    size, spark = pieces(path).size, docs.sparkSession
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    number = usable.groupBy("lang").agg(F.count("*").alias("documents"))
    languages = sorted(r["lang"] for r in number.collect())
    if not languages:
        return Model([], np.zeros((size, 0)), path)
    # The share of each language's documents that is read: all, or as many as give fit_docs on average.
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.join(number, "lang").where(drawn < F.lit(float(fit_docs)) / F.col("documents"))
    # As many pieces as shuffles have: the sample is small in bytes, but each word takes work.
    scratch = Scratch(spark, "unigram")
    counts = scratch.table(word_counts(sample).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), "counts")
    chances = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chances)
        found = expected(counts, languages, shared, path).toArrow()
        shared.destroy()
        total = np.zeros((size, len(languages)))
        total[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        alike = (total / np.maximum(total.sum(axis=0), 1.0)).mean(axis=1) * 0.9 + 0.1 / size
        chances = total + SHARED * alike[:, None]
        chances /= chances.sum(axis=0)
    scratch.drop(counts)
    return Model(languages, chances, path)


def predict(text: Column | str, model: Model, docs: DataFrame) -> Column:
    """A struct of ``lang_pred`` and ``score`` (the posterior, all languages alike beforehand) from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [x for texts in slices(batch, 2 << 20) for x in shared.value.predict(texts)]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())], names=["lang_pred", "score"])
        shared.value.known, shared.value.rows = {}, None  # workers live on: nothing is kept between tasks
        give_back()

    return predicted(text)


def identify(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row, learned from the rows not held out."""
    held = in_fold(F.col("doc_id"))
    model = fit(docs.where(~held & F.col("doc_id").isNotNull()), **settings)
    return docs.select("doc_id", held.alias("held_out"), predict("text", model, docs).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **settings) -> DataFrame:
    """The rows whose language is found with ``min_score`` or more; same columns. Where no language is given to learn from, all rows stay."""
    model = fit(docs.where(~in_fold(F.col("doc_id")) & F.col("doc_id").isNotNull()), **settings)
    if not model.languages:
        return docs
    mark = "_".join([*docs.columns, "language"])
    found = docs.withColumn(mark, predict("text", model, docs))
    kept_rows = found.where((F.col(f"`{mark}`.lang_pred") != "und") & (F.col(f"`{mark}`.score") >= min_score))
    return kept_rows.select(*[F.col(f"`{c}`") for c in docs.columns])
