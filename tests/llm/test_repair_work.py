"""What shards cost: pieces are encoded once, pairs are counted where they may have changed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from earmark.llm import repair

PATH = public_tokenizers.path(repair.WORD_49K)
ODD = [chr(c) for c in range(0x180)] + ["'", "'", "s", "T", "re", "LL", " ", " ", "\n", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>",
                                        "́", "̌", "̇", "İ", "K", "Σ", " ", "　", "日本", "\U0001f600"]


class Counted:
    """A tokenizer, and how many words it was given."""

    def __init__(self, inner):
        self.inner, self.words = inner, 0

    def encode(self, text, **more):
        self.words += len(text.split())
        return self.inner.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.words += sum(len(t.split()) for t in texts)
        return self.inner.encode_batch_fast(texts, **more)


def test_cut_words_have_the_ids_of_the_library():
    random.seed(8)
    library, coder = Tokenizer.from_file(PATH), repair.Words(PATH)
    assert coder.cuts
    plain = [*map(chr, range(33, 127)), *map(chr, range(0xC0, 0x100)), " ", " ", " "]
    texts = ["".join(random.choices(chars, k=random.randint(0, 90))) for chars in (ODD, plain) for _ in range(1500)]
    texts += [None, "", "  ", " a ", "it''s", "IT'S 'Ll", "J̌ ǰ", "a<|endoftext|>b", "x<|ENDOFTEXT|>"]
    for _ in range(2):  # the second time from memory
        got = coder.encode(pa.array(texts))
        assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert coder.encode(pa.array([], type=pa.string())) == []
    assert [x.tolist() for x in coder.encode(pa.array([None, ""], type=pa.string()))] == [[], []]
    # Cut or not, remembered or not, is the same.
    coder.cuts, coder.known, coder.older = False, {}, {}
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == [x.tolist() for x in got]


def test_forgotten_pieces_are_the_same(monkeypatch):
    monkeypatch.setattr(repair, "REMEMBERED", 20)
    random.seed(9)
    library, coder = Tokenizer.from_file(PATH), repair.Words(PATH)
    for _ in range(30):
        texts = [" ".join("".join(random.choices("abÉ,.Σ'", k=3)) for _ in range(8)) for _ in range(3)]
        assert [x.tolist() for x in coder.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_share_their_pieces_are_encoded_once():
    stems = ["".join(random.Random(k).choices("abcdefghij", k=9)) for k in range(200)]
    forms = ["{}", "{},", "{}.", "({})", "{}!!", '"{}"', "{}'s", "{}?", "{};"]
    texts = [" ".join(make(form.format(s)) for s in stems) for form in forms for make in (str, str.upper, str.capitalize)]
    coder = repair.Words(PATH)
    seen = [Counted(coder.tokenizer), Counted(coder.of_cut)]
    coder.tokenizer, coder.of_cut = seen
    for text in texts:
        coder.encode(pa.array([text]))
    assert sum(x.words for x in seen) <= len(set(stems)) + 2 * len(forms)


def test_pairs_are_counted_where_they_may_have_changed(monkeypatch):
    """Passages halve round by round; the rare rest isn't counted again each time."""
    rng, counted = np.random.default_rng(4), []
    inner = repair._grouped

    def grouped(left, right, at, bits):
        counted.append(len(at))
        return inner(left, right, at, bits)

    monkeypatch.setattr(repair, "_grouped", grouped)
    passage = rng.integers(0, 40_000, 3000).astype(np.uint32)
    parts = [rng.integers(0, 300, 100_000).astype(np.uint32), *[passage] * 12]
    every, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    repair.replace_pairs(every, ends)
    assert len(counted) >= 8 and sum(counted) < 2.5 * len(every)


def test_places_too_wide_for_one_number():
    left, right, at = np.array([7, 3, 7, 3], dtype=np.uint32), np.array([1, 9, 1, 2], dtype=np.uint32), np.arange(4)
    for bits in (4, 32):
        got, counts = repair._grouped(left, right, at, bits)
        assert (got.tolist(), counts.tolist()) == ([3, 1, 0, 2], [1, 1, 2])
    big = [np.tile(np.array([1 << 31, 5, 1 << 31, 6], dtype=np.uint32), 50), np.zeros(0, dtype=np.uint32)]
    assert [x.tolist() for x in repair.Shard(repair.pack(big)).documents()] == [x.tolist() for x in big]


def test_rules_are_expanded_level_by_level(monkeypatch):
    calls, inner = [], repair.Shard.expand
    monkeypatch.setattr(repair.Shard, "expand", lambda self, symbols: calls.append(len(symbols)) or inner(self, symbols))
    rng = np.random.default_rng(5)
    texts = [np.tile(rng.integers(0, 3000, 700).astype(np.uint32), 20), np.zeros(900, dtype=np.uint32), rng.integers(0, 40, 9000).astype(np.uint32)]
    shard = repair.Shard(repair.pack(texts))
    assert 2 <= len(calls) < 60 < 500 < len(shard.rules) and sum(calls) == 2 * len(shard.rules)
    assert all(np.array_equal(shard.document(k), t) for k, t in enumerate(texts))
    assert all(np.array_equal(a, t) for a, t in zip(shard.documents(), texts, strict=True))
