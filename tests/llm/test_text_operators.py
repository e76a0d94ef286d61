"""Tokens, language, quality rules, edits and shards against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earmark.llm import common, bpe, editcounts, lines, repair, unigram

ODD = [None, "", " ", "a", "a  b", " a", "a \n b c\n\nd", "x   y", "it's \x85 d", "ab" * 3000, "é" * 999, "\U0001f600" * 50, "<|endoftext|>", "!" * 999,
       "one two three four five six seven eight nine ten.", "日本語テスト", "\x1c\x1fb", "12 345"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens string, lang_pred int"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, null ids, repeated rows, and columns named like results."""
    rows = [(i, t, None, None, None, "x", "y", 1) for i, t in enumerate(ODD)]
    rows += [(None, "no id here.", "en", "s", 3, "x", "y", 1), (3, "a", "en", "s", 1, "x", "y", 1), (3, "a", "en", "s", 1, "x", "y", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def encoding(name):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path(name)).ranks, special_tokens={})


def test_bpe_is_what_the_library_gives(docs):
    want = encoding(bpe.MULTI_50K)
    got = bpe.encode_table(docs).withColumn("back", bpe.decode("token_ids")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(ODD) + 2
    for row in got:
        assert row.token_ids == want.encode_ordinary(row.text or "")
        assert bytes(row.back).decode() == (row.text or "")


def test_bpe_one_pair_at_a_time_gives_the_same():
    random.seed(5)
    coder, want = bpe.Encoder(public_tokenizers.path(bpe.MULTI_50K)), encoding(bpe.MULTI_50K)
    texts = ["".join(random.choices(["th", "e", "a", " ", "'s", "\n", "é", "1"], k=random.randint(0, 200))) for _ in range(200)]
    plain = [np.array(want.encode_ordinary(t), dtype=np.int32).tobytes() for t in texts]
    assert coder.encode(texts) == plain
    coder.vocabulary.at_once = False
    try:
        coder.runs = {}
        assert coder.encode(texts[:50]) == plain[:50]
    finally:
        coder.vocabulary.at_once = True


def test_rank_queue_pops_the_lowest():
    queue, want = bpe.RankQueue(50_256), {}
    random.seed(1)
    for _ in range(500):
        rank, place = random.randrange(50_256), random.randrange(1000)
        queue.push(rank, np.array([place]))
        want.setdefault(rank, []).append(place)
    got = []
    while (popped := queue.pop()) is not None:
        got.append((popped[0], sorted(popped[1].tolist())))
    assert got == [(r, sorted(want[r])) for r in sorted(want)]


def test_decoding_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.createDataFrame([([-1],)], "ids array<int>").select(bpe.decode("ids")).collect()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.encode_table(none).count() == lines.judge_table(none).count() == unigram.identify(none).count() == 0
    assert repair.write_and_index(none).count() == 0
    assert lines.clean(none).columns == none.columns


def test_edits_count_as_if_encoded_anew():
    count, want = editcounts.counter(public_tokenizers.path(editcounts.BYTE_50K)), encoding(editcounts.BYTE_50K)
    random.seed(2)
    alphabet, leaf = ["a", "b", "'", "s", "re", " ", "  ", "\n", "1", "é", "!", "The", " x"], editcounts.LEAF
    try:
        for _ in range(300):
            editcounts.LEAF = random.choice([1, 2, 3, 8, 64])
            one = editcounts.Document("".join(random.choices(alphabet, k=random.choice([0, 1, 5, 40, 300]))), count)
            for _ in range(4):
                at = random.randint(-1, len(one.text) + 1)
                one.edit(at, at + random.choice([0, 0, 1, 3, 50]), "".join(random.choices(alphabet, k=random.choice([0, 1, 5, 30]))))
                assert one.n_tokens == len(want.encode_ordinary(one.text))
                assert sum(chars for chars, _ in one.tree.leaves()) == len(one.text)
    finally:
        editcounts.LEAF = leaf


def test_an_edit_encodes_little_again():
    count = editcounts.counter(public_tokenizers.path(editcounts.BYTE_50K))
    one = editcounts.Document("some words of a long text, " * 5000, count)
    one.edit(60_000, 60_003, "new")
    assert one.reencoded <= 3 * editcounts.LEAF


def test_edit_table_on_odd_rows(docs):
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"), F.lit("Q ").alias("insert")), F.lit(None))
    want = encoding(editcounts.BYTE_50K)
    for row in editcounts.count_table(docs, edits).collect():
        assert row.edited.startswith("Q ") and row.tokens_after == len(want.encode_ordinary(row.edited))


def plain_rules(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    full = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(marked),
            len(words) < 10 or 100 * len(marked) > 20 * len(words))


def test_line_rules_base_counts(docs):
    random.seed(3)
    texts = [*ODD, *("".join(random.choices(["a ", "b ", "c", "\n", "\t", "|", "é ", " "], k=random.randint(0, 150))) for _ in range(300))]
    for text in texts:
        got = lines.judge(text)
        assert (*got[:5], got[8]) == plain_rules(text), text
        assert not (got[8] and got[9])
    assert lines.judge_table(docs).count() == docs.count()


def test_line_rules_remove_lines_and_reject_what_loses_too_much():
    good = "This is a whole sentence of quite some words that ends well."
    assert lines.judge(f"{good}\nHome | News | About\nAll Rights Reserved.\n{good[::-1]} .")[9:] == (True, f"{good}\n{good[::-1]} .")
    assert lines.judge("Home | News | About | Contact | Shop | Imprint | More\n" * 1 + "A line here.")[9] is False
    assert lines.judge("no end marks at all in this text of many words\nbut more than one line")[9] is True


def test_repeated_words_in_large_vocabularies():
    random.seed(4)
    words = [str(random.randrange(70_000)).encode() for _ in range(90_000)]
    words += words[100:130]
    counts = {}
    for i in range(len(words) - 4):
        counts.setdefault(tuple(words[i:i + 5]), []).append(i)
    marked = {i + k for at in counts.values() if len(at) > 1 for i in at for k in range(5)}
    assert lines.repeated_words(words) == len(marked) > 0


def test_language_sums_over_all_segmentations():
    vocabulary = unigram.pieces(unigram.vocabulary_path(unigram.PIECES))
    rng = np.random.default_rng(1)
    chances = rng.random((vocabulary.size, 3))
    model = unigram.Model(["a", "b", "c"], chances / chances.sum(axis=0), unigram.vocabulary_path(unigram.PIECES))

    def brute(word):
        if not word:
            return np.ones(3)
        total = np.zeros(3)
        if word[0] not in vocabulary.number:
            total += model.chances[[vocabulary.byte[b] for b in word[0].encode()]].prod(axis=0) * brute(word[1:])
        for n in range(1, len(word) + 1):
            if word[:n] in vocabulary.number:
                total += model.chances[vocabulary.number[word[:n]]] * brute(word[n:])
        return total

    for word in ("▁the", "▁straße", "▁ation", "▁ཀ日", "▁x"):
        assert np.allclose(np.exp(model._short([word])[0]), brute(word), rtol=1e-9, atol=0)
        assert np.allclose(model._long(word), model._short([word])[0])


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = unigram.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in found)


def test_a_long_foreign_run_leaves_the_other_evidence(spark):
    english = "the people of this house were reading the letters that their friends had written "
    german = "die Leute in diesem Haus haben die Briefe gelesen, die ihre Freunde geschrieben haben "
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)]
    model = unigram.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=2)
    seldom = model.chances.copy()
    seldom[seldom < np.sort(seldom, axis=0)[-200]] = 6e-10  # as after some 1e6 pieces
    model = unigram.Model(model.languages, seldom, model.path)
    for run in ("\U00020000" * 13, "\U00020000" * 100, "\U00020000" * 400, "\u0f40" * 41, "日" * 41, "日" * 119, "日" * 300, "x" * 50_000):
        (lang, score), = model.predict([english + run])
        assert lang == "en" and 0.99 < score <= 1
    word = "▁" + "日" * 20
    assert np.allclose(model._short([word])[0], model._by_logs([word])[0]) and np.allclose(model._long(word), model._by_logs([word])[0])


def test_words_of_every_length_are_learned_from(spark):
    path = unigram.vocabulary_path(unigram.PIECES)
    vocabulary = unigram.pieces(path)
    chances = np.full((vocabulary.size, 1), 1e-12)
    words = ["the", "日" * 30, "\U00020000" * 30, "ab" * 60, "straße" * 100]
    counts = spark.createDataFrame([("a", w, 2) for w in words], "lang string, word string, n long")
    got = {r.piece: r.n for r in unigram.expected(counts, ["a"], spark.sparkContext.broadcast(chances), path).collect()}
    want = np.zeros(chances.shape)
    unigram.expected_by_logs(vocabulary, ["▁" + w for w in words], np.zeros(5, dtype=int), np.full(5, 2.0), np.log(chances), want)
    assert sorted(got) == np.flatnonzero(want).tolist() and np.allclose([got[p] for p in sorted(got)], want[sorted(got), 0])
    chars = sum(n * vocabulary.length[p] for p, n in got.items() if p not in vocabulary.byte.values())
    spelled = sum(n for p, n in got.items() if p in vocabulary.byte.values())
    assert chars == pytest.approx(2 * sum(1 + len(w) for w in words if w[0] != "\U00020000") + 2) and spelled == pytest.approx(2 * 4 * 30)


def test_language_without_letters_or_labels(spark, docs):
    found = {(r.doc_id, r.lang_pred) for r in unigram.identify(docs).collect()}
    assert {(0, "und"), (1, "und"), (17, "und")} <= found and (14, "en") in found
    nothing = unigram.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert unigram.keep_identified(docs).columns == docs.columns


def test_shards_hold_what_the_library_gives(spark, docs, tmp_path):
    folder = str(tmp_path / "shards")
    repair.write(docs, folder, shard_tokens=64)
    library = Tokenizer.from_file(public_tokenizers.path(repair.WORD_49K))
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = repair.read(spark, folder).collect()
    assert len(rows) == docs.count() and all(r.token_ids == want[r.doc_id] for r in rows)
    start = 0
    for row in sorted(repair.index(spark, folder).collect(), key=lambda r: r.start):
        assert (row.start, row.n_tokens) == (start, len(want[row.doc_id]))
        assert row.ids_crc32 == zlib.crc32(np.array(want[row.doc_id], dtype="<u4").tobytes())
        start += row.n_tokens
    assert [r.doc_id for r in sorted(repair.index(spark, folder).collect(), key=lambda r: r.start)][:1] == [None]
    assert {r.doc_id: r.token_ids for r in repair.lookup(spark, folder, [9, 14]).collect()} == {9: want[9], 14: want[14]}


def test_grammars_expand_to_what_went_in():
    random.seed(6)
    for _ in range(200):
        texts = [np.array(random.choices(range(random.choice([1, 2, 4])), k=random.choice([0, 1, 2, 50, 400])), dtype=np.uint32) for _ in range(random.randint(1, 8))]
        shard = repair.Shard(repair.pack(texts))
        assert [x.tolist() for x in shard.documents()] == [x.tolist() for x in texts]
        assert [shard.document(k).tolist() for k in range(len(texts))] == [x.tolist() for x in texts]
    many = [np.tile(np.arange(7, dtype=np.uint32), 200)] * 5
    assert len(repair.pack(many)) < 4 * 7 * 200 * 5 / 10


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(3)
    one = rng.permutation(1000).astype(np.uint32)
    copies = [one] * 40
    _, symbols, ends, lengths, _ = repair.replace_pairs(np.concatenate(copies), np.cumsum([1000] * 40))
    assert len(symbols) == 40 and ends.tolist() == list(range(1, 41)) and lengths.max() == 1000
    # No frequent pair is left, also in a run of one symbol and among many rare pairs.
    for texts in ([np.zeros(5000, dtype=np.uint32)], [rng.integers(0, 700, 200_000).astype(np.uint32), *copies]):
        _, symbols, ends, _, _ = repair.replace_pairs(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
        inside = np.setdiff1d(np.arange(len(symbols) - 1), ends - 1)
        pairs = symbols[inside].astype(np.int64) << 32 | symbols[inside + 1]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < repair.LEAST
        shard = repair.Shard(repair.pack(texts))
        assert all(np.array_equal(shard.document(i), t) for i, t in enumerate(texts))


def test_digests_of_the_query(spark):
    from earmark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = encoding(bpe.MULTI_50K)
    for row in queries.QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = want.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_as_many_languages_as_there_are(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 4, f"l{i % 450:03d}") for i in range(1350)]
    model = unigram.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1)
    assert model.languages == sorted({r[2] for r in rows}) and np.allclose(model.chances.sum(axis=0), 1)


def test_caches_of_one_module_at_a_time():
    unigram.pieces(unigram.vocabulary_path(unigram.PIECES))
    bpe.encoder(bpe.vocabulary_path(bpe.VOCABULARY) if hasattr(bpe, "VOCABULARY") else bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    assert not any(mine.cache_info().currsize for module, mine in common._kept if module == unigram.__name__)
