"""Spelling variants, packing and collocations against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from earmark.llm import collocations, packing, variants

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], DOCS)


# --- spelling variants

def plain_words(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else 0, root(w)) for w in n)


def got_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def variant_rows():
    rng = random.Random(5)
    stems = ["collation", "Straße" + "nname", "aaaaaaaa", "aaaaaaa", "abababab", "ÀÉÎõüñç", "correlation", "x" * 300, "l" * 41]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(stems)
            if rng.random() < .5:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abxyÿ×")) + w[at + (kind != 1):]
            words.append(w)
        rows.append((i, " ".join(words), "en"))
    rows += [(500 + i, "collation " * 40 + "correlation, " * 30, "en") for i in range(12)]
    return [*rows, rows[3], rows[3], (None, "collation collations Collation", None), (901, None, None), (902, "", "en"), (903, "-- 12", "en")]


@pytest.mark.parametrize("group", [variants.GROUP, 60])
def test_variants_as_brute_force(spark, group):
    rows = variant_rows()
    want = plain_variants(rows)
    assert sum(1 for r in want if r[3]) > 20 and max(r[2] for r in want) > 20
    assert got_variants(variants.group_variants(documents(spark, rows), group=group)) == want


def test_variants_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
    n = plain_words(rows)
    by_hole = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1:]].add(w)  # replaced
    near = defaultdict(set)
    for group in by_hole.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    got = {r.word: r for r in variants.group_variants(docs).collect()}
    assert {w: r.n for w, r in got.items()} == n and all(got[w].n_near == len(near[w]) for w in n)
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        assert got[w].form == (best if best and n[best] >= 10 * n[w] else None)


def test_variants_follow_chains_and_take_nothing(spark):
    words = {"streaming": 2000, "streamings": 200, "streamingss": 20, "streamingsst": 2}
    text = " ".join(" ".join([w] * n) for w, n in words.items())
    rows = [(next(i for i in range(100) if variants.words_of(text, i) == words), text, "en")]
    got = {r.word: r for r in variants.group_variants(documents(spark, rows)).collect()}
    assert {w: (r.n, r.form, r.root) for w, r in got.items()} == {
        "streaming": (2000, None, "streaming"), "streamings": (200, "streaming", "streaming"),
        "streamingss": (20, "streamings", "streaming"), "streamingsst": (2, "streamingss", "streaming")}
    assert variants.group_variants(documents(spark, [])).collect() == []
    extra = documents(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "'k' AS key")
    assert got_variants(variants.group_variants(extra)) == got_variants(variants.group_variants(documents(spark, rows)))


# --- packing

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(placed, rows, tokenizer, length=2048):
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= length else (len(ids) - 1) % length + 1
        ends = [first, *range(first + length, len(ids) + 1, length)]
        for k, e in enumerate(ends):
            part = np.array(ids[max(0, e - length) if k else 0:e], dtype="<u4")
            want[doc_id, k, e - len(part), len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), sum(r.length for r in placed)


def test_packing_of_all_texts(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "γάμμα", "\n\n", "12,5", "<|endoftext|>", "混合"]) for _ in range(rng.choice([0, 3, 40, 300, 900, 5000]))), "en") for i in range(150)]
    rows += [rows[7], rows[7], (None, "x", None), (800, None, None), (801, "ab" * 30_000, "en"), (802, "a", "en")]
    placed = packing.pack_table(documents(spark, rows)).collect()
    n, tokens = check_packed(placed, rows, tokenizer)
    assert n <= -(-tokens // 2048) + 1
    shards = packing.pack_table(documents(spark, rows), shard=16).collect()
    n, tokens = check_packed(shards, rows, tokenizer)
    assert n <= -(-tokens // 2048) + 2
    assert packing.pack_table(documents(spark, [])).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(i, f"text {i} " * (i % 90), "en") for i in range(60)] + [(3, "again", "en")]
    found = packing.sequences(documents(spark, rows), length=256).collect()
    texts = Counter()
    for r in found:
        assert len(r.token_ids) == sum(s.length for s in r.spans) <= 256
        for s in r.spans:
            texts[s.doc_id, s.piece, tuple(r.token_ids[s.offset:s.offset + s.length])] += 1
    want = Counter()
    for doc_id, text, _ in rows:
        ids = packing.encode(text, public_tokenizers.path(packing.RANKS))
        for k, (a, b) in enumerate(packing.cuts(len(ids), 256)):
            want[doc_id, k, tuple(int(x) for x in ids[a:b])] += 1
    assert texts == want


@pytest.mark.parametrize("low, high", [(1, 2049), (600, 1200), (1000, 2049), (5, 60)])
def test_search_never_loses_to_best_fit(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 4000)
    fit, bins = packing.best_fit(sizes, 2048), packing.pack(sizes)
    assert sorted(x for b in bins for x in b) == list(range(len(sizes)))
    assert max(int(sizes[b].sum()) for b in bins) <= 2048 and len(bins) <= len(fit)
    fills = lambda some: sum(int(sizes[b].sum()) ** 2 for b in some)
    assert fills(bins) >= fills(fit)
    if (low, high) == (600, 1200):
        assert len(bins) < len(fit)
    again = packing.pack(sizes, 2048, bins)
    assert len(again) <= len(bins)


@pytest.mark.parametrize("sizes, start, best", [
    ([6, 4, 5, 5], [[0], [1, 2], [3]], 2),       # a move fills a bin
    ([7, 5, 5, 3], [[0, 3], [1, 2]], 2),
    ([4, 4, 6, 2, 2, 2], [[0, 1], [2, 3], [4, 5]], 2),  # two pieces come at once
])
def test_exchanges(sizes, start, best):
    sizes = np.array(sizes)
    search = packing.Search(sizes, start, 10)
    while search.improve():
        pass
    assert len(search.bins()) == best and sorted(x for b in search.bins() for x in b) == list(range(len(sizes)))


# --- collocations

def plain_collocations(rows, least, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                inside |= {p[i:i + k] for i in range(len(p) - k + 1) if 100 * a >= 100 * f[p[i:i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows(seed=1, n=300):
    rng = random.Random(seed)
    names = ["New York City Hall", "new york", "a a a a a a", "Übung macht den Meister", "x\x00y z", "und und", "e.g. this,that"]
    rows = []
    for i in range(n):
        some = [rng.choice([*names, "the", "of", "a", "city", "york", "\t", "\n", "; ", "\x0b", "é"]) for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(some), rng.choice(["en", "en", "de", None])))
    return [*rows, rows[0], rows[0], (900, None, "en"), (901, "", None), (902, "new york " * 3000, "en"), (None, "of the " * 50, "zz")]


@pytest.mark.parametrize("least, shards, bits", [(30, 4, 1 << 20), (5, 3, 64), (100, 1, 1 << 16)])
def test_collocations_as_brute_force(spark, monkeypatch, least, shards, bits):
    monkeypatch.setattr(collocations, "ROW", 200)  # rows of a shard, so that all have some
    rows = phrase_rows(least)
    got = collocations.collocations(documents(spark, rows), least=least, shards=shards, bits=bits)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    want = plain_collocations(rows, least)
    assert len(want) > 5 and got == want


def test_collocations_top_empty_and_extra_columns(spark):
    rows = phrase_rows(3, 80)
    extra = documents(spark, rows).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS shard")
    got = collocations.collocations(extra, least=4, top=3).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 4, top=3)
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "one word", "en")])).collect() == []


def test_collocation_scores_pass_64_bits(spark):
    one = spark.range(1).selectExpr("200000000000000L AS a", "3000000000000000L AS n", "400000000000000L AS l", "500000000000000L AS r")
    score = one.selectExpr("(1000 * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(16,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS s").first().s
    assert score == 1000 * 200000000000000 * 3000000000000000 // (400000000000000 * 500000000000000)


def test_collocations_keep_few_counters_and_name_what_is_returned(spark, monkeypatch):
    rng, sizes, made = random.Random(3), {}, collocations.Scratch.table

    def table(self, df, name="t"):
        out = made(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(collocations.Scratch, "table", table)
    monkeypatch.setattr(collocations, "ROW", 100)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(100)]
    # Some are only in the first or the last texts, so only in some shards.
    rows = [(-i, " ".join(["north sea", rng.choice(words)] * 5), "en") for i in range(1, 9)] + rows
    rows += [(1000 + i, " ".join(["south sea oil", rng.choice(words)] * 5), "en") for i in range(8)]
    got = collocations.collocations(documents(spark, rows).coalesce(1), least=30, top=2, shards=3, bits=1 << 20).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 30, top=2)
    assert sizes["names"] < 10
    assert max(n for name, n in sizes.items() if name.startswith("state")) < 100


def test_collocations_with_two_words_of_one_id(spark, monkeypatch):
    made = collocations._shards
    york, city = (np.frombuffer(collocations.digest(b"en", w, 0), dtype="<i8")[0] for w in (b"york", b"city"))
    seeds = []

    def shards(n, seed):
        seeds.append(seed)
        rows = made(n, seed)

        def changed(batches):
            for batch in rows(batches):
                ids = [None if x is None else [york if i == city else i for i in x] for x in batch.column("ids").to_pylist()]
                yield batch if seed else batch.set_column(1, "ids", pa.array(ids, type=pa.list_(pa.int64())))

        return changed

    monkeypatch.setattr(collocations, "_shards", shards)
    rows = phrase_rows(4, 80)
    got = collocations.collocations(documents(spark, rows), least=4).collect()
    assert seeds == [0, 1]
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 4)
