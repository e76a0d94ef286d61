"""Near-duplicates, sites, lists, mixing and the pipeline against plain versions and SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, _rows
from earmark.llm import bayes, components, lattice, queries, raking, simhash, unigram, urllists
from earmark.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cursor.description], cursor.fetchall())


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7), (900, 900)] + [(random.randrange(1000, 1400),) * 1 + (random.randrange(1000, 1400),) for _ in range(300)]
    want = union_find(1400, links)
    got = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert len({r.node for r in got}) == len(got) and all(want[r.node] == r.component for r in got)
    assert {r.node for r in got} == {x for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def vectors_and_links(vectors, labels):
    unit = np.array(vectors, dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(unit), dtype=bool)
    return near.sum(axis=1), union_find(len(unit), list(zip(*np.nonzero(near), strict=True)))


def test_lattice_finds_near_vectors_in_dense_groups(spark):
    rng = np.random.default_rng(2)
    made, labels = [], []
    for group in range(25):
        base = rng.normal(size=64)
        for _ in range(30):
            off = rng.normal(size=64)
            off -= off @ base * base / (base @ base)
            c = rng.uniform(0.93, 1)
            made.append((c * base / np.linalg.norm(base) + math.sqrt(1 - c * c) * off / np.linalg.norm(off)).tolist())
            labels.append(group % 2)
    made, labels = made + made[:200], labels + labels[:200]
    n, component = vectors_and_links(made, labels)
    df = spark.createDataFrame([(i, v, l) for i, (v, l) in enumerate(zip(made, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.near_vectors(df, block=16).collect()}  # small blocks: every path of the split
    links = np.array([got[i].n_links for i in range(len(made))])
    assert (links <= n).all() and links.sum() >= 0.99 * n.sum()
    assert sum(got[i].component_id == component[i] for i in range(len(made))) >= 0.99 * len(made)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_e8_points_are_nearest():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 8)) * 2
    point = lattice.nearest_e8(y)
    best = ((y - point) ** 2).sum(axis=1)
    for step in lattice.steps():
        assert (best <= ((y - point - step) ** 2).sum(axis=1) + 1e-12).all()
    assert (best <= 1 + 1e-12).all() and len(lattice.steps()) == 240


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 0.0], None), (6, [], 1),
            (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, -0.0], 1), (7, [1.0, 0.0], 1), (10, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, kept string")
    got = sorted((r.vec_id if r.vec_id is not None else 99, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 9, 10)]
    assert got == sorted([*alone, (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (99, 3, 7, False)])
    assert lattice.near_vectors(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_are_those_of_all_pairs(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "é É x", "a b c", "a b c d"]
    for _ in range(12):
        base = random.choices(words, k=400)
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(400)] = random.choice(words)
            texts.append(" ".join(copy))
    texts += texts[20:30]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    prints = [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = union_find(len(texts), near)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(simhash.groups(docs).collect(), key=lambda r: r.doc_id)
    assert [int(r.fingerprint, 16) for r in got] == prints and [r.component_id for r in got] == want
    kept = simhash.keep_one(docs.unionByName(docs.where("doc_id < 3")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns
    assert simhash.groups(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "something else")], "doc_id long, text string")
    assert simhash.keep_one(lost).count() == 2


def test_flips_and_syndromes_cover_the_ball():
    radius = simhash.flips(2)
    assert len(radius) == 2081 == len(np.unique(radius)) and np.bitwise_count(radius).max() == 2
    a, b = np.uint64(random.getrandbits(64)), np.uint64(random.getrandbits(64))
    assert simhash.syndrome(np.array([a ^ b]))[0] == simhash.syndrome(np.array([a]))[0] ^ simhash.syndrome(np.array([b]))[0]


def test_site_posteriors(spark):
    random.seed(5)
    rows = [(i, f"vh{min(i % 7, i % 3)}", f"vp{i % 4}", random.random()) for i in range(400)] + [(400, "vrare", "n", 0.9)]
    slim = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    got = {r.doc_id: r for r in bayes.posteriors(slim, Scratch(spark, "t")).collect()}
    by_host, by_path = {}, {}
    for _, host, path, p in rows:
        by_host.setdefault(host, []).append(p)
        by_path.setdefault((host, path), []).append(p)
    every = [r[3] for r in rows]
    n, mean = len(every), sum(every) / len(every)
    mm = sum(sum(v) ** 2 / len(v) for v in by_path.values())
    hm = sum(sum(v) ** 2 / len(v) for v in by_host.values())
    within = (sum(p * p for p in every) - mm) / (n - len(by_path))
    paths = (mm - hm - (len(by_path) - len(by_host)) * within) / (n - sum(len(v) ** 2 / len(by_host[k[0]]) for k, v in by_path.items()))
    hosts = (hm - n * mean**2 - (len(by_host) - 1) * within) / (n - sum(len(v) ** 2 for v in by_host.values()) / n)
    kh, kp = (1e12 if b <= 0 else within / b for b in (hosts, paths))
    for i, host, path, p in rows:
        h = (kh * mean + sum(by_host[host]) - p) / (kh + len(by_host[host]) - 1)
        q = (kp * h + sum(by_path[host, path]) - p) / (kp + len(by_path[host, path]) - 1)
        z = math.log(p / (1 - p)) + math.log(q / (1 - q)) - math.log(mean / (1 - mean))
        assert got[i].path_mean == pytest.approx(q, rel=1e-6) and got[i].posterior == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_quality_of_unseen_documents_and_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = unigram.in_fold(F.col("doc_id"))
    found = bayes.classify(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    good, bad = [r for r in found if r.quality], [r for r in found if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad) > 50
    odd = spark.createDataFrame([(1, None, None, None, 1), (1, "", "s", "en", 1), (None, "x y", "s", None, 1)], "doc_id long, text string, source string, lang string, evidence int")
    assert bayes.classify(odd, labels.limit(0)).where("kept AND evidence = 0.5").count() == 3
    assert bayes.classify(odd.limit(0), labels).count() == 0


def test_lists_as_of_the_day(spark):
    entries = [("bad.com", None, "2024-01-05", True), ("bad.com", "", "2024-01-10", False), ("www.ok.com", "/a/", "2024-01-01", True), ("bad.com", "/x", "2024-01-08", True),
               ("bad.com", "/x", "2024-01-08", False), (None, None, "2024-01-01", True), ("bad.com", None, None, True), ("com", None, "2024-03-01", True)]
    entries = spark.createDataFrame(entries, "host string, prefix string, d string, listed boolean").selectExpr("host", "prefix", "CAST(d AS DATE) AS day", "listed")
    cases = [("http://bad.com/", "2024-01-04", 0, None), ("http://sub.BAD.com:80/q", "2024-01-05", 1, "bad.com"), ("https://bad.com/x/y?z", "2024-01-09", 2, "bad.com/x"),
             ("https://bad.com/xy", "2024-01-10", 0, None), ("https://bad.com/x", "2024-02-10", 1, "bad.com/x"), ("http://notbad.com", "2024-01-06", 0, None),
             ("http://www.ok.com/a", "2024-01-01", 1, "www.ok.com/a"), ("http://www.ok.com/ab", "2024-01-01", 0, None), ("http://ok.com/a", "2024-01-01", 0, None),
             ("http://u:p@bad.com./x/", "2024-01-09", 2, "bad.com/x"), (None, "2024-01-06", 0, None), ("no url", "2024-01-06", 0, None), ("http://bad.com", None, 0, None),
             ("http://" + "a." * 200 + "com/", "2024-04-01", 0, None), ("http://bad.com/x", "2024-03-02", 2, "bad.com/x")]
    captures = spark.createDataFrame([(i, u, d, "old") for i, (u, d, _, _) in enumerate(cases)], "page_id long, url string, d string, kept string").selectExpr("page_id", "url", "CAST(d AS DATE) AS day", "kept")
    got = {r.page_id: r for r in urllists.filter_captures(captures.unionByName(captures.where("page_id = 1")), entries).collect()}
    for i, (_, _, n, matched) in enumerate(cases):
        assert (got[i].n_matches, got[i].matched, got[i].kept) == (n, matched, n == 0), cases[i]
    assert urllists.filter_captures(captures.limit(0), entries).count() == 0
    assert urllists.filter_captures(captures, entries.limit(0)).where("kept").count() == len(cases)


def test_shapes_are_of_whole_words():
    word = "a1" * 150
    assert bayes.features(word) != bayes.features(word + "!")


def test_raking_meets_its_targets(spark):
    random.seed(6)
    rows = [(i, " ".join(["w"] * random.randint(1, 60)), random.choice(["en", "de", None]), random.choice("abc"), "x") for i in range(3000)]
    rows += [(9000, None, "fr", "z", "x"), (None, "w", "en", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability string")
    shares = {"lang": {"en": 0.2, "de": 0.5, None: 0.3}, "source": {"a": 0.6, "b": 0.3, "c": 0.1}}
    targets = {d: spark.createDataFrame([("n" if k is None else "v" + k, v) for k, v in s.items()], "k string, share double") for d, s in shares.items()}
    got = raking.mix_table(docs, targets=targets).collect()
    assert len(got) == len(rows)
    whole = sum(r.n_tokens * r.probability for r in got)
    for d, s in shares.items():
        for k, share in s.items():
            assert sum(r.n_tokens * r.probability for r in got if r[d] == k) / whole == pytest.approx(share, rel=1e-3)
    assert max(r.probability for r in got) <= 1 and [r.probability for r in got if r.doc_id == 9000] == [0]
    kept = raking.sample(docs, targets=targets)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert raking.mix_table(docs.limit(0)).count() == raking.sample(docs.limit(0)).count() == 0


def test_one_small_source_does_not_lower_what_is_kept(spark):
    random.seed(7)
    rows = [(i, " ".join(["w"] * random.randint(1, 60)), random.choice(["en", "de"]), random.choice("abc")) for i in range(3000)]
    rows += [(9000, "w " * 20, "en", "z"), (9001, "w w", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in raking.sample(docs, fill=True).collect()}
    words = {r[0]: len(r[1].split()) for r in rows}
    assert sum(words[i] for i in kept) / sum(words.values()) == pytest.approx(raking.RATE, abs=0.02)
    got = raking.mix_table(docs, fill=True).collect()
    assert sum(r.n_tokens * r.probability for r in got) / sum(words.values()) == pytest.approx(raking.RATE, rel=1e-3)
    assert {r.doc_id for r in got if r.kept} == kept and [r.probability for r in got if r.doc_id == 9000] == [pytest.approx(1)]
    assert raking.sample(docs.limit(0), fill=True).count() == 0


def test_mixing_query_keeps_its_rate(spark):
    got = queries.QUERIES["op9_mixing"](spark, SF).collect()
    whole, kept = sum(r.n_tokens for r in got), sum(r.n_tokens * r.probability for r in got)
    assert kept / whole == pytest.approx(raking.RATE, rel=1e-3)
    for d in raking.DIMENSIONS:
        there, now = Counter(), Counter()
        for r in got:
            there[r[d]] += r.n_tokens
            now[r[d]] += r.n_tokens * r.probability
        # Rarer values are kept at a higher rate, and none loses more than the tempering asks for.
        rates = [now[v] / there[v] for v, _ in there.most_common()]
        assert rates == sorted(rates) or max(a - b for a, b in zip(rates, rates[1:])) < 2e-3


def test_raking_goes_on_until_a_tied_source_is_met(spark, caplog):
    cells = [("hot", "xx", 5000), ("hot", "en", 600), ("a", "xx", 600), ("a", "en", 5000), ("b", "en", 2000), ("b", "de", 3000)]
    docs = spark.createDataFrame([(i, "w " * n, lang, source) for i, (source, lang, n) in enumerate(cells)], "doc_id long, text string, lang string, source string")
    shares = {"source": {"hot": 0.30, "a": 0.36, "b": 0.34}, "lang": {"xx": 0.33, "en": 0.44, "de": 0.23}}
    targets = {d: spark.createDataFrame([("v" + k, v) for k, v in s.items()], "k string, share double") for d, s in shares.items()}
    off = {}
    for fill in (False, True):
        got = raking.mix_table(docs, targets=targets, rate=0.05, fill=fill).collect()
        whole = sum(r.n_tokens * r.probability for r in got)
        off[fill] = max(abs(sum(r.n_tokens * r.probability for r in got if r[d] == k) / whole / v - 1) for d, s in shares.items() for k, v in s.items())
    assert off[True] < 2e-3 < off[False], off
    assert not any("stopped" in r.message for r in caplog.records)


@pytest.mark.parametrize("name", ["op5_url_lists", "op9_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        found = out.collect()
        assert {r.doc_id for r in found} <= ids and len(found) == len({r.doc_id for r in found})
        docs, ids = (spark.createDataFrame(found, out.schema), {r.doc_id for r in found})
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in found) and ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


ODD = [(1, "The cat sat on the mat and looked at the dog.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "12 34 --", "de", "b"),
       (5, "x" * 200_000 + " the end of a very long word", "en", "a"), (None, "Die Katze sitzt auf der Matte und schaut.", "de", None)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    rows = [*ODD, ODD[0], ODD[0], *[(10 + i, f"number {i} of the words in the list that is here for you and me today", "en", "a") for i in range(40)]]
    docs = spark.createDataFrame([(*r, r[1], 7, "x") for r in rows], "doc_id long, text string, lang string, source string, coded string, token_ids int, `a.b` string")
    out = stage(spark, docs, SF)
    got = out.collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r["a.b"] == "x" for r in got)
    assert out.columns == docs.columns if name != "tokens" else out.columns == [*docs.columns, "token_ids_", "n_tokens", "round_trip"]
    if name == "tokens":
        assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.token_ids_) for r in got)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.collect() == []


def test_without_languages_no_document_goes(spark):
    docs = spark.createDataFrame([(i, f"a text {i}", None, "s") for i in range(5)], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.language(spark, docs, SF).count() == 5


def test_topics_of_a_long_run_of_letters(spark):
    docs = spark.createDataFrame([("a" * 1_000_000,), ("b" * 1_000_000 + "@c",)], "text string")
    assert [r[0] for r in docs.select(raking.topic_of("text")).collect()] == ["prose", "contact"]
