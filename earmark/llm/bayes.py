"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

A logistic model of hashed words, word shapes and a few text ratios gives each
document a probability of being good. Hosts and paths (a part of a host) have
their documents' mean, shrunk: a path towards its host, a host towards all
documents, the more the fewer documents they have and the less such sites
differ (variance components, estimated from grouped sums). A document's final
log-odds are its own plus how much its path, without itself, is above or below
the whole corpus.

The model is fitted on a bounded sample, ``FIT_ROWS`` labelled documents on
average, drawn by a hash of the id; evidence, sums and posteriors cover all
documents. Sums are taken before the shuffle, so a site with a third of all
documents is one row of each task.

Null hosts and paths are sites of their own. Texts without a word are judged by
the ratios alone. Without labels every document has evidence 1/2 and is kept.
Documents labelled twice count as good only if all their labels say so.
Repeated rows are documents of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import Scratch, key_of, slices

FIT_ROWS, BUCKETS, PENALTY, STEPS = 20_000, 1 << 16, 1.0, 150
#: Words a task remembers; doesn't change a result.
REMEMBERED = 300_000
#: The share of a corpus that is worth keeping, where nothing is known.
KEEP_AT = 0.5

_capitals = bytes(range(65, 91))
_run = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+")
_known: dict[bytes, tuple[int, int]] = {}


def _shape(match: re.Match) -> bytes:
    run = match.group()
    return b"0" if run[:1].isdigit() else b"A" if run.isupper() else b"a"


def features(text: str | None) -> set[int]:
    """Buckets of the distinct words, their shapes (``Ab3!`` is ``a0!``) and ratios of the text."""
    data = (text or "").encode()
    words = data.split()
    distinct, n = set(words), max(len(words), 1)
    found: set[int] = set()
    for word in distinct:
        pair = _known.get(word)
        if pair is None:
            pair = (xxhash.xxh32_intdigest(word.lower().strip(b".,;:!?"), 1) % BUCKETS, xxhash.xxh32_intdigest(_run.sub(_shape, word), 2) % BUCKETS)
            if len(_known) >= REMEMBERED:
                _known.clear()
            _known[word] = pair
        found.update(pair)
    ratios = (10 * len(distinct) // n, 10 * sum(map(bytes.__eq__, words, words[1:])) // n, 10 * (len(data) - len(data.translate(None, _capitals))) // max(len(data), 1), min(len(words).bit_length(), 12))
    found.update(xxhash.xxh32_intdigest(b"%d:%d" % pair, 3) % BUCKETS for pair in enumerate(ratios))
    return found


def logistic(rows: list[np.ndarray], good: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression on bucket sets, by Adam."""
    weight, bias, first, second = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS)
    if not len(rows):
        return weight, bias
    at, buckets = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    for step in range(1, steps + 1):
        off = 1 / (1 + np.exp(-np.clip(np.bincount(at, weight[buckets], len(rows)) + bias, -500, 500))) - good
        slope = (np.bincount(buckets, off[at], BUCKETS) + penalty * weight) / len(rows)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        weight -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        bias -= 0.5 * off.mean()
    return weight, float(bias)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from (doc_id, text) and (doc_id, quality)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    share = min(1.0, fit_rows / max(marks.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) / float(1 << 20) < share

    @F.arrow_udf("array<int>")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(features(t)) for texts in slices(batch) for t in texts], type=pa.list_(pa.int32()))

    # fit_rows ids at most, on average: a bounded broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(marks.where(drawn)), "doc_id").select("doc_id", "good", buckets("text").alias("buckets"))
    rows = sample.toArrow().sort_by("doc_id")
    return logistic([np.asarray(r, dtype=np.int64) for r in rows["buckets"].to_pylist()], np.asarray(rows["good"], dtype=float))


def evidence(text: Column | str, model: tuple[np.ndarray, float], docs: DataFrame) -> Column:
    """Each text's probability of being good, by itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def chance(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight, bias = shared.value
        for batch in batches:
            found = []
            for texts in slices(batch):
                for text in texts:
                    buckets = features(text)
                    odds = float(weight[np.fromiter(sorted(buckets), dtype=np.int64, count=len(buckets))].sum()) + bias
                    found.append(1 / (1 + math.exp(-min(max(odds, -30.0), 30.0))))
            yield pa.array(found, type=pa.float64())
        _known.clear()  # workers live on: nothing is kept between tasks

    return chance(text)


def strength(within: float, between: float) -> float:
    """Documents that a prior is worth: how much single ones differ over how much sites do."""
    return 1e12 if between <= 0 else max(within / between, 1e-9)


def posteriors(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """``slim`` (host, path, evidence, ...) with ``host_mean``, ``path_mean`` and ``posterior``.

    A document's own evidence is taken out of its host's and path's sums.
    """
    p = F.col("evidence")
    paths = slim.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    paths = scratch.table(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("kinds"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("mm"))
    hosts = scratch.table(hosts, "hosts")
    whole = hosts.agg(F.sum("hn"), F.sum("hs"), F.count("*"), F.sum(F.col("hn") * F.col("hn")), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum("kinds"), F.sum("mm"), F.sum(F.col("nn") / F.col("hn"))).first()
    n, s, n_hosts, host_nn, host_mm, n_paths, path_mm, path_nn = (float(v or 0) for v in whole)
    q = float(paths.agg(F.sum("q")).first()[0] or 0)
    mean = min(max(s / n, 1e-6), 1 - 1e-6) if n else 0.5
    # Variance components of documents in paths, paths in hosts, hosts in the corpus.
    within = max((q - path_mm) / max(n - n_paths, 1.0), 1e-12)
    of_paths = (path_mm - host_mm - (n_paths - n_hosts) * within) / max(n - path_nn, 1.0)
    of_hosts = (host_mm - (s * s / n if n else 0) - (n_hosts - 1) * within) / max(n - (host_nn / n if n else 0), 1.0)
    for_host, for_path = strength(within, of_hosts), strength(within, of_paths)
    rows = slim.join(paths.select("host", "path", "n", "s").join(hosts.select("host", "hn", "hs"), "host"), ["host", "path"])
    host_mean = (F.lit(for_host * mean) + F.col("hs") - p) / (F.lit(for_host) + F.col("hn") - 1)
    rows = rows.withColumn("host_mean", host_mean)
    rows = rows.withColumn("path_mean", (F.lit(for_path) * F.col("host_mean") + F.col("s") - p) / (F.lit(for_path) + F.col("n") - 1))
    odds = lambda c: F.log(c / (1 - c))
    inside = F.least(F.greatest("path_mean", F.lit(1e-6)), F.lit(1 - 1e-6))
    own = F.least(F.greatest(p, F.lit(1e-13)), F.lit(1 - 1e-13))
    total = odds(own) + odds(inside) - math.log(mean / (1 - mean))
    return rows.withColumn("posterior", 1 / (1 + F.exp(-total))).drop("n", "s", "hn", "hs")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep_at: float = KEEP_AT, **settings) -> DataFrame:
    """``doc_id``, ``host``, ``path``, ``evidence``, ``host_mean``, ``path_mean``, ``posterior`` and ``kept`` of every row.

    ``host`` and ``path`` are columns of ``docs``; by default its ``source``,
    and the source's texts of one ``lang``. Nothing else but ``doc_id`` and ``text`` is read.
    """
    scratch = Scratch(docs.sparkSession, "bayes")
    model = fit(docs, labels, **settings)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    slim = docs.select("doc_id", key_of(host.cast("string")).alias("host"), key_of(path.cast("string")).alias("path"), evidence("text", model, docs).alias("evidence"))
    rows = posteriors(scratch.table(slim, "evidence"), scratch)
    value = lambda c: F.when(F.col(c) != "n", F.substr(c, F.lit(2))).alias(c)
    return rows.select("doc_id", value("host"), value("path"), "evidence", "host_mean", "path_mean", "posterior", (F.col("posterior") >= keep_at).alias("kept"))
