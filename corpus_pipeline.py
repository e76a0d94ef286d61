"""A corpus pipeline of five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.

Every stage takes null texts, languages, sources and ids, empty and very long
texts, repeated rows, an empty table and further columns of any name: texts
without a letter go in the first stage (where no row has a language to learn
from, all rows stay), equal texts leave one row in the third, and other columns
pass through. Texts go to Python workers a few megabytes at a time
(``small_batches``), which bounds what a worker holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import bpe, lines, raking, simhash, unigram
from earmark.llm.common import Scratch, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go."""
    small_batches(spark)
    return unigram.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    small_batches(spark)
    return lines.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the wanted shares of sources, languages and topics."""
    return raking.sample(docs, fill=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``token_ids``, ``n_tokens`` and ``round_trip`` (they decode to the text).

    A new column whose name is taken has ``_`` after it, as often as it needs.
    """
    small_batches(spark)
    own, taken = [F.col(f"`{c}`") for c in docs.columns], {c.lower() for c in docs.columns}
    mark = "_".join([*docs.columns, "coded"])  # longer than any name there
    coded = docs.withColumn(mark, bpe.encode_and_decode(F.coalesce("text", F.lit(""))))
    ids = F.col(f"`{mark}`.token_ids")
    new = {"token_ids": ids, "n_tokens": F.size(ids).cast("long"), "round_trip": F.col(f"`{mark}`.round_trip")}
    for name in [*new]:
        free = name
        while free in taken:
            free += "_"
        new[free] = new.pop(name)
    return coded.select(*own, *[c.alias(name) for name, c in new.items()])


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: SimHash, the language model and the merges aren't expressible; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
