"""Shared pieces: scratch tables, Arrow text helpers, the vocabulary files."""

from __future__ import annotations

import atexit
import base64
import ctypes
from collections.abc import Iterator
from functools import cache, wraps

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.session import scratch_path

#: Texts of a batch that Python works on at a time, in bytes.
SLICE_BYTES = 8 << 20


class Scratch:
    """Tables below the shared folder, dropped as soon as the caller says so.

    ``table`` writes a DataFrame and reads it back, which cuts its lineage in a
    way that survives lost executors. A lazy result may still read its last
    tables, so what is not dropped is removed when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, scratch_path(spark, name), 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # kept for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._scratch)

    def delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)

    def close(self) -> None:
        try:
            self.delete(self.root)
        except Exception:  # the session has ended: its cluster clears the folder
            pass


def without_old_shuffles(spark: SparkSession, write) -> None:
    """Run ``write()`` so that Spark removes its shuffle files when it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        write()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The strings of an Arrow array in order, some ``limit`` bytes at a time."""
    step = max(1, int(limit * len(texts) / max(texts.nbytes, 1)))
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: Python workers live on, and the JVM beside them needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_kept: list = []


def kept(fn):
    """``functools.cache``, but for one module at a time: its first call drops what other modules keep in this process."""
    mine = cache(fn)
    _kept.append((fn.__module__, mine))

    @wraps(fn)
    def call(*args):
        if not mine.cache_info().currsize:
            for module, other in _kept:
                if module != fn.__module__:
                    other.cache_clear()
        return mine(*args)

    return call


#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python workers a few megabytes at a time, from here on in this session; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, space, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def letters_digest(column: Column) -> Column:
    """Lowercase hex SHA-256 of a binary or string column."""
    return F.sha2(column, 256)


def key_of(value: Column | str) -> Column:
    """A value as text that is never null: ``v`` and the value, or ``n``."""
    return F.coalesce(F.concat(F.lit("v"), F.col(value) if isinstance(value, str) else value), F.lit("n"))
