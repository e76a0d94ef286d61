"""Reading whole files and listing what a folder of episodes holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earmark.functions import fixed
from earmark.functions.urls import suffix

def read_texts(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """``path, episode_id, suffix, text``: one row per text file below ``path``.

    Every file is read, unless a caller sets ``max_bytes`` and takes the rest from ``oversized_files``; a byte order mark
    is dropped. The episode is the folder the file lies in.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("episode_id"), suffix(F.col("path")).alias("suffix"),
        F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "").alias("text"))


def oversized_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Files too large to read as one text; only their names are scanned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > max_bytes).select("path", "length")


def read_inventory(spark: SparkSession, root: str, with_hash: bool = True) -> DataFrame:
    """``episode_id, path, size_bytes, modified, sha256`` of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", F.lit(r"^[a-z0-9]+:/*"), F.lit("/"))
    base = "/" + root.split("://")[-1].strip("/") + "/"
    relative = F.substring(below, F.lit(len(base) + 1), F.length(below))
    return files.select(
        F.split(relative, "/")[0].alias("episode_id"), F.regexp_replace(relative, "^[^/]+/", "").alias("path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
        *([F.sha2("content", 256).alias("sha256")] if with_hash else []))


def artifact_category(path: Column) -> Column:
    """Category of an episode file, from its name and suffix."""
    name, end = F.element_at(F.split(path, "/"), -1), suffix(path)
    return (
        F.when(name.isin(fixed.METADATA_NAMES), F.lit("metadata"))
        .when(F.startswith(name, F.lit("transcript")) | end.isin(".srt", ".vtt", ".ttml", ".ass"), F.lit("transcripts"))
        .when(name == "chunks.json", F.lit("indexes"))
        .when(end.isin(fixed.MEDIA_SUFFIXES), F.lit("media"))
        .when(name.isin(fixed.ANALYSIS_NAMES) | (end == ".csv"), F.lit("analysis"))
        .when(F.startswith(path, F.lit("frames/")), F.lit("visual"))
        .otherwise(F.lit("other")))


def inventory(files: DataFrame) -> DataFrame:
    """Categorized files; partial downloads are left out."""
    return files.where(~F.endswith("path", F.lit(".part"))).withColumn("category", artifact_category(F.col("path")))


def inventory_summary(files: DataFrame) -> DataFrame:
    """Files and bytes per episode and category."""
    return inventory(files).groupBy("episode_id", "category").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
