"""The files a stream is read from are as many as a shuffle has parts."""

import glob

from earmark.plans import stream_queries


def test_files_grow_with_the_parts_of_a_shuffle(spark, monkeypatch, tmp_path):
    """Four files whatever the input: each of four tasks held a quarter of it."""
    monkeypatch.setattr(stream_queries, "scratch_path", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        stream_queries._as_stream(spark.range(1000), "rows")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(glob.glob(str(tmp_path / "rows" / "*.parquet"))) == 12
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1000
