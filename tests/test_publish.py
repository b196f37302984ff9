"""Publishing a table over itself: failed jobs, running readers, old versions, unfinished version files."""

import os

import pytest
from pyspark.sql import functions as F

from tagweave.sources.publish import publish, read_published, versions


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_overwrite_what_was_read(spark, tmp_path):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    assert publish(spark.range(10), path) == 1
    before = read_published(spark, path)
    assert publish(before.filter("id % 2 = 0"), path) == 2
    assert ids(before) == list(range(10)) and ids(read_published(spark, path)) == [0, 2, 4, 6, 8]
    publish(read_published(spark, path).filter("id > 2").withColumn("part", F.col("id") % 3), path, partition_by=("part",))
    assert ids(read_published(spark, path)) == [4, 6, 8]
    assert [n for n, _ in versions(spark, path)] == [2, 3] and len(os.listdir(f"{path}/data")) == 2


def test_a_failed_job_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/table"
    publish(spark.range(5), path)
    bad = read_published(spark, path).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        publish(bad, path)
    assert ids(read_published(spark, path)) == list(range(5))


def test_an_unfinished_version_file_does_not_count(spark, tmp_path):
    path = f"{tmp_path}/table"
    publish(spark.range(3), path)
    with open(f"{path}/versions/000000000002", "w") as f:
        f.write("cut")
    assert ids(read_published(spark, path)) == [0, 1, 2]
    assert publish(spark.range(4), path) == 3 and ids(read_published(spark, path)) == [0, 1, 2, 3]
