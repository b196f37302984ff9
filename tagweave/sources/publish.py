"""Replace a table that readers, or the job itself, still read.

Below the table's path:

* ``data/<id>``: the rows of one version, written whole before they count;
* ``versions/<number>``: a small file that names the version's folder, created
  only when no file of that number exists, and only after the rows are written.

The highest complete version file is the current version.  A job that dies before its
version file leaves the old version current; one that dies while writing the
file leaves a name without its end mark, which readers pass over.  Old versions stay until
``keep`` newer ones exist, so that running readers, the publishing job's own scan
among them, finish on what they began with.  Of two publishers at once, one gets the
number and the other raises ``FileExistsError``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_END = "\n"


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """(number, data folder), oldest first; the folder of a version file without its end mark is None."""
    fs, folder = _folder(spark, f"{path.rstrip('/')}/versions")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        with_end = _read(spark, status.getPath().toString())
        found.append((int(status.getPath().getName()), with_end[:-1] if with_end.endswith(_END) else None))
    return sorted(found)


def _read(spark: SparkSession, path: str) -> str:
    fs, file = _folder(spark, path)
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """Data folder of the newest complete version."""
    done = [folder for _, folder in versions(spark, path) if folder]
    if not done:
        raise FileNotFoundError(f"{path} has no published version")
    return f"{path.rstrip('/')}/data/{done[-1]}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version; a later publish does not change what this frame reads."""
    return spark.read.parquet(current(spark, path))


def publish(df: DataFrame, path: str, keep: int = 2, partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number.

    ``df`` may read the current version.  The newest ``keep`` versions stay (at least 2: the new one and
    the one before it); older ones and their rows are removed.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    number = max((n for n, _ in versions(spark, root)), default=0) + 1
    name = uuid.uuid4().hex
    df.write.mode("error").partitionBy(*partition_by).parquet(f"{root}/data/{name}")
    fs, file = _folder(spark, f"{root}/versions/{number:012d}")
    if fs.exists(file):
        raise FileExistsError(f"version {number} of {path} was published by another job")
    out = fs.create(file, False)
    try:
        out.write(bytearray((name + _END).encode()))
    finally:
        out.close()
    old = [(n, folder) for n, folder in versions(spark, root) if folder][:-max(keep, 2)]
    for n, folder in old:
        for gone in (f"{root}/versions/{n:012d}", f"{root}/data/{folder}"):
            fs.delete(_folder(spark, gone)[1], True)
    return number
