"""Session helpers: a tuned local session for tests/bench and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_BYTES = 8 << 20      # of one Arrow batch between the JVM and a worker (Spark's default: 64 MiB)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tagweave") -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as given.  Only a local-mode session without the setting gets a fresh
    scratch folder (tests, bench); a cluster session without it is an error
    rather than a silent machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a shared folder before running iterative operators")
        conf_dir = tempfile.mkdtemp(prefix="tagweave-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tagweave`` importable in Python workers (once per application).

    Pandas UDFs defined here are pickled by reference, so workers must be
    able to import the package wherever the driver was started from; the
    zipped package is distributed with ``addPyFile`` like any library.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tagweave-py-")
    zpath = shutil.make_archive(os.path.join(out, "tagweave"), "zip",
                                root_dir=os.path.dirname(pkg_dir), base_dir="tagweave")
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES`` (a lower one stays):
    both sides of the pipe hold a whole batch, and rows here can be long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{64 << 20}b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared checkpoint folder.

    Reliable like ``checkpoint()`` (survives executor loss; never a local
    checkpoint), but stored as parquet: reads back columnar, with column
    pruning and filter pushdown, instead of Java-serialised rows.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within: Spark removes the shuffle files of each query as it ends (else they stay until the driver's JVM happens to
    collect its garbage).  For steps that write what they compute, and so read no shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read one table (only ``columns`` when given): a plain scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
