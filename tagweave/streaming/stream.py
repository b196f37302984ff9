"""Tag newly arriving texts with Structured Streaming.

Replaces the single-text endpoint: a file stream of documents is cleaned
(C4), scored by the caller's model (M6, ``mapInPandas`` works on streams),
turned into label names with the inference-form rank thresholds (M5), and
appended to a sink.  The pipeline is stateless, so there is no watermark,
no state store and no late-data rule; ``trigger(availableNow=True)`` makes
a bounded run that must equal the batch result on the same files.  The sink
is written exactly once by an idempotent batch write and a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS_LONG
from ..functions.text import collapse_ws
from ..operators.ranking import infer_tags
from .scoring import ScorerFactory, score_texts, with_probabilities


def tag_frame(df: DataFrame, scorer_factory: ScorerFactory, id_col: str = "doc_id",
              text_col: str = "text", names: list[str] = LABELS_LONG) -> DataFrame:
    """The per-batch transformation shared by the batch and streaming paths."""
    clean = df.select(id_col, collapse_ws(text_col).alias("_t"))
    scored = with_probabilities(score_texts(clean, "_t", scorer_factory, len(names), keep=[id_col]))
    tagged = infer_tags(scored, names, "scores")
    return tagged.select(id_col, F.col("label").alias("labels"), F.col("score").alias("label_scores"))


def run_stream(spark: SparkSession, source_path: str, schema, sink_path: str,
               scorer_factory: ScorerFactory, checkpoint_path: str | None = None,
               id_col: str = "doc_id", text_col: str = "text",
               max_files_per_trigger: int | None = None, glob: str | None = None,
               after_write: Callable[[int], None] | None = None) -> None:
    """Run the tagging stream to completion over the files present now, each file's rows exactly once.

    ``source_path`` is a directory or a pattern; ``glob`` restricts it to files of matching names.  Below ``sink_path``:

    * ``data/batch_id=N``: the rows of batch N, written whole (a repeated batch replaces its own rows);
    * ``ledger/batch_id=N``: one row, written afterwards: only then the batch counts (``read_sink``);
    * ``checkpoint``: the offsets, unless ``checkpoint_path`` names another place.

    A run that dies anywhere is repeated by calling this again: Spark plans the open batch anew with the same number and files,
    and its rows replace what was left.  Offsets belong to one sink: the sink notes its checkpoint, and a call with
    another one raises ``ValueError``, as batch numbers would start again and replace rows.
    ``after_write`` is called with the batch number between the two writes (tests).
    """
    sink = sink_path.rstrip("/")
    ckpt = checkpoint_path or f"{sink}/checkpoint"
    _bind(spark, sink, ckpt)
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_path)

    def commit(batch: DataFrame, number: int) -> None:
        tag_frame(batch, scorer_factory, id_col, text_col).write.mode("overwrite").parquet(f"{sink}/data/batch_id={number}")
        if after_write:
            after_write(number)
        batch.sparkSession.range(1).select(F.lit(ckpt).alias("checkpoint")).coalesce(1).write.mode("overwrite").parquet(f"{sink}/ledger/batch_id={number}")

    q = (src.writeStream.foreachBatch(commit).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def _bind(spark: SparkSession, sink: str, ckpt: str) -> None:
    """Note the sink's checkpoint at its first use; another one later is an error."""
    path = f"{sink}/owner"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        owner = spark.read.text(path).first()
        if owner is not None and owner[0] != ckpt:
            raise ValueError(f"{sink} belongs to the checkpoint {owner[0]}")
    spark.createDataFrame([(ckpt,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sink(spark: SparkSession, sink_path: str) -> DataFrame:
    """The rows of all batches in the ledger, with ``batch_id``."""
    sink = sink_path.rstrip("/")
    done = spark.read.parquet(f"{sink}/ledger").select("batch_id")
    return spark.read.parquet(f"{sink}/data").join(F.broadcast(done), "batch_id", "left_semi")
