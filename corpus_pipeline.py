"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with all their columns (the last one: the encoded documents).  Between stages the
rows are written as Parquet in the shared checkpoint folder and read again.
In every stage a null text is an empty one, and rows with a null or repeated id are documents of their own; an empty text fails
the base rule of stage quality (below 50 words), a null source or language is a category like any other.

* quality: documents that the rules reject go (base rule or a certified cutoff).
* lines: a line that an earlier document holds is cut out of a text; every
  document stays, also one whose text becomes empty; ``n_chars`` follows the text.
* near: of each group of linked documents the one with the smallest id stays (rows are judged, not ids: an id that
  repeats with another text is another document); documents without words or without an id are never linked and stay.
* mix: documents are drawn by their raked weights, as many tokens as there are; a weight above 1 gives whole
  repeats of the row and a draw on the fraction, so a document may come several times.
* encode: doc_id, lang, source, n_tokens, ids (decimal, joined by a space), decoded_sha256, copies; repeats that
  follow each other are encoded once, and ``copies`` says how many rows of the mixture the row stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import bpe, lines, mixing, neardups, quality
from tagweave.llm.common import cut_lineage, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardups.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(mixing.mix(docs, mixing.topic_of(F.col("text")))).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, before=mixing.run_counter(docs)).select("doc_id", "lang", "source", "_bpe.n_tokens", "_bpe.ids",
                                                                  F.sha2("_bpe.decoded", 256).alias("decoded_sha256"), "copies")


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: two stages are beyond SQL (certified cutoffs, BPE); tests/llm/test_pipeline.py holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents", "*")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
