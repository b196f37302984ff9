"""Batch scoring around a caller-supplied model (M6).

``score_texts`` runs a scorer over a text column with ``mapInPandas``: the
scorer factory is called once per task (the model is loaded once per
partition, not per row), and each Arrow batch of texts is scored as a
whole.  Ranking and thresholds stay in Catalyst (``operators.ranking``).

A scorer is any ``callable(pd.Series[str]) -> np.ndarray[n, n_labels]`` of
logits.  ``hashed_linear_scorer`` is a small stand-in with no model file: a
seeded linear map over hashed word counts, useful for tests and demos.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.Series], np.ndarray]
ScorerFactory = Callable[[], Scorer]


def hashed_linear_scorer(n_labels: int = 48, dim: int = 4096, seed: int = 7) -> ScorerFactory:
    """Factory of a seeded linear scorer over hashed, whitespace-split words."""

    def factory() -> Scorer:
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, 1.0, size=(dim, n_labels)).astype(np.float64)
        b = rng.normal(-2.0, 0.5, size=n_labels)

        def score(texts: pd.Series) -> np.ndarray:
            x = np.zeros((len(texts), dim), dtype=np.float64)
            for i, t in enumerate(texts):
                words = (t or "").lower().split()
                if not words:
                    continue
                idx = np.fromiter((zlib.crc32(s.encode("utf-8")) % dim for s in words),
                                  dtype=np.int64, count=len(words))
                np.add.at(x[i], idx, 1.0 / len(words))
            return x @ w * 8.0 + b

        return score

    return factory


def score_texts(df: DataFrame, text_col: str, scorer_factory: ScorerFactory, n_labels: int,
                keep: list[str] = ("doc_id",), out_col: str = "logits") -> DataFrame:
    """M6: ``keep`` columns + an ``array<double>`` of logits per row."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    keep = list(keep)
    in_schema = df.select(*keep, text_col).schema
    out_schema = T.StructType([in_schema[c] for c in keep] +
                              [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            logits = np.asarray(scorer(pdf[text_col]), dtype=np.float64)
            out = pdf[keep].copy()
            out[out_col] = list(logits)
            yield out

    return df.select(*keep, text_col).mapInPandas(run, out_schema)


def with_probabilities(df: DataFrame, logits_col: str = "logits", out_col: str = "scores") -> DataFrame:
    """C13 on an array column (JVM-side)."""
    from ..functions.scores import sigmoid_array
    return df.withColumn(out_col, sigmoid_array(F.col(logits_col)))
