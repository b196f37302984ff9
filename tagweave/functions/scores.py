"""Score functions: sigmoid and element-wise thresholds on score arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FLAT_THRESHOLD
from .text import _col


def sigmoid(c: str | Column) -> Column:
    """1 / (1 + exp(-x)) in double precision."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c).cast("double")))


def sigmoid_array(c: str | Column) -> Column:
    return F.transform(_col(c), lambda x: sigmoid(x))


def flat_positive_indices(c: str | Column, threshold: float = FLAT_THRESHOLD) -> Column:
    """0-based indices whose score is strictly above ``threshold``."""
    idx = F.transform(_col(c), lambda x, i: F.when(x > F.lit(threshold), i))
    return F.array_compact(idx)
