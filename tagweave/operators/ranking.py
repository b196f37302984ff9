"""Score ranking and rank-dependent thresholds.

Scores live in one ``array<double>`` per row, so ranking is an in-row sort:
no shuffle, no window, whatever the number of rows.  Ties rank the higher
label index first (a reversed ascending argsort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BEYOND_THRESHOLD, FLAT_THRESHOLD, RANK_THRESHOLDS
from ..functions.scores import flat_positive_indices


def ranked(scores: str | Column) -> Column:
    """Array of struct(score, idx) sorted by score desc, then idx desc."""
    c = F.col(scores) if isinstance(scores, str) else scores
    pairs = F.transform(c, lambda x, i: F.struct(x.cast("double").alias("score"), i.alias("idx")))
    return F.sort_array(pairs, asc=False)


def rank_long(df: DataFrame, scores_col: str = "scores", id_col: str = "row_id") -> DataFrame:
    """Long form: (row_id, label_idx, score, rank) with rank 1 = highest."""
    return (df.select(id_col, F.posexplode(ranked(scores_col)).alias("pos", "s"))
              .select(id_col, F.col("s.idx").alias("label_idx"), F.col("s.score").alias("score"),
                      (F.col("pos") + 1).alias("rank")))


def threshold_array(thresholds: list[float], beyond: str = "one") -> Column:
    return F.array(*[F.lit(float(t)) for t in thresholds])


def rank_threshold_indices(scores: str | Column, thresholds: list[float] = RANK_THRESHOLDS,
                           inclusive: bool = False, beyond: str = "one") -> Column:
    """M3/M5: label indices (ascending) whose score beats the threshold of its rank.

    ``inclusive`` selects ``>=`` (inference form) over ``>`` (evaluation
    form).  After the listed ranks the threshold is 1.0 (``beyond='one'``),
    which a saturated score can still meet under ``>=``; ``beyond='never'``
    drops every rank after the list (effective top-k).
    """
    th = threshold_array(thresholds)
    k = len(thresholds)

    def passes(s: Column, pos: Column) -> Column:
        t = F.when(pos < k, F.element_at(th, pos + 1)).otherwise(F.lit(BEYOND_THRESHOLD))
        ok = (s["score"] >= t) if inclusive else (s["score"] > t)
        if beyond == "never":
            ok = ok & (pos < k)
        return F.when(ok, s["idx"])

    picked = F.array_compact(F.transform(ranked(scores), lambda s, i: passes(s, i)))
    return F.array_sort(picked)


def rank_threshold_tags(df: DataFrame, scores_col: str = "scores", out_col: str = "tags",
                        thresholds: list[float] = RANK_THRESHOLDS, inclusive: bool = False,
                        beyond: str = "one") -> DataFrame:
    return df.withColumn(out_col, rank_threshold_indices(scores_col, thresholds, inclusive, beyond))


def flat_threshold_tags(df: DataFrame, scores_col: str = "scores", out_col: str = "tags",
                        threshold: float = FLAT_THRESHOLD) -> DataFrame:
    """M4: every label whose score is strictly above ``threshold``."""
    return df.withColumn(out_col, flat_positive_indices(scores_col, threshold))


def infer_tags(df: DataFrame, names: list[str], scores_col: str = "scores",
               thresholds: list[float] = RANK_THRESHOLDS) -> DataFrame:
    """M5: inference form (``>=``): label names and their scores, in label order."""
    idx = rank_threshold_indices(scores_col, thresholds, inclusive=True)
    name_arr = F.array(*[F.lit(n) for n in names])
    return df.withColumn("_idx", idx).withColumn(
        "label", F.transform("_idx", lambda i: F.element_at(name_arr, i + 1))).withColumn(
        "score", F.transform("_idx", lambda i: F.element_at(scores_col, i + 1))).drop("_idx")
