"""Quality rules with risk-controlled thresholds (operator 10).

Each document gets integer counts (one Arrow kernel, no shuffle).  A fixed base
rule rejects short or repetitive texts.  Four share rules ("reject when the
share is at least a cutoff") get their cutoffs per stratum from labelled
holdout documents: a cutoff is admissible when an exact binomial test shows
that it rejects less than ``alpha / n_rules`` of the good documents.  Cutoffs are
tested from the most lenient on and testing stops at the first failure (fixed
sequence, so the grid costs nothing); the level is ``delta / (n_rules * n_strata)``
(Bonferroni).  Among the admissible cutoffs of a rule the most lenient one is used
that removes every labelled bad document which the most aggressive one would
remove and the rules before it leave; a rule that would remove none is unused.
Labels without any bad document cannot tell, and the most aggressive admissible
cutoff is used.  With probability ``1 - delta`` no stratum then loses more than a
share ``alpha`` of its good documents to these rules.  Without enough labels no
cutoff is admissible and the rules reject nothing.

Defined cases: null or empty text has no words and fails the base rule; a null
stratum is a stratum of its own; a null ``doc_id`` is kept as a row; repeated
rows give repeated results; labels that are null or contradict each other take
no part; copies of a text count once in the holdout, so they cannot fake
evidence; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage, slices, with_column_schema
from .words import gram_hashes, mix, ragged, word_hashes

MIN_WORDS = 50
SLICE = 2 << 20   # bytes of text per kernel call: its work arrays take some 50 times that
ALPHA, DELTA = 0.05, 0.05
#: rule -> cutoffs, most lenient first
GRIDS: dict[str, list[float]] = {
    "symbol_share": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "mean_word_chars": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = " \t\n\v\f\r"


def _per_text(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return np.diff(total[ends], prepend=0)


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The five counts, the number of lines with a word, and a text hash."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(b) for b in raw])
    h, off = word_hashes(texts)
    white = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    n_lines, n_dup = [], []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(_WHITE)]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    start, doc = ragged(off, 3)
    covered = np.zeros(len(h) + 3, dtype=np.int8)
    if len(start):
        with np.errstate(over="ignore"):
            key = mix(gram_hashes(h, 3)[start] ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        same = np.zeros(len(key), dtype=bool)
        eq = key[order[1:]] == key[order[:-1]]
        same[order[1:][eq]] = True
        same[order[:-1][eq]] = True
        for j in range(3):
            covered[start[same] + j] = 1
    return {
        "n_words": np.diff(off), "word_chars": _per_text(~white & ((buf & 0xC0) != 0x80), ends),
        "n_symbols": _per_text(_SYMBOL[buf], ends), "n_dup_lines": np.array(n_dup, dtype=np.int64),
        "n_repeat_words": _per_text(covered[:len(h)], off[1:]), "n_lines": np.array(n_lines, dtype=np.int64),
        "text_hash": np.array([hash_text(b) for b in raw], dtype=np.int64),
    }


def hash_text(b: bytes) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def features(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, stratum, counts and rule shares."""
    def kernel(b):
        c = text_counts(b.column(2).to_pylist())
        yield {"doc_id": b.column(0), "stratum": b.column(1), **c}

    raw = arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                    F.col(text_col).alias("text")),
        kernel, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines", "text_hash"]),
        SLICE)
    return raw.select("*", *[c.alias(r) for r, c in shares().items()], base_failed().alias("base_failed"))


def shares(at: str = "") -> dict[str, Column]:
    """The rules' shares from the counts (``at``: prefix of the count columns)."""
    words = F.greatest(F.col(at + "n_words"), F.lit(1))
    return {"symbol_share": F.col(at + "n_symbols") / words, "repeat_share": F.col(at + "n_repeat_words") / words,
            "dup_line_share": F.col(at + "n_dup_lines") / F.greatest(F.col(at + "n_lines"), F.lit(1)),
            "mean_word_chars": F.col(at + "word_chars") / words}


def base_failed(at: str = "") -> Column:
    return (F.col(at + "n_words") < MIN_WORDS) | (100 * F.col(at + "n_repeat_words") > 50 * F.col(at + "n_words"))


def binom_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), as the regularised incomplete beta I_{1-p}(n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


def pick_cutoffs(row: dict, n_strata: int, alpha: float, delta: float, bad: list | None = None) -> dict[str, float | None]:
    """An admissible cutoff of each rule for one stratum's counts.

    ``bad``: per kind of labelled bad document the place of the first cutoff of each rule that removes it.
    None: no bad labels at all, the most aggressive admissible cutoff is taken.
    """
    left = None if bad is None else [tuple(b) for b in bad]
    level, share = delta / (len(GRIDS) * max(n_strata, 1)), alpha / len(GRIDS)
    out: dict[str, float | None] = {}
    for at, (rule, grid) in enumerate(GRIDS.items()):
        out[rule], last = None, -1
        for i, cut in enumerate(grid):
            if row["n_good"] == 0 or binom_cdf(int(row[f"good_{rule}_{i}"]), int(row["n_good"]), share) > level:
                break
            out[rule], last = cut, i
        if left is not None:
            use = max((b[at] for b in left if b[at] <= last), default=None)
            out[rule] = None if use is None else grid[use]
            left = [b for b in left if use is None or b[at] > use]
    return out


def risk_cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                 id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, cutoff per rule; null: rule unused), one row per stratum with good holdout documents."""
    agreed = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("good"))
              .dropna().groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("most"))
              .filter("good = most and good in (0, 1)").select("doc_id", "good"))
    hold = (feats.filter(~F.col("base_failed")).join(agreed, "doc_id")
            .groupBy("stratum", "good", "text_hash").agg(*[F.first(r).alias(r) for r in GRIDS]))
    # per stratum the distinct places of the first cutoffs that remove a bad document: at most 10,080 whatever the input
    first = F.array(*[sum((F.col(r) < c).cast("int") for c in g) for r, g in GRIDS.items()])
    bad = (hold.filter("good = 0").groupBy(F.col("stratum").alias("_s")).agg(F.collect_set(first).alias("bad")))
    two_sided = agreed.filter("good = 0").limit(1).count() > 0
    counts = hold.filter("good = 1").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"),
        *[F.count_if(F.col(r) >= cut).alias(f"good_{r}_{i}") for r, g in GRIDS.items() for i, cut in enumerate(g)])
    counts = cut_lineage(counts.join(bad, F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s"))
    n_strata = counts.count()

    def pick(parts):
        for pdf in parts:
            yield pd.DataFrame([{"stratum": r["stratum"], **pick_cutoffs(r, n_strata, alpha, delta, (
                                    [] if r["bad"] is None else r["bad"]) if two_sided else None)}
                                for r in pdf.to_dict("records")],
                               columns=["stratum", *GRIDS]).astype({r: "float64" for r in GRIDS})

    cuts = counts.mapInPandas(pick, "stratum string, " + ", ".join(f"{r} double" for r in GRIDS))
    # NaN (pandas' null) and null both mean: unused
    return cut_lineage(cuts.select("stratum", *[F.nullif(F.col(r), F.lit(float("nan"))).alias(f"cut_{r}") for r in GRIDS]))


def judge(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``kept``: neither the base rule nor a certified cutoff rejects the document.

    The cutoff table has one row per stratum and is read back from storage,
    so the planner knows its size and broadcasts it only when it is small.
    """
    c = cutoffs.withColumnRenamed("stratum", "cut_stratum")
    rejected = F.lit(False)
    for r in GRIDS:
        rejected = rejected | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return (feats.join(c, feats["stratum"].eqNullSafe(c["cut_stratum"]), "left")
            .withColumn("kept", ~F.col("base_failed") & ~rejected))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
                     delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document row."""
    feats = cut_lineage(features(docs, stratum))
    return judge(feats, risk_cutoffs(feats, labels, alpha, delta)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns; texts are not shuffled."""
    cutoffs = risk_cutoffs(cut_lineage(features(docs, stratum, id_col, text_col)), labels, alpha, delta)
    names = [*COUNTS, "n_lines"]
    kind = pa.struct([(c, pa.int64()) for c in names])
    at = docs.columns.index(text_col)

    def count(batches):
        for b in slices(batches, SLICE):
            c = text_counts(b.column(at).to_pylist())
            new = pa.StructArray.from_arrays([pa.array(c[n], pa.int64()) for n in names], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, new], schema=b.schema.append(pa.field("_counts", kind)))

    counted = docs.mapInArrow(count, with_column_schema(docs, "_counts", "struct<" + ",".join(f"{n}:long" for n in names) + ">"))
    cut = cutoffs.select(F.struct("*").alias("_cut"))
    good = ~base_failed("_counts.")
    for rule, share in shares("_counts.").items():
        good = good & ~F.coalesce(share >= F.col(f"_cut.cut_{rule}"), F.lit(False))
    return (counted.join(cut, F.col(stratum).cast("string").eqNullSafe(F.col("_cut.stratum")), "left").filter(good)
            .select(*docs.columns))
