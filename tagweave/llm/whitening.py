"""Embedding whitening by a weighted multiplicity covariance (operator 11).

Each entry c of a vector becomes the integer x = floor(1024 * c) + 100000.

1. identical x-vectors are grouped (a partial count, so a group of copies of any
   size is reduced before the shuffle) into a written table of distinct vectors with
   their counts; the fit weight of a distinct vector is its count, or one (``weights``);
2. n and the per-dimension sums S are added up exactly (integers), then every task adds up the weighted
   outer products of x - S/n, a block of vectors at a time as one matrix product
   (centred before multiplying); the d*d/2 sums meet in a grouped sum;
3. the driver holds one d x d matrix (``MAX_DIM`` dimensions at most) and takes its
   eigenvectors; every distinct vector is whitened once;
4. the whitened table is checked in the same way (its covariance minus the identity) and joined
   back to the rows on a 128-bit digest of the x-vector; the distinct side is a written table, so
   that a digest with very many rows can be split at run time.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry (or one whose x
is no 64-bit integer) take no part, nor do rows whose length is not the most frequent one (of equals the longest);
a null id and repeated rows are rows like any other; components without variance (at
most 1e-12 of the largest) are not given, so a table with one distinct vector, or an empty one, gives no rows;
``deviation`` is null where it does not fit into 64 bits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage

SCALE, SHIFT = 1024, 100_000
MAX_DIM = 4096
BLOCK = 4096            # vectors of one matrix product
FLAT = 1e-12            # share of the largest eigenvalue below which a component has no variance
LIMIT = float(1 << 62)


def pack(x: np.ndarray) -> bytes:
    """Canonical bytes of an x-vector: 32-bit differences from SHIFT when all fit, else 64-bit values."""
    low = x - SHIFT
    if len(x) and (np.abs(low) < 1 << 31).all():
        return b"i" + low.astype("<i4").tobytes()
    return b"q" + x.astype("<i8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"i":
        return np.frombuffer(raw, dtype="<i4", offset=1).astype(np.int64) + SHIFT
    return np.frombuffer(raw, dtype="<i8", offset=1).astype(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, x, digest) of the rows that take part, whatever their length."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        v = b.column(1)
        flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)     # a null entry is NaN here
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), 0), dtype=np.int64)
        end = np.cumsum(size)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * flat) + SHIFT
        ok = np.isfinite(x) & (np.abs(x) < LIMIT)
        bad = np.concatenate([[0], np.cumsum(~ok)])
        take = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
        x = np.where(ok, x, 0).astype(np.int64)
        raw = [pack(x[end[i] - size[i]:end[i]]) for i in take]
        yield {"id": b.column(0).take(pa.array(take)), "dim": size[take].astype(np.int32), "x": raw,
               "digest": [hashlib.blake2b(r, digest_size=16).digest() for r in raw]}

    return arrow_map(src, run, f"id {id_type}, dim int, x binary, digest binary")


def _matrix(b: pa.RecordBatch, at: int, d: int):
    """Blocks of (x-vectors as a matrix, their row numbers)."""
    raw = b.column(at).to_pylist()
    for lo in range(0, len(raw), BLOCK):
        yield np.stack([unpack(r) for r in raw[lo:lo + BLOCK]]), slice(lo, lo + BLOCK)


def _upper(df: DataFrame, products, d: int) -> np.ndarray:
    """Sum over all tasks of a d x d matrix that ``products`` yields for each batch (its upper half)."""
    i, j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            for m in products(b):
                total += m
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                         names=["i", "j", "v"])

    rows = df.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _sums(groups: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact weight and per-dimension weighted sums of the distinct vectors."""
    def run(batches):
        n, s = 0, [0] * d
        for b in batches:
            for x, at in _matrix(b, 0, d):
                w = b.column(1)[at].to_numpy()
                n += int(w.sum())
                if float(np.abs(x).max()) * float(w.sum()) < LIMIT:
                    part = (w @ x).tolist()
                else:
                    part = (w.astype(object) @ x.astype(object)).tolist()
                s = [p + q for p, q in zip(s, part)]
        yield pa.RecordBatch.from_arrays([pa.array(list(range(-1, d)), pa.int32()), pa.array([str(v) for v in (n, *s)])],
                                         names=["i", "v"])

    got = (groups.select("x", "w").mapInArrow(run, "i int, v string")
           .groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    by = {r["i"]: int(r["v"]) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def components_of(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at most) k largest eigenvalues with variance, falling, and their unit eigenvectors as columns.

    The sign is fixed: the entry of largest size is positive.
    """
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    some = e > FLAT * max(float(e[0]), 0.0) if len(e) else np.zeros(0, dtype=bool)
    e, u = e[some], u[:, some]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n*x - S)^2 of every row; None where it needs more than 64 bits."""
    d = x.shape[1]
    span = max(abs(n * int(x.max()) - min(s)), abs(n * int(x.min()) - max(s))) if len(x) else 0
    if n * max(abs(int(x.max())), abs(int(x.min()))) < LIMIT and max(map(abs, s)) < LIMIT and span * span * d < LIMIT:
        v = n * x - np.array(s, dtype=np.int64)
        return (v * v).sum(axis=1).tolist()
    v = n * x.astype(object) - np.array(s, dtype=object)
    return [t if t < 1 << 63 else None for t in (v * v).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, k: int = 8, weights: str = "counts", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: id, n, deviation, whitened (array of up to ``k``
    doubles), explained (array), identity_error.

    ``weights``: "counts" fits on all vectors, "one" on each distinct vector once.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    rows = quantised(vectors, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    groups = cut_lineage(rows.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("copies")))
    top = groups.groupBy("dim").agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), F.desc("dim")).first()
    spark = vectors.sparkSession
    if top is None:
        return spark.createDataFrame([], out)
    d = top["dim"]
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} dimensions: the covariance must fit on the driver (at most {MAX_DIM})")
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    groups = groups.filter(F.col("dim") == d).select("x", weight.alias("w"))
    n, s = _sums(groups, d)
    mean = np.array([v // n for v in s], dtype=np.float64) + np.array([v % n / n for v in s])

    def centred(b):
        for x, at in _matrix(b, 0, d):
            c = x - mean
            yield (c * b.column(1)[at].to_numpy().astype(np.float64)[:, None]).T @ c

    cov = _upper(groups, centred, d) / n
    e, u = components_of(cov, k)
    if not len(e):
        return spark.createDataFrame([], out)
    trace = float(np.trace(cov))
    project = u / np.sqrt(e)

    def apply(b: pa.RecordBatch):
        for x, at in _matrix(b, 0, d):
            yield {"digest": [hashlib.blake2b(r, digest_size=16).digest() for r in b.column(0)[at].to_pylist()],
                   "w": b.column(1)[at], "deviation": deviations(x, n, s), "whitened": ((x - mean) @ project).tolist()}

    white = cut_lineage(arrow_map(groups, apply, "digest binary, w long, deviation long, whitened array<double>"))
    error = _identity_error(white, n, len(e))
    known = white.select("digest", "deviation", "whitened")
    return (rows.filter(F.col("dim") == d).select("id", "digest").join(known, "digest")
            .select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.array(*[F.lit(float(v)) for v in e / trace]).alias("explained"), F.lit(error).alias("identity_error")))


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest entry of the weighted covariance of the whitened vectors minus the identity."""
    means = white.agg(*[(F.sum(F.col("w") * F.col("whitened")[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    mean = np.array(list(means))

    def centred(b):
        v = np.asarray(b.column(1).flatten().to_numpy()).reshape(-1, k) - mean
        yield (v * b.column(0).to_numpy().astype(np.float64)[:, None]).T @ v

    return float(np.abs(_upper(white.select("w", "whitened"), centred, k) / n - np.eye(k)).max())


def by_component(whitened: DataFrame, id_name: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    return whitened.select(F.col("id").alias(id_name), "n", "deviation", "explained", "identity_error",
                           F.posexplode("whitened").alias("at", "whitened")).select(
        id_name, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error")
