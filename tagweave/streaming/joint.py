"""A multi-label tagger trained for all labels at once, saved, loaded and scored (M6, M7).

Features are hashed word counts (``dim`` places, length 1), the model is one weight matrix
(``dim`` + 1 places by labels).  Every training pass is one Spark job whatever the number of labels:
each task adds up the gradient of all labels' weighted logistic losses over its rows, the
partial gradients are summed by blocks of places in parallel tasks, and only their sum (the size of
the matrix, at most ``MAX_WEIGHTS``) reaches the driver, which takes a limited-memory BFGS step.  Rows are dealt to a
held-out part by a hash of their id; training stops when the held-out loss has not improved for ``patience``
passes, and the best pass is kept.

A model is saved as a folder of two Spark tables (any path that Spark writes), one folder per version, and
loaded from there; scoring tasks get it as a broadcast, so each executor loads it once.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import class_weights
from ..session import cut_lineage, ship_package
from .scoring import Scorer, ScorerFactory

MAX_WEIGHTS = 1 << 25          # places times labels: 256 MB of doubles on the driver
BLOCK = 1 << 18                # weights of one block of the gradient
ROWS = 256                     # rows of one matrix product
SHORT = 64                     # bytes of a word hashed together with others (255 at most)
_WORD = re.compile(r"\w+")


#: bytes that are in a word or beyond ASCII
_INSIDE = np.array([b > 127 or chr(b) == "_" or chr(b).isalnum() for b in range(256)])
_NOT_BLANK = np.arange(256) != 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32s(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``zlib.crc32`` of many ranges of ``data`` (bytes), a byte of all of them at a time."""
    order = np.argsort(size.max(initial=0) - size, kind="stable")
    at = first[order]
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    longer = len(at) - np.cumsum(np.bincount(size))              # how many ranges have more than so many bytes
    for j, n in enumerate(longer[longer > 0].tolist()):
        now = crc[:n]
        crc[:n] = _CRC[(now ^ data[at[:n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _tokens(raw: list[bytes], inside: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by blanks, and of each run of bytes that are ``inside`` its start, its size and its text."""
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = b" ".join([b"", *raw, b""])
    edge = np.flatnonzero(np.diff(inside[np.frombuffer(data, dtype=np.uint8)])) + 1
    return data, edge[::2], edge[1::2] - edge[::2], np.searchsorted(ends, edge[::2], "right")


def _keys(data: bytes, first: np.ndarray, size: np.ndarray, row: np.ndarray, dim: int) -> np.ndarray:
    """Row and place of each word as one number."""
    short, crc = size <= SHORT, np.empty(len(first), dtype=np.int64)
    crc[short] = crc32s(np.frombuffer(data, dtype=np.uint8), first[short], size[short].astype(np.uint8))
    for i in np.flatnonzero(~short).tolist():      # one by one: crc32s would take a step for each of their bytes
        crc[i] = zlib.crc32(data[first[i]:first[i] + size[i]])
    return row * dim + crc % dim


def counted(texts, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of its places; all texts' places and word counts, one text after the other, places rising.

    Words are the matches of ``_WORD`` in the lower-case text; only tokens beyond ASCII go through the expression.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data, first, size, row = _tokens(raw, _INSIDE)
    plain = np.ones(len(first), dtype=bool)
    plain[np.searchsorted(first, np.flatnonzero(np.frombuffer(data, dtype=np.uint8) > 127), "right") - 1] = False
    rest, found = np.flatnonzero(~plain), []
    cut = np.searchsorted(row[rest], np.arange(len(raw) + 1)).tolist()
    starts, ends = first[rest].tolist(), (first + size)[rest].tolist()
    for i, j in zip(cut, cut[1:]):
        tokens = b" ".join([data[x:y] for x, y in zip(starts[i:j], ends[i:j])]).decode("utf-8", "surrogatepass")
        found.append(" ".join(_WORD.findall(tokens)).encode("utf-8", "surrogatepass") if tokens else b"")
    keys = np.append(_keys(data, first[plain], size[plain], row[plain], dim), _keys(*_tokens(found, _NOT_BLANK), dim))
    key, n = np.unique(keys, return_counts=True)
    return np.bincount(key // dim, minlength=len(raw)), (key % dim).astype(np.int32), n.astype(np.int32)


def features(many: np.ndarray, place: np.ndarray, n: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, places and values of the rows of ``counted``: counts of Euclidean length 1, and the constant in place ``dim``."""
    row = np.repeat(np.arange(len(many)), many)
    squares = np.zeros(len(many), dtype=np.int64)
    np.add.at(squares, row, n.astype(np.int64) ** 2)
    last = np.cumsum(many)                                       # the constant comes after a row's places
    return (np.append(0, np.cumsum(many + 1)), np.insert(place.astype(np.int32), last, dim),
            np.insert(n / np.sqrt(squares)[row], last, 1.0))


def hashed(text: str | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (Euclidean length 1) of a text's word counts; place ``dim`` is the constant."""
    return features(*counted([text], dim), dim)[1:]


def dense(pairs: list, dim: int) -> np.ndarray:
    x = np.zeros((len(pairs), dim + 1))
    for i, (place, value) in enumerate(pairs):
        x[i, place] = value
    return x


def dense_rows(place: pa.Array, value: pa.Array, at: int, to: int, dim: int) -> np.ndarray:
    """``dense`` of the rows ``at`` to ``to`` of two list columns (no null lists), without a Python object a place."""
    starts = place.offsets.to_numpy()[at:to + 1]
    first = value.offsets.to_numpy()[at]
    return filled(starts - starts[0], place.values.to_numpy()[starts[0]:starts[-1]],
                  value.values.to_numpy()[first:first + starts[-1] - starts[0]], dim)


def filled(starts: np.ndarray, place: np.ndarray, value: np.ndarray, dim: int) -> np.ndarray:
    """``dense`` of rows that begin at ``starts`` (one more at the end) of ``place`` and ``value``."""
    x = np.zeros((len(starts) - 1, dim + 1))
    x[np.repeat(np.arange(len(x)), np.diff(starts)), place] = value
    return x


@dataclass
class JointModel:
    labels: list[str]
    dim: int
    weights: np.ndarray                       # (dim + 1, labels)
    history: list[dict] = field(default_factory=list)

    def logits(self, texts) -> np.ndarray:
        out = [filled(*features(*counted(texts[at:at + ROWS], self.dim), self.dim), self.dim) @ self.weights for at in range(0, len(texts), ROWS)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))

    def save(self, spark: SparkSession, path: str, version: str) -> str:
        """Write ``path``/``version`` (an existing version is an error) and return it."""
        out = f"{path.rstrip('/')}/{version}"
        meta = {"labels": self.labels, "dim": self.dim, "features": "crc32 of lower-case words, counts of length 1", "history": self.history}
        flat = self.weights.ravel()
        rows = [(i, flat[i * BLOCK:(i + 1) * BLOCK].tobytes()) for i in range(-(-len(flat) // BLOCK))]
        spark.createDataFrame(rows, "block int, data binary").coalesce(1).write.mode("error").parquet(f"{out}/weights")
        # last: a folder without it is no model
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("error").text(f"{out}/meta")
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> JointModel:
        meta = json.loads(spark.read.text(f"{path.rstrip('/')}/meta").first()[0])
        blocks = sorted(spark.read.parquet(f"{path.rstrip('/')}/weights").collect(), key=lambda r: r["block"])
        flat = np.frombuffer(b"".join(bytes(r["data"]) for r in blocks))
        return cls(meta["labels"], meta["dim"], flat.reshape(meta["dim"] + 1, len(meta["labels"])).copy(), meta["history"])

    def scorer(self, spark: SparkSession) -> ScorerFactory:
        """For ``score_texts``: the model as a broadcast."""
        ship_package(spark)
        shared = spark.sparkContext.broadcast((self.labels, self.dim, self.weights))

        def factory() -> Scorer:
            model = JointModel(*shared.value)
            return lambda texts: model.logits(list(texts))

        return factory


def _features(df: DataFrame, id_col: str, text_col: str, labels_col: str, labels: list[str], dim: int, hold_share: float) -> DataFrame:
    """Written table, a row for up to ``ROWS`` rows: held (by a hash of the id), many, place, n (as of ``counted``) and
    y (number of the row * labels + place of a label), each as the bytes of an array, which every pass takes as they are."""
    number = F.map_from_arrays(F.lit(labels), F.lit(list(range(len(labels))))) if labels else F.create_map().cast("map<string,int>")
    known = F.filter(F.transform(F.array_distinct(F.coalesce(labels_col, F.array().cast("array<string>"))), lambda x: number[x]), lambda i: i.isNotNull())
    held = F.pmod(F.xxhash64(F.lit("hold"), F.col(id_col)), F.lit(10 ** 6)) < F.lit(round(hold_share * 10 ** 6))
    src = df.select(held.alias("held"), F.col(text_col).alias("text"), known.alias("y"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                y = [i * len(labels) + k for i, ks in enumerate(b.column(2).to_pylist()) for k in ks]
                arrays = [b.column(0).to_numpy(zero_copy_only=False).astype(np.bool_), *(x.astype(np.int32) for x in counted(b.column(1).to_pylist(), dim)),
                          np.array(y, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["held", "many", "place", "n", "y"])

    return cut_lineage(src.mapInArrow(run, "held binary, many binary, place binary, n binary, y binary"))


def _pass(feats: DataFrame, model: JointModel, weight: np.ndarray) -> tuple[np.ndarray, float, float, int, int, np.ndarray]:
    """One job: gradient and loss over the training rows, loss and per-label counts over the held-out rows."""
    shared = feats.sparkSession.sparkContext.broadcast((model.weights, weight))
    dim, n_labels = model.dim, len(model.labels)

    def run(batches):
        w, pos = shared.value
        grad, loss, rows, counts = np.zeros_like(w), np.zeros(2), np.zeros(2), np.zeros((3, n_labels))
        for b in batches:
            for block in zip(*(c.to_pylist() for c in b.columns)):
                h, many, place, n, places = (np.frombuffer(x, kind) for x, kind in zip(block, (np.bool_, np.int32, np.int32, np.int32, np.int64)))
                x = filled(*features(many, place, n, dim), dim)
                y = np.zeros((len(x), n_labels))
                y.ravel()[places] = 1
                z = x @ w
                cost = np.where(y > 0, pos, 1.0)
                each = (cost * (np.logaddexp(0, z) - y * z)).sum(axis=1)
                for k, rows_of in enumerate((~h, h)):
                    loss[k] += each[rows_of].sum()
                    rows[k] += rows_of.sum()
                g = cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
                g[h] = 0
                grad += x.T @ g
                hit, true = z[h] > 0, y[h] > 0          # counts of the held-out rows
                counts += [(hit & true).sum(axis=0), (hit & ~true).sum(axis=0), (~hit & true).sum(axis=0)]
        flat = grad.ravel()
        out = [(i, flat[i * BLOCK:(i + 1) * BLOCK].tobytes()) for i in range(-(-len(flat) // BLOCK))]
        out.append((-1, np.concatenate([loss, rows, counts.ravel()]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["block", "data"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(d)
                total[i] = total[i] + v if i in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["block", "data"])

    ddl = "block int, data binary"
    got = {r["block"]: np.frombuffer(bytes(r["data"])) for r in
           feats.mapInArrow(run, ddl).repartition("block").mapInArrow(add, ddl).collect()}
    shared.destroy()
    if not got:
        return np.zeros_like(model.weights), 0.0, 0.0, 0, 0, np.zeros((3, n_labels))
    tail = got.pop(-1)
    grad = np.concatenate([got[i] for i in sorted(got)]).reshape(model.weights.shape)
    return grad, tail[0], tail[1], int(tail[2]), int(tail[3]), tail[4:].reshape(3, n_labels)


def fit_joint(df: DataFrame, text_col: str, labels_col: str, labels: list[str], id_col: str = "row_id", dim: int = 1 << 12,
              max_passes: int = 40, patience: int = 4, ridge: float = 1e-5, hold_share: float = 0.2, class_weighting: bool = True) -> JointModel:
    """Fit all labels together; ``history`` holds, per pass, training and held-out loss a row and held-out micro F1.

    A null or unknown label counts as none, a null text as empty; without rows the weights stay 0.
    """
    if (dim + 1) * max(len(labels), 1) > MAX_WEIGHTS:
        raise ValueError("the weight matrix must fit on the driver")
    ship_package(df.sparkSession)
    feats = _features(df, id_col, text_col, labels_col, labels, dim, hold_share)
    pos = np.ones(len(labels))
    if class_weighting:
        found = {r["label"]: r["weight"] for r in class_weights(
            df.select(F.explode(labels_col).alias("label")).filter(F.col("label").isin(labels))).collect()}
        pos = np.array([float(found.get(x) or 1.0) for x in labels])
    model = JointModel(list(labels), dim, np.zeros((dim + 1, len(labels))))
    best, best_at, kept = np.inf, 0, model.weights
    steps: list[tuple[np.ndarray, np.ndarray]] = []          # the last moves and gradient changes
    now: tuple | None = None                                 # accepted point: weights, value, gradient, direction
    length = 1.0
    for step in range(max_passes):
        grad, loss, held_loss, n, n_held, (tp, fp, fn) = _pass(feats, model, pos)
        if not n:
            break
        w = model.weights
        value, slope = loss / n + ridge / 2 * float((w * w).sum()), grad / n + ridge * w
        score = held_loss / n_held if n_held else loss / n
        total = 2 * tp.sum() + fp.sum() + fn.sum()
        model.history.append({"pass": step, "loss": float(loss / n), "held_loss": float(score),
                              "held_f1": float(2 * tp.sum() / total) if total else 0.0})
        if score < best - 1e-6:
            best, best_at, kept = score, step, w
        elif step - best_at >= patience:
            break
        if now is not None and value > now[1] + 1e-4 * length * float((now[2] * now[3]).sum()):
            length /= 2                                      # too far: half the way along the same direction
        else:
            if now is not None:
                moved, turned = w - now[0], slope - now[2]
                if float((moved * turned).sum()) > 1e-12:
                    steps = [*steps[-9:], (moved, turned)]
            now, length = (w, value, slope, _direction(slope, steps)), 1.0
        model.weights = now[0] + length * now[3]
    model.weights = kept
    return model


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion of limited-memory BFGS; the first step has length 1."""
    d, factors = -slope, []
    for moved, turned in reversed(steps):
        f = (moved * d).sum() / (moved * turned).sum()
        factors.append(f)
        d = d - f * turned
    if not steps:
        return d / max(np.sqrt((d * d).sum()), 1e-12)
    moved, turned = steps[-1]
    d = d * ((moved * turned).sum() / (turned * turned).sum())
    for (moved, turned), f in zip(steps, reversed(factors)):
        d = d + (f - (turned * d).sum() / (moved * turned).sum()) * moved
    return d


def held_out_scores(df: DataFrame, model: JointModel, text_col: str, labels_col: str, id_col: str = "row_id", hold_share: float = 0.2) -> DataFrame:
    """Per label: support, precision, recall and F1 over the held-out rows."""
    weight = np.ones(len(model.labels))
    feats = _features(df, id_col, text_col, labels_col, model.labels, model.dim, hold_share)
    tp, fp, fn = _pass(feats, model, weight)[5]
    p, r = (np.divide(tp, x, out=np.zeros_like(tp), where=x > 0) for x in (tp + fp, tp + fn))
    f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros_like(tp), where=2 * tp + fp + fn > 0)
    rows = pd.DataFrame({"label": model.labels, "support": (tp + fn).astype("int64"), "precision": p, "recall": r, "f1": f1})
    return df.sparkSession.createDataFrame([tuple(x) for x in rows.itertuples(index=False)],
                                           "label string, support long, precision double, recall double, f1 double")
