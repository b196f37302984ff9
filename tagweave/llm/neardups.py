"""N-gram Jaccard join with Bayesian candidate pruning (operator 3).

Similarity is the Jaccard index of the sets of five-word shingles (a text of one
to four words is one shingle); pairs at 0.8 or more are linked.

1. Every text gets 60 MinHash values and a digest of its shingle set.
   Documents with the same set are one class, represented by its smallest id;
   copies are never expanded.
2. Representatives meet in 20 bands of 3 values: a pair at 0.8 misses all
   bands with probability below 6e-7.  A bucket of n texts is cut into blocks of
   at most ``BLOCK`` and dealt out as cells of two blocks, so no task holds a
   hot bucket; a pair is handled only in the first band that it shares.
3. Inside a cell all pairs are compared on 12 MinHash values at a time (NumPy
   matrices).  With m of n values equal and a uniform prior the posterior
   of the similarity is Beta(m+1, n-m+1); a pair is dropped as soon as the
   posterior probability of reaching the threshold falls below ``TOLERANCE``.
4. The survivors' shingle sets are fetched (only for cells with survivors) and
   every surviving pair is verified exactly.  A cell returns per member its
   number of links and the smallest member it reaches: never pairs.
5. Classes are the connected components of those stars.

Nodes are shingle sets (numbered in a written table), never document ids: an id is only looked up at the end.

Defined cases: null, empty or blank text has no shingles and no link; a null
``doc_id`` takes no part (its row keeps a null class); rows that repeat a
``doc_id`` with another text count as documents of their own that share that id, whatever the order of the rows;
rows that repeat id and text are one document for ``drop_near_duplicates`` (they stay or go together); empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage
from .components import components
from .quality import binom_cdf
from .words import gram_hashes, mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS, STEP = 20, 3, 12
K = BANDS * ROWS
TOLERANCE = 1e-7
BLOCK = 256
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, off = word_hashes(texts)
    g = gram_hashes(h, size)
    out = []
    for lo, hi in zip(off[:-1], off[1:]):
        if hi - lo >= size:
            out.append(np.unique(g[lo:hi - size + 1]))
        elif hi > lo:
            out.append(gram_hashes(h[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, K) MinHash values; sets must not be empty."""
    out = np.empty((len(sets), K), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            x = (s >> np.uint64(32)).astype(np.uint32)
            low = np.full(K, np.iinfo(np.uint32).max, dtype=np.uint32)
            for at in range(0, len(x), 2048):
                v = x[None, at:at + 2048] * _A[:, None]
                v += _B[:, None]
                v ^= v >> np.uint32(15)
                low = np.minimum(low, v.min(axis=1))
            out[i] = low
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; equal only for the same band with the same values (up to hashing)."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            key = mix(key ^ parts[:, :, r])
    return key


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 12, 24, .. compared values: the fewest equal ones that keep a pair."""
    out = []
    for n in range(STEP, K + 1, STEP):
        # P(J >= t | m of n) = P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
        out.append(next(m for m in range(n + 1) if binom_cdf(m, n + 1, threshold) >= tolerance))
    return out


def _cell_pairs(side: np.ndarray, sig: np.ndarray, size: np.ndarray, band: int, threshold: float, least: list[int]):
    """Index pairs of one cell that survive size filter, first-band rule and pruning.

    ``side``: 0 / 1 for the two blocks of a cell, 2 when the cell is one block.
    """
    if side[0] == 2:
        a, b = np.triu_indices(len(side), 1)
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    lo, hi = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    ok = lo >= threshold * hi - 1e-9
    a, b = a[ok], b[ok]
    if band and len(a):
        parts = sig[:, :band * ROWS].reshape(len(sig), band, ROWS)
        keep = np.ones(len(a), dtype=bool)
        for j in range(band):
            keep &= (parts[a, j] != parts[b, j]).any(axis=1)
        a, b = a[keep], b[keep]
    m = np.zeros(len(a), dtype=np.int32)
    for i, need in enumerate(least):
        if not len(a):
            break
        m = m + (sig[a, i * STEP:(i + 1) * STEP] == sig[b, i * STEP:(i + 1) * STEP]).sum(axis=1)
        keep = m >= need
        a, b, m = a[keep], b[keep], m[keep]
    return a, b


def _verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float):
    """The pairs whose shingle sets reach the threshold exactly."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if len(a) < 64:
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    else:
        # members x shingles incidence, a bounded number of columns at a time
        row = np.repeat(np.arange(len(sets)), size)
        ids, col = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for at in range(0, len(ids), 4096):
            x, y = np.searchsorted(col, (at, at + 4096))
            m = np.zeros((len(sets), 4096), dtype=np.float32)
            m[row[x:y], col[x:y] - at] = 1
            both += m @ m.T
        inter = both[a, b].astype(np.int64)
    ok = inter >= threshold * (size[a] + size[b] - inter) - 1e-9
    return a[ok], b[ok]


def _cells(batches, columns: int):
    """Whole cells from rows sorted by (key, lo, hi): yields lists of column arrays."""
    held: pa.Table | None = None

    def groups(t: pa.Table, last: bool):
        cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
        cut = np.append(np.flatnonzero(new), t.num_rows)
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi < t.num_rows or last:
                yield [c[lo:hi] for c in cols]
        return

    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b])
        held = pa.concat_tables([held, t]) if held is not None else t
        key = [held.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
        tail = int(np.argmin(same[::-1])) if not same.all() else held.num_rows
        if tail < held.num_rows:
            yield from groups(held.slice(0, held.num_rows - tail), True)
            held = held.slice(held.num_rows - tail).combine_chunks()
    if held is not None:
        yield from groups(held, True)


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with words and an id: doc_id, text_md5, node (its class, as a number), class_id,
    copy_id, n_links (see ``near_duplicates``)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(b: pa.RecordBatch):
        texts = b.column(1).to_pylist()
        sets = shingle_sets(texts)
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = minhash([sets[i] for i in full])
        yield {"doc_id": b.column(0).take(pa.array(full, pa.int64())),
               "text_md5": [hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest() for i in full],
               "digest": [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full],
               "n": [len(sets[i]) for i in full], "sig": [x.tobytes() for x in sig]}

    signed = cut_lineage(arrow_map(src.filter("doc_id is not null"), sign, "doc_id long, text_md5 binary, digest binary, n int, sig binary"))
    reps = cut_lineage(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                    F.first("n").alias("n"), F.first("sig").alias("sig"))
                       .withColumn("node", F.monotonically_increasing_id()))

    def bands(b: pa.RecordBatch):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, K)
        key = band_keys(sig)
        yield {"node": np.repeat(b.column(0).to_numpy(), BANDS), "band": np.tile(np.arange(BANDS), len(sig)),
               "key": key.view(np.int64).ravel()}

    member = arrow_map(reps.select("node", "sig"), bands, "node long, band int, key long")
    bucket = cut_lineage(member.groupBy("key").agg(F.count(F.lit(1)).alias("n_in")).filter("n_in > 1"))
    met = member.join(bucket, "key")
    blocks = F.ceil(F.col("n_in") / BLOCK).cast("int")
    cell = (met.withColumn("blk", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"),
                    F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1).alias("side"),
                    "node", "band"))
    cell = cut_lineage(cell)
    least = least_matches(threshold)

    def prune(batches):
        for key, lo, hi, side, node, band, n, sig in _cells(batches, 8):
            if len(node) < 2:
                continue
            s = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(-1, K)
            a, b = _cell_pairs(side, s, n, int(band[0]), threshold, least)
            live = np.unique(np.concatenate([a, b]))
            if len(live):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[live], pa.int64()), pa.array(lo[live], pa.int32()), pa.array(hi[live], pa.int32()),
                     pa.array(side[live], pa.int32()), pa.array(node[live], pa.int64()), pa.array(band[live], pa.int32())],
                    names=["key", "lo", "hi", "side", "node", "band"])

    withsig = cell.join(reps.select("node", "n", "sig"), "node").select("key", "lo", "hi", "side", "node", "band", "n", "sig")
    live = cut_lineage(_dealt(withsig).mapInArrow(prune, "key long, lo int, hi int, side int, node long, band int"))

    # one text of each class with survivors; rows that repeat a doc_id may differ, so the set is matched by its digest
    wanted = live.select("node").distinct().join(reps.select("node", "rep", "digest"), "node")
    texts = src.join(wanted, src["doc_id"] == wanted["rep"]).select("node", "text", "digest")

    def checked(b: pa.RecordBatch):
        sets = shingle_sets(b.column(1).to_pylist())
        ok = [i for i, (s, d) in enumerate(zip(sets, b.column(2).to_pylist()))
              if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
        yield {"node": b.column(0).take(pa.array(ok, pa.int64())), "grams": [sets[i].tobytes() for i in ok]}

    grams = arrow_map(texts, checked, "node long, grams binary").dropDuplicates(["node"])
    grams = cut_lineage(grams.join(reps.select("node", "copies", "sig"), "node"))

    def verify(batches):
        for key, lo, hi, side, node, band, copies, sig, raw in _cells(batches, 9):
            s = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(-1, K)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
            a, b = _cell_pairs(side, s, np.array([len(x) for x in sets]), int(band[0]), threshold, least)
            a, b = _verified(a, b, sets, threshold)
            if not len(a):
                continue
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = np.arange(len(node))
            while True:                                  # smallest member reachable inside the cell
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                if (low == root).all():
                    break
                root = low
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit], pa.int64()), pa.array(node[root[hit]], pa.int64()),
                                              pa.array(links[hit], pa.int64())], names=["node", "near", "links"])

    full = live.join(grams, "node").select("key", "lo", "hi", "side", "node", "band", "copies", "sig", "grams")
    stars = cut_lineage(_dealt(full).mapInArrow(verify, "node long, near long, links long"))
    links = stars.groupBy("node").agg(F.sum("links").alias("links"))
    roots = cut_lineage(components(stars.select(F.col("node").alias("u"), F.col("near").alias("v")))
                        .join(reps.select("node", "rep"), "node"))
    # a table of its own, so that the join can split a class that holds most nodes
    class_ids = cut_lineage(roots.groupBy("root").agg(F.min("rep").alias("class_id")))
    linked = roots.join(class_ids, "root").select("node", "root", "class_id")
    known = (reps.select("digest", "node", "rep", "copies").join(links, "node", "left").join(linked, "node", "left")
             .select("digest", F.coalesce("root", "node").alias("node"), F.col("rep").alias("copy_id"),
                     F.coalesce("class_id", "rep").alias("class_id"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return signed.select("doc_id", "text_md5", "digest").join(known, "digest").drop("digest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its linked group; itself
    when alone), copy_id (smallest id with the same shingle set), n_links (other
    documents at ``threshold`` or more, copies included)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blank = arrow_map(src, lambda b: [_blank(b)], "doc_id long").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return (classes(docs, id_col, text_col, threshold).select("doc_id", "class_id", "copy_id", "n_links")
            .unionByName(blank))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the later documents of each class (smallest id stays, of equal ids the text with the
    smallest digest); documents without words or without an id stay."""
    got = cut_lineage(classes(docs, id_col, text_col, threshold).select("doc_id", "text_md5", "node", "class_id"))
    # only ids that repeat can have two documents with the smallest id of one class
    tied = (got.filter("doc_id = class_id").groupBy("node").agg(F.min("text_md5").alias("low"), F.max("text_md5").alias("high"))
            .filter("low <> high").select("node", "low"))
    later = (got.filter("doc_id <> class_id").select("doc_id", "text_md5")
             .unionByName(got.filter("doc_id = class_id").join(tied, "node").filter("text_md5 <> low").select("doc_id", "text_md5"))
             .distinct().select(F.col("doc_id").alias("_late_id"), F.col("text_md5").alias("_late_md5")))
    late = cut_lineage(later)
    same = (F.col(id_col) == F.col("_late_id")) & (F.unhex(F.md5(F.col(text_col))) == F.col("_late_md5"))
    return docs.join(late, same, "left_anti")


def _blank(b: pa.RecordBatch) -> dict:
    """Rows that take no part: a null id, or no words."""
    out = [i for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
           if i is None or not (t or "").encode("utf-8", "surrogatepass").split()]
    return {"doc_id": out}
