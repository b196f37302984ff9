"""Exact set-similarity self-join (J5, N2): every pair of texts with Jaccard at or above a threshold.

No pair is missed: candidates come from prefix filtering, not from sampling or hashing into bands.

1. Texts that are equal in lower case are one set; copies are expanded at the end.  Texts are written once with the
   size of their set; sets are built from the texts whenever they are needed and never written.
2. The space of shingle hashes is cut into slices.  A pair with |x & y| >= t * |x | y| has a slice in which the same
   holds for the shingles of that slice (else the sum over the slices would fail), so each slice is joined alone, over all of
   its shingles, and the pairs of all slices together miss none.  Long texts are cut into more slices than short ones:
   a level holds the sets of one range of sizes and those that can have a partner there.
3. Inside a slice, shingles are ordered by how many sets hold them, rarest first.  Two sets of Jaccard t share a shingle
   among the rarest n - ceil(t * n) + 1 of the longer and the rarest n - ceil(2t / (1+t) * n) + 1 of the shorter one, so
   only those, without the shingles of one set alone, are met: boilerplate, being frequent, is met only in texts
   that hold little else.  Pairs are filtered by length and position, then counted on the whole slice.
4. The shuffled shingles fill the disk, so the slices are dealt in ``PASSES`` passes over the texts; the files of a
   pass go before the next.
5. Every pair of any slice is verified on both whole sets, in cells of two blocks of texts: a text is sent once to a
   cell, not once a pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NEAR_DUP_JACCARD
from ..session import bound_batches, cut_lineage, ship_package, shuffles_dropped
from .neardup import SHINGLE_CHARS, _distinct, _hasher, _shingler

_EPS = 1e-9
LEVELS = (0, 128, 1024)        # sizes of sets at which a level begins
CELL_TOKENS = 6_000_000        # shingles of one slice: what a task holds
PASSES = 4                     # each shuffles a quarter of the shingles, 4 bytes each
MEETS = 1 << 21                # meetings of two prefix entries at once
LOOKED_UP = 1 << 16            # shingles of pairs counted at once: they stay in the cache
FEW_IDS = 10_000               # of copies that are left out of each pass by a broadcast
CELL_PAIRS = 2_000             # pairs verified in one cell


def prefix_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, id, n, at, short) of every shared prefix shingle of ``sets(id, sh, n)``; ``at`` is its 0-based place in
    the set's order, ``short`` whether it also is in the prefix of a shorter partner."""
    tokens = sets.select("id", "n", F.explode("sh").alias("h"))
    freq = cut_lineage(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    need = F.ceil(F.col("n") * threshold - _EPS).cast("int")
    both = F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - _EPS).cast("int")
    # The counts are one row a shingle, dealt evenly by hash, so a hash table of a partition of them is small beside the
    # tokens, which then need no sort.  The grouping gathers a set's own shingles: bounded by one text.
    shared = (tokens.join(freq.hint("shuffle_hash"), "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
              .withColumn("alone", F.col("n") - F.size("s")).filter(F.size("s") >= need))
    places = F.greatest(F.col("n") - need + 1 - F.col("alone"), F.lit(0))
    return (shared.select("id", "n", "alone", both.alias("both"), F.posexplode(F.slice("s", F.lit(1), places)).alias("i", "c"))
            .select(F.col("c.h").alias("h"), "id", "n", (F.col("alone") + F.col("i")).alias("at"),
                    (F.col("alone") + F.col("i") <= F.col("n") - F.col("both")).alias("short")))


def candidate_pairs(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a the shorter set (ties: smaller id), that share a prefix shingle and pass length and position filter."""
    l, r = index.filter("short").alias("l"), index.alias("r")
    n_l, n_r = F.col("l.n"), F.col("r.n")
    shorter = (n_l < n_r) | ((n_l == n_r) & (F.col("l.id") < F.col("r.id")))
    overlap = F.ceil((n_l + n_r) * (threshold / (1 + threshold)) - _EPS)
    left = F.least(n_l - F.col("l.at"), n_r - F.col("r.at"))
    return (l.join(r, (F.col("l.h") == F.col("r.h")) & shorter & (n_l >= n_r * threshold - _EPS) & (left >= overlap))
            .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())


def _spread(h: np.ndarray) -> np.ndarray:
    """Shingle hashes made even in all bits (one to one)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _dealer(levels: list[tuple[int, float, int, int, int, int]], kind: str, size: int):
    """Kernel: rows (id, t, n) to rows (cell, id, n, tokens), a row for each slice of this pass that holds shingles of the text.

    ``levels``: (smallest, largest set size; slices; first and end slice of this pass; cell number of slice 0).  A slice is a range of the
    hash's upper half, a token its lower half, 4 bytes each in ``tokens``.
    """
    hashes = _hasher(kind, size)
    half = np.uint64(32)

    def run(batches):
        for batch in batches:
            cells, rows, counts, tokens = [], [], [], []
            sizes = batch.column(2).to_numpy()
            for i, t in enumerate(batch.column(1).to_pylist()):
                h = None
                for least, most, slices, lo, hi, at in levels:
                    if not least <= sizes[i] <= most:
                        continue
                    h = _spread(hashes(t)) if h is None else h
                    bounds = np.array([-(-(s << 32) // slices) for s in range(lo, hi + 1)], dtype=np.uint64)
                    up = h >> half
                    own = _distinct(h[(up >= bounds[0]) & (up < bounds[-1])] if hi - lo < slices else h)
                    k = np.diff(np.searchsorted(own >> half, bounds))
                    full = np.flatnonzero(k)
                    cells.append(full + (at + lo))
                    counts.append(k[full])
                    rows.append(np.full(len(full), i))
                    tokens.append(own.astype(np.uint32))
            if not cells:
                continue
            rows, counts, tokens = np.concatenate(rows), np.concatenate(counts), np.concatenate(tokens)
            ends = np.zeros(len(rows) + 1, dtype=np.int64)
            np.cumsum(counts * 4, out=ends[1:])
            for a in range(0, len(rows), 1 << 14):
                b = min(a + (1 << 14), len(rows))
                part = tokens[ends[a] // 4:ends[b] // 4]
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a:b + 1] - ends[a]).astype(np.int32)),
                                                                    pa.py_buffer(part)])
                take = pa.array(rows[a:b], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)[a:b], pa.int32()), batch.column(0).take(take),
                                                  pa.array(sizes[rows[a:b]], pa.int32()), packed], names=["cell", "id", "n", "tokens"])

    return run


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .., first + count - 1 of each entry, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _blocks(count: np.ndarray, most: int):
    """Ranges of entries whose counts add up to about ``most`` (one entry at least)."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _overlaps(a: np.ndarray, b: np.ndarray, first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Common tokens of sets a[i] and b[i]; set s is ``tokens[first[s]:first[s + 1]]``, distinct numbers below 2**32."""
    out, size = np.zeros(len(a), dtype=np.int64), np.diff(first)
    for lo, hi in _blocks(size[a] + size[b], LOOKED_UP):
        pair = np.arange(hi - lo) << 32
        both = np.concatenate([np.repeat(pair, size[x[lo:hi]]) | tokens[_expanded(first[x[lo:hi]], size[x[lo:hi]])] for x in (a, b)])
        both.sort()
        out[lo:hi] = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=hi - lo)
    return out


def _slice_pairs(k: np.ndarray, whole: np.ndarray, tokens: np.ndarray, threshold: float):
    """Yields index pairs of the sets whose tokens in this slice reach ``threshold`` (the longer set may come first).

    ``k``: shingles of each set in the slice, in rising order; ``whole``: in all; ``tokens``: 4 bytes of each, set by set.
    Two shingles of a set may have one token: the set then holds fewer tokens than shingles, and what is lacking is
    granted to the overlap, so no pair is lost by it.
    """
    n, low, half = len(k), np.uint64(0xFFFFFFFF), np.uint64(32)
    entry = (tokens.astype(np.uint64) << half) | np.repeat(np.arange(n, dtype=np.uint64), k)
    entry.sort()
    entry = entry[np.append(True, entry[1:] != entry[:-1])]
    start = np.flatnonzero(np.append(True, (entry[1:] >> half) != (entry[:-1] >> half)))
    df = np.diff(np.append(start, len(entry)))
    by_df = np.argsort(df, kind="stable")
    place = np.empty(len(df), dtype=np.uint64)
    place[by_df] = np.arange(len(df), dtype=np.uint64)
    entry = ((entry & low) << half) | np.repeat(place, df)      # now by set, each in prefix order
    entry.sort()
    df = df[by_df]
    owner, token = (entry >> half).astype(np.int64), (entry & low).astype(np.int64)
    first = np.searchsorted(owner, np.arange(n + 1))
    lacking = k - np.diff(first)
    at = np.arange(len(entry)) - first[owner]
    need, both = np.ceil(k * threshold - _EPS).astype(np.int64), np.ceil(k * (2 * threshold / (1 + threshold)) - _EPS).astype(np.int64)
    met = np.flatnonzero((at <= (k - need)[owner]) & (df[token] > 1))
    met = met[np.argsort(token[met], kind="stable")]            # postings: by token, then by set
    owner, place, at = owner[met], token[met], at[met]
    posting = (place << 32) | owner
    end = np.searchsorted(posting, (place << 32) | np.searchsorted(k, k / threshold + _EPS, side="right")[owner])
    here = np.arange(len(met))
    here = here[(at <= (k - both)[owner]) & (end > here + 1)]
    here = here[np.argsort(owner[here], kind="stable")]         # the partners of a set come together
    count = end[here] - here - 1
    for lo, hi in _blocks(count, MEETS):
        i = np.repeat(here[lo:hi], count[lo:hi])
        j = _expanded(here[lo:hi] + 1, count[lo:hi])
        a, b = owner[i], owner[j]
        overlap = np.ceil((k[a] + k[b]) * (threshold / (1 + threshold)) - _EPS)
        ok = ((np.minimum(k[a] - at[i], k[b] - at[j]) >= overlap)
              & (np.minimum(whole[a], whole[b]) >= threshold * np.maximum(whole[a], whole[b]) - _EPS))
        pair = _distinct((a[ok] << 32) | b[ok])
        a, b = pair >> 32, pair & 0xFFFFFFFF
        inter = _overlaps(a, b, first, token) + np.minimum(lacking[a], lacking[b])
        ok = inter >= np.ceil((k[a] + k[b]) * (threshold / (1 + threshold)) - _EPS)
        yield a[ok], b[ok]


def _slice_joiner(threshold: float):
    def join(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        k = np.array([len(x) // 4 for x in rows.column("tokens").to_pylist()], dtype=np.int64)
        order = np.argsort(k, kind="stable")
        rows = rows.take(pa.array(order))
        tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), dtype=np.uint32)
        found = [*_slice_pairs(k[order], rows.column("n").to_numpy(), tokens, threshold)] if len(k) > 1 else []
        a, b = (np.concatenate([p[i] for p in found]) if found else np.empty(0, dtype=np.int64) for i in (0, 1))
        ids = rows.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    return join


def _verifier(threshold: float, kind: str, size: int):
    shingle = _shingler(kind, size)

    def verify(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, back = np.unique(texts.column("id").to_numpy(), return_index=True)
        column = texts.column("t")
        sets = [shingle(column[int(i)].as_py()) for i in back]
        first = np.append(0, np.cumsum([len(x) for x in sets]))
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
        a, b = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in "ab")
        inter = _overlaps(a, b, first, tokens)
        n = np.diff(first)
        j = inter / (n[a] + n[b] - inter)
        ok = j >= threshold
        return pa.table({"a": ids[a[ok]], "b": ids[b[ok]], "jaccard": j[ok]})

    return verify


def _candidates(texts: DataFrame, threshold: float, kind: str, size: int) -> DataFrame:
    """(a, b) of ``texts(id, t, n)`` that reach ``threshold`` in some slice, in either order, written."""
    id_type = dict(texts.dtypes)["id"]
    ranges = []
    for least, above in zip(LEVELS, [*LEVELS[1:], None]):
        # a set of n can have partners from t * n on: it takes part in every level that holds such sizes
        most = float("inf") if above is None else (above - 1 + _EPS) / threshold
        ranges.append((least, most))
    held = texts.agg(*[F.sum(F.when((F.col("n") >= lo) & (F.col("n") <= F.lit(hi)), F.col("n"))) for lo, hi in ranges]).first()
    slices = [-(-int(x or 0) // CELL_TOKENS) for x in held]
    ends = np.append(0, np.cumsum(slices)).tolist()
    found = []
    for p in range(passes := min(PASSES, ends[-1])):
        lo, hi = ends[-1] * p // passes, ends[-1] * (p + 1) // passes
        levels = [(*r, s, max(lo - e, 0), min(hi - e, s), e) for r, s, e in zip(ranges, slices, ends) if lo < e + s and hi > e and s]
        dealt = texts.select("id", "t", "n").mapInArrow(_dealer(levels, kind, size), f"cell int, id {id_type}, n int, tokens binary")
        found.append(cut_lineage(dealt.groupBy("cell").applyInArrow(_slice_joiner(threshold), f"a {id_type}, b {id_type}")))
    if not found:
        return texts.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    pairs = reduce(DataFrame.unionByName, found)
    return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, kind: str, size: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole sets reach ``threshold``."""
    id_type = dict(texts.dtypes)["id"]
    side = max(1, int(np.ceil((pairs.count() / CELL_PAIRS) ** 0.5)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    pairs = cut_lineage(pairs.withColumn("cell", block("a") * side + block("b")))
    wanted = cut_lineage(pairs.select("cell", F.col("a").alias("id")).unionByName(pairs.select("cell", F.col("b").alias("id"))).distinct())
    sent = texts.select("id", "t").join(wanted, "id")
    return (sent.groupBy("cell").cogroup(pairs.groupBy("cell"))
            .applyInArrow(_verifier(threshold, kind, size), f"a {id_type}, b {id_type}, jaccard double"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = NEAR_DUP_JACCARD,
                  kind: str = "char", size: int = SHINGLE_CHARS) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of rows whose lower-cased texts' shingle sets reach ``threshold``.

    A null text counts as empty; ids are taken to be unique and not null.
    """
    spark = df.sparkSession
    ship_package(spark)
    bound_batches(spark)
    shingle = _shingler(kind, size)

    @F.pandas_udf("int")
    def set_size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(shingle(t)))

    with shuffles_dropped(spark):
        rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.lower(F.col(text_col)), F.lit("")).alias("t"))
        rows = cut_lineage(rows.withColumn("k", F.md5("t")).withColumn("n", set_size("t")))
        reps = cut_lineage(rows.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
        others = cut_lineage(rows.select("id", "k").join(reps.filter("copies > 1").select("k", "rep"), "k").filter("id <> rep").select("id"))
        few = others.count() <= FEW_IDS
        texts = rows.join(F.broadcast(others) if few else others, "id", "left_anti")
        texts = texts if few else cut_lineage(texts)
        close = cut_lineage(_verified(_candidates(texts, threshold, kind, size), texts, threshold, kind, size))
    # copies: only keys with several rows are joined
    many = rows.select("id", "k").join(reps.filter("copies > 1").select("k", "rep"), "k").select("rep", "id", "k")
    copy = cut_lineage(many)

    def spread(pairs, c):
        other = copy.filter("id <> rep").select(F.col("rep").alias(c), F.col("id").alias("_copy"))
        return pairs.unionByName(pairs.join(other, c).withColumn(c, F.col("_copy")).select(*pairs.columns))

    x, y = copy.alias("x"), copy.alias("y")
    equal = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("jaccard"))
    found = spread(spread(close, "a"), "b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").unionByName(equal)
