"""Substring dedup by relative Lempel-Ziv parsing (operator 2).

The reference is the collection itself: a word sequence may only be copied
from a document with a smaller id.  A factor is (start, length, reference
document, reference start); factors under ``size`` (13) words are literals.

1. Seeds.  A window of 13 words is represented by its smallest 5-word hash
   (a minimiser: a function of the window's content alone), so neighbouring
   windows mostly share a seed, and equal windows always do.  Seeds pass the
   two filters of :mod:`.bloom`; only windows whose seed occurs in two
   documents can be copied, the rest are literals and leave the map task.
2. Index.  The reference blocks are the hash partitions of the remaining
   windows, sorted; the first row of a window is its reference (first document
   and the position there).  The windows are computed and shuffled once, for
   the index and the lookup.
3. Parse.  Each window takes its reference from its block (the rows of one
   window are streamed and spill); each document gets its copied windows with
   their reference positions and is factored greedily from the left: a factor
   grows while the next window continues at the next reference position.
4. Factor boundaries.  A copied window may begin inside one factor and end in
   the next one or in a literal.  Each was looked up too, so it opens a factor
   of its own; the union of all factors is exactly the set of words in copied windows.

Windows are compared by 64-bit hashes of their 13 word hashes.

Defined cases: null or empty text has no words; a null ``doc_id`` takes no part
and loses nothing; rows that repeat a ``doc_id`` are one document as a source
and are each cleaned alike; a window repeated within one document only is not a
copy; empty tables give empty results; extra columns pass through untouched.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import repeat_filter
from .common import arrow_map
from .words import gram_hashes, mix, ragged, word_hashes

WINDOW = 13
SEED = 5
CHARS_PER_SEED = 30   # only sizes the filter


def windows(texts: list[str | None], size: int = WINDOW, seed: int = SEED):
    """(word offsets, text of each window, its start in the text, its hash, its seed)."""
    h, off = word_hashes(texts)
    start, doc = ragged(off, size)
    if not len(start):
        e = np.empty(0, dtype=np.uint64)
        return off, doc, start, e, e
    g = gram_hashes(h, seed)
    span, low, reach = size - seed + 1, g, 1
    while reach * 2 <= span:                      # minimum over `reach` consecutive seeds
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    return off, doc, start - off[:-1][doc], gram_hashes(h, size)[start], low[start]


def _distinct(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of the first occurrence of each (doc, key), ordered."""
    if not len(key):
        return np.empty(0, dtype=np.int64)
    both = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    return np.sort(np.unique(both, return_index=True)[1])


def copied_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, h, ref_doc, ref_pos): windows that start in an earlier document.

    The three are arrays in step (lists of one aggregation keep one row order).
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    n_chars = src.agg(F.sum(F.length("text"))).first()[0] or 0

    def seeds(b: pa.RecordBatch) -> np.ndarray:
        _, doc, _, _, low = windows(b.column(1).to_pylist(), size, seed)
        ids = b.column(0).to_numpy()[doc] if len(doc) else doc
        return low[_distinct(ids, low)]

    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(src, seeds, n_chars // CHARS_PER_SEED))

    def suspects(b: pa.RecordBatch):
        _, doc, pos, h, low = windows(b.column(1).to_pylist(), size, seed)
        hit = shared.value.test(low)
        doc, pos, h = doc[hit], pos[hit], h[hit]
        one = _distinct(doc, h)
        yield {"doc_id": b.column(0).to_numpy()[doc[one]], "pos": pos[one].astype(np.int32), "h": h[one].view(np.int64)}

    found = arrow_map(src, suspects, "doc_id long, pos int, h long")
    same = Window.partitionBy("h").orderBy("doc_id", "pos")
    looked_up = found.select("doc_id", "h", F.first("doc_id").over(same).alias("ref_doc"), F.first("pos").over(same).alias("ref_pos"))
    return (looked_up.filter("doc_id > ref_doc")
            .groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("h", "ref_doc", "ref_pos")]))


def parse(n_words: int, h: np.ndarray, copies: dict[str, np.ndarray], size: int):
    """Factors [(start, length, ref_doc, ref_start)] and the mask of copied words of one text."""
    gone = np.zeros(n_words, dtype=bool)
    if not len(h) or not len(copies["h"]):
        return [], gone
    order = np.argsort(copies["h"], kind="stable")
    keys = copies["h"][order]
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    pos = np.flatnonzero(keys[at] == h)
    if not len(pos):
        return [], gone
    src = order[at[pos]]
    ref_doc, ref_pos = copies["ref_doc"][src], copies["ref_pos"][src].astype(np.int64)
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (np.diff(pos) != 1) | (ref_doc[1:] != ref_doc[:-1]) | (np.diff(ref_pos) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    factors = [(int(pos[f]), int(pos[t] - pos[f]) + size, int(ref_doc[f]), int(ref_pos[f])) for f, t in zip(first, last)]
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, [f[0] for f in factors], 1)
    np.add.at(step, [f[0] + f[1] for f in factors], -1)
    return factors, np.cumsum(step[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     size: int = WINDOW, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, the text without copied words (the rest joined by one space),
    plus ``_parse`` (struct: ``n_words``, ``n_removed``, ``factors``)."""
    copies = copied_windows(docs, id_col, text_col, size, seed).withColumnsRenamed(
        {"doc_id": "_copy_id", "h": "_h", "ref_doc": "_ref_doc", "ref_pos": "_ref_pos"})

    @F.pandas_udf("text string, n_words long, n_removed long, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>")
    def clean(text: pd.Series, hs: pd.Series, ref_docs: pd.Series, ref_starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, h, ref_doc, ref_pos in zip(text, hs, ref_docs, ref_starts):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            factors: list = []
            if h is not None:
                cols = {"h": np.asarray(h, dtype=np.int64).view(np.uint64), "ref_doc": np.asarray(ref_doc),
                        "ref_pos": np.asarray(ref_pos)}
                factors, gone = parse(len(words), windows([t], size, seed)[3], cols, size)
                kept = list(compress(words, ~gone))
            else:
                kept = words
            out.append((b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept),
                        [dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in factors]))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "factors"])

    joined = docs.join(copies, F.col(id_col) == F.col("_copy_id"), "left").withColumn(
        "_parse", clean(F.col(text_col), "_h", "_ref_doc", "_ref_pos"))
    return joined.select(*[F.col("_parse.text").alias(c) if c == text_col else F.col(c) for c in docs.columns],
                         F.struct("_parse.n_words", "_parse.n_removed", "_parse.factors").alias("_parse"))
