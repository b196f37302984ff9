"""Line dedup with a once-seen and a twice-seen Bloom filter (operator 9).

1. map: hash the key of every eligible line (distinct per document), feed the
   two filters of :mod:`.bloom`; 4 bytes a line are shuffled;
2. map: only lines that the twice-seen filter knows are suspects; their keys
   go through one exact aggregation (first document, number of documents) —
   false positives of the filter fall out here;
3. confirmed keys are joined back to the suspects; each later document gets
   the hashes of the lines that it loses and rewrites its text.

Hot lines are reduced map-side by the aggregation, and the join's large side
can be split by AQE.  Texts are shuffled once, to meet their lists of lost lines.

Defined cases: null or empty text is one empty line; a null ``doc_id`` takes no
part and loses nothing; rows that repeat a ``doc_id`` count as one document and
each of them is cleaned by the same rule; keys under ``min_chars`` code points
stay; empty tables give empty results; extra columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import repeat_filter
from .common import arrow_map, cut_lineage

MIN_CHARS = 10


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Key of each line (ASCII strip and lower-case), None for a short one."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(key if long else None)
    return out


def _distinct(text: str | None, min_chars: int) -> dict[int, bytes]:
    return {xxhash.xxh3_64_intdigest(k): k for k in line_keys(text, min_chars) if k is not None}


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_hashes): for each document, the lines that an earlier document holds."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    n_lines = src.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0

    def hashes(b):
        pairs = [h for t in _rows(b) for h in t]
        return np.array(pairs, dtype=np.uint64)

    def _rows(b):
        seen: dict = {}
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.setdefault(i, {}).update(_distinct(t, min_chars))
        return seen.values()

    flt = repeat_filter(src, hashes, n_lines)
    shared = docs.sparkSession.sparkContext.broadcast(flt)

    def suspects(b):
        ids, hs, ks = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for h, k in _distinct(t, min_chars).items():
                ids.append(i)
                hs.append(h)
                ks.append(k)
        hit = shared.value.test(np.array(hs, dtype=np.uint64)) if hs else []
        pick = np.flatnonzero(hit)
        yield {"doc_id": [ids[j] for j in pick], "h": np.array(hs, dtype=np.uint64).view(np.int64)[pick],
               "key": [ks[j] for j in pick]}

    found = cut_lineage(arrow_map(src, suspects, "doc_id long, h long, key binary"))
    shared.destroy()            # the suspects are a written table now
    # a table of its own: the join below then shuffles the suspects for itself, and AQE can split a hot key
    first = cut_lineage(found.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
                        .filter("first_doc < last_doc").select("key", "first_doc"))
    return (found.join(first, "key").filter("doc_id > first_doc")
            .groupBy("doc_id").agg(F.collect_set("h").alias("line_hashes")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with repeated lines removed from the text, plus
    ``_lines`` (struct: ``total`` before dropping, ``dropped``)."""
    drop = cut_lineage(repeated_lines(docs, id_col, text_col, min_chars)
                       .withColumnsRenamed({"doc_id": "_drop_id", "line_hashes": "_drop"}))

    @F.pandas_udf("text string, total long, dropped long")
    def clean(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, gone):
            t = t or ""
            lines = t.split("\n")
            kept = lines
            if g is not None:
                bad = {int(x) & 0xFFFFFFFFFFFFFFFF for x in g}
                kept = [x for x, k in zip(lines, line_keys(t, min_chars))
                        if k is None or xxhash.xxh3_64_intdigest(k) not in bad]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "total", "dropped"]).astype({"total": "int64", "dropped": "int64"})

    joined = docs.join(drop, F.col(id_col) == F.col("_drop_id"), "left").withColumn(
        "_lines", clean(F.col(text_col), F.col("_drop")))
    return joined.select(*[F.col("_lines.text").alias(c) if c == text_col else F.col(c) for c in docs.columns], "_lines")
