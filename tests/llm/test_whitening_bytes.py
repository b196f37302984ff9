"""Whitening and byte-level BPE against plain computations."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm.bytebpe import ByteBpe, encode_bytes, public_pattern, rank_file
from tagweave.llm.whitening import by_component, components_of, deviations, pack, unpack, whiten

from .data import frame

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, digest string, whitened double"


def vectors(rng, n, d):
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return [[float(np.float32(c)) for c in v] for v in base]


def plain(rows, k, counts=True):
    """(id, whitened by component), explained, deviations: the straightforward way over the whole list."""
    ok = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(x) for _, x in ok)
    d = max(size, key=lambda s: (size[s], s))
    ok = [(i, x) for i, x in ok if len(x) == d]
    fit = [x for _, x in ok] if counts else sorted(set(map(tuple, [x for _, x in ok])))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, dtype=np.float64) - np.array(s) / n
    cov = m.T @ m / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in ok:
        out.append((i, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)))
    return n, out, e / np.trace(cov)


@pytest.mark.parametrize("counts", [True, False])
def test_whitening(spark, counts):
    rng = np.random.default_rng(4)
    vs = vectors(rng, 300, 12)
    rows = [(i, v) for i, v in enumerate(vs)] + [(1000 + i, vs[7]) for i in range(200)] + [(3, vs[3]), (None, vs[4])]
    odd = [(2001, None), (2002, []), (2003, [float("nan")] * 12), (2004, [1.0] * 11 + [None]), (2005, [float("inf")] * 12),
           (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c", 5, "d", 0.5) for i, v in rows + odd], SCHEMA).repartition(5)
    got = by_component(whiten(df, 8, "counts" if counts else "one")).collect()
    n, want, explained = plain(rows + odd, 8, counts)
    assert len(got) == 8 * len(want) and {r["n"] for r in got} == {n}
    sign = {}
    have, need = Counter(), Counter()
    first = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 10}
    for c in range(8):
        sign[c] = np.sign(first[c + 1]) * np.sign([w for i, _, w in want if i == 10][0][c])
    for r in got:
        have[r["vec_id"], r["component"], r["deviation"], round(r["whitened"] * sign[r["component"] - 1], 6) + 0.0] += 1
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    for i, dev, w in want:
        for c in range(8):
            need[i, c + 1, dev, round(float(w[c]), 6) + 0.0] += 1
    assert have == need


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert by_component(whiten(empty)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, "c", 5, "d", 0.5) for i in range(9)], SCHEMA)
    assert by_component(whiten(same)).count() == 0
    flat = spark.createDataFrame([(i, [0.5, float(i)], 1, "c", 5, "d", 0.5) for i in range(9)], SCHEMA)
    got = by_component(whiten(flat)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


def test_whitening_parts():
    x = np.array([1, -5, 100_000 + (1 << 31), 7])
    assert (unpack(pack(x)) == x).all() and (unpack(pack(x[:2])) == x[:2]).all() and pack(x)[:1] == b"q"
    small = np.array([[100_000, 99_000], [100_500, 98_000]])
    assert deviations(small, 2, [200_500, 197_000]) == [2 * 0 + 500 ** 2 + 1000 ** 2] * 2
    big = 10 ** 9
    assert deviations(small, big, [big * 100_250, big * 98_500]) == [None, None]
    e, u = components_of(np.diag([4.0, 9.0, 0.0]), 3)
    assert e.tolist() == [9, 4] and (u.max(axis=0) == 1).all()


@pytest.fixture(scope="module")
def codec():
    with open(rank_file(), "rb") as f:
        return ByteBpe(f.read(), public_pattern())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_pattern(), mergeable_ranks=codec.whole, special_tokens={})


def test_byte_bpe_equals_the_library(codec, library):
    rng = random.Random(3)
    parts = ["a", "b", " ", "\n", "1", "é", "'s", "th", "er", "東", "\u0085", "\xa0", "\x1c", "!", "  ", "ing", "²", "aaaa", "\0",
             "ab" * 9, "<|endoftext|>", "👍"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a" * 100_000, "".join(rng.choice("abcdeth") for _ in range(100_000)), " " * 70_000, "é" * 40_000, "x" * 64, "x" * 65, ""]
    n, ids, back = codec.encode_texts(texts)
    for t, c, i, b in zip(texts, n, ids, back):
        want = library.encode_ordinary(t)
        assert i == ",".join(map(str, want)) and c == len(want) and b == t.encode()


def test_shared_list_equals_single_lists(codec):
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcst eo") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3000)})
    assert codec.merge_all(words) == [codec.merge(w) for w in words]
    assert not any(codec.bits) and not any(codec.bucket)


def test_lower_rank_made_by_a_merge():
    # "bc" (rank 300) can make "abc" (rank 270), which then comes before the second "bc"
    import base64
    tokens = [bytes([b]) for b in range(256)] + [b"zz%d" % i for i in range(14)] + [b"abc"] + [b"yy%d" % i for i in range(29)] + [b"bc", b"cb"]
    c = ByteBpe(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), public_pattern())

    def naive(raw):
        t = [bytes([b]) for b in raw]
        while True:
            best = min(((c.whole[t[i] + t[i + 1]], i) for i in range(len(t) - 1) if t[i] + t[i + 1] in c.whole), default=None)
            if best is None:
                return [c.whole[x] for x in t]
            t[best[1]:best[1] + 2] = [t[best[1]] + t[best[1] + 1]]

    words = [b"abcbc", b"bcabcbcb", b"cbcbcabcabcbc", b"abcabc" * 3, b"aabcb"]
    assert c.merge_all(words) == [naive(w) for w in words] == [c.merge(w) for w in words]


def test_byte_bpe_frame(spark, library):
    docs = frame(spark)
    out = encode_bytes(docs)
    assert out.columns == [*docs.columns, "_bytes"]

    def digest(ids):
        return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    got = Counter((r["doc_id"], r["n"], r["ids"], r["back"]) for r in out.select(
        "doc_id", F.col("_bytes.n_tokens").alias("n"), F.sha2("_bytes.ids", 256).alias("ids"),
        F.sha2("_bytes.decoded", 256).alias("back")).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), digest(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want
    assert encode_bytes(docs.limit(0)).count() == 0
