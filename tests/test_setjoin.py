"""The exact similarity join against all pairs, and what its index holds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import neardup as ND
from tagweave.operators import setjoin as SJ


def shingles(t, size=9):
    t = (t or "").lower()
    return {t[i:i + size] for i in range(len(t) - size + 1)} or {t}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    header = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for c in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 20, 60]))]
        for v in range(4):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    out += [header + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 40]))) for _ in range(30)]
    out += [out[0].upper(), out[0], out[3], "", "", None, "short", "SHORT", "shorter", "w1 w2 w3 w4", "w1 w2 w3 w5"]
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_every_pair_and_no_other(spark, threshold):
    texts = corpus(int(threshold * 10))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    sets = [shingles(t) for t in texts]
    want = {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            want[a, b] = round(j, 9)
    rows = SJ.similar_pairs(df, "id", "text", threshold).collect()
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in rows}
    assert got == want and len(rows) == len(want)


def test_no_rows(spark):
    assert SJ.similar_pairs(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_texts_with_a_common_header_only_are_not_indexed_by_it(spark):
    """A text is met by its rare shingles: unrelated texts behind one header give no candidates."""
    rng = random.Random(5)
    header = " ".join(f"head{i}" for i in range(8))
    texts = [header + " " + " ".join(f"{rng.randrange(10 ** 9)}" for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = df.select("id", ND._shingle_set_udf("char", 9)("t").alias("sh")).withColumn("n", F.size("sh")).cache()
    index = SJ.prefix_index(sets, 0.6).cache()
    assert index.count() == 0 and SJ.candidate_pairs(index, 0.6).count() == 0
    # at a threshold that the header alone nearly reaches, only prefixes are indexed, never whole sets
    low = SJ.prefix_index(sets, 0.15)
    worst = low.join(sets.select("id", "sh"), "id").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    assert worst.filter("k > n - ceil(0.15 * n - 1e-9) + 1").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_slices_levels_and_passes_lose_no_pair(spark, monkeypatch, threshold):
    """Many slices of small levels, dealt in several passes and verified in many cells, give the pairs of one slice."""
    monkeypatch.setattr(SJ, "LEVELS", (0, 30, 90, 200))
    monkeypatch.setattr(SJ, "CELL_TOKENS", 1500)
    monkeypatch.setattr(SJ, "CELL_PAIRS", 5)
    test_every_pair_and_no_other(spark, threshold)


def test_slice_pairs_of_equal_tokens():
    """Shingles of a set that have the same token are granted to the overlap: no pair is lost by them."""
    import numpy as np
    k = np.array([5, 5, 6])
    tokens = np.array([1, 2, 3, 3, 4] + [1, 2, 3, 3, 9] + [11, 12, 13, 14, 15, 16], dtype=np.uint32)
    got = [(int(x), int(y)) for a, b in SJ._slice_pairs(k, k, tokens, 0.6) for x, y in zip(a, b)]
    assert got == [(0, 1)]          # 3 tokens and one that may be a second common shingle: 4 of 6


def test_pairs_write_less_than_the_texts_shingles(spark):
    """Neither sets nor shingle counts nor an index are written: what is written stays in proportion to the texts."""
    import os
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=4000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def written():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)

    before = written()
    assert SJ.similar_pairs(df, "id", "t").count() == 0
    assert written() - before < 2 * sum(map(len, texts))        # before: 12 times the texts
