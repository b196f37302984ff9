"""The jointly trained tagger: equal to a plain gradient, learns, saves and loads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators.labels import class_weights
from tagweave.streaming import joint as J
from tagweave.streaming.scoring import score_texts

SCHEMA = "row_id long, text string, tags array<string>"


def data(spark, n=600, n_labels=4, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tags = [f"t{k}" for k in range(n_labels) if rng.random() < .3]
        words = [f"{t}word{rng.randrange(3)}" for t in tags for _ in range(3)] + [f"noise{rng.randrange(200)}" for _ in range(10)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), tags))
    rows += [(n, None, ["t0"]), (n + 1, "", None), (n + 2, "t0word1", [None, "unknown"])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def test_gradient_equals_a_plain_one(spark):
    df, rows = data(spark, 120)
    labels, dim = ["t0", "t1", "t2", "t3"], 64
    feats = J._features(df, "row_id", "text", "tags", labels, dim, 0.0)
    w = np.random.default_rng(1).normal(size=(dim + 1, 4))
    pos = np.array([1.0, 2.0, 3.0, 4.0])
    grad, loss, _, n, held, _ = J._pass(feats, J.JointModel(labels, dim, w), pos)
    want, total = np.zeros_like(w), 0.0
    for _, text, tags in rows:
        x = np.zeros(dim + 1)
        place, value = J.hashed(text, dim)
        x[place] = value
        y = np.array([float(t in (tags or [])) for t in labels])
        z = x @ w
        c = np.where(y > 0, pos, 1.0)
        total += (c * (np.log1p(np.exp(z)) - y * z)).sum()
        want += np.outer(x, c * (1 / (1 + np.exp(-z)) - y))
    assert np.allclose(grad, want) and abs(loss - total) < 1e-8 and (n, held) == (len(rows), 0)


@pytest.fixture(scope="module")
def fitted(spark):
    df, _ = data(spark)
    labels = ["t0", "t1", "t2", "t3"]
    return df, J.fit_joint(df, "text", "tags", labels, dim=1 << 10)


def test_learns_and_stops_on_held_out_rows(spark, fitted):
    df, model = fitted
    scores = {r["label"]: r for r in J.held_out_scores(df, model, "text", "tags").collect()}
    assert all(r["f1"] > 0.85 and r["support"] > 10 for r in scores.values())
    held = [h["held_loss"] for h in model.history]
    assert min(held) < held[0] / 3 and len(held) <= 40
    # the kept weights are those of the best pass: their held-out loss is the least one
    feats = J._features(df, "row_id", "text", "tags", model.labels, model.dim, 0.2)
    weights = {r["label"]: r["weight"] for r in class_weights(df.select(F.explode("tags").alias("label")).filter("label like 't%'")).collect()}
    got = J._pass(feats, model, np.array([weights[x] for x in model.labels]))
    assert abs(got[2] / got[4] - min(held)) < 1e-9


def test_early_stop(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(8)), ["t0"] if rng.random() < .5 else []) for i in range(300)]
    model = J.fit_joint(spark.createDataFrame(rows, SCHEMA), "text", "tags", ["t0"], dim=512, class_weighting=False)
    assert len(model.history) < 40             # nothing to learn: stops when the held-out loss rises


def test_save_load_score(spark, fitted, tmp_path):
    df, model = fitted
    path = model.save(spark, str(tmp_path), "v1")
    again = J.JointModel.load(spark, path)
    assert again.labels == model.labels and (again.weights == model.weights).all() and again.history == model.history
    with pytest.raises(Exception):
        model.save(spark, str(tmp_path), "v1")
    got = [sorted((r["row_id"], r["logits"]) for r in score_texts(df, "text", m.scorer(spark), 4, ["row_id"]).collect()) for m in (model, again)]
    assert got[0] == got[1] and len(got[0]) == 603


def test_passes_do_not_depend_on_the_labels(spark):
    df, _ = data(spark, 100, 2)
    few = J.fit_joint(df, "text", "tags", ["t0", "t1"], dim=64, max_passes=4, patience=9)
    many = J.fit_joint(df, "text", "tags", ["t0", "t1", *(f"u{i}" for i in range(60))], dim=64, max_passes=4, patience=9)
    assert len(few.history) == len(many.history) == 4 and few.weights.shape == (65, 2) and many.weights.shape == (65, 62)
    none = J.fit_joint(df.limit(0), "text", "tags", ["t0"], dim=64, max_passes=2)
    assert not none.weights.any()


def test_rows_of_a_batch_without_python_lists():
    """The dense rows of any part of an Arrow batch, sliced or not, as from Python lists."""
    import numpy as np
    import pyarrow as pa

    from tagweave.streaming.joint import dense, dense_rows, hashed
    pairs = [hashed(t, 64) for t in ("a b b c", "", None, "d " * 70, "e f g", "a c")]
    place = pa.array([p for p, _ in pairs], pa.list_(pa.int32()))
    value = pa.array([v for _, v in pairs], pa.list_(pa.float64()))
    for at, to in ((0, 6), (1, 4), (5, 6)):
        assert (dense_rows(place, value, at, to, 64) == dense(pairs[at:to], 64)).all()
    assert (dense_rows(place.slice(2), value.slice(2), 1, 3, 64) == dense(pairs[3:5], 64)).all()
    assert np.isclose(np.linalg.norm(hashed("a b b c", 64)[1][:-1]), 1)


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    """One call hashes the short words of all texts; rows equal those of the texts alone."""
    import re
    import zlib
    calls = []
    together = J.crc32s
    monkeypatch.setattr(J, "crc32s", lambda *a: calls.append(len(a[1])) or together(*a))
    texts = ["a b b c", None, "", "x" * 64 + " " + "x" * 65 + " \u00e9-a", "-", "\u65e5\u672c\u8a9e b" + "y" * 300 + "\u00e9", " b "]
    many, place, n = J.counted(texts, 1 << 16)
    assert len(calls) == 2 and sum(calls) == 9       # ASCII words, words beyond ASCII; the two long ones alone
    ends = np.cumsum(many)
    for t, a, b in zip(texts, [0, *ends], ends):
        want, k = np.unique([zlib.crc32(w.encode()) % (1 << 16) for w in re.findall(r"\w+", (t or "").lower())], return_counts=True)
        assert place[a:b].tolist() == want.tolist() and n[a:b].tolist() == k.tolist()
    words = [b"", b"a", b"abc" * 20, b"123456789"]
    data, size = np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words])
    assert together(data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(w) for w in words]


def test_a_pass_reads_a_row_for_many_rows(spark):
    """The written features hold the bytes of arrays, a row for up to ``ROWS`` rows, not a value for each place."""
    df, _ = data(spark, 600, 2)
    feats = J._features(df.coalesce(1), "row_id", "text", "tags", ["t0", "t1"], 64, 0.5)
    assert {t for _, t in feats.dtypes} == {"binary"} and feats.count() == -(-603 // J.ROWS)
    *_, n, held, counts = J._pass(feats, J.JointModel(["t0", "t1"], 64, np.zeros((65, 2))), np.ones(2))
    assert n + held == 603 and n and held and counts.shape == (3, 2)


def test_only_tokens_beyond_ascii_are_searched(monkeypatch):
    """Places and values as from the expression's matches; ASCII words are cut without it."""
    import re
    import zlib
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    texts = ["A b's b'S\u0130 x_1\x1cy\u00a0z\u2028\u00e9t\u00e9 " * 3, blanks, "", None, "\ud800a b-c-b", f"p{blanks}q{blanks}p-p"]
    for text in texts:
        at = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+", (text or "").lower())], dtype=np.int64) % 64
        want, n = np.unique(at, return_counts=True)
        place, value = J.hashed(text, 64)
        assert place.tolist() == [*want, 64] and value.tolist() == [*(n / np.sqrt((n * n).sum()) if len(n) else []), 1.0]
    seen = []

    class Watched:
        def findall(self, text):
            seen.append(text)
            return re.findall(r"\w+", text)

    monkeypatch.setattr(J, "_WORD", Watched())
    J.hashed("one two-three " * 50 + "\u00e9t\u00e9.", 64)
    assert seen == ["\u00e9t\u00e9"]
