"""Operators against brute force on rows with every defined odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm.bloom import repeat_filter
from tagweave.llm.bpe import WordBpe, encode, word_bpe_path
from tagweave.llm.licenses import BASE, TEMPLATES, Automaton, scan_licenses, words_of
from tagweave.llm.lines import dedup_lines
from tagweave.llm.mixing import counted_runs, drawn, mix
from tagweave.llm.neardups import drop_near_duplicates, near_duplicates
from tagweave.llm.quality import GRIDS, binom_cdf, keep_good, pick_cutoffs, quality_verdicts
from tagweave.llm.substrings import copied_windows, dedup_substrings
from tagweave.llm.topk import exact_topk, threshold_topk

from .data import frame

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WHITE.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def test_substrings(spark, docs):
    rows = docs.collect()
    first = {}
    for r in rows:
        w = words(r["text"])
        if r["doc_id"] is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i:i + 13])
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in rows:
        w, gone = words(r["text"]), set()
        for i in range(len(w) - 12):
            if r["doc_id"] is not None and first[tuple(w[i:i + 13])] < r["doc_id"]:
                gone.update(range(i, i + 13))
        want[r["doc_id"], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    out = dedup_substrings(docs)
    got = out.collect()
    assert Counter((r["doc_id"], r["_parse"]["n_words"], r["_parse"]["n_removed"], r["text"]) for r in got) == want
    assert [c for c in out.columns if c != "_parse"] == docs.columns
    factors = [f for r in got for f in r["_parse"]["factors"]]
    assert factors and all(f["length"] >= 13 for f in factors)


def test_windows_are_shuffled_once(spark):
    """One shuffle and no join serve index and lookup; a hot window, and one repeated in a document or under its id, give the first place."""
    common = " ".join(f"c{i}" for i in range(13))
    rows = [(7, f"x {common} y {common}"), (3, f"a b {common}"), (3, f"{common} z"), (None, common), *((100 + i, common) for i in range(300))]
    out = copied_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {7, *range(100, 400)}
    assert all(set(zip(r["ref_doc"], r["ref_pos"])) == {(3, 0)} and len(set(r["h"])) == 1 for r in got.values())


def test_lines(spark, docs):
    rows = docs.collect()

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))

    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 10 and r["doc_id"] is not None:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    want = Counter()
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if r["doc_id"] is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r["doc_id"]]
        want[r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = dedup_lines(docs).collect()
    assert Counter((r["doc_id"], r["_lines"]["total"], r["_lines"]["dropped"], r["text"]) for r in got) == want


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(20_000).repartition(7).selectExpr("id % 15000 as v")
    mixed = lambda b: b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    flt = repeat_filter(df, mixed, 15_000)
    with np.errstate(over="ignore"):
        hit = flt.test(np.arange(15_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert hit[:5000].all() and hit[5000:].mean() < 0.05


def test_near_duplicates(spark, docs):
    rows = docs.collect()

    def grams(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    live = [(r["doc_id"], grams(r["text"])) for r in rows if r["doc_id"] is not None and grams(r["text"])]
    near = {i: {j for j, (_, y) in enumerate(live) if i != j and len(x & y) >= 0.8 * len(x | y)} for i, (_, x) in enumerate(live)}

    def root(i):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(live[j][0] for j in seen)

    want = Counter((a, root(i), len(near[i])) for i, (a, _) in enumerate(live))
    want += Counter((r["doc_id"], r["doc_id"], 0) for r in rows if r["doc_id"] is None or not grams(r["text"]))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect()) == want


def test_repeated_id_with_two_texts(spark):
    """An id with a unique and a near-copy text: the same links and the same rows in every order of the rows."""
    base = [f"w{i}" for i in range(100)]
    texts = {"near": " ".join(base), "copy": " ".join([*base[:50], "x", *base[51:]]), "own": " ".join(f"u{i}" for i in range(80)),
             "twin": " ".join([*(f"u{i}" for i in range(79)), "y"])}
    rows = [(1, texts["near"]), (1, texts["own"]), (2, texts["twin"]), (5, texts["copy"]), (5, texts["near"]), (7, "alone"), (7, None)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(df).collect())
        assert got == Counter([(1, 1, 2), (1, 1, 1), (2, 1, 1), (5, 1, 2), (5, 1, 2), (7, 7, 0), (7, 7, 0)])
        kept = Counter((r["doc_id"], r["text"]) for r in drop_near_duplicates(df).collect())
        assert kept == Counter([(1, texts["near"]), (1, texts["own"]), (7, "alone"), (7, None)])
    tied = spark.createDataFrame([(3, texts["near"]), (3, texts["copy"]), (4, texts["near"])], "doc_id long, text string")
    assert drop_near_duplicates(tied).count() == 1


def test_near_duplicates_of_a_large_group(spark):
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base[:k] + [f"v{i}"] + base[k + 1:])) for i in range(400) for k in [i % 150]]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(t.split()[i:i + 5]) for i in range(146)} for _, t in rows]
    assert {r["class_id"] for r in got} == {0} and len(got) == 400
    for r in got[:20]:
        x = sets[r["doc_id"]]
        assert r["n_links"] == sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(word_bpe_path())
    for r in encode(docs).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["_bpe"]["n_tokens"] == len(ids) and r["_bpe"]["ids"] == " ".join(map(str, ids))
        assert r["_bpe"]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_verification_is_exact():
    with open(word_bpe_path(), encoding="utf-8") as f:
        codec = WordBpe(f.read())
    some = [w.encode() for w in ("thth", "ononon", "aaaaaaa", "theereating", "straße", "x" * 70, "unbelievable", "nderntanion")]
    assert codec.encode_words(some) == [codec.merge(w) for w in some]


def test_bpe_cache_holds_numbers_only():
    """A word is kept as its number and its tokens; forgotten words are learned anew."""
    with open(word_bpe_path(), encoding="utf-8") as f:
        codec = WordBpe(f.read())
    texts = ["the cat, the straße", None, "", "cat <|endoftext|> 12", "cat"]
    n, ids, back = (x.to_pylist() for x in codec.encode_texts(texts))
    assert all(isinstance(v, int) for v in codec.cache.values()) and sorted(codec.cache.values()) == list(range(len(codec.cache)))
    assert len(codec.ends) == len(codec.cache) + 1 and codec.ends[-1] == len(codec.tokens)
    codec.forget()
    for t, k, i, b in zip(texts, n, ids, back):
        alone = [x.to_pylist()[0] for x in codec.encode_texts([t])]
        assert alone == [k, i, b] and b == " ".join(codec.names[int(x)] for x in i.split()) and k == len(i.split())


def test_licenses(spark, docs):
    for r in scan_licenses(docs).collect():
        low = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((i, i + len(p.split()), label) for p, label in BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert r["_license"]["n_words"] == len(w) and [tuple(x) for x in r["_license"]["base"]] == want
        assert all(0.75 <= s["cover"] and s["start"] < s["end"] <= len(w) for s in r["_license"]["spans"])


def test_license_kinds_are_told_apart():
    auto = Automaton()
    for text, label in [
            ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
            ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
            ("This work is licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
            ("This work is licensed under the GNU Affero General Public License, version 3", "agpl-3"),
            ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
            ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
            ("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. This work is licensed under a Creative "
             "Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
            ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Licensed under CC BY 4.0.", "cc-by"),
            ("Licensed under the Mozilla Public License, Version 2.0.", "mpl-2"), ("Released under the ISC license.", "isc"),
            ("Released under the MIT License.", "mit"), ("Released under the Creative Commons CC0 1.0 Universal", "cc0"),
            ("Licensed under the Apache License, Version 2.0.", "apache-2")]:
        assert {s[2] for s in auto.scan(words_of(text))["spans"]} == {label}, text
    for text, label in TEMPLATES:
        assert {s[2] for s in auto.scan(words_of("x1 " + text + " x1"))["spans"]} == {label}, text


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None), (9, 0)], "doc_id long, quality int")
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = words(t)
        n = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
             len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    got = quality_verdicts(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)            # nothing certified by four labels
    assert keep_good(docs, labels).count() == sum(r["kept"] for r in got)


def test_binomial_bound():
    from math import comb
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (7, 9, 0.8), (200, 1000, 0.22)):
        assert abs(binom_cdf(k, n, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_certified_cutoffs_limit_false_rejection(spark):
    good = [(i, " ".join(f"g{i}x{j}" for j in range(60)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"g{i}x{j}###" for j in range(60)), "en") for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_verdicts(df, labels).collect()}
    assert not any(got[i] for i, *_ in bad) and sum(not got[i] for i, *_ in good) <= 0.05 * len(good)


def test_cutoffs_are_spent_on_bad_documents_only(spark):
    good = [(i, " ".join(f"g{i}x{j}" for j in range(60)) + ("\nsame line\nsame line" if i % 200 == 0 else ""), "en") for i in range(2000)]
    bad = [(5000 + i, " ".join(f"b{i}x{j}" + "##" * (j % 2) for j in range(60)), "en") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_verdicts(df, labels).collect()}
    assert not any(got[i] for i, *_ in bad) and all(got[i] for i, *_ in good)
    assert keep_good(df, labels).count() == len(good)


def test_most_lenient_cutoff_that_removes_as_much():
    row = {"n_good": 5000} | {f"good_{r}_{i}": 0 for r, g in GRIDS.items() for i in range(len(g))}
    none = [len(g) for g in GRIDS.values()]
    kinds = [[2, *none[1:]], [5, 0, *none[2:]], none]
    assert list(pick_cutoffs(row, 1, 0.05, 0.05, kinds).values()) == [0.5, None, None, None]
    assert list(pick_cutoffs(row, 1, 0.05, 0.05, []).values()) == [None] * 4
    assert list(pick_cutoffs(row, 1, 0.05, 0.05).values()) == [g[-1] for g in GRIDS.values()]
    strict = row | {"good_symbol_share_4": 4000}                              # only the first four cutoffs are admissible
    assert list(pick_cutoffs(strict, 1, 0.05, 0.05, kinds).values()) == [1.0, 0.5, None, None]


def test_mixing_rounds_have_small_plans(spark, monkeypatch):
    """Each written step of the fit joins once: the driver's memory does not grow with what a plan repeats."""
    from tagweave.llm import mixing
    joins, cut = [], mixing.cut_lineage

    def seen(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(mixing, "cut_lineage", seen)
    rows = [(s, lang, t, n) for s, lang, t, n in (("a", "en", "x", 40), ("a", None, "y", 3), ("b", "en", "y", 7), (None, "de", "x", 9), ("b", "de", "x", 0))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {d: mixing.tempered(cells, d) for d in ("source", "lang", "topic")}
    fitted = mixing.fit(cells, targets, max_rounds=2)
    assert fitted.columns == ["source", "lang", "topic", "tokens", "factor"] and fitted.count() == 5
    assert max(joins) == 1


def test_mixing_meets_the_marginals(spark):
    rows = [(i, "w " * (1 + i % 7), ["s0", "s0", "s1", None][i % 4], ["en", "de", "fr"][i % 3], "t") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    share = lambda x: spark.createDataFrame(list(x.items()), "value string, share double")
    out = mix(df, F.col("topic"), {"source": share({"s0": 0.2, "s1": 0.5}), "lang": share({"en": 0.5, "de": 0.3, "fr": 0.2})})
    m = out.select("source", "lang", (F.col("_mix.n_tokens") * F.col("_mix.prob")).alias("w"), "_mix.prob").collect()
    total = sum(r["w"] for r in m)
    part = {v: sum(r["w"] for r in m if r["lang"] == v) / total for v in ("en", "de", "fr")}
    assert abs(part["en"] - 0.5) < 1e-6 and abs(part["de"] - 0.3) < 1e-6 and max(r["prob"] for r in m) <= 1.0
    s0 = sum(r["w"] for r in m if r["source"] == "s0") / sum(r["w"] for r in m if r["source"] == "s1")
    assert abs(s0 - 0.4) < 1e-6
    assert mix(frame(spark), F.lit("t")).count() == frame(spark).count()
    assert mix(frame(spark, only=lambda r: False), F.lit("t")).count() == 0


def test_one_rare_document_leaves_the_mixture(spark):
    rows = [(i, "w " * 60, ["s0", "s0", "s1"][i % 3], ["en", "de"][i % 2], "t") for i in range(600)]
    names = "doc_id long, text string, source string, lang string, topic string"
    plain = mix(spark.createDataFrame(rows, names), F.col("topic")).select("doc_id", "_mix.*").collect()
    more = mix(spark.createDataFrame([*rows, (9000, "w " * 60, None, "en", "t")], names), F.col("topic"))
    with_rare = {r["doc_id"]: r for r in more.select("doc_id", "_mix.*").collect()}
    assert all(abs(with_rare[r["doc_id"]]["weight"] / r["weight"] - 1) < 0.03 for r in plain)
    assert with_rare[9000]["weight"] > 2 and with_rare[9000]["copies"] >= 2
    assert abs(sum(r["weight"] * r["n_tokens"] for r in with_rare.values()) - 601 * 60) < 1e-3       # the total is kept
    half = mix(spark.createDataFrame(rows, names), F.col("topic"), budget=18_000).select("_mix.*").collect()
    assert abs(sum(r["weight"] * r["n_tokens"] for r in half) - 18_000) < 1e-3
    out = Counter(r["doc_id"] for r in drawn(more).collect())
    assert out == Counter({i: r["copies"] for i, r in with_rare.items() if r["copies"]}) and sum(out.values()) > 500
    runs = Counter()
    for r in counted_runs(drawn(more)).collect():
        runs[r["doc_id"]] += r["copies"]
    assert runs == out


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, []), (406, [2.0]), rows[0], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in use:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in use.items() if i != q)[:5]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {tuple(r) for r in exact_topk(df, df.filter("vec_id % 50 = 0"), 5).collect()} == want
    easy = np.zeros((5000, 3), dtype=np.int64)
    easy[:, 0] = np.arange(5000)
    _, scored = threshold_topk(np.arange(5000), easy, np.array([-1]), np.array([[3, 0, 0]]), 5)
    assert scored <= 16                                    # stops early


def test_empty_tables(spark):
    none = frame(spark, only=lambda r: False)
    for out in (dedup_substrings(none), dedup_lines(none), near_duplicates(none), encode(none), scan_licenses(none)):
        assert out.count() == 0
    assert hashlib.sha256(b"").hexdigest()
