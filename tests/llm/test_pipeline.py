"""Each pipeline stage against a brute-force version on its own input; the whole run."""

import hashlib
import re

import corpus_pipeline as P
from tagweave.llm.bpe import word_bpe_path
from tagweave.llm.common import cut_lineage, read

from .data import frame

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_encode_holds_one_worker_a_core(spark):
    """Runs are counted and encoded in one Python step: chained ones hold a worker each in every core."""
    out = dict(P.STAGES)["encode"](spark, read(spark, SF, "documents", "*"), SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_stages_by_brute_force(spark):
    from tokenizers import Tokenizer
    docs = read(spark, SF, "documents", "*")
    names = docs.columns
    got = {}
    for name, stage in P.STAGES:
        got[name] = (docs.collect(), docs := cut_lineage(stage(spark, docs, SF)))
        assert name == "encode" or docs.columns == names
    out = {n: d.collect() for n, (_, d) in got.items()}

    def passes(t):
        w = words(t)
        grams = list(zip(w, w[1:], w[2:]))
        cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(w) >= 50 else ()
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)

    # few labels: no cutoff is certified, the base rule alone decides
    assert {r["doc_id"] for r in out["quality"]} == {r["doc_id"] for r in got["quality"][0] if passes(r["text"])}

    def key(x):
        return "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))

    first = {}
    for r in sorted(got["lines"][0], key=lambda r: r["doc_id"]):
        for x in r["text"].split("\n"):
            first.setdefault(key(x), r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or first[key(x)] == r["doc_id"])
            for r in got["lines"][0]}
    assert {r["doc_id"]: r["text"] for r in out["lines"]} == want and all(r["n_chars"] == len(r["text"]) for r in out["lines"])

    grams = {r["doc_id"]: {tuple(words(r["text"])[i:i + 5]) for i in range(max(1, len(words(r["text"])) - 4))} - {()} for r in got["near"][0]}
    lead = {a: a for a in grams}
    changed = True
    while changed:
        changed = False
        for a, x in grams.items():
            for b, y in grams.items():
                if a < b and x and len(x & y) >= 0.8 * len(x | y) and lead[a] != lead[b]:
                    lead[a] = lead[b] = min(lead[a], lead[b])
                    changed = True
    assert {r["doc_id"] for r in out["near"]} == {a for a in grams if lead[a] == a}
    assert {r["doc_id"] for r in out["mix"]} <= {r["doc_id"] for r in got["mix"][0]}
    texts, lib = {r["doc_id"]: r["text"] for r in got["encode"][0]}, Tokenizer.from_file(word_bpe_path())
    assert len(out["encode"]) == len(texts)
    for r in out["encode"]:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids))
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == {r["doc_id"] for r in out["encode"]}


def test_stages_on_odd_rows(spark):
    for name, stage in P.STAGES:
        odd, none = frame(spark), frame(spark, only=lambda r: False)
        out = stage(spark, odd, SF)
        assert stage(spark, none, SF).count() == 0 and (name == "encode" or out.columns == odd.columns)
        out.collect()
