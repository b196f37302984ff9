"""Base spans against plain regular expressions; EM; empty input."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tagweave.llm.pii import KINDS, find_pii, reliabilities, span_text

from .data import SCHEMA, frame

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                  14 <= len(d) <= 19 and luhn(d) if k == 2 else True, 10 <= len(d) <= 15][k] if k != 1 else \
                all(int(x) <= 255 for x in m.group().split("."))
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(3)
    alphabet = "a1b2@.+-() 4567 0_é😀,"
    noise = [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(200))), None, None, 0, "", "", "", "")
             for i in range(400)]
    docs = frame(spark).unionByName(spark.createDataFrame(noise, SCHEMA))
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], set()).add(tuple(base(r["text"])))
    got = find_pii(docs).withColumn("text", span_text(F.col("spans"))).collect()
    assert len(got) == docs.count()
    for r in got:
        spans = tuple((c["s"], c["kind"], c["e"]) for c in r["base"])
        assert spans in want[r["doc_id"]], (r["doc_id"], spans)
        everything = [(c["s"], c["kind"], c["e"]) for c in r["spans"]]
        assert set(spans) <= set(everything) and everything == sorted(everything)
        assert r["text"] == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in everything)
    assert hashlib.sha256(b"").hexdigest()


def test_em_learns_who_is_reliable():
    truth = [(0, [1, 1, 0, 1, 1], 60), (0, [-1, -1, 0, -1, 1], 40), (0, [1, 1, 0, -1, 1], 10), (0, [-1, -1, 0, 1, -1], 10)]
    p = reliabilities(truth)
    assert p[0, (1, 1, 0, 1, 1)] > 0.9 and p[0, (1, 1, 0, -1, 1)] > 0.5 > p[0, (-1, -1, 0, 1, -1)]


def test_no_candidates(spark):
    assert find_pii(frame(spark, only=lambda r: False)).count() == 0
    one = find_pii(frame(spark, only=lambda r: r[1] is None)).collect()
    assert len(one) == 1 and one[0]["spans"] == []
