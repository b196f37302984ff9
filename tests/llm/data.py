"""Small documents with every defined odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, rep string, label string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "été", "straße", "x1", "don't", "Zoë", "mid-word", "a|b", "#tag"]


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)

    def prose(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

    passage = prose(30)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "one", "two words here now", base, base, " ".join(near), prose(40) + "\n" + passage,
             passage + "\n" + prose(25), prose(10) + " " + passage + " " + prose(10), "a common line here\n" * 4 + prose(60),
             "A COMMON line here \nshort\n\n" + prose(55), "w " * 30_000, prose(4000), "x" * 50_000,
             "mail me.now@host-a.example.com, call +1 (275) 555-5927 or 10.0.0.256 10.0.0.25 4111 1111 1111 1111 é4111111111111112",
             "a@b.c_d@e.f x@y@z.com +12((((((( +123456789012345678 1.2.3.4.5.6.7.8 00255.1.1.01 " + "9" * 3000,
             "Released under the MIT License. Licensed under the Apache License, Version 2.0; under the mit license\nCC-BY-NC 4.0",
             "<|endoftext|>a'S\u0085b\x1cÉté ΑΣ İ ½ 東京 <|startoftext|>" + "ab" * 400,
             'token = "e51a5499e3950eabef3742d6cf40b27b4e61a74a" commit 9f51a5499e3950eabef3742d6cf40b27b4e61a74 password=b7db7aa4a5fcc78305']
    out = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), None if t is None else len(t),
            "h", "k", "r", "l") for i, t in enumerate(texts)]
    out += [out[6], (out[9][0], passage, "en", "src0", 1, "h", "k", "r", "l"), (None, base, "en", "src0", 1, "h", "k", "r", "l")]
    return out


def frame(spark, seed: int = 5, only=None):
    return spark.createDataFrame([r for r in rows(seed) if only is None or only(r)], SCHEMA).repartition(3)
