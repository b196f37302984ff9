"""Personal data by weak supervision (operator 7), with DataFrame functions only.

Candidates are all matches of the four base patterns, valid or not, and two
looser ones (national phone numbers, spelled-out mail addresses).  Five labelers
vote +1, -1 or 0 on each: the base check (regex), two gazetteers (number
prefixes and domains; reserved addresses), neighbouring words (context), and
the written form.  Votes are counted per (kind, vote pattern) over all
documents — at most 4 * 3**5 rows whatever the input — and expectation
maximisation estimates per kind how often each labeler casts each vote on
true and on false spans.  A logistic regression (Spark ML) is trained on the
counted patterns, weighted by the EM posteriors; its probability decides which
candidates are added.  Valid base matches always stay.

Candidates are per-row arrays; texts are never shuffled.  Patterns use
possessive loops: no backtracking, no deep recursion, linear on long runs.

Defined cases: null or empty text has no spans; a null ``doc_id`` and repeated
rows are scanned like any other; without candidates nothing is trained;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .spans import digits, located, luhn

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: base patterns; equal to the plain forms, written so that they never backtrack into a run
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: candidates of the method's own
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+\x20?[(\[]dot[)\]]\x20?[A-Za-z]{2,}",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
HINT = {"email": "(?i)(e-?mail|contact|write|address)", "ip": r"(?i)(\bip\b|host|server|address|login)",
        "card": "(?i)(card|visa|master|credit|payment)", "phone": r"(?i)(phone|\btel|call|mobile|fax|contact)"}
COUNTER = r"(?i)(version|\bisbn|order|invoice|item|page|section|license|release)"
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"]
VOTES = ["regex", "prefix", "reserved", "context", "form"]
MIN_PROB, EM_ROUNDS, CONTEXT = 0.9, 50, 40


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(
            F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255)
    n = F.length(digits(m))
    return n.between(14, 19) & luhn(digits(m)) if kind == "card" else n.between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _votes(kind: str, m: Column, near: Column, valid: Column) -> list[Column]:
    d, never = digits(m), F.lit(False)
    if kind == "email":
        top = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        prefix = _vote(top.isin(TOP_DOMAINS), ~top.rlike("^[a-z]{2,}$"))
        reserved = _vote(never, m.rlike(r"(?i)^(noreply|no-reply)@|@localhost"))
        form = _vote(m.rlike("[A-Za-z]") & ~m.startswith("."), m.startswith("."))
    elif kind == "ip":
        prefix = _vote(~m.rlike(r"^0*\."), m.rlike(r"^0*\."))
        reserved = _vote(never, m.rlike(r"^(10|127|255)\.|^192\.168\.|^169\.254\."))
        form = _vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]"))
    elif kind == "card":
        prefix = _vote(d.rlike("^(4|5[1-5]|34|37|6011|65|2[2-7])"), d.rlike("^[01789]"))
        reserved = _vote(never, d.rlike("^([0-9])\\1+$"))
        form = _vote(m.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), ~F.length(d).between(13, 19))
    else:
        prefix = _vote(m.rlike(r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), ~m.startswith("+"))
        reserved = _vote(never, d.rlike("^([0-9])\\1+$"))
        form = _vote(m.rlike(r"[0-9][\x20.()-]+[0-9]"), ~F.length(d).between(7, 15))
    return [_vote(valid, ~valid), prefix, reserved, _vote(near.rlike(HINT[kind]), near.rlike(COUNTER)), form]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``cand``: array of (s, kind, e, base, v: votes), ordered by s, then kind."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def spans(kind: str, pattern: str, loose: bool) -> Column:
        def one(x):
            near = F.substring(t, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)).cast("int"),
                               (F.least(x["s"], F.lit(CONTEXT)) + x["e"] - x["s"] + CONTEXT).cast("int"))
            valid = F.lit(False) if loose else _valid(kind, x["m"])
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("e"),
                            valid.alias("base"), F.array(*_votes(kind, x["m"], near, valid)).alias("v"))
        return F.transform(located(t, pattern), one)

    found = [spans(k, p, False) for k, p in PATTERNS.items()] + [spans(k, p, True) for k, p in LOOSE.items()]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_sort(F.concat(*found)).alias("cand"))


def reliabilities(counts: list[tuple[int, list[int], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """EM over counted vote patterns (kind, votes, n): posterior of each pattern."""
    post = {}
    for kind in {k for k, _, _ in counts}:
        rows = [(tuple(v), n) for k, v, n in counts if k == kind]
        # start from the majority of votes
        p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows}
        for _ in range(EM_ROUNDS):
            mass = [sum(n * p[v] for v, n in rows), sum(n * (1 - p[v]) for v, n in rows)]
            prior = (mass[0] + 1) / (mass[0] + mass[1] + 2)
            like = []
            for side, total in enumerate(mass):
                like.append([{x: (sum(n * (p[v] if side == 0 else 1 - p[v]) for v, n in rows if v[j] == x) + 1) / (total + 3)
                              for x in (-1, 0, 1)} for j in range(len(VOTES))])
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(
                    math.log(like[0][j][x] / like[1][j][x]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        post |= {(kind, v): p[v] for v, _ in rows}
    return post


def span_classifier(cand: DataFrame) -> Column | None:
    """Probability, as an expression over (kind, v), that a candidate is personal data; None without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    spark = cand.sparkSession
    counts = [(r["kind"], list(r["v"]), r["n"]) for r in
              cand.select(F.explode("cand").alias("c")).groupBy("c.kind", "c.v").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts:
        return None
    post = reliabilities(counts)
    rows = [(float(label), float(n) * w, *[float(k == i) for i in range(len(KINDS))], *map(float, v))
            for k, v, n in counts for label, w in ((1, post[k, tuple(v)]), (0, 1 - post[k, tuple(v)])) if n * w > 1e-9]
    names = [f"is_{k}" for k in KINDS] + VOTES
    values = ", ".join("(" + ", ".join(f"{x!r}D" for x in r) + ")" for r in rows)   # a few hundred rows at most
    train = VectorAssembler(inputCols=names, outputCol="x").transform(
        spark.sql(f"SELECT * FROM VALUES {values} AS t(label, w, {', '.join(names)})"))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1e-3, maxIter=50).fit(train)
    coef, bias = [float(c) for c in model.coefficients], float(model.intercept)
    return lambda c: 1 / (1 + F.exp(-(F.lit(bias) + sum(F.when(c["kind"] == i, coef[i]).otherwise(0.0) for i in range(len(KINDS)))
                                      + sum(c["v"][j] * coef[len(KINDS) + j] for j in range(len(VOTES))))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_prob: float = MIN_PROB) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (s, kind, e), base matches and all spans."""
    cand = cut_lineage(candidates(docs, id_col, text_col))
    prob = span_classifier(cand)
    base = F.filter("cand", lambda c: c["base"])
    added = F.array().cast("array<struct<s:bigint,kind:int,e:bigint,base:boolean,v:array<int>>>")
    if prob is not None:
        added = F.filter("cand", lambda c: ~c["base"] & (prob(c) >= min_prob)
                         & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def plain(spans):
        return F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))

    return cand.select("doc_id", plain(base).alias("base"), F.array_sort(plain(F.concat(base, added))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"], c["e"])))
