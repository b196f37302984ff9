"""Secret scan: a random forest removes false positives (operator 4), with DataFrame functions only.

Candidates are values of six or more characters assigned to a secret-like name
(any case, optional quotes and spaces, any characters but white space), runs
of 12 or more key-like characters that mix letters and digits, and runs of 12 or more digits
(card, account and order numbers: the usual false alarms of such a scan).  Features of a candidate:
length; how often neighbouring characters change class (lower, upper, digit,
other) and the share of each class; how much of it consists of the corpus's
most frequent words (dictionary, counted over all documents); whether it looks
like a path and the document's source; and the neighbouring words (assignment
names, negative words, quotes, operators).  A Spark ML random forest is trained
from labelled findings on ``TRAIN_ROWS`` rows at most (chosen by hash), and
scores every candidate.  :func:`held_out` trains on four fifths of the labelled values and
measures precision and recall on the rest; copies of one value stay on one side.

Labelled findings are a table (doc_id, start, label), with a column ``match`` where a doc_id may repeat with
another text.  The given tables have
none, so :func:`rule_findings` labels them by rule: a value assigned to a secret
name is a finding, unless it is a placeholder; a placeholder, a path, a value
beside a negative word and a plain bare run are false positives; bare runs of
known key forms or of high entropy and the rest stay unlabelled, so that the
forest decides on their shape.

Defined cases: null or empty text has no candidates; a null ``doc_id`` or source
is allowed; repeated rows give repeated findings; with findings of one class
only, that class's share is the score and ``trained`` is false; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .spans import located

TRAIN_ROWS = 50_000
DICTIONARY_WORDS = 2_000
TREES, DEPTH, SEED = 30, 6, 17
MIN_PROB = 0.5
CONTEXT = 40
_CHAR = "[A-Za-z0-9_/+-]"
NAMES = "(?i)(token|passw(or)?d|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth(?!or(?!iz))|credential)"
#: in front of a value: a name, the end of a longer name, an operator with spaces around it, an opening quote
_SET = rf"{NAMES}(?:s|[_-][A-Za-z0-9_-]{{1,20}})?[\"']?\s{{0,4}}(?:={{1,3}}>?|:=?)\s{{0,4}}"
#: cheap looks behind first: this one runs at every character
_CHEAP = r"""(?<=[=:>"'\s])(?<=[=:>][\s"']{0,5})"""
_VALUE = (rf"""{_CHEAP}(?:(?<={_SET}")[^\s"]{{6,}}|(?<={_SET}')[^\s']{{6,}}"""
          rf"""|(?<={_SET})[^\s"'=>:](?:(?!&[A-Za-z0-9_.-]{{1,40}}=)\S){{4,}}(?!&[A-Za-z0-9_.-]{{1,40}}=)[^\s"',;.)}}\]])""")
_BARE = rf"(?<!{_CHAR})(?=[A-Za-z_/+-]{{0,64}}[0-9])(?=[0-9_/+-]{{0,64}}[A-Za-z]){_CHAR}{{12,}}+={{0,2}}"
_NUMBER = rf"(?<!{_CHAR})[0-9]{{12,}}+(?!{_CHAR})"
PATTERN = rf"{_VALUE}|{_BARE}|{_NUMBER}"
KEY_FORM = (r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{20,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk[_-][\w-]{20,}"
            r"|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|eyJ[\w-]{10,})")
ENTROPY, ENTROPY_HEX = 3.8, 3.2     # bits a character from which a bare run (a hexadecimal one) counts as random
PLACEHOLDER = r"(?i)(example|changeme|your[_-]|placeholder|dummy|redacted|x{4,}|0{6,}|1234567|abcdef)"
NEGATIVE = r"(?i)(commit|revision|checksum|md5|sha1|sha256|uuid|version|isbn)"
FEATURES = ["length", "transitions", "lower_share", "upper_share", "digit_share", "hex", "distinct_share", "dictionary",
            "path", "source", "assigned", "named", "negative", "quoted", "placeholder",
            "entropy", "key_form"]


def _share(m: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{chars}]", "")) / F.length(m)


def _entropy(m: Column) -> Column:
    """Bits a character."""
    n = F.length(m)
    counts = F.transform(F.array_distinct(F.split(m, "")), lambda c: (n - F.length(F.replace(m, c, F.lit("")))) / n)
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` most frequent words (three letters or more) over all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("(?<![a-z0-9])[a-z]{3,12}(?![a-z0-9])"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def candidates(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text",
               path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start, end, match, and its features."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("where"), t.alias("t"),
                        F.explode(located(t, PATTERN)).alias("c"))
    one = found.select(
        "doc_id", "where", F.col("c.s").alias("start"), F.col("c.e").alias("end"), F.col("c.m").alias("match"),
        F.substring("t", F.greatest(F.col("c.s") - CONTEXT + 1, F.lit(1)).cast("int"), F.least(F.col("c.s"), F.lit(CONTEXT)).cast("int")).alias("before"),
        F.substring("t", (F.col("c.e") + 1).cast("int"), F.lit(CONTEXT)).alias("after"))
    m = F.col("match")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "o")
    runs = F.length(F.regexp_replace(shape, r"(.)\1+", "$1"))
    pieces = F.filter(F.split(F.lower(m), "[^a-z]+"), lambda p: F.length(p) >= 3)
    known = F.filter(pieces, lambda p: F.array_contains(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>"), p))
    near = F.lower(F.regexp_extract("before", r"([A-Za-z0-9_-]+)\W{0,12}$", 1))
    return one.select(
        "doc_id", "start", "end", "match",
        F.length(m).cast("double").alias("length"), ((runs - 1) / F.length(m)).alias("transitions"),
        _share(m, "a-z").alias("lower_share"), _share(m, "A-Z").alias("upper_share"), _share(m, "0-9").alias("digit_share"),
        m.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (F.size(F.array_distinct(F.split(m, ""))) / F.length(m)).alias("distinct_share"),
        (F.length(F.concat_ws("", known)) / F.length(m)).alias("dictionary"),
        (m.rlike("/[^/]+/") | F.col("before").rlike(r"[/.]$")).cast("double").alias("path"),
        (F.pmod(F.xxhash64(F.coalesce("where", F.lit(""))), F.lit(64))).cast("double").alias("source"),
        F.col("before").rlike(r"""[=:]>?\s{0,4}["']?$""").cast("double").alias("assigned"), near.rlike(NAMES).cast("double").alias("named"),
        (near.rlike(NEGATIVE) | F.col("after").rlike(rf"^\W{{0,2}}{NEGATIVE}")).cast("double").alias("negative"),
        (F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")).cast("double").alias("quoted"),
        m.rlike(PLACEHOLDER).cast("double").alias("placeholder"), _entropy(m).alias("entropy"),
        m.rlike(KEY_FORM).cast("double").alias("key_form"))


def rule_label() -> Column:
    """1.0 or 0.0 by rule, null for a candidate that the rule leaves open; see the module text."""
    secret = (F.col("assigned") == 1) & (F.col("named") == 1)
    random = (F.col("key_form") == 1) | (F.col("entropy") >= F.when(F.col("hex") == 1, ENTROPY_HEX).otherwise(ENTROPY))
    number = F.col("digit_share") == 1      # ten signs: its bits a character say nothing
    bare = (F.col("named") == 0) & (F.col("assigned") == 0) & (~random | number)
    false = (F.col("placeholder") == 1) | (F.col("path") == 1) & ~secret | (F.col("negative") == 1) | bare
    return F.when(false, 0.0).when(secret, 1.0)


def rule_findings(cand: DataFrame) -> DataFrame:
    """Labelled findings (doc_id, start, label) by rule."""
    return cand.select("doc_id", "start", rule_label().alias("label")).dropna()


def _labelled(cand: DataFrame, findings: DataFrame | None) -> DataFrame:
    """The candidates that carry a label."""
    if findings is None:
        return cand.withColumn("label", rule_label()).filter("label is not null")
    by = [c for c in ("doc_id", "start", "match") if c in findings.columns]
    named = findings.select(*[F.col(c).alias(f"f_{c}") for c in by], F.col("label").cast("double")).dropna(subset=["label"]).distinct()
    same = [cand[c] == named[f"f_{c}"] for c in by]
    return cand.join(named, same).drop(*[f"f_{c}" for c in by])


def _fit(labelled: DataFrame, train_rows: int):
    """A forest on at most ``train_rows`` rows, or None and the share of findings where one class is left."""
    from pyspark.ml.classification import RandomForestClassifier
    train = cut_lineage(labelled.orderBy(F.xxhash64("doc_id", "start", "match"), "doc_id", "start", "match", "label")
                        .limit(train_rows).select("label", *FEATURES))
    n, share = train.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return None, float(share or 0.0)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_vectors(train)), share


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df)


def _scored(df: DataFrame, model, share: float) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    if model is None:
        out = df.withColumn("prob", F.lit(share))
    else:
        out = (model.transform(_vectors(df)).withColumn("prob", vector_to_array("probability")[1])
               .drop("x", "rawPrediction", "probability", "prediction"))
    return out.withColumn("is_secret", F.col("prob") >= MIN_PROB).withColumn("trained", F.lit(model is not None))


def _candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    return cut_lineage(candidates(docs, dictionary(docs, text_col), id_col, text_col, path_col))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, start, end, match, the features, ``prob``, ``is_secret`` and ``trained``, one row per candidate."""
    cand = _candidates(docs, id_col, text_col, path_col)
    return _scored(cand, *_fit(_labelled(cand, findings), train_rows))


def held_out(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             path_col: str = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row: n, positives, found, precision and recall on the labelled candidates whose value's hash falls into
    the fifth that is not trained on (null where there is nothing to divide by)."""
    labelled = cut_lineage(_labelled(_candidates(docs, id_col, text_col, path_col), findings))
    aside = F.pmod(F.xxhash64("match"), F.lit(5)) == 0
    scored = _scored(labelled.filter(aside), *_fit(labelled.filter(~aside), train_rows))
    hit, true = F.col("is_secret"), F.col("label") == 1
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(true).alias("positives"), F.count_if(hit).alias("found"),
                      F.count_if(hit & true).alias("right"))
    return sums.select("n", "positives", "found", F.try_divide("right", "found").alias("precision"),
                       F.try_divide("right", "positives").alias("recall"))
