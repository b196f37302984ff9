"""Multi-label metrics over label vectors.

Inputs are long ``(row_id, label)`` tables of true and predicted labels.
Every level (detail / parent / super group) and scope (all rows / one
subgroup) is scored in one pass:

  truth ∪ pred ∪ meta  --one shuffle on row_id, bit_or-->  (row_id, t, p, in_sub)
  --bit tests, counts partial per task-->  (level, key) counts

A row's labels are one long: a bit for each parent and super group and for up to
``MAX_DETAILS`` known detail labels, so the OR roll-up is the OR of the bits and what is shuffled is not multiplied by
the levels or scopes.  Labels outside the layout (unknown codes, longer class lists) are kept as
the row's own sets.  Null labels count
for nothing.  Zero denominators score 0; ``support`` is kept so callers
can tell a true zero from an empty class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (FLAT_THRESHOLD, LABELS_LONG, LABELS_SHORT, LABELS_TINY, RANK_THRESHOLDS,
                         SUBGROUP_FUNDER, SUPER_GROUPS)
from ..functions.tags import label_parent
from ..session import cut_lineage
from .ranking import flat_threshold_tags, rank_threshold_tags

CODES = [n.split(":")[0] for n in LABELS_LONG]
COUNTS = ("tp", "fp", "fn")
ALL_COUNTS = (*COUNTS, *[f"sub_{c}" for c in COUNTS])
LEVELS = ("detail", "parent", "super")
PREFIX = {("detail", "all"): "", ("parent", "all"): "parent_", ("super", "all"): "super_parent_",
          ("detail", "sub"): "wellcome_", ("parent", "sub"): "parent_wellcome_",
          ("super", "sub"): "super_parent_wellcome_"}


def _super(parent: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SUPER_GROUPS.items() for x in kv])
    return F.element_at(m, parent)


def level_keys(label: Column) -> Column:
    """Array of struct(level, key) for one detail label; unparsable parents are skipped."""
    parent = label_parent(label)
    sup = _super(parent)
    return F.array_compact(F.array(
        F.struct(F.lit("detail").alias("level"), label.alias("key")),
        F.when(parent > 0, F.struct(F.lit("parent").alias("level"), parent.cast("string").alias("key"))),
        F.when(sup.isNotNull(), F.struct(F.lit("super").alias("level"), sup.cast("string").alias("key")))))


PARENTS, SUPERS = range(1, 9), range(1, 4)
MAX_DETAILS = 63 - len(PARENTS) - len(SUPERS)       # a long without its sign bit
FIXED_KEYS = [("parent", str(i)) for i in PARENTS] + [("super", str(i)) for i in SUPERS]


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _has(bits: Column, i: Column) -> Column:
    return F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("long"))


def _texts(values: list[str]) -> Column:
    """A constant array, folded from one literal (a column per element is slow to plan)."""
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


def label_bits(label: Column, details: list[str]) -> Column:
    """The long of one detail label: its own bit (0 outside ``details``), its parent's and its super group's."""
    parent, none = label_parent(label), F.lit(0).cast("long")
    own, sup = F.array_position(_texts(details), label), _super(parent)
    at = [F.when(parent.between(1, len(PARENTS)), _bit(parent - 1)), F.when(sup.isNotNull(), _bit(sup + (len(PARENTS) - 1))),
          F.when(own > 0, _bit(own + (len(FIXED_KEYS) - 1)))]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.coalesce(b, none) for b in at])


def vector_keys(details: list[str], others: bool) -> Column:
    """array<struct<level,key,t,p>>: the keys that the columns ``t``, ``p`` (and the others) hold."""
    layout = FIXED_KEYS + [("detail", d) for d in details]
    levels, keys = _texts([lv for lv, _ in layout]), _texts([k for _, k in layout])
    t, p = F.col("t"), F.col("p")
    held = F.filter(F.sequence(F.lit(0), F.lit(len(layout) - 1)), lambda i: _has(t.bitwiseOR(p), i) == 1)
    found = F.transform(held, lambda i: F.struct(F.element_at(levels, i + 1).alias("level"), F.element_at(keys, i + 1).alias("key"),
                                                 _has(t, i).alias("t"), _has(p, i).alias("p")))
    if not others:
        return found
    return F.concat(found, F.transform(F.array_union("t_other", "p_other"), lambda x: F.struct(
        x["level"].alias("level"), x["key"].alias("key"), F.array_contains("t_other", x).cast("long").alias("t"),
        F.array_contains("p_other", x).cast("long").alias("p"))))


def label_vectors(truth: DataFrame, pred: DataFrame, meta: DataFrame | None, details: list[str], others: bool = True,
                  subgroup_col: str = "FundingOrganisation", subgroup: str = SUBGROUP_FUNDER) -> DataFrame:
    """One row per labelled row_id: ``t`` and ``p`` (longs), ``in_sub``, ``has_meta`` (null without metadata).

    With ``others`` also ``t_other`` and ``p_other``: (level, key) pairs outside the layout.
    Metadata come as a third branch of the union, so there is one shuffle and no join.
    """
    none, false = F.lit(0).cast("long"), F.lit(False)

    def side(df: DataFrame, t: bool) -> DataFrame:
        d = df.select("row_id", F.col("label").cast("string").alias("label")).filter(F.col("label").isNotNull())
        bits = label_bits(F.col("label"), details)
        return d.select("row_id", (bits if t else none).alias("t"), (none if t else bits).alias("p"), "label",
                        F.lit(t).alias("is_t"), F.lit(True).alias("labelled"), false.alias("in_sub"), F.lit(None).cast("boolean").alias("has_meta"))

    rows = side(truth, True).unionByName(side(pred, False))
    if meta is not None:
        rows = rows.unionByName(meta.filter(F.col("row_id").isNotNull()).select(
            "row_id", none.alias("t"), none.alias("p"), F.lit(None).cast("string").alias("label"), false.alias("is_t"),
            false.alias("labelled"), F.coalesce(F.col(subgroup_col).cast("string") == F.lit(subgroup), false).alias("in_sub"),
            F.lit(True).alias("has_meta")))
    aggs = [F.bit_or("t").alias("t"), F.bit_or("p").alias("p"), F.max("labelled").alias("labelled"),
            F.max("in_sub").alias("in_sub"), F.max("has_meta").alias("has_meta")]
    if others:
        out = F.when((F.array_position(_texts(details), F.col("label")) == 0) | (label_parent(F.col("label")) > len(PARENTS)), F.col("label"))
        known = _texts([f"{lv} {k}" for lv, k in FIXED_KEYS + [("detail", d) for d in details]])
        aggs += [F.collect_set(F.when(F.col("is_t") if t else ~F.col("is_t"), out)).alias(c) for c, t in (("t_other", True), ("p_other", False))]
    vec = rows.groupBy("row_id").agg(*aggs).filter("labelled").drop("labelled")
    if others:
        for c in ("t_other", "p_other"):
            keys = F.array_distinct(F.flatten(F.transform(F.array_sort(c), level_keys)))
            keys = F.filter(keys, lambda x: ~F.array_contains(known, F.concat_ws(" ", x["level"], x["key"])))
            vec = vec.withColumn(c, F.when(F.size(c) > 0, keys).otherwise(F.array().cast("array<struct<level:string,key:string>>")))
    return vec


def rolled_up(truth: DataFrame, pred: DataFrame, meta: DataFrame | None = None,
              subgroup_col: str = "FundingOrganisation", subgroup: str = SUBGROUP_FUNDER,
              levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(row_id, level, key, t, p, in_sub, has_meta), one row per key that a row has, with OR over children."""
    vec = label_vectors(truth, pred, meta, CODES, True, subgroup_col, subgroup)
    keys = F.filter(vector_keys(CODES, True), lambda x: x["level"].isin(list(levels)))
    return (vec.select("row_id", "in_sub", "has_meta", F.explode(keys).alias("k"))
               .select("row_id", "k.level", "k.key", F.col("k.t").cast("int").alias("t"), F.col("k.p").cast("int").alias("p"),
                       "in_sub", "has_meta"))


def level_counts(truth: DataFrame, pred: DataFrame, meta: DataFrame | None = None, classes: DataFrame | None = None,
                 subgroup_col: str = "FundingOrganisation", subgroup: str = SUBGROUP_FUNDER) -> DataFrame:
    """(level, key, tp, fp, fn, sub_tp, sub_fp, sub_fn) of the 8 parents, the 3 groups and the detail classes.

    Detail classes are those of ``classes`` (a ``key`` column), else the observed ones; all are zero-filled.
    One more row, ``("status", "rows")``, counts rows with metadata (tp), rows without
    (fn) and the rows of the subgroup (sub_tp).  Each input is scanned once; besides the shuffle on row_id only
    counts move.
    """
    spark = truth.sparkSession
    details, others = CODES, True
    if classes is not None:
        first = [r[0] for r in classes.select(F.col("key").cast("string")).dropna().distinct().orderBy("key").limit(MAX_DETAILS + 1).collect()]
        details, others = first[:MAX_DETAILS], len(first) > MAX_DETAILS
    vec = label_vectors(truth, pred, meta, details, others, subgroup_col, subgroup)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    status = F.struct(F.lit("status").alias("level"), F.lit("rows").alias("key"), one.alias("t"), F.col("has_meta").isNotNull().cast("long").alias("p"))
    found = vec.select("in_sub", F.explode(F.concat(vector_keys(details, others), F.array(status))).alias("k"))
    t, p = F.col("k.t"), F.col("k.p")
    found = found.select("k.level", "k.key", "in_sub", (t * p).alias("tp"), (p * (1 - t)).alias("fp"), (t * (1 - p)).alias("fn"))
    found = found.select("level", "key", *COUNTS, *[F.when(F.col("in_sub"), F.col(c)).otherwise(zero).alias(f"sub_{c}") for c in COUNTS],
                         F.lit(False).alias("listed"))
    listed = spark.range(1).select(F.explode(_texts([f"{lv} {k}" for lv, k in FIXED_KEYS + [("status", "rows")]])).alias("k")).select(
        F.split_part("k", F.lit(" "), F.lit(1)).alias("level"), F.split_part("k", F.lit(" "), F.lit(2)).alias("key"))
    if classes is not None:
        listed = listed.unionByName(classes.select(F.lit("detail").alias("level"), F.col("key").cast("string").alias("key")).dropna())
    both = found.unionByName(listed.select("level", "key", *[zero.alias(c) for c in ALL_COUNTS], F.lit(True).alias("listed")))
    total = both.groupBy("level", "key").agg(*[F.sum(c).alias(c) for c in ALL_COUNTS], F.max("listed").alias("listed"))
    keep = F.col("listed")
    if classes is None:
        keep = keep | (F.col("level") == "detail") & (F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return total.filter(keep).drop("listed")


def _scored(counts: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """tp/fp/fn/support/precision/recall/f1 per (scope, level, key)."""
    by = [F.struct(F.lit(s).alias("scope"), *[F.col(c if s == "all" else f"sub_{c}").cast("long").alias(c) for c in COUNTS]) for s in scopes]
    j = counts.filter("level <> 'status'").select("level", "key", F.explode(F.array(*by)).alias("c")).select("level", "key", "c.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return j.select("scope", "level", "key", tp, fp, fn, (tp + fn).alias("support"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def per_label(truth: DataFrame, pred: DataFrame, meta: DataFrame | None = None,
              classes: DataFrame | None = None, subgroup: str = SUBGROUP_FUNDER,
              scopes: tuple[str, ...] = ("all", "sub")) -> DataFrame:
    """tp/fp/fn/support/precision/recall/f1 per (scope, level, key), zero-filled."""
    return _scored(level_counts(truth, pred, meta, classes, subgroup=subgroup), scopes)


def with_names(per: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Readable names, by code for details (not by position)."""
    short = F.array(*[F.lit(x) for x in LABELS_SHORT])
    tiny = F.array(*[F.lit(x) for x in LABELS_TINY])
    by_code = F.create_map(*[F.lit(x) for n in LABELS_LONG for x in (n.split(":")[0], n)])
    name = (F.when(F.col("level") == "detail", F.element_at(by_code, F.col("key")))
             .when(F.col("level") == "parent", F.try_element_at(short, F.col("key").cast("int")))
             .otherwise(F.try_element_at(tiny, F.col("key").cast("int"))))
    return per.withColumn("name", name)


def summary(per: DataFrame) -> DataFrame:
    """Micro (from summed counts) and macro (plain mean over all classes)."""
    first = F.min_by(F.struct("support", (F.col("tp") + F.col("fp")).alias("npred")), F.col("key"))
    g = per.groupBy("scope", "level").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), first.alias("c0"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prefix = F.create_map(*[F.lit(x) for (lv, sc), p in PREFIX.items() for x in (f"{lv}|{sc}", p)])
    return g.select(
        F.element_at(prefix, F.concat_ws("|", "level", "scope")).alias("prefix"), "scope", "level",
        "precision_macro",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision_micro"),
        "recall_macro",
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall_micro"),
        "f1_macro",
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1_micro"),
        F.col("c0.support").alias("label0_true"), F.col("c0.npred").alias("label0_pred"))


def subgroup_status(truth: DataFrame, pred: DataFrame, meta: DataFrame | None,
                    subgroup_col: str = "FundingOrganisation",
                    subgroup: str = SUBGROUP_FUNDER) -> DataFrame:
    """One row telling whether subgroup metrics are meaningful, and why not.

    Rows are matched to metadata by id; ids without metadata are counted
    (the positional form silently skipped the whole subgroup instead).
    """
    spark = truth.sparkSession
    rows = truth.select("row_id").unionByName(pred.select("row_id")).distinct()
    if meta is None:
        return spark.createDataFrame([("meta_not_found", None, None, None)],
                                     "status string, n_rows long, n_unmatched long, n_subgroup long")
    if subgroup_col not in meta.columns:
        return spark.createDataFrame([("funding_org_missing", None, None, None)],
                                     "status string, n_rows long, n_unmatched long, n_subgroup long")
    m = meta.select("row_id", (F.col(subgroup_col).cast("string") == F.lit(subgroup)).alias("sub"),
                    F.lit(1).alias("has"))
    j = rows.join(m, "row_id", "left")
    agg = j.agg(F.count(F.lit(1)).alias("n_rows"),
                F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).cast("long").alias("n_unmatched"),
                F.sum(F.when(F.col("sub"), 1).otherwise(0)).cast("long").alias("n_subgroup"))
    status = (F.when(F.col("n_unmatched") > 0, F.lit("unmatched_rows"))
               .when(F.col("n_subgroup") == 0, F.lit("no_subgroup_rows"))
               .otherwise(F.lit("computed")))
    return agg.select(status.alias("status"), "n_rows", "n_unmatched", "n_subgroup")


def metric_suite(truth: DataFrame, pred: DataFrame, meta: DataFrame | None = None,
                 classes: DataFrame | None = None, subgroup: str = SUBGROUP_FUNDER) -> DataFrame:
    """All six prefixes' summary rows from one pass over the inputs, whose counts (one row a label) are written.

    The three subgroup prefixes appear only when :func:`subgroup_status` says
    ``computed``: an empty subgroup or rows without metadata give no subgroup scores.
    """
    counts = cut_lineage(level_counts(truth, pred, meta, classes, subgroup=subgroup))   # one row a label
    seen = counts.filter("level = 'status'").first()
    computed = meta is not None and seen["fn"] == 0 and seen["sub_tp"] > 0
    return summary(_scored(counts, ("all", "sub") if computed else ("all",)))


def evaluate(scores: DataFrame, truth: DataFrame, labels: list[str], rank_weighting: bool = True,
             meta: DataFrame | None = None, subgroup: str = SUBGROUP_FUNDER,
             thresholds: list[float] = RANK_THRESHOLDS, flat: float = FLAT_THRESHOLD) -> DataFrame:
    """M8: (row_id, scores) -> tags -> metric suite over ``labels`` at all levels.

    Tags come from the rank thresholds, or from the one threshold ``flat``
    when ``rank_weighting`` is off.  With ``meta`` the subgroup's scores are
    added if its status is ``computed``.
    """
    tagged = (rank_threshold_tags(scores, "scores", "tags", thresholds) if rank_weighting
              else flat_threshold_tags(scores, "scores", "tags", flat))
    names = F.array(*[F.lit(x) for x in labels])
    pred = tagged.select("row_id", F.explode("tags").alias("i")).select(
        "row_id", F.element_at(names, F.col("i") + 1).alias("label"))
    classes = scores.sparkSession.createDataFrame([(x,) for x in labels], "key string")
    return metric_suite(truth, pred, meta, classes, subgroup)
