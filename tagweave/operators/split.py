"""Multi-label stratified train/test split.

``split_rarest`` (one pass after counting the labels): each row's stratum is its
rarest label, looked up in the row (ties by label; rows without labels form
their own stratum); rows are ranked in
their stratum by md5(id | seed) and row ``rn`` goes to test when
``floor(rn*p/q) > floor((rn-1)*p/q)`` for the share p/q — exact shares, in
integer arithmetic, identical on any engine.

The in-stratum rank is computed without sorting a stratum in one task: the
md5 order is split on its first hex digits into sub-buckets, per-sub-bucket
counts (a partial aggregate) give each sub-bucket's offset, and ranks are
taken inside (stratum, sub-bucket).  A stratum holding a third of all rows
is thus ranked by thousands of tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TEST_SHARE
from .labels import binarise, class_list

SUB_BUCKET_HEX = 3  # 4096 sub-buckets per stratum
MAX_LABELS = 10_000  # labels whose counts the driver holds; more raise an error
KEYS_AT_ONCE = 4096


def _share(test_share: float) -> tuple[int, int]:
    f = Fraction(str(test_share))
    return f.numerator, f.denominator


def hash_order(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def label_totals(df: DataFrame, labels_col: str, weight: str | F.Column) -> dict[str, int]:
    """Sum of ``weight`` over the rows of each label; ``ValueError`` beyond ``MAX_LABELS`` labels."""
    long = df.select(F.explode(labels_col).alias("label"), (F.col(weight) if isinstance(weight, str) else weight).alias("w"))
    found = long.groupBy("label").agg(F.sum("w").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return {r["label"]: r["n"] for r in found}


def literal_map(values: dict) -> F.Column:
    """A dictionary as one constant map."""
    if not values:
        return F.create_map().cast("map<string,double>")
    return F.map_from_arrays(F.lit(list(values)), F.lit(list(values.values())))


def rank_in_groups(df: DataFrame, group_col: str, order_col: str, id_col: str,
                   prefix_len: int = SUB_BUCKET_HEX) -> DataFrame:
    """Exact 1-based rank of each row in ``group_col`` by (order_col, id).

    ``order_col`` is a hex digest: its prefix defines sub-buckets whose
    sizes are counted first, so no group is ever sorted by a single task.
    """
    d = df.withColumn("_sb", F.substring(order_col, 1, prefix_len))
    sizes = d.groupBy(group_col, "_sb").agg(F.count(F.lit(1)).alias("_n"))
    w_off = (Window.partitionBy(group_col).orderBy("_sb")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(group_col, "_sb",
                           F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy(group_col, "_sb").orderBy(order_col, id_col)
    ranked = d.withColumn("_rn", F.row_number().over(w))
    return (ranked.join(offsets, [group_col, "_sb"])
                  .withColumn("rank", F.col("_off") + F.col("_rn"))
                  .drop("_sb", "_rn", "_off"))


def split_rarest(df: DataFrame, labels_col: str, id_col: str = "row_id",
                 test_share: float = TEST_SHARE, seed: int = 10) -> DataFrame:
    """(id, stratum, split) for every row with a non-null label list."""
    from ..session import cut_lineage
    p, q = _share(test_share)
    rows = df.filter(F.col(labels_col).isNotNull()).select(
        id_col, F.array_distinct(F.filter(labels_col, lambda x: x.isNotNull())).alias("_labs"))
    counts = literal_map(label_totals(rows, "_labs", F.lit(1)))
    rarest = F.array_min(F.transform("_labs", lambda x: F.struct(counts[x].alias("n"), x.alias("label"))))["label"]
    strata = cut_lineage(rows.select(id_col, F.coalesce(rarest, F.lit("")).alias("stratum"), hash_order(id_col, seed).alias("_h")))
    ranked = rank_in_groups(strata, "stratum", "_h", id_col)
    is_test = (F.expr(f"(rank * {p}) div {q}") > F.expr(f"((rank - 1) * {p}) div {q}"))
    return ranked.select(id_col, "stratum",
                         F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def split_balance(df: DataFrame, labels_col: str, split: DataFrame,
                  id_col: str = "row_id") -> DataFrame:
    """Per-label row count, test count and test share of a split."""
    long = df.select(id_col, F.explode(F.array_distinct(labels_col)).alias("label"))
    j = long.join(split.select(id_col, "split"), id_col)
    return (j.groupBy("label")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("n_test"))
             .withColumn("test_share", F.col("n_test") / F.col("n")))


def split_with_meta(df: DataFrame, labels_col: str, meta_cols: list[str],
                    id_col: str = "row_id", text_col: str | None = None,
                    test_share: float = TEST_SHARE, seed: int = 10) -> DataFrame:
    """Metadata stays on the row (joined by id, never by position)."""
    s = split_rarest(df, labels_col, id_col, test_share, seed)
    keep = [id_col, labels_col] + list(meta_cols) + ([text_col] if text_col else [])
    return df.select(*keep).join(s, id_col)


def split_categories(df: DataFrame, categories: list[str], id_col: str = "row_id",
                     text_col: str = "AllText", meta_cols: list[str] = ("FundingOrganisation",),
                     test_share: float = TEST_SHARE, seed: int = 10,
                     cased: bool = False, splitter: Callable[..., DataFrame] | None = None) -> DataFrame:
    """One split per category over one input, as a single plan with a
    ``category`` column.  ``splitter`` is :func:`split_rarest` (one pass) or
    :func:`split_iterative` (closer shares per label, one round per label).  The input is read by every category's split and once
    for the payload, so it is materialised once as a table in the checkpoint
    folder instead of being recomputed per branch."""
    from ..session import cut_lineage
    df = cut_lineage(df.select(id_col, text_col, *categories, *meta_cols))
    text = F.col(text_col) if cased else F.lower(F.col(text_col))
    splits = None
    for cat in categories:
        s = (splitter or split_rarest)(df, cat, id_col, test_share, seed).select(id_col, "split", F.lit(cat).alias("_cat"))
        splits = s if splits is None else splits.unionByName(s)
    # one join for all categories: the texts are moved once, the narrow (id, split, category) rows meet them.  A repeated
    # id meets its own category's rows only, so a row of null labels still goes with its id's split.
    labels = F.coalesce(*[F.when(F.col("_cat") == cat, F.col(cat)) for cat in categories])
    return (df.join(splits, id_col)
              .select(id_col, text.alias("text"), labels.alias("labels"), *meta_cols, "split", F.lower("_cat").alias("category")))


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One write, partitioned by (category, split); row id kept."""
    df.write.mode(mode).partitionBy("category", "split").parquet(path)


def write_export(df: DataFrame, labels_col: str, path: str, text_col: str, meta_cols: list[str],
                 id_col: str = "row_id", splitter: Callable[..., DataFrame] | None = None, **split_opts) -> None:
    """``data`` (row id, one 0/1 column per sorted class, text last),
    partitioned by split, and ``meta`` (row id and metadata), below a new path.  The input is read four times
    (classes, split, data, meta), so it is materialised once as a table in the checkpoint folder."""
    from ..session import cut_lineage
    df = cut_lineage(df.select(id_col, labels_col, text_col, *meta_cols))
    classes = class_list(df, labels_col)
    s = (splitter or split_rarest)(df, labels_col, id_col, **split_opts).select(id_col, "split")
    rows = df.join(s, id_col)
    binarise(rows, labels_col, classes, [id_col, "split"], text_col).write.mode("error").partitionBy("split").parquet(f"{path}/data")
    df.filter(F.col(labels_col).isNotNull()).select(id_col, *meta_cols).write.mode("error").parquet(f"{path}/meta")


def _nth_key(keys: DataFrame, n: int, total: int) -> str:
    """The n-th smallest of ``total`` distinct ``_key`` strings of one width.

    Counts by growing prefixes (at most 4096 counts a step) until at most
    ``KEYS_AT_ONCE`` keys are left to choose from: no global sort.
    """
    width = 0
    while total > KEYS_AT_ONCE:
        width += 3
        for prefix, total in sorted(map(tuple, keys.groupBy(F.substring("_key", 1, width)).count().collect())):
            if n <= total:
                break
            n -= total
        keys = keys.filter(F.col("_key").startswith(prefix))
    return sorted(r["_key"] for r in keys.select("_key").collect())[n - 1]


def split_iterative(df: DataFrame, labels_col: str, id_col: str = "row_id",
                    test_share: float = TEST_SHARE, seed: int = 10) -> DataFrame:
    """M1 (iterative stratification by label set): (id, split) for every row
    with a non-null label list.

    Rows are counted once per distinct label set; all rounds run on that table.
    Round r takes the label with the fewest unassigned rows (ties by label) and
    settles all open sets that hold it.  Its test demand k is spread over them:
    a set of n rows gets ``floor(n * k / open rows)`` test rows, and the rest of
    k goes, one row each, to the sets whose labels most need test rows (mean
    remaining test share of their labels; ties by the set's digest).  The rows without
    labels come last and balance the overall share.  In the end the rows are
    ranked once in their set by md5(id | seed), and the first ones go to test.

    The driver holds the demand and remaining count of each label (at most
    ``MAX_LABELS``, else ``ValueError``); there is one round per label, which scans
    the table of sets once: its settled sets are written to the checkpoint folder, counted there and read back together.
    """
    from ..session import cut_lineage, ensure_checkpoint_dir

    spark = df.sparkSession
    labs = F.array_sort(F.array_distinct(F.filter(labels_col, lambda x: x.isNotNull())))
    rows = df.filter(F.col(labels_col).isNotNull()).select(id_col, labs.alias("_labs"), hash_order(id_col, seed).alias("_h"))
    rows = cut_lineage(rows.withColumn("_set", F.md5(F.to_json("_labs"))))
    sets = cut_lineage(rows.groupBy("_set", "_labs").agg(F.count(F.lit(1)).alias("_n")))
    remaining = label_totals(sets, "_labs", "_n")
    want_test = {lab: test_share * n for lab, n in remaining.items()}
    want_train = {lab: n - want_test[lab] for lab, n in remaining.items()}
    want_all_test = test_share * (sets.agg(F.sum("_n")).first()[0] or 0)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/split-{uuid.uuid4().hex}"
    done: list[str] = []
    extra: dict[int, str] = {}        # by round: the last key that gets one row more
    while any(remaining.values()):
        lab = min((x for x in remaining if remaining[x] > 0), key=lambda x: (remaining[x], x))
        open_rows = remaining[lab]
        k = min(max(math.floor(want_test[lab] + 0.5), 0), open_rows)
        ratio = literal_map({m: want_test[m] / left if (left := want_test[m] + want_train[m]) > 0 else 0.0 for m in remaining})
        need = F.aggregate("_labs", F.lit(0.0), lambda a, m: a + ratio[m]) / F.size("_labs")
        late = F.floor((1 - F.greatest(F.least(need, F.lit(1.0)), F.lit(0.0))) * 10 ** 12).cast("long").cast("string")
        cand = sets.filter(F.array_contains("_labs", lab) & ~F.arrays_overlap("_labs", F.lit(done).cast("array<string>")))
        cand.select("_set", "_labs", "_n", F.expr(f"(_n * {k}) div {open_rows}").alias("_t"),
                    F.concat(F.lpad(late, 13, "0"), "_set").alias("_key")).write.parquet(f"{path}/round={len(done)}")
        settled = spark.read.parquet(f"{path}/round={len(done)}")        # the rest of the round reads its own sets only
        seen = settled.agg(F.count(F.lit(1)).alias("sets"), F.sum("_t").alias("given")).first()
        if k > seen["given"]:
            extra[len(done)] = _nth_key(settled.select("_key"), k - seen["given"], seen["sets"])
        test = F.col("_t") + (F.col("_key") <= F.lit(extra.get(len(done), ""))).cast("long")
        long = settled.select(F.explode("_labs").alias("label"), "_n", test.alias("_t"))
        for m, n, t in long.groupBy("label").agg(F.sum("_n"), F.sum("_t")).collect():
            remaining[m] -= n
            want_train[m] += t - n
            want_test[m] -= t
        want_all_test -= k
        done.append(lab)
    bare = sets.filter(F.size("_labs") == 0)
    rest = F.lit(max(math.floor(want_all_test + 0.5), 0)).cast("long")
    (bare.select("_set", "_labs", "_n", F.least("_n", rest).alias("_t"), F.lit("none").alias("_key"))
         .write.parquet(f"{path}/round={len(done)}"))
    last = F.create_map().cast("map<int,string>") if not extra else F.map_from_arrays(F.lit(list(extra)), F.lit(list(extra.values())))
    one_more = F.coalesce(F.col("_key") <= F.try_element_at(last, F.col("round")), F.lit(False)).cast("long")
    taken = spark.read.parquet(path).select("_set", (F.col("_t") + one_more).alias("_t"))
    return (rank_in_groups(rows.drop("_labs"), "_set", "_h", id_col).join(taken, "_set")
            .select(id_col, F.when(F.col("rank") <= F.col("_t"), "test").otherwise("train").alias("split")))
