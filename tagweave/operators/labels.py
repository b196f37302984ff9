"""Tag distributions, per-class counts, class weights, one-hot export, down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import number_rows


def to_long(df: DataFrame, tags_col: str, id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """List column -> long (id, label); null and empty lists contribute no rows."""
    return df.select(id_col, F.explode(tags_col).alias(label_col))


def tag_distribution(df: DataFrame, tags_col: str, out_col: str | None = None) -> DataFrame:
    """A1: count per tag, ascending by count (ties by tag).

    ``explode`` (not ``explode_outer``), so null/empty lists count nothing.
    The count is a partial aggregate: a tag on a third of all rows is summed
    map-side first.
    """
    out_col = out_col or tags_col
    return (df.select(F.explode(tags_col).alias(out_col)).groupBy(out_col)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").asc(), F.col(out_col).asc()))


def long_distribution(long_df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1 on a long table (no explode needed)."""
    return (long_df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
                   .orderBy(F.col("count").asc(), F.col(label_col).asc()))


def label_counts(long_df: DataFrame, classes: DataFrame, split_col: str = "split",
                 label_col: str = "label", splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """A2: positive count per (split, class), zero-filled from the class list.

    ``classes`` is a DataFrame of labels (the label dimension); each class
    is expanded to one row per split name, and the data side is aggregated
    before the join.
    """
    counts = long_df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    grid = classes.select(label_col).distinct().select(
        label_col, F.explode(F.array(*[F.lit(s) for s in splits])).alias(split_col))
    return (grid.join(counts, [split_col, label_col], "left")
                .select(split_col, label_col, F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def class_weights(long_df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3: weight = (all label assignments) / (assignments of the class).

    The total counts assignments, not rows.  A zero count gives null, not
    infinity.  The data is aggregated per class first (partial aggregate);
    the total is a scalar subquery over that per-class table, so there is no
    cross join and no single-partition window.
    """
    per = long_df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    total = per.agg(F.sum("count")).scalar()
    return per.select(label_col, "count",
                      F.when(F.col("count") > 0, total / F.col("count")).alias("weight"))


def class_list(df: DataFrame, tags_col: str) -> list[str]:
    """Sorted distinct classes (driver-side list: bounded by the label universe)."""
    rows = df.select(F.explode(tags_col).alias("c")).distinct().orderBy("c").collect()
    return [r["c"] for r in rows]


def binarise(df: DataFrame, tags_col: str, classes: list[str], keep: list[str] = ("row_id",),
             text_col: str | None = None) -> DataFrame:
    """C14: one 0/1 int column per class (sorted), optional text column last."""
    cols: list[Column] = [F.col(c) for c in keep]
    cols += [F.array_contains(tags_col, c).cast("int").alias(c) for c in classes]
    if text_col:
        cols.append(F.col(text_col).alias("text"))
    return df.select(*cols)


def label_index(df: DataFrame, tags_col: str) -> DataFrame:
    """C14: (label, idx), the distinct labels numbered from 0 in sorted order; no driver list."""
    labels = df.select(F.explode(tags_col).alias("label")).dropna().distinct()
    return number_rows(labels, ["label"], "idx")


def sparse_indicators(df: DataFrame, tags_col: str, index: DataFrame, keep: list[str] = ("row_id",)) -> DataFrame:
    """C14 for large label sets: ``keep``, ``n_classes`` and ``indices``, the sorted places of the row's ones.

    ``index`` is a (label, idx) table as of :func:`label_index`; labels that it lacks are left out.
    Each distinct list is looked up once and joined back to its rows, so that a list on a third
    of the rows costs one lookup and rows need no unique id.  A repeated label counts once, an empty list
    gives no places, a null list null.
    """
    lists = df.select(F.col(tags_col).alias("_tags")).filter(F.size("_tags") > 0).distinct()
    placed = (lists.select("_tags", F.explode(F.array_distinct("_tags")).alias("label")).join(index, "label")
              .groupBy("_tags").agg(F.array_sort(F.collect_list("idx")).alias("_places")))
    rows = df.select(*keep, F.col(tags_col).alias("_tags")).join(placed, "_tags", "left")
    total = index.agg(F.count(F.lit(1))).scalar()
    places = F.when(F.col("_tags").isNotNull(), F.coalesce("_places", F.array().cast("array<bigint>")))
    return rows.select(*keep, total.alias("n_classes"), places.alias("indices"))


def downsample(df: DataFrame, tags_col: str, target: list[str], n: int, seed: int = 2,
               id_col: str = "row_id") -> DataFrame:
    """Keep every row whose list is not exactly ``target``; of those
    that are, keep a seeded sample of exactly ``n`` (all when fewer).

    The sample is the ``n`` smallest md5(id, seed) values: a top-k
    (TakeOrderedAndProject keeps at most ``n`` rows per task), so a target
    class holding a third of the data is never sorted in one task.
    """
    tgt = F.array(*[F.lit(t) for t in target])
    is_t = F.coalesce(F.col(tags_col) == tgt, F.lit(False))
    rest = df.filter(~is_t)
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    sample = (df.filter(is_t).withColumn("_h", key)
                .orderBy("_h", id_col).limit(n).drop("_h"))
    return rest.unionByName(sample)


def tags_per_row_histogram(df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """A4: number of rows per number of tags."""
    return (df.groupBy(F.coalesce(F.size(tags_col), F.lit(0)).alias("n_tags"))
              .agg(F.count(F.lit(1)).alias("n_rows")).orderBy("n_tags"))
