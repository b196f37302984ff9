"""Mixing sources to target weights by iterative proportional fitting (operator 1).

Documents are counted once into cells (source, language, topic) of token sums;
all fitting happens on that table.  A round scales every cell's factor so that
the weighted tokens meet the target of each source, then language, then topic.
Rounds repeat until no marginal is off by more than ``TOLERANCE`` (or
``MAX_ROUNDS``).  A document's ``weight`` is its cell's factor, scaled so that the
expected tokens are ``budget`` (none given: the tokens that are there); it gets
as many whole ``copies``, and one more when a hash of its id is below the
fraction.  Expected token shares meet all three marginals, and a rare cell with
a large factor is repeated instead of thinning out the others.  No shuffle, the
same answer in every run.

``prob`` and ``sampled`` are the form without repeats: the factor divided by the
largest one.  There a single rare cell sets the rate of the whole corpus.

The cell table stays distributed: marginals are partial aggregates, and joins
with them are broadcast only when the planner sees that they are small.

Targets: a table (value, share) per dimension, or tempered shares (token share
to the power ``alpha``).  Values without a target keep their present share, and
listed shares are scaled into the rest.

Defined cases: null source, language or topic is a category of its own; null or
empty text has no tokens and its cell's probability all the same; a cell without
tokens has weight 1; a null
``doc_id`` has one fixed hash; repeated rows get the same decision; zero
marginals keep factor 1; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut_lineage, slices, with_column_schema

ALPHA = 0.8
TOLERANCE, MAX_ROUNDS = 1e-9, 100
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """Topic by the text's form; the tables have no topic column."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("%%%") | t.contains("###"), "markup")
            .when(t.rlike("[0-9]{4}"), "records").when(F.length(t) - F.length(F.replace(t, F.lit("\n"))) >= 5, "article")
            .otherwise("prose"))


def tempered(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """(value, share): token shares to the power ``alpha``, scaled to one."""
    m = cut_lineage(cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
                    .select(F.col(dim).alias("value"), F.pow(F.col("t").cast("double"), alpha).alias("p")))
    total = m.agg(F.sum("p")).first()[0] or 1.0
    return m.select("value", (F.col("p") / total).alias("share"))


def fit(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The cells (dimensions, tokens) plus ``factor``, raked to the targets of each dimension."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("factor", F.lit(1.0))
    for dim, t in targets.items():
        have = cells.groupBy(dim).agg(F.sum("tokens").alias("have"))
        g = cut_lineage(have.join(t.select(F.col("value").alias("_v"), "share"), F.col(dim).eqNullSafe(F.col("_v")), "left"))
        sums = g.agg(F.sum(F.when(F.col("share").isNull(), F.col("have")).otherwise(0)).alias("unlisted"),
                     F.sum("share").alias("listed")).first()
        rest = total - (sums["unlisted"] or 0)
        goal = g.select(F.col(dim).alias("_d"), F.when(
            F.col("share").isNull(), F.col("have").cast("double")).otherwise(F.col("share") * (rest / (sums["listed"] or 1.0))).alias(f"_goal_{dim}"))
        state = cut_lineage(state.join(goal, F.col(dim).eqNullSafe(F.col("_d"))).drop("_d"))
    for done in range(max_rounds):
        state = state.withColumn("_off", F.lit(0.0))
        for dim in targets:
            # written after each dimension: a plan reads its state twice, and would double with every dimension it holds
            marg = state.groupBy(F.col(dim).alias("_d")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("_sum"))
            scale = F.when(F.col("_sum") > 0, F.col(f"_goal_{dim}") / F.col("_sum")).otherwise(1.0)
            state = cut_lineage(state.join(marg, F.col(dim).eqNullSafe(F.col("_d"))).withColumns(
                {"factor": F.col("factor") * scale, "_off": F.greatest(F.abs(scale - 1), F.col("_off"))}).drop("_d", "_sum"))
        met = state.filter((F.col("tokens") > 0) & (F.col("_off") > tolerance)).isEmpty()
        state = state.drop("_off")
        if met:
            break
    return state.drop(*[f"_goal_{dim}" for dim in targets])


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """Hash of an id in [0, 1)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, topic: Column, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, budget: float | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` plus ``_mix`` (struct: ``n_tokens``, ``prob``, ``sampled``, ``weight``, ``copies``)."""
    tagged = docs.withColumn("_mix", F.struct(
        token_count(F.col(text_col)).alias("n_tokens"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), topic.alias("topic")))
    cells = cut_lineage(tagged.groupBy(F.col("_mix.source").alias("source"), F.col("_mix.lang").alias("lang"), F.col("_mix.topic").alias("topic"))
                        .agg(F.sum("_mix.n_tokens").alias("tokens")))
    fitted = fit(cells, targets or {d: tempered(cells, d, alpha) for d in ("source", "lang", "topic")})
    top, held, total = fitted.filter("tokens > 0").agg(F.max("factor"), F.sum(F.col("tokens") * F.col("factor")), F.sum("tokens")).first()
    top, scale = top or 1.0, (total if budget is None else budget) / held if held else 1.0
    prob = cut_lineage(fitted.select(F.struct(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"),
                                              F.least(F.col("factor") / top, F.lit(1.0)).alias("p"),
                                              F.when(F.col("tokens") > 0, F.col("factor") * scale).otherwise(1.0).alias("w")).alias("_cell")))
    joined = tagged.join(prob, F.col("_mix.source").eqNullSafe(F.col("_cell.s")) & F.col("_mix.lang").eqNullSafe(F.col("_cell.l"))
                         & F.col("_mix.topic").eqNullSafe(F.col("_cell.t")))
    return joined.select(*docs.columns, F.struct(
        F.col("_mix.n_tokens").alias("n_tokens"), F.col("_cell.p").alias("prob"),
        (uniform(F.col(id_col)) < F.col("_cell.p")).alias("sampled"), F.col("_cell.w").alias("weight"),
        (F.floor("_cell.w") + (uniform(F.col(id_col)) < F.col("_cell.w") - F.floor("_cell.w")).cast("long")).alias("copies")).alias("_mix"))


def drawn(mixed: DataFrame) -> DataFrame:
    """The rows of a mixed table as often as their ``copies`` say, neighbours in one partition."""
    names = [c for c in mixed.columns if c != "_mix"]
    return mixed.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int"))).alias("_copy")).select(*names)


def counted_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Neighbouring equal rows as one row with their number in ``copies``.

    A run that a slice border cuts gives two rows: the sum of ``copies`` is always the number of rows.
    """
    return docs.mapInArrow(*run_counter(docs, id_col))


def run_counter(docs: DataFrame, id_col: str = "doc_id") -> tuple[Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], StructType]:
    """The step of ``counted_runs`` over Arrow batches and its schema."""
    at = docs.columns.index(id_col)

    def run(batches):
        for b in slices(batches):
            ids = b.column(at).to_pylist()
            first = [i for i in range(b.num_rows) if i == 0 or ids[i] != ids[i - 1] or not b.slice(i, 1).equals(b.slice(i - 1, 1))]
            copies = [j - i for i, j in zip(first, [*first[1:], b.num_rows])]
            yield pa.RecordBatch.from_arrays([*(b if len(first) == b.num_rows else b.take(pa.array(first))).columns, pa.array(copies, pa.int64())],
                                             schema=b.schema.append(pa.field("copies", pa.int64())))

    return run, with_column_schema(docs, "copies", "long")
