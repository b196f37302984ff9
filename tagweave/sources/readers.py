"""Readers for the two award sources and the label dictionaries.

Both readers take an already-loaded raw DataFrame (any Spark source: parquet,
CSV with an explicit schema, a table) so file format and location stay the
caller's choice; ``load`` is a thin convenience for the usual formats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (LABELS_LONG, LABELS_SHORT, LABELS_TINY, MANUAL_CODING,
                         SECOND_SOURCE_FUNDER, SECOND_SOURCE_RENAMES, SUPER_GROUPS,
                         SURVEY_2014_RENAMES, SURVEY_YEARS)
from ..operators.dedup import latest_per_key
from ..operators.numbering import number_rows
from ..functions.tags import (first_tokens_slash, in_scope, label_parent, null_placeholders,
                              split_commas, top_chars_from_slash, top_level, truncate_codes,
                              wide_to_list)

BASE_COLS = ["FundingOrganisation", "OrganisationReference", "AwardTitle", "AwardAbstract"]


def load(spark: SparkSession, path: str, fmt: str = "parquet",
         schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a table; CSV needs an explicit schema (no inference at scale)."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("pass an explicit schema for CSV sources")
    return reader.load(path)


def load_sheet(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """S5 for a yearly sheet: the rows plus ``sheet_row``, their position in the file (1-based).

    The order is that of the file's blocks and of the rows in each, so any format that splits keeps it.
    """
    raw = load(spark, path, fmt, schema, **options)
    spot = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_read"))
    return number_rows(spot, ["_file", "_block", "_read"], "sheet_row", 1).drop("_file", "_block", "_read")


def tag_columns(columns: list[str], marker: str) -> list[str]:
    """Tag columns of a sheet in column order, without the percentages."""
    return [c for c in columns if marker in c and not c.endswith("%")]


def read_survey_year(raw: DataFrame, year: int) -> DataFrame:
    """One yearly sheet -> base columns + RA_*/HC_* + year.

    The first year uses public column names (renamed here) and has no
    CodingType; later years keep only manually coded rows.
    """
    df = raw
    if year == SURVEY_YEARS[0]:
        df = df.withColumnsRenamed(SURVEY_2014_RENAMES)
    else:
        df = df.filter(F.col("CodingType") == F.lit(MANUAL_CODING))
    tag_cols = tag_columns(df.columns, "RA_") + tag_columns(df.columns, "HC_")
    numeric = {f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # Tag cells become strings here (numeric NaN -> null), so years whose
    # sheets typed the codes differently union cleanly.
    tags = [(F.when(~F.isnan(c), F.col(c)) if c in numeric else F.col(c)).cast("string").alias(c)
            for c in tag_cols]
    extra = ["sheet_row"] if "sheet_row" in df.columns else []
    return df.select(*BASE_COLS, *tags, *extra).withColumn("year", F.lit(year).cast("int"))


def _prefix_cols(columns: list[str], prefix: str) -> list[str]:
    return [c for c in columns if c.split("_")[0] == prefix]


def union_years(years: list[DataFrame]) -> DataFrame:
    """Union by name; a year without some tag columns gets nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)


def combine_survey_years(years: list[DataFrame]) -> DataFrame:
    """U1 -> W1 -> C11 -> C12 -> A10 -> P4 over the yearly frames.

    W1 keeps the newest year per (funder, reference), ties by sheet row.  It
    is an aggregate with ``max_by`` rather than a window, so a hot key is
    reduced map-side before the shuffle instead of being sorted in one task.
    """
    rows = union_years(years)
    if "sheet_row" not in rows.columns:   # not read by load_sheet: rows of one key and year go by a hash, never the year
        rows = rows.withColumn("sheet_row", F.xxhash64(*BASE_COLS))
    latest = latest_per_key(rows, ["FundingOrganisation", "OrganisationReference"], ["year", "sheet_row"])
    numeric = {f.name for f in latest.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    hc_cols = _prefix_cols(latest.columns, "HC")
    ra_cols = _prefix_cols(latest.columns, "RA")
    df = (latest.withColumn("HC", wide_to_list(hc_cols, numeric))
                .withColumn("RA", truncate_codes(wide_to_list(ra_cols, numeric), 3)))
    df = df.withColumn("RA_top", top_level("RA"))
    return df.select(*BASE_COLS, "RA", "RA_top", "HC",
                     F.lit(0).alias("src_rank"), F.col("year").alias("src_year"),
                     F.col("sheet_row").cast("bigint").alias("src_row"))


def read_second_source(raw: DataFrame, apply_placeholder_nulls: bool = False) -> DataFrame:
    """The second award source in the common shape."""
    df = raw.select(*SECOND_SOURCE_RENAMES.keys()).withColumnsRenamed(SECOND_SOURCE_RENAMES)
    df = df.na.drop(how="any", subset=["RA_top", "RA"])
    df = df.filter(in_scope("RA"))
    df = df.withColumn("HC", split_commas(null_placeholders("HC", apply=apply_placeholder_nulls)))
    df = df.withColumn("RA_top", top_chars_from_slash("RA_top"))
    df = df.withColumn("RA", first_tokens_slash("RA"))
    return df.select(
        F.lit(SECOND_SOURCE_FUNDER).alias("FundingOrganisation"), "OrganisationReference",
        "AwardTitle", "AwardAbstract", "RA", "RA_top", "HC",
        F.lit(1).alias("src_rank"), F.lit(0).alias("src_year"),
        second_source_row().alias("src_row"))


def second_source_row() -> Column:
    """Order key of a second-source record, never null: its reference when that is a number under 10**10,
    else a 61-bit hash of reference and texts above all of those.  It orders rows and identifies none
    (``pre_clean`` numbers them)."""
    number = F.col("OrganisationReference").try_cast("bigint")
    hashed = F.xxhash64("OrganisationReference", "AwardTitle", "AwardAbstract").bitwiseAND(F.lit((1 << 61) - 1))
    return F.when(number.between(0, SECOND_ROW_LIMIT - 1), number).otherwise(hashed + F.lit(SECOND_ROW_LIMIT))


SECOND_ROW_LIMIT = 10 ** 10
LABEL_DICTS = {"long": LABELS_LONG, "short": LABELS_SHORT, "tiny": LABELS_TINY}


def label_names(label_type: str = "long") -> list[str]:
    """The label dictionary; index = position."""
    if label_type not in LABEL_DICTS:
        raise ValueError("label_type must be 'long', 'short', or 'tiny'")
    return LABEL_DICTS[label_type]


def label_dimension(spark: SparkSession) -> DataFrame:
    """The 48-code label dimension keyed by code: idx, code, name, parent, super."""
    rows = [(i, n.split(":")[0], n) for i, n in enumerate(LABELS_LONG)]
    df = spark.createDataFrame(rows, "label_idx int, code string, name string")
    parent = label_parent("code")
    sup = F.element_at(F.create_map(*[F.lit(x) for kv in SUPER_GROUPS.items() for x in kv]), parent)
    short = F.array(*[F.lit(x) for x in LABELS_SHORT])
    tiny = F.array(*[F.lit(x) for x in LABELS_TINY])
    return df.select(
        "label_idx", "code", "name", parent.alias("parent"), sup.alias("super_parent"),
        F.try_element_at(short, parent).alias("parent_name"),
        F.try_element_at(tiny, sup).alias("super_parent_name"))
