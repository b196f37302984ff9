"""Combining the two sources (J1, U2) and the pre-clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SECOND_SOURCE_FUNDER
from .numbering import number_rows

ORDER_COLS = ["src_rank", "src_year", "src_row"]


def semi_join_refs(survey: DataFrame, second: DataFrame,
                   funder: str = SECOND_SOURCE_FUNDER, null_safe: bool = False) -> DataFrame:
    """Keep second-source rows whose reference appears among ``funder``'s survey rows.

    The reference side is made distinct first (map-side partial aggregation),
    which also leaves it hash-partitioned on the join key, so the semi-join
    adds no exchange on that side; AQE may still broadcast it when small.
    ``null_safe`` matches null with null (``<=>``) as a pandas isin would.
    """
    refs = (survey.filter(F.col("FundingOrganisation") == F.lit(funder))
                  .select(F.col("OrganisationReference").alias("_ref")).distinct())
    if null_safe:
        cond = second["OrganisationReference"].eqNullSafe(refs["_ref"])
    else:
        cond = second["OrganisationReference"] == refs["_ref"]
    return second.join(refs, cond, "left_semi")


def combine_sources(survey: DataFrame, second: DataFrame,
                    funder: str = SECOND_SOURCE_FUNDER, null_safe: bool = False) -> DataFrame:
    """J1 + U2: survey rows, then the matching second-source rows (order kept in src_rank)."""
    kept = semi_join_refs(survey, second, funder, null_safe)
    return survey.unionByName(kept.select(*survey.columns))


def pre_clean(combined: DataFrame) -> DataFrame:
    """Reference as string and the row's position in the combined table as its id.

    ``index`` runs 0, 1, .. over survey rows by year and sheet row, then the second source: unique
    and gap-free whatever the references look like, and in year order.
    """
    return number_rows(combined.withColumn("OrganisationReference", F.col("OrganisationReference").cast("string")), ORDER_COLS)
