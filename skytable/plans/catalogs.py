"""Catalog loaders and label filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import coords

LOWER, UPPER, MIN_VOTES = 0.9, 1.0, 5


def superclean(votes: DataFrame, fraction: str, weight: str) -> DataFrame:
    """Rows with a fraction in [0.9, 1.0) and at least five votes; text that is no number is skipped."""
    f, n = F.col(fraction).try_cast("double"), F.col(weight).try_cast("double")
    return votes.filter((f >= LOWER) & (f < UPPER) & (n >= MIN_VOTES))


def master_catalog(df: DataFrame, ra: str, dec: str, survey: Column, sexagesimal: bool = False) -> DataFrame:
    """(id, ra, dec, survey) from decimal or sexagesimal columns."""
    a = coords.sexagesimal_ra(F.col(ra)) if sexagesimal else F.col(ra)
    d = coords.sexagesimal_dec(F.col(dec)) if sexagesimal else F.col(dec)
    return df.select("id", a.alias("ra"), d.alias("dec"), survey.alias("survey"))


def imaging_label(imaging: Column) -> Column:
    """Survey label of one of the catalogs."""
    return F.concat(F.lit("GZH-"), F.trim(imaging))
