"""One-row results next to every row of a table, and joins in which null keys meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of both sides in which null equals null; the right side's keys are left out."""
    renamed = right.select([F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table as a scalar subquery: computed once, no join. No row gives nulls."""
    value = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", value).select(*df.columns, *[F.col("_row")[c].alias(c) for c in row.columns])
