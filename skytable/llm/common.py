"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.session import apply_settings

# Rows and bytes that one Arrow batch may hold, so that a batch of very long texts stays small.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings for the operators of this subpackage."""
    apply_settings(spark)
    for name, value in BATCH_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table; without names, all of them."""
    rows = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def map_batches(rows: DataFrame, schema: str, process: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Apply a function to every Arrow batch; ``process()`` makes it once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = process()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return rows.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fresh_name(taken: list[str], name: str) -> str:
    """A column name that no given column has, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; the right side's keys are dropped."""
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
