"""Splits and balancing (E6-E8, F5, G4, C10). Draws are repeatable: rows are ordered by a seeded hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators.ranking import random_rank, seeded_order
from skytable.operators.scalars import with_row
from skytable.operators.stats import BINS, bin_of, bucket_of


def observed_bin(p: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Equal-width bin over the observed range, closed on the right; the lowest value belongs to the first bin."""
    step = (high - low) / bins
    return F.when(step == 0, F.lit(0)).otherwise(F.greatest(F.ceil((p - low) / step).cast("int") - 1, F.lit(0)))


def validation_names(df: DataFrame, target: str, ids: list[str], share: float = 0.2, seed: int = 42, at_least: int = 1) -> DataFrame:
    """Names of the validation rows: per bin ``max(at_least, int(n * share))`` random rows.

    Chosen by name, so rows of one name stay together.
    """
    spread = df.agg(F.min(target).alias("_low"), F.max(target).alias("_high"))
    binned = with_row(df.filter(F.col(target).isNotNull()), spread).withColumn(
        "_bin", observed_bin(F.col(target), F.col("_low"), F.col("_high"))
    )
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    quota = F.greatest(F.lit(at_least), F.floor(F.col("_n") * F.lit(share)))
    ranked = random_rank(binned.select("name", "_bin", *[i for i in ids if i != "name"]), ["_bin"], ids, seed, "_rank")
    # One row per bin, at most ``BINS``.
    return ranked.join(F.broadcast(sizes), "_bin").filter(F.col("_rank") <= quota).select("name").distinct()


def bucket_split(df: DataFrame, target: str, ids: list[str], buckets: int, test_share: float = 0.2, seed: int = 42, mode: str = "later") -> DataFrame:
    """Adds ``split``: per bucket the same number of random train rows, the rest test.

    The number is ``int(smallest bucket * (1 - test_share))``. ``original`` computes the smallest bucket without the
    rows at 1.0 in the last one and counts empty buckets; ``later`` does neither.
    """
    placed = df.withColumn("_bucket", bucket_of(F.col(target), buckets, True)).filter("_bucket is not null")
    counted = bucket_of(F.col(target), buckets, mode != "original")
    sizes = placed.groupBy(counted.alias("_b")).agg(F.count("*").alias("_n")).filter("_b is not null")
    few = sizes.agg(F.min("_n").alias("_least"), F.count("*").alias("_kinds"))
    least = F.when(F.col("_kinds") < buckets, F.lit(0)).otherwise(F.col("_least")) if mode == "original" else F.col("_least")
    ranked = random_rank(placed, ["_bucket"], ids, seed, "_rank")
    keep = F.floor(least * F.lit(1 - test_share))
    split = F.when(F.col("_rank") <= keep, "train").otherwise("test")
    return with_row(ranked, few).withColumn("split", split).drop("_bucket", "_rank", "_least", "_kinds")


def fill_deficit(variations: DataFrame, original: DataFrame, target: str, ids: list[str], seed: int = 42) -> DataFrame:
    """Per bin as many random variations as the bin lacks to the fullest one; ``P_CW`` = p and ``P_ACW`` = 0.

    ``variations``: labelled rows with ``p``; ``original``: the training rows with ``target``.
    """
    spark = variations.sparkSession
    counts = original.groupBy(bin_of(F.col(target)).alias("_bin")).agg(F.count("*").alias("_n"))
    bins = spark.range(BINS).select(F.col("id").cast("int").alias("_bin")).join(counts, "_bin", "left").fillna(0, ["_n"])
    top = counts.agg(F.max("_n").alias("_top"))
    lack = with_row(bins, top).select("_bin", (F.col("_top") - F.col("_n")).alias("_lack"))
    placed = variations.filter("p is not null").withColumn("_bin", bin_of(F.col("p")))
    ranked = random_rank(placed, ["_bin"], ids, seed, "_rank")
    chosen = ranked.join(F.broadcast(lack), "_bin").filter(F.col("_rank") <= F.col("_lack"))
    return chosen.withColumn("P_CW", F.col("p")).withColumn("P_ACW", F.lit(0.0)).drop("_bin", "_rank", "_lack", "p")


def assemble_training(original: DataFrame, validation: DataFrame, augmented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the original rows apart by name, augmented rows joined to train in its columns."""
    names = validation.select("name").distinct()
    train = original.join(names, "name", "left_anti").select(*original.columns)
    held = original.join(names, "name", "left_semi").select(*original.columns)
    have = [c for c in original.columns if c in augmented.columns]
    return train.unionByName(augmented.select(*have), allowMissingColumns=True), held


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """the first n rows in a given order."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, ids: list[str], n: int, seed: int) -> DataFrame:
    """n random rows, the same for the same seed."""
    return df.withColumn("_h", seeded_order(ids, seed)).orderBy("_h", *ids).limit(n).drop("_h")


def fold_number(df: DataFrame, label: str, ids: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold per row: each class is dealt out evenly."""
    ranked = random_rank(df, [label], ids, seed, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")
