"""Lookups by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import names
from skytable.functions.coords import grid_key
from skytable.operators.ranking import first_per_key

KEY_DECIMALS = 4


def _keyed(df: DataFrame, ra: Column, dec: Column) -> DataFrame:
    return df.withColumn("_kr", grid_key(ra, KEY_DECIMALS)).withColumn("_kd", grid_key(dec, KEY_DECIMALS))


def match_ground_truth(report: DataFrame, truth: DataFrame, value: str, arrival: str) -> DataFrame:
    """C4: report rows whose position, read from ``name`` and rounded to four decimals, has a truth value.

    The last truth row per key wins; the value becomes ``P_CW`` and ``P_ACW`` is 0. The truth side is one row per key,
    so a popular key on the report side is a one-to-many join that adaptive skew splitting can cut.
    """
    good = truth.filter("ra is not null and dec is not null")
    lookup = first_per_key(
        _keyed(good, F.col("ra"), F.col("dec")).select("_kr", "_kd", F.trim(F.col(value).cast("string")).alias("P_CW"), F.col(arrival).alias("_arrival")),
        ["_kr", "_kd"],
        [F.col("_arrival")],
        last=True,
    ).drop("_arrival")
    # Going through an array keeps the optimizer from parsing the name once per use.
    parsed = F.filter(F.array(names.parse_report_name(F.col("name"))), lambda p: p.isNotNull())
    place = report.withColumn("_p", F.explode(parsed))
    keyed = _keyed(place, F.col("_p.ra"), F.col("_p.dec")).drop("_p")
    return keyed.join(lookup, ["_kr", "_kd"]).drop("_kr", "_kd").withColumn("P_ACW", F.lit("0"))


def label_sources(labels: DataFrame, mapping: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``reason`` (``accepted`` or why not), ``source_name`` and ``fits_path`` to each label.

    ``labels``: (label_dir, score_filename, ...). ``mapping``: (label_dir, score_filename, source_name). ``files``:
    (fits_path, readable). Only the mapping's row count and one value per key are kept, never a list.
    """
    key = ["label_dir", "score_filename"]
    per_key = mapping.groupBy(*key).agg(F.count("*").alias("_n"), F.min("source_name").alias("source_name"))
    known = files.groupBy("fits_path").agg(F.max("readable").alias("_readable"))
    joined = labels.join(per_key, key, "left").withColumn("source_name", F.trim("source_name"))
    joined = joined.withColumn("fits_path", F.when(F.col("_n") == 1, names.underscore_to_file(F.col("source_name"))))
    full = joined.join(known, "fits_path", "left")
    reason = (
        F.when(F.col("_n").isNull(), "missing_mapping")
        .when(F.col("_n") > 1, "duplicate_mapping")
        .when(F.coalesce("source_name", F.lit("")) == "", "missing_source_name")
        .when(F.col("fits_path").isNull(), "invalid_source_name")
        .when(F.col("_readable").isNull(), "missing_fits")
        .when(~F.col("_readable"), "unreadable_fits")
        .otherwise("accepted")
    )
    return full.withColumn("reason", reason).drop("_n", "_readable")


def missing_label_dirs(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected label folders without any file, one ``missing_label_dir`` row each."""
    gone = expected.select("label_dir").join(labels.select("label_dir").distinct(), "label_dir", "left_anti")
    return gone.withColumn("reason", F.lit("missing_label_dir"))


def ensemble_predictions(parts: list[DataFrame]) -> DataFrame:
    """Names of the first table's test rows with the mean prediction over all tables, missing ones skipped.

    One union and one aggregate in place of a join per table; names are unique within a table.
    """
    first = parts[0].filter("split = 'test'")
    tagged = [
        p.filter("split = 'test'").select("name", "P_spiral_predicted", F.lit(i == 0).alias("_first")) for i, p in enumerate(parts)
    ]
    mean = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("name")
        .agg(F.avg("P_spiral_predicted").alias("P_spiral_predicted"), F.max("_first").alias("_first"))
        .filter("_first")
        .drop("_first")
    )
    return first.drop("P_spiral_predicted").join(mean, "name")


def name_for_score(scores: DataFrame, predictions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Source name per score text, with ``state`` ok, missing or ambiguous.

    ``scores``: (score), ``predictions``: (name, score), ``overrides``: (score_text, name). Overrides win.
    """
    by_text = predictions.select(names.score_text(F.col("score")).alias("score_text"), "name")
    # Two extremes tell one name from several without collecting them.
    found = by_text.groupBy("score_text").agg(F.min("name").alias("_lo"), F.max("name").alias("_hi"))
    forced = overrides.groupBy("score_text").agg(F.min("name").alias("_forced"))
    asked = scores.withColumn("score_text", names.score_text(F.col("score")))
    joined = asked.join(found, "score_text", "left").join(forced, "score_text", "left")
    one = F.coalesce("_forced", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    state = F.when(one.isNotNull(), "ok").when(F.col("_lo").isNull(), "missing").otherwise("ambiguous")
    return joined.withColumn("name", one).withColumn("state", state).drop("_lo", "_hi", "_forced")


def with_label_value(variations: DataFrame, labels: DataFrame, validation: DataFrame, arrival: str) -> DataFrame:
    """Variations of labelled objects outside the validation set; the last label row per id wins."""
    good = labels.filter("object_id is not null").withColumn("object_id", F.trim("object_id"))
    one = first_per_key(good.select("object_id", "p", F.col(arrival).alias("_arrival")), ["object_id"], [F.col("_arrival")], last=True)
    outside = variations.join(validation.select("object_id").distinct(), "object_id", "left_anti")
    return outside.join(one.drop("_arrival"), "object_id")


def pending_work(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """C11: wanted rows marked ``skipped`` when already done, else ``pending``."""
    seen = done.select(*key).distinct().withColumn("_done", F.lit(True))
    return wanted.join(seen, key, "left").withColumn("status", F.when(F.col("_done"), "skipped").otherwise("pending")).drop("_done")


def reusable_source(scope: str, exists: Column) -> Column:
    """C11: a resolved row counts only with the right scope, a path that exists, and the SCI extension."""
    has_path = F.coalesce(F.col("path"), F.lit("")) != ""
    named = F.upper(F.coalesce(F.col("ext_name"), F.lit(""))) == "SCI"
    return F.coalesce((F.col("scope") == scope) & has_path & named & exists, F.lit(False))


def map_back(results: DataFrame, originals: DataFrame, row_id: str) -> DataFrame:
    """Put results next to the rows they came from."""
    return originals.join(results, row_id)
