"""Product manifests (C5, G1, G3, G5, N1, N2, S6 keys)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import names
from skytable.operators.ranking import first_per_key
from skytable.operators.scalars import with_row
from skytable.sources.tables import MANIFEST_COLUMNS

# Where each manifest column may come from, in order of preference.
ALIASES = {
    "dataURI": ["dataURI", "data_uri", "uri"],
    "productFilename": ["productFilename", "filename"],
    "obsID": ["obsID", "obs_id", "observation_id", "dataset", "fileSetName"],
    "target_name": ["target_name", "target", "targname", "sci_targname", "target_name_obs"],
    "obs_collection": ["obs_collection"],
    "calib_level": ["calib_level", "productLevel", "calib_level_obs"],
    "productType": ["productType", "product_type", "category", "type"],
    "dataproduct_type": ["dataproduct_type"],
    "instrume": ["instrume", "instrument_name", "instrument", "instrume_obs"],
    "exp_type": ["exp_type", "exp_type_obs"],
    "filters": ["filters", "filter", "filters_obs", "opticalElements"],
    "proposal_id": ["proposal_id", "proposal", "proposal_id_obs"],
    "size": ["size"],
    "dataRights": ["dataRights", "data_rights", "access", "dataRights_obs"],
}
# Observation columns and their names on a product row.
OBSERVATION_NAMES = {
    "fileSetName": "dataset",
    "targprop": "target_name_obs",
    "instrume": "instrume_obs",
    "exp_type": "exp_type_obs",
    "program": "proposal_id_obs",
    "access": "dataRights_obs",
    "productLevel": "calib_level_obs",
    "opticalElements": "filters_obs",
}
DEFAULT_MISSION = "JWST"
PRODUCT_URI = "mast:JWST/product/"
MOSAIC_SUFFIX = "_i2d.fits"


def enrich_products(products: DataFrame, observations: DataFrame, arrival: str) -> DataFrame:
    """Products get the metadata of their observation; of repeated observations the first by ``arrival`` counts."""
    if "dataset" not in products.columns or "fileSetName" not in observations.columns:
        return products
    present = [c for c in OBSERVATION_NAMES if c in observations.columns]
    picked = observations.select(*[F.col(c).alias(OBSERVATION_NAMES[c]) for c in present], F.col(arrival).alias("_arrival"))
    one = first_per_key(picked, ["dataset"], [F.col("_arrival")]).drop("_arrival")
    return products.join(one, "dataset", "left")


def _filled(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def normalize_products(raw: DataFrame, arrival: str, batch: list[str] | None = None) -> DataFrame:
    """Manifest rows of mosaic images, one per file name.

    The level and image filters only apply where a batch has any such value, and a batch without levels counts as
    level 3. ``batch`` columns scope these flags and the keep-first rule; without them the whole table is one batch.
    """
    batch = batch or []
    base = raw.select(
        *batch,
        F.col(arrival).alias("_arrival"),
        *[names.coalesce_columns(raw, a).alias(c) for c, a in ALIASES.items()],
    )
    level = names.level_text(F.col("calib_level"))
    kind = F.lower(_filled(F.col("dataproduct_type")))
    flags = [F.max(level != "").alias("_has_level"), F.max(kind != "").alias("_has_kind")]
    if batch:
        marked = base.join(base.groupBy(*batch).agg(*flags), batch)
    else:
        marked = with_row(base, base.agg(*flags))
    file_name = _filled(F.col("productFilename"))
    uri = _filled(F.col("dataURI"))
    final_level = F.when(F.col("_has_level"), level).otherwise("3")
    keep = file_name.endswith(MOSAIC_SUFFIX) & (final_level == "3") & (~F.col("_has_kind") | (kind == "image"))
    changed = {
        "dataURI": F.when(uri == "", F.concat(F.lit(PRODUCT_URI), file_name)).otherwise(uri),
        "obs_collection": F.when(F.coalesce("obs_collection", F.lit("")) == "", DEFAULT_MISSION).otherwise(F.col("obs_collection")),
        "calib_level": final_level,
    }
    rows = marked.filter(keep).select(
        *batch, "_arrival", *[changed.get(c, F.col(c)).alias(c) for c in MANIFEST_COLUMNS]
    )
    return first_per_key(rows, [*batch, "productFilename"], [F.col("_arrival")]).drop("_arrival")


def export_manifest(products: DataFrame, observations: DataFrame, arrival: str, batch: str) -> DataFrame:
    """Enrich and normalize landed product rows batch by batch."""
    return normalize_products(enrich_products(products, observations, arrival), arrival, [batch])


def merge_manifests(parts: list[DataFrame], arrival: str) -> DataFrame:
    """G1: union in the given order, the first row per file name wins, sorted by file name."""
    for place, part in enumerate(parts):
        missing = [c for c in MANIFEST_COLUMNS if c not in part.columns]
        if missing:
            raise ValueError(f"manifest {place} is missing required columns: {', '.join(missing)}")
    tagged = [p.select(*MANIFEST_COLUMNS, F.lit(i).alias("_part"), F.col(arrival).alias("_arrival")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    return first_per_key(every, ["productFilename"], [F.col("_part"), F.col("_arrival")]).drop("_part", "_arrival").orderBy("productFilename")


def extend_work_list(existing: DataFrame, found: DataFrame, key: str, place: str) -> DataFrame:
    """The existing list keeps its order, unseen entries follow in sorted order.

    The order is (``block``, ``place``, key): block 0 are the old entries with their first place, block 1 the new.
    """
    old = existing.groupBy(key).agg(F.min(place).alias(place)).withColumn("block", F.lit(0))
    new = found.select(key).distinct().join(old.select(key), key, "left_anti")
    new = new.withColumn(place, F.lit(None).cast(old.schema[place].dataType)).withColumn("block", F.lit(1))
    return old.unionByName(new).select("block", place, key)


def column_differences(spark, wanted: list[str], present: list[str]) -> DataFrame:
    """Columns missing from or extra to a wanted list, in sorted order. Schema work only."""
    rows = [(c, "missing") for c in sorted(set(wanted) - set(present))] + [(c, "extra") for c in sorted(set(present) - set(wanted))]
    return spark.createDataFrame(rows, "column string, state string")


def matched_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """G2."""
    return a.select(key).intersect(b.select(key))
