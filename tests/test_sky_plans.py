"""Sky joins of small files: a file of a million positions is a few MB, so no join may hand positions to the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytable.functions import coords
from skytable.operators import spatial


@pytest.fixture(scope="module")
def cats(spark, tmp_path_factory):
    r = np.random.default_rng(9)
    out = []
    for n in range(3):
        rows = pd.DataFrame({"id": range(400), "ra": r.uniform(0, 360, 400), "dec": r.uniform(-89, 89, 400)})
        path = str(tmp_path_factory.mktemp("cats") / str(n))
        spark.createDataFrame(rows).coalesce(1).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_overlaps_are_not_broadcast(cats):
    assert broadcasts(spatial.survey_overlaps(*cats, ("a", "b", "c"))) == 0

def test_sources_are_not_broadcast(cats):
    a, b, _ = cats
    obs = a.select(F.col("id").cast("string").alias("obs_id"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), F.lit(0).alias("filter_rank"))
    products = obs.select(
        "obs_id", F.lit(0).alias("product_rank"), F.col("obs_id").alias("product_filename"), F.lit(1e-4).alias("scale_deg"), F.lit(20.0).alias("crpix_x"),
        F.lit(20.0).alias("crpix_y"), F.col("c_ra").alias("crval_ra"), F.col("c_dec").alias("crval_dec"), F.lit(40).alias("width"), F.lit(40).alias("height"),
    )
    assert broadcasts(spatial.resolve_sources(b, obs, products)) == 0

def test_cones_are_not_broadcast(cats):
    a, b, _ = cats
    assert broadcasts(spatial.cone_pairs(b, a.select(F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec")), 36.0)) == 0

def test_most_positions_meet_one_cell(cats):
    """A left row went to 27 cells before."""
    reach = coords.chord(1.0)
    spots = cats[0]
    for name, col in zip("xyz", coords.unit_vector(F.col("ra"), F.col("dec"))):
        spots = spots.withColumn(name, col)
    assert spatial._cells_in_reach(spots, ["x", "y", "z"], reach * spatial.MATCH_WIDTH, reach).count() < 2 * 400
