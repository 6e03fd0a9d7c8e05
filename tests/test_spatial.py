"""Sky joins against brute force, at RA 0/360, both poles and in dense fields."""

import numpy as np
import pandas as pd
import pytest

from skytable.operators import spatial


def catalog(n, spread, seed):
    r = np.random.default_rng(seed)
    c = r.choice(5, n)
    ra = np.array([0, 359.9999, 120, 50, 10])[c] + r.normal(0, spread, n)
    dec = np.array([0, 10, 89.9999, -89.9998, 45])[c] + r.normal(0, spread, n)
    return pd.DataFrame({"id": np.arange(n), "ra": ra % 360, "dec": np.clip(dec, -90, 90)})


def separations(a, b):
    r1, d1 = np.radians(a.ra.values)[:, None], np.radians(a.dec.values)[:, None]
    r2, d2 = np.radians(b.ra.values)[None], np.radians(b.dec.values)[None]
    h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((r2 - r1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600


@pytest.fixture(scope="module")
def pair(spark):
    a, b = catalog(500, 3e-4, 1), catalog(500, 3e-4, 2)
    a = pd.concat([a, a.head(50).assign(id=lambda x: x.id + 1000)])
    return a, b, spark.createDataFrame(a), spark.createDataFrame(b)


@pytest.mark.parametrize("leaf", [256, 8])
def test_nearest(pair, leaf):
    a, b, sa, sb = pair
    sep = separations(a, b)
    want = {i: b.id.values[j] for i, j, m in zip(a.id, sep.argmin(1), sep.min(1)) if m <= 1.0}
    got = {r.id: r.right_id for r in spatial.nearest_match(sa, sb, 1.0, leaf).collect()}
    assert got == want


@pytest.mark.parametrize("leaf", [256, 8])
def test_box(pair, leaf):
    a, b, sa, sb = pair
    near = (abs(a.ra.values[:, None] - b.ra.values) <= 1e-4) & (abs(a.dec.values[:, None] - b.dec.values) <= 1e-4)
    got = {r.id for r in spatial.box_semi_join(sa, sb, 1e-4, leaf).collect()}
    assert got == set(a.id.values[near.any(1)])


def test_one_cell_holds_most_rows(spark):
    """A third of the right side in one spot, most of it at one position."""
    r = np.random.default_rng(5)
    hot = pd.DataFrame({"ra": 10 + r.normal(0, 2e-5, 3000), "dec": 20 + r.normal(0, 2e-5, 3000)})
    same = pd.DataFrame({"ra": [10.0] * 3000, "dec": [20.0] * 3000})
    b = pd.concat([hot, same, catalog(500, 3e-4, 3)[["ra", "dec"]]], ignore_index=True)
    b.insert(0, "id", np.arange(len(b)))
    a = pd.concat([hot.head(200) + 1e-6, same.head(200)], ignore_index=True)
    a.insert(0, "id", np.arange(len(a)))
    sep = separations(a, b)
    got = spatial.nearest_match(spark.createDataFrame(a), spark.createDataFrame(b), 1.0, 64).toPandas().set_index("id")
    assert len(got) == len(a)
    assert np.allclose(got.loc[a.id].sep_arcsec, sep.min(1), atol=1e-7)


def test_cone(pair):
    from pyspark.sql import functions as F

    a, b, sa, sb = pair
    got = spatial.cone_pairs(sa, sb.select(F.col("id").alias("other"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec")), 2.0)
    want = {(a.id.values[i], b.id.values[j]) for i, j in zip(*np.where(separations(a, b) <= 2.0))}
    assert {(r.id, r.other) for r in got.select("id", "other").collect()} == want


def test_tolerance_must_be_positive(pair):
    with pytest.raises(ValueError):
        spatial.nearest_match(pair[2], pair[3], 0)


def test_resolve_sources_dense_equals_plain(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    n = 120
    c = pd.DataFrame({"obs_id": [f"o{i}" for i in range(n)], "c_ra": 30 + r.normal(0, 3e-3, n), "c_dec": 10 + r.normal(0, 3e-3, n), "filter_rank": r.choice([0, 1, 2], n)})
    obs = spark.createDataFrame(c)
    size = F.when(F.col("filter_rank") == 0, 8).otherwise(40)
    products = obs.select(
        "obs_id", F.lit(0).alias("product_rank"), F.concat("obs_id", F.lit(".fits")).alias("product_filename"), F.lit(1e-4).alias("scale_deg"),
        (size / 2.0).alias("crpix_x"), (size / 2.0).alias("crpix_y"), F.col("c_ra").alias("crval_ra"), F.col("c_dec").alias("crval_dec"), size.alias("width"), size.alias("height"),
    )
    spots = spark.createDataFrame(pd.DataFrame({"id": range(80), "ra": 30 + r.normal(0, 4e-3, 80), "dec": 10 + r.normal(0, 4e-3, 80)}))
    plain = {x.id: x.obs_id for x in spatial.resolve_sources(spots, obs, products, 0.004, 1000).collect()}
    dense = {x.id: x.obs_id for x in spatial.resolve_sources(spots, obs, products, 0.004, 8).collect()}
    assert len(spatial.search_rings(obs.select("c_ra", "c_dec"), 14.4, 8)) > 1
    assert dense == plain and 20 < len(plain)
