"""Null keys, missing values and empty results stay in the result."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skytable.operators import images, quantiles, ranking, spatial, stats


def test_null_keys_are_keys(spark):
    rows = [(i, None if i % 2 else "f", None if i % 3 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, band string, file string")
    got = ranking.capped_sample(df, ["band"], "file", ["id"], 8, 12, 1)
    sizes = {(r.band, r.file): r.n for r in got.groupBy("band", "file").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 24 and max(sizes.values()) <= 8
    ranked = ranking.arrival_rank(df, ["band"], "id", "place", rows=7)
    assert {(r.id, r.place) for r in ranked.collect()} == {(i, i // 2 + 1) for i in range(60)}
    old = spark.createDataFrame([(None, 5), ("f", 2)], "band string, version bigint")
    new = ranking.next_versions(df.filter("id < 4"), old, ["band"], "id")
    assert {(r.id, r.version) for r in new.collect()} == {(0, 3), (2, 4), (1, 6), (3, 7)}
    medians = quantiles.exact_quantiles(df.withColumn("v", F.col("id").cast("double")), ["band"], "v", {"m": 0.5})
    assert {(r.band, r.m) for r in medians.collect()} == {("f", 29.0), (None, 30.0)}


def test_squares_without_values_keep_their_pixels(spark):
    rows = [(1, 8, 8, y, x, float("nan") if y < 4 and x < 4 else float(y * x)) for y in range(8) for x in range(8)]
    p = spark.createDataFrame(rows, "image_id bigint, h int, w int, y int, x int, v double")
    clean, rms = images.subtract_background(p, 4)
    got = {(r.y, r.x): r.v for r in clean.collect()}
    assert len(got) == 64 and math.isnan(got[0, 0]) and rms.count() == 1
    squares = np.array([[y * x for x in range(4, 8)] for y in range(4, 8)])
    assert got[5, 5] == 25 - np.median(squares)


def test_images_without_sources_count_zero(spark):
    rows = [(i, 4, 4, y, x, 9.0 if i == 1 and (y, x) == (1, 1) else 0.0) for i in (1, 2) for y in range(4) for x in range(4)]
    p = spark.createDataFrame(rows, "image_id bigint, h int, w int, y int, x int, v double")
    level = p.groupBy("image_id").agg(F.lit(1.0).alias("mean"), F.lit(1.0).alias("var"))
    assert {(r.image_id, r.n_sources) for r in images.count_sources(p, level).collect()} == {(1, 1.0), (2, 0.0)}


def test_missing_filter_ranks_come_first_at_any_density(spark):
    r = np.random.default_rng(4)
    n = 150
    c = pd.DataFrame({"obs_id": [f"o{i}" for i in range(n)], "c_ra": 30 + r.normal(0, 3e-3, n), "c_dec": 10 + r.normal(0, 3e-3, n), "r": r.choice([-1, 0, 1, 2], n, p=[0.05, 0.15, 0.4, 0.4])})
    obs = spark.createDataFrame(c).select("obs_id", "c_ra", "c_dec", F.when(F.col("r") >= 0, F.col("r")).cast("int").alias("filter_rank"))
    size = F.lit(12)
    products = obs.select(
        "obs_id", F.lit(0).alias("product_rank"), F.concat("obs_id", F.lit(".fits")).alias("product_filename"), F.lit(1e-4).alias("scale_deg"),
        (size / 2.0).alias("crpix_x"), (size / 2.0).alias("crpix_y"), F.col("c_ra").alias("crval_ra"), F.col("c_dec").alias("crval_dec"), size.alias("width"), size.alias("height"),
    )
    spots = spark.createDataFrame(pd.DataFrame({"id": range(80), "ra": 30 + r.normal(0, 3e-3, 80), "dec": 10 + r.normal(0, 3e-3, 80)}))
    rows = lambda leaf: {(x.id, x.obs_id, x.filter_rank) for x in spatial.resolve_sources(spots, obs, products, 0.004, leaf).collect()}
    plain = rows(1000)
    assert rows(4) == plain and None in {x[2] for x in plain} and len({x[2] for x in plain}) > 2


def test_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "split string, y double, p double")
    got = {r.split: r for r in stats.regression_metrics(df, "y", "p", ["split"]).collect()}
    assert got["a"].r2 is None and got["a"].mae == 0.5 and got["b"].r2 == 1.0


def test_reports_are_read_by_header(spark, tmp_path):
    """Extra leading columns, another order and blanks in names do not shift values; a missing name is an error."""
    import pytest

    from skytable.sources import tables

    (tmp_path / "r.csv").write_text("index, b ,P_CW,a\n7,x,0.5,y\n8,p,0.25\n")
    got = tables.read_report(spark, str(tmp_path / "r.csv"), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("y", "x"), (None, "p")]
    cat = tables.read_catalog(spark, str(tmp_path / "r.csv"), "P_CW double, ` b` string, index bigint")
    assert [tuple(r) for r in cat.collect()] == [(0.5, "x", 7), (0.25, "p", 8)]
    with pytest.raises(ValueError):
        tables.read_report(spark, str(tmp_path / "r.csv"), ["a", "absent"])


def test_worker_without_time_waits(spark):
    from skytable.streaming import jobs

    events = spark.createDataFrame([("w1", None), ("w2", "2024-01-01 00:00:00")], "worker string, t string").select("worker", F.col("t").cast("timestamp").alias("ts"))
    got = {r.worker: r.status for r in jobs.worker_freshness(events, F.lit("2024-01-01 00:00:30")).collect()}
    assert got == {"w1": "waiting", "w2": "fresh"}
