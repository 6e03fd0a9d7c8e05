"""Grouping against a sequential replay of the rule."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skytable.operators import grouping, ranking


def replay(rows, arcsec=1.0):
    tol, founders, out = arcsec / 3600, [], []
    for seq, ra, dec in rows:
        for s, r, d in founders:
            scaled = (ra - r) * math.cos(math.radians((dec + d) / 2))
            if abs(ra - r) <= tol and abs(dec - d) <= tol and math.hypot(scaled, dec - d) <= tol:
                out.append(s)
                break
        else:
            founders.append((seq, ra, dec))
            out.append(seq)
    return out


def crowded(n, spread, seed):
    r = np.random.default_rng(seed)
    d = pd.DataFrame({"seq": np.arange(n), "ra": 50 + r.normal(0, spread, n), "dec": r.choice([0, 60], n) + r.normal(0, spread, n)})
    again = d.sample(n // 4, random_state=1).assign(seq=np.arange(n, n + n // 4))
    return pd.concat([d, again], ignore_index=True)


def test_matches_sequential_rule(spark):
    d = crowded(400, 7e-4, 3)
    want = replay(d[["seq", "ra", "dec"]].values.tolist())
    got = grouping.group_detections(spark.createDataFrame(d)).select("seq", "group_seq").toPandas().sort_values("seq")
    assert list(got.group_seq) == want
    assert len(set(want)) > 10


def test_hot_object(spark):
    """One object seen thousands of times with jitter stays one group, found in one round."""
    r = np.random.default_rng(1)
    d = pd.DataFrame({"seq": np.arange(6000), "ra": 10 + r.uniform(-5e-5, 5e-5, 6000), "dec": 5 + r.uniform(-5e-5, 5e-5, 6000)})
    g = grouping.group_detections(spark.createDataFrame(d))
    assert g.select("group_seq").distinct().count() == 1
    versions = ranking.arrival_rank(g, ["group_seq"], "seq", "version", rows=100)
    assert versions.filter(F.col("version") != F.col("seq") + 1).count() == 0


def test_batches_equal_one_run(spark):
    d = crowded(200, 7e-4, 9)
    s = spark.createDataFrame(d)
    whole = {r.seq: r.group_seq for r in grouping.group_detections(s).collect()}
    first = grouping.group_detections(s.filter("seq < 150"))
    known = first.select("group_seq", "group_ra", "group_dec").distinct()
    second = grouping.attach_batch(known, s.filter("seq >= 150"))
    got = {r.seq: r.group_seq for r in first.collect()} | {r.seq: r.group_seq for r in second.collect()}
    assert got == whole


def test_footprints(spark):
    r = np.random.default_rng(3)
    n = 250
    d = pd.DataFrame(
        {
            "seq": np.arange(n), "ra": r.choice([0.0, 359.9999, 50.0], n) + r.normal(0, 3e-4, n), "dec": r.normal(0, 3e-4, n),
            "half_ra": r.choice([1e-4, 3e-4, 8e-4], n), "half_dec": r.choice([1e-4, 5e-4], n),
            "size": np.where(r.random(n) < 0.1, np.nan, r.choice([0.5, 1.2, 2.5, 9.0], n)),
        }
    )
    d["ra"] %= 360
    founders, want = [], []
    for seq, ra, dec, hr, hd, size in d.values.tolist():
        for g in founders:
            gap = abs((ra - g[1] + 180) % 360 - 180)
            similar = math.isnan(size) or math.isnan(g[5]) or abs(g[5] - size) <= max(0.5 * g[5], 1)
            if gap <= g[3] and abs(dec - g[2]) <= g[4] and similar:
                want.append(g[0])
                break
        else:
            founders.append((seq, ra, dec, hr, hd, size))
            want.append(seq)
    s = spark.createDataFrame(d).withColumn("size", F.nanvl("size", F.lit(None).cast("double")))
    got = grouping.group_by_footprint(s).select("seq", "group_seq").toPandas().sort_values("seq")
    assert list(got.group_seq) == want


def test_positions_without_value(spark):
    """Rows without a finite position end with a null group; the others are grouped as if they were not there."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, 1.0, inf), (5, 1.0, 1.0), (6, None, None)]
    got = grouping.group_detections(spark.createDataFrame(rows, "seq bigint, ra double, dec double"))
    assert {r.seq: r.group_seq for r in got.collect()} == {1: 1, 5: 1, 2: None, 3: None, 4: None, 6: None}
    none = grouping.group_detections(spark.createDataFrame([(2, None, 1.0)], "seq bigint, ra double, dec double"))
    assert none.first().group_seq is None
    prints = [(1, 1.0, 1.0, 0.1, 0.1, 5.0), (2, None, 1.0, 0.1, 0.1, 5.0), (3, 1.0, 1.0, 0.0, 0.1, 5.0), (4, 1.0, nan, 0.1, 0.1, 5.0), (5, 1.01, 1.0, 0.1, 0.1, 5.0)]
    got = grouping.group_by_footprint(spark.createDataFrame(prints, "seq bigint, ra double, dec double, half_ra double, half_dec double, size double"))
    assert {r.seq: r.group_seq for r in got.collect()} == {1: 1, 5: 1, 2: None, 3: None, 4: None}


def test_long_chain_settles_in_few_rounds(spark, monkeypatch):
    """Neighbours in arrival order, 2,000 links over half a degree."""
    step = 0.9 / 3600
    d = pd.DataFrame({"seq": np.arange(2000), "ra": 40 + np.arange(2000) * step, "dec": 0.0})
    rounds = []
    plain = grouping._founders
    monkeypatch.setattr(grouping, "_founders", lambda *a: rounds.append(1) or plain(*a))
    got = grouping.group_detections(spark.createDataFrame(d)).select("seq", "group_seq").toPandas().sort_values("seq")
    assert list(got.group_seq) == replay(d[["seq", "ra", "dec"]].values.tolist())
    assert len(rounds) <= 10


def test_blocks_smaller_than_the_field(spark, monkeypatch):
    """Founders across the borders of many blocks, with cells that hold more than what one round sees."""
    monkeypatch.setattr(grouping, "SETTLE_CELLS", 4)
    d = crowded(300, 4e-4, 5)
    got = grouping.group_detections(spark.createDataFrame(d)).select("seq", "group_seq").toPandas().sort_values("seq")
    assert list(got.group_seq) == replay(d[["seq", "ra", "dec"]].values.tolist())
