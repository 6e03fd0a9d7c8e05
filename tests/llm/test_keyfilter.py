"""Bitmaps that grow with their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.llm import keyfilter


def test_share_let_through(spark) -> None:
    n = keyfilter.LEAST_BITS + 100_000
    keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).union(spark.createDataFrame([(None,)], "key string"))
    known = keyfilter.Known(keyfilter.bitmap(keys))
    # More keys than the least bitmap has bits.
    assert known.size >= 8 * n and all(known[f"k{i}"] for i in range(0, n, 997))
    others = sum(known[f"other{i}"] for i in range(20_000))
    assert others < 0.13 * 20_000
    assert not any(keyfilter.bitmap(keys.limit(0)))


def test_sizes() -> None:
    assert keyfilter.size_for(0) == keyfilter.LEAST_BITS and keyfilter.size_for(10**12) == keyfilter.MOST_BITS
    assert all(keyfilter.size_for(n) >= 8 * n for n in (1, 262_144, 262_145, 10**6, 6 * 10**7))
