"""Running totals and exact quantiles for keys of any size.

The built-in exact percentile holds every distinct value of a key in one task. Here values are counted first, cut into
chunks that follow their order, and only the small table of chunk totals is summed per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.operators.scalars import null_safe_join, with_row

STEPS_PER_OCTAVE = 1024
LOWEST_OCTAVE = 1100


def magnitude_chunk(value: Column) -> Column:
    """Chunk that grows with the value: equal steps of its logarithm, mirrored for negative values.

    A step is 0.07% of the value, so values with a spread of ten percent fall into more than a hundred chunks.
    """
    size = (F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE) + STEPS_PER_OCTAVE * LOWEST_OCTAVE).cast("int")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def running_before(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, totals: dict[str, str]) -> DataFrame:
    """Adds for each ``{new: column}`` the sum of ``column`` over the rows of the key that come earlier in ``order``.

    ``chunk`` must never decrease along ``order``.
    """
    tagged = df.withColumn("_chunk", chunk)
    sums = tagged.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals])
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in totals.items()]
    joined = null_safe_join(tagged.select("*", *local), offsets, [*keys, "_chunk"])
    out = [(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in totals]
    return joined.select(*df.columns, *out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, the same values as ``percentile``; nulls and NaN are left out."""
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    counts = good.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = running_before(counts, keys, [F.col("_v")], magnitude_chunk(F.col("_v")), {"_before": "_c"})
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        placed = null_safe_join(placed, sizes, keys)
    else:
        placed = with_row(placed, sizes)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")), F.col("_v")))

    ends, out = [], []
    for name, share in wanted.items():
        spot = (F.col("_n") - 1) * F.lit(share)
        ends += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}")]
        frac = F.col("_n1") * F.lit(share) - F.floor(F.col("_n1") * F.lit(share))
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).alias(name))
    return placed.groupBy(*keys).agg(F.max(F.col("_n") - 1).alias("_n1"), *ends).select(*keys, *out)
