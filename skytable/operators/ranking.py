"""Ranks, keep-first and numbering that survive a hot key.

A plain window puts a whole key into one task. Here each key is first cut into chunks that follow the wanted order;
a window ranks inside a chunk, and the small table of chunk counts supplies how many rows come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.operators.scalars import null_safe_join
from skytable.session import cut_lineage

CHUNK_ROWS = 1 << 20
HASH_BITS = 14


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``. An aggregate, so copies collapse before the shuffle."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row")).select("_row.*")


def rank_in_chunks(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str) -> DataFrame:
    """1-based rank per key in ``order``; ``chunk`` must never decrease along ``order``; null is a key like any other."""
    tagged = df.withColumn("_chunk", chunk)
    sizes = tagged.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Chunks after the first of their key get one more row, ahead of the others, with the count to start from: no join with the rows.
    both = tagged.withColumn("_before", F.lit(None).cast("bigint")).unionByName(offsets.filter("_before > 0"), allowMissingColumns=True)
    so_far = W.partitionBy(*keys, "_chunk").orderBy(F.col("_before").isNotNull().desc(), *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # The rank has its own name from the start: callers ask for "_rank", which a helper column of that name would take with it.
    ranked = both.withColumn(name, F.sum(F.coalesce("_before", F.lit(1).cast("bigint"))).over(so_far)).filter("_before is null")
    return ranked.drop("_chunk", "_before")


def arrival_chunk(seq: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk for an integer arrival order."""
    return F.floor(F.col(seq) / rows)


def arrival_rank(df: DataFrame, keys: list[str], seq: str, name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Running count per key in arrival order."""
    return rank_in_chunks(df, keys, [F.col(seq)], arrival_chunk(seq, rows), name)


def seeded_order(ids: list[str], seed: int) -> Column:
    """Repeatable shuffle key: a hash of the row's identity and the seed."""
    return F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))


def random_rank(df: DataFrame, keys: list[str], ids: list[str], seed: int, name: str, bits: int = HASH_BITS) -> DataFrame:
    """1-based rank per key in shuffled order. The top bits of the hash are the chunk, so few huge keys still spread."""
    tagged = df.withColumn("_hash", seeded_order(ids, seed))
    order = [F.col("_hash"), *[F.col(i) for i in ids]]
    return rank_in_chunks(tagged, keys, order, F.shiftright(F.col("_hash"), 64 - bits), name).drop("_hash")


def renumber(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense 0-based number in a total order. Writes the sorted rows once to the checkpoint folder.

    Rows equal in ``order`` are told apart by where they were read, so that a mass of equal rows still spreads over tasks.
    """
    told = df.withColumn("_read", F.monotonically_increasing_id())
    placed = cut_lineage(told.orderBy(*order, "_read").drop("_read").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort, so the window over all of them is small.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    return numbered.withColumn(name, F.col("_before") + local).drop("_part", "_at", "_before")


def next_versions(new: DataFrame, existing: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Version of each new row = highest existing version of its key + its place among the new rows; gaps stay."""
    top = existing.groupBy(*keys).agg(F.max("version").alias("_top"))
    ranked = arrival_rank(new, keys, seq, "_place")
    joined = null_safe_join(ranked, top, keys, "left")
    return joined.withColumn("version", F.coalesce("_top", F.lit(0)) + F.col("_place")).drop("_top", "_place")


def largest_crop(df: DataFrame) -> DataFrame:
    """Per file and six-decimal position the largest crop, the earlier one on a tie."""
    from skytable.functions.coords import grid_key

    keyed = df.withColumn("_kr", grid_key(F.col("ra"), 6)).withColumn("_kd", grid_key(F.col("dec"), 6))
    order = [-(F.col("height") * F.col("width")), F.col("seq")]
    return first_per_key(keyed, ["file", "_kr", "_kd"], order).drop("_kr", "_kd")


# Preference order of product file suffixes.
SUFFIX_PRIORITY = ["_drc.fits", "_drz.fits", "_flc.fits", "_flt.fits"]


def product_rank(file_name: Column, level: Column) -> Column:
    """E5: sortable rank by suffix, level 3 first, wanted filter first, mosaics last, then name."""
    low = F.lower(file_name)
    suffix = F.lit(len(SUFFIX_PRIORITY))
    for place, ending in reversed(list(enumerate(SUFFIX_PRIORITY))):
        suffix = F.when(low.endswith(ending), place).otherwise(suffix)
    mosaic = low.contains("skycell") | low.contains("_all_") | low.contains("_total_")
    return F.struct(
        suffix.alias("suffix_rank"),
        F.when(level == 3, 0).otherwise(1).alias("level_rank"),
        F.when(low.contains("_f814w_"), 0).otherwise(1).alias("filter_rank"),
        F.when(mosaic, 1).otherwise(0).alias("mosaic_rank"),
        file_name.alias("name_rank"),
    )


def mosaic_product_rank(file_name: Column, obs_id: Column) -> Column:
    """E5, second archive: the exact product of the observation, then full mosaics before detector parts, then name."""
    return F.struct(
        (file_name != F.concat(obs_id, F.lit("_i2d.fits"))).cast("int").alias("other_name"),
        F.lower(file_name).contains("_nrc").cast("int").alias("detector_part"),
        file_name.alias("name_rank"),
    )


def capped_sample(df: DataFrame, group: list[str], file: str, ids: list[str], per_file: int, per_group: int, seed: int) -> DataFrame:
    """At most ``per_file`` random rows of a file and ``per_group`` of a group."""
    a = random_rank(df, [*group, file], ids, seed, "_in_file").filter(F.col("_in_file") <= per_file).drop("_in_file")
    return random_rank(a, group, ids, seed + 1, "_in_group").filter(F.col("_in_group") <= per_group).drop("_in_group")
