"""Grouping of repeated detections by position.

The sequential rule: in arrival order a detection joins the earliest group whose first position lies within the
tolerance, else it starts a group. Run in parallel this way: the plane is cut into cells so small that two positions in
one cell always match. A cell then founds at most one group, and only its earliest open position can be the founder.
Each round settles, block by block, every candidate whose earlier neighbours are settled too, removes what the new founders cover, and repeats; a
block is some minutes of arc wide, so rounds count the blocks that a chain of neighbours crosses, not its links. All positions of one object collapse to one candidate before any shuffle,
so a very popular object costs no more than a rare one, and pairs of detections are never formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.functions import coords
from skytable.operators.ranking import arrival_rank, renumber
from skytable.operators.scalars import with_row
from skytable.session import cut_lineage

REACH = 2
BLOCK_CELLS = 16
# Cells along a side of the blocks that one round settles, and candidates of a cell that it sees.
SETTLE_CELLS = 512
CANDIDATES = 4
# Rows that are settled in one call, on average: the blocks of a thin field share calls.
CALL_ROWS = 50_000
# So many rows, of 24 bytes, may be broadcast.
FEW_ROWS = 100_000
# Width, in distances, of the cells of lookups and batches.
WIDE = 16
WHOLE_CIRCLE = 360.0
CELL = ["level", "cu", "cv"]
BLOCK = ["level", "gu", "gv"]


def _on_ring(u: Column, ring: Column) -> Column:
    return F.when(ring > 0, F.pmod(u, ring)).otherwise(u)


def _block(c: Column) -> Column:
    return F.floor(c / BLOCK_CELLS).cast("bigint")


def _to_blocks(df: DataFrame) -> DataFrame:
    """One row per block of cells that has a cell within reach: mostly one, at most four."""
    u, v, ring = F.col("cu"), F.col("cv"), F.col("ring")
    across = F.array_distinct(F.array(_block(_on_ring(u - REACH, ring)), _block(_on_ring(u, ring)), _block(_on_ring(u + REACH, ring))))
    along = F.array_distinct(F.array(_block(v - REACH), _block(v + REACH)))
    return df.withColumn("gu", F.explode(across)).withColumn("gv", F.explode(along))


def _by_block(df: DataFrame, shown: list[str]) -> DataFrame:
    """Per block the rows that reach into it. The input has one row per cell and kind, so a list is bounded by the
    cells of a block."""
    return _to_blocks(df).groupBy(*BLOCK).agg(F.collect_list(F.struct("seq", *shown, "cu", "cv")).alias("near"))


def _seen_from(items: DataFrame, grids: Column) -> DataFrame:
    """One row per grid in use, with the item's cell on that grid. ``grids``: array of (level, cu, cv, ring) structs."""
    kept = [c for c in items.columns if c not in (*CELL, "ring")]
    out = items.withColumn("_grid", F.explode(grids)).select(*kept, "_grid.level", "_grid.cu", "_grid.cv", "_grid.ring")
    return out.withColumn("gu", _block(F.col("cu"))).withColumn("gv", _block(F.col("cv")))


def _cell_in_reach(f: Column) -> Column:
    gap = F.abs(f["cu"] - F.col("cu"))
    gap = F.when(F.col("ring") > 0, F.least(gap, F.col("ring") - gap)).otherwise(gap)
    return (gap <= REACH) & (F.abs(f["cv"] - F.col("cv")) <= REACH)


def _settle(blocks: pa.Table, tolerance: float) -> pa.Table:
    """The own candidates of some blocks with their groups' first positions, null where an earlier neighbour is open. ``by_open`` is true for all
    rows in reach of a row that may be open after the round: an unsettled one, one after the last of its cell, or one of another block."""
    got = {c: blocks[c].to_numpy(zero_copy_only=False) for c in ("_bu", "_bv", "seq", "ra", "dec", "cu", "cv", "own", "last")}
    place, width = _numbered_cells(got)
    first = _settle_clusters(got, place, width, tolerance)
    slow = np.flatnonzero(first < -1)
    rows: dict[tuple[int, int], list[tuple]] = {}
    for at, bu, bv, *row in zip(slow.tolist(), *[got[c][slow].tolist() for c in got], strict=True):
        rows.setdefault((bu, bv), []).append((*row, at))
    first[slow] = -1
    for block in rows.values():
        for at, home in _settle_block(block, tolerance):
            first[at] = home
    steps = np.array([du * width + dv for du in range(-REACH, REACH + 1) for dv in range(-REACH, REACH + 1)])
    may_open = ~got["own"].astype(bool) | got["last"].astype(bool) | (first < 0)
    by_open = np.isin(place, np.unique(np.unique(place[may_open])[:, None] + steps))
    own = np.flatnonzero(got["own"])
    home, known = first[own], first[own] >= 0
    columns = {c: pa.array(got[c][own]) for c in ("seq", "ra", "dec", "cu", "cv", "last")}
    columns |= {f"home_{c}": pa.array(got[c][np.maximum(home, 0)], mask=~known) for c in ("seq", "ra", "dec")}
    return pa.table(columns | {"by_open": pa.array(by_open[own])})


def _numbered_cells(got: dict[str, np.ndarray]) -> tuple[np.ndarray, int]:
    """A number for the block and cell of each row, and the difference between cells side by side along the first axis."""
    pad = 2 * REACH
    width = SETTLE_CELLS + 2 * REACH + 2 * pad
    block = np.unique((got["_bu"] << 32) + got["_bv"], return_inverse=True)[1]
    across, along = got["cu"] - got["_bu"] * SETTLE_CELLS + pad, got["cv"] - got["_bv"] * SETTLE_CELLS + pad
    return (block * width + across) * width + along, width


def _settle_clusters(got: dict[str, np.ndarray], place: np.ndarray, width: int, tolerance: float) -> np.ndarray:
    """For each row the row that founds its group: where a cluster of cells in reach of each other belongs to the block as a whole and its earliest row
    matches all others; -2 elsewhere."""
    cells, cell = np.unique(place, return_inverse=True)
    pairs = []
    for step in [du * width + dv for du in range(REACH + 1) for dv in range(-REACH, REACH + 1) if (du, dv) > (0, 0)]:
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        hit = np.flatnonzero(cells[at] == cells + step)
        pairs.append((hit, at[hit]))
    one, other = (np.concatenate(p) for p in zip(*pairs, strict=True))
    label = np.arange(len(cells))
    while True:
        least = label.copy()
        np.minimum.at(least, one, label[other])
        np.minimum.at(least, other, label[one])
        least = least[least]
        if (least == label).all():
            break
        label = least
    cluster = label[cell]
    order = np.lexsort((got["seq"], cluster))
    starts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]))
    dra, ddec = got["ra"] - got["ra"][first], got["dec"] - got["dec"][first]
    scaled = dra * np.cos(np.radians((got["dec"] + got["dec"][first]) / 2.0))
    near = (np.abs(dra) <= tolerance) & (np.abs(ddec) <= tolerance) & (np.sqrt(scaled * scaled + ddec * ddec) <= tolerance)
    good = near & got["own"].astype(bool) & ~got["last"].astype(bool)
    bad = np.zeros(len(cells), dtype=bool)
    bad[cluster[~good]] = True
    first[bad[cluster]] = -2
    return first


def _settle_block(rows: list[tuple], tolerance: float) -> list[tuple[int, int]]:
    """Candidates (seq, ra, dec, cu, cv, own, last, at) of one block by the sequential rule: (at, the founder's at) of those that are settled.

    A candidate is settled if nothing earlier within reach is open: rows of the border belong to other blocks and stay open, and
    so does a cell after the last of its candidates that was sent.
    """
    founders: dict[tuple[int, int], tuple[int, int, float, float]] = {}
    open_from: dict[tuple[int, int], int] = {}
    settled = []
    steps = [(du, dv) for du in range(-REACH, REACH + 1) for dv in range(-REACH, REACH + 1)]
    for seq, ra, dec, u, v, own, last, at in sorted(rows):
        around = [(u + du, v + dv) for du, dv in steps] if founders or open_from else []
        is_open = not own or any(open_from.get(c, seq) < seq for c in around)
        if not is_open:
            near = [founders[c] for c in around if c in founders]
            home = min((f[:2] for f in near if _flat_match(ra, dec, f[2], f[3], tolerance)), default=(seq, at))
            if home[1] == at:
                founders[u, v] = (seq, at, ra, dec)
            settled.append((at, home[1]))
        if is_open or (last and (u, v) not in founders):
            open_from.setdefault((u, v), seq)
    return settled


def _flat_match(ra1: float, dec1: float, ra2: float, dec2: float, tolerance: float) -> bool:
    """The rule of ``coords.flat_match`` for two positions."""
    dra, ddec = ra1 - ra2, dec1 - dec2
    scaled = dra * math.cos(math.radians((dec1 + dec2) / 2.0))
    return abs(dra) <= tolerance and abs(ddec) <= tolerance and math.sqrt(scaled * scaled + ddec * ddec) <= tolerance


def _founders(open_rows: DataFrame, tolerance: float) -> DataFrame:
    """Candidates on the flat plane with the homes that one round settles; a block holds at most ``CANDIDATES`` rows for each of its cells."""
    order = W.partitionBy("cu", "cv").orderBy("seq")
    # The rank limit is applied before the shuffle too, so a crowded cell sends a few rows from each task.
    first = open_rows.select("seq", "ra", "dec", "cu", "cv").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= CANDIDATES)
    first = first.withColumn("last", F.col("_n") == CANDIDATES).drop("_n")
    side = lambda c: F.floor(c / SETTLE_CELLS).cast("bigint")
    sides = lambda c: F.array_distinct(F.array(side(F.col(c)), side(F.col(c) - REACH), side(F.col(c) + REACH)))
    sent = first.withColumn("_bu", F.explode(sides("cu"))).withColumn("_bv", F.explode(sides("cv")))
    sent = sent.withColumn("own", (F.col("_bu") == side(F.col("cu"))) & (F.col("_bv") == side(F.col("cv"))))
    calls = 1 + open_rows.count() // CALL_ROWS
    sent = sent.withColumn("_call", F.pmod(F.xxhash64("_bu", "_bv"), F.lit(calls)))
    shape = "seq bigint, ra double, dec double, cu bigint, cv bigint, last boolean, home_seq bigint, home_ra double, home_dec double, by_open boolean"
    return sent.groupBy("_call").applyInArrow(lambda blocks: _settle(blocks, tolerance), shape)


def _near_founders(rows: DataFrame, n: int, founders: DataFrame) -> DataFrame:
    """The ``n`` rows with the list of founders in the cells around; only blocks of the rows are read."""
    placed = rows.withColumn("gu", _block(F.col("cu"))).withColumn("gv", _block(F.col("cv")))
    blocks = placed.select(*BLOCK).distinct()
    # Few rows are open after a round, and their blocks spare a shuffle of all founders.
    blocks = F.broadcast(blocks) if n <= FEW_ROWS else blocks.hint("merge")
    sent = _to_blocks(founders.select(*CELL, "ring", "seq", "ra", "dec")).join(blocks, BLOCK, "left_semi")
    near = sent.groupBy(*BLOCK).agg(F.collect_list(F.struct("seq", "ra", "dec")).alias("near"))
    return placed.join(near.hint("merge"), BLOCK, "left").drop("gu", "gv")


def flat_groups(items: DataFrame, match: Callable[[Column], Column], tolerance: float) -> DataFrame:
    """The sequential rule on the flat plane: (ra, dec, group_seq, group_ra, group_dec) per item.

    ``items``: unique ``seq``, finite (ra, dec), cell (level, cu, cv) and ``ring``; a written table. ``match`` is the flat match within ``tolerance`` degrees.
    A round settles whole blocks and tells the homes of nearly all of their items; what it leaves meets the round's founders in a join: a covered item waits
    for the end, when all founders are known, the others form the next round.
    """
    told, founders, waiting, late_rows, open_rows = [], [], [], 0, items
    fixed = items.select("level", "ring").schema
    plane = lambda df: df.withColumn("level", F.lit(0).cast(fixed["level"].dataType)).withColumn("ring", F.lit(0).cast(fixed["ring"].dataType))
    shown = ["seq", "ra", "dec", "cu", "cv", "level", "ring"]
    hit = F.coalesce(F.exists("near", match), F.lit(False))
    while True:
        seen = plane(cut_lineage(_founders(open_rows, tolerance)))
        known = seen.filter("home_seq is not null")
        told.append(known)
        # What waits was open in the first round, so of its many founders only those near open rows are asked again.
        founders.append(known.filter("seq = home_seq" if founders else "seq = home_seq and by_open"))
        rest = seen.filter("home_seq is null").select(*shown)
        full = seen.filter("last").select("cu", "cv", F.col("seq").alias("_last"))
        if not full.isEmpty():
            # Items of a crowded cell after the ones that were sent.
            rest = rest.unionByName(open_rows.join(full, ["cu", "cv"]).filter("seq > _last").select(*shown))
        rest = cut_lineage(rest)
        left = rest.count()
        if left == 0:
            break
        if known.isEmpty():
            raise RuntimeError("a round of grouping settled nothing")
        late_rows += left
        rest = cut_lineage(_near_founders(rest, left, founders[-1]).withColumn("covered", hit).drop("near"))
        waiting.append(rest.filter("covered").drop("covered"))
        open_rows = rest.filter("not covered").drop("covered")
        if open_rows.isEmpty():
            break
    out = ["ra", "dec", *[F.col(f"home_{c}").alias(f"group_{c}") for c in ("seq", "ra", "dec")]]
    every = reduce(DataFrame.unionByName, told)
    if not waiting:
        return every.select(*out)
    # Structs order by their first field, so the least one is the earliest founder.
    late = _near_founders(reduce(DataFrame.unionByName, waiting), late_rows, reduce(DataFrame.unionByName, founders)).withColumn("home", F.array_min(F.filter("near", match)))
    late = late.select("ra", "dec", *[F.col(f"home.{c}").alias(f"group_{c}") for c in ("seq", "ra", "dec")])
    return every.select(*out).unionByName(late)


def first_come_groups(items: DataFrame, grids: list[Column], shown: list[str], match: Callable[[Column], Column]) -> DataFrame:
    """The sequential rule in parallel rounds: the ``shown`` columns and ``group_seq``, the number of the group's first item, per item.

    ``items``: unique ``seq``, own cell (level, cu, cv), ``kind`` so that items of one cell and kind always match,
    ``ring`` (cells around the circle, 0 without wrap), and the ``shown`` columns that ``match`` reads; a written table,
    as every round reads it. A match lies within two cells. ``grids``: the item's cell on each grid in use. Positions must be finite.
    """
    views = F.array(*grids)
    one_grid = len(grids) == 1
    founders, told = [], []
    open_rows = items
    while True:
        first = open_rows.groupBy(*CELL, "ring", "kind").agg(F.min(F.struct("seq", *shown)).alias("c"))
        first = first.select(*CELL, "ring", "kind", "c.*")
        seen = _seen_from(first, views).join(_by_block(first, []), BLOCK)
        seen = seen.withColumn("earliest", F.array_min(F.transform(F.filter("near", _cell_in_reach), lambda f: f["seq"])))
        if one_grid:
            sure = seen.filter("seq = earliest").select(*first.columns)
        else:
            calm = seen.groupBy("seq").agg(F.min("earliest").alias("earliest")).filter("seq = earliest").select("seq")
            sure = first.join(calm, "seq", "left_semi")
        sure = cut_lineage(sure)
        if one_grid:
            founders.append(sure)
            covered, open_rows = _next_round(sure, open_rows, views, shown, match)
            told.append(covered)
        else:
            if sure.isEmpty() and not open_rows.isEmpty():
                raise RuntimeError("a round of grouping settled nothing")
            founders.append(sure)
            near = _by_block(sure, shown)
            hit = F.coalesce(F.exists("near", match), F.lit(False))
            covered = _seen_from(open_rows, views).join(near, BLOCK).filter(hit).select("seq").distinct()
            open_rows = cut_lineage(open_rows.join(covered, "seq", "left_anti"))
        if open_rows.isEmpty():
            break
    # Structs order by their first field, so the least one is the earliest founder.
    home = F.array_min(F.filter("near", match))["seq"]
    if one_grid:
        every = reduce(DataFrame.unionByName, told)
        if len(told) == 1:
            return every.select(*shown, "group_seq")
        # A row that a round covers may still lie in reach of an earlier founder that a later round finds.
        later = _by_block(reduce(DataFrame.unionByName, founders[1:]), shown)
        return _seen_from(every, views).join(later, BLOCK, "left").select(*shown, F.least("group_seq", home).alias("group_seq"))
    placed = _seen_from(items, views).join(_by_block(reduce(DataFrame.unionByName, founders), shown), BLOCK).select("seq", home.alias("group_seq"))
    homes = placed.filter("group_seq is not null").groupBy("seq").agg(F.min("group_seq").alias("group_seq"))
    return items.join(homes, "seq").select(*shown, "group_seq")


def _next_round(sure: DataFrame, open_rows: DataFrame, views: Column, shown: list[str], match) -> tuple[DataFrame, DataFrame]:
    """The rows that the new founders cover, each with the earliest of them as ``group_seq``, and the rows that stay open: one join, written once."""
    if sure.isEmpty() and not open_rows.isEmpty():
        raise RuntimeError("a round of grouping settled nothing")
    home = F.array_min(F.filter("near", match))["seq"]
    kept = [c for c in open_rows.columns if c != "group_seq"]
    met = _seen_from(open_rows, views).join(_by_block(sure, shown), BLOCK, "left").select(*kept, home.alias("group_seq"))
    met = cut_lineage(met)
    return met.filter("group_seq is not null"), met.filter("group_seq is null").drop("group_seq")


def _finite(*columns: str) -> Column:
    """Whether all columns hold a number that is neither NaN nor infinite."""
    good = F.lit(True)
    for c in columns:
        value = F.col(c).cast("double")
        good = good & F.coalesce((F.abs(value) < F.lit(float("inf"))) & ~F.isnan(value), F.lit(False))
    return good


def group_detections(detections: DataFrame, arcsec: float = 1.0) -> DataFrame:
    """Adds (group_seq, group_ra, group_dec), the arrival number and position of the group's first detection.

    ``detections`` needs a unique integer ``seq`` and (ra, dec); rows without a finite position come back with a null group. Runs
    a few rounds of jobs with checkpoints.
    """
    return _with_groups(detections, _placed(detections, arcsec))


def _placed(detections: DataFrame, arcsec: float) -> DataFrame:
    """(ra, dec, group_seq, group_ra, group_dec) of every finite position of the detections (seq, ra, dec)."""
    detections = detections.filter(_finite("ra", "dec"))
    side = arcsec / coords.ARCSEC / math.sqrt(2.0) * (1 - 1e-9)
    positions = (
        detections.groupBy("ra", "dec")
        .agg(F.min("seq").alias("seq"))
        .withColumn("level", F.lit(0))
        .withColumn("cu", F.floor(F.col("ra") / side).cast("bigint"))
        .withColumn("cv", F.floor(F.col("dec") / side).cast("bigint"))
        .withColumn("ring", F.lit(0).cast("bigint"))
    )
    positions = cut_lineage(positions)
    match = lambda f: coords.flat_match(F.col("ra"), F.col("dec"), f["ra"], f["dec"], arcsec)
    return flat_groups(positions, match, arcsec / coords.ARCSEC)


def _with_groups(whole: DataFrame, placed: DataFrame) -> DataFrame:
    """The detections with their positions' groups, null where a position is not finite."""
    detections, without = whole.filter(_finite("ra", "dec")), whole.filter(~_finite("ra", "dec"))
    none = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("group_seq", "group_ra", "group_dec")]
    return detections.join(placed, ["ra", "dec"]).select(*whole.columns, "group_seq", "group_ra", "group_dec").unionByName(without.select("*", *none))


def group_by_footprint(detections: DataFrame, size_fraction: float = 0.5, size_floor: float = 1.0) -> DataFrame:
    """In arrival order a detection joins the first group whose footprint contains it and whose size is similar.

    ``detections``: unique ``seq``, (ra, dec), half sides ``half_ra``, ``half_dec`` of the footprint in degrees (below
    16, larger ones stop the job with an error) and ``size`` in arcsec, which may be null. RA wraps. Adds ``group_seq``, null for rows without a
    finite position and positive half sides. A footprint's grid is the largest
    power of two that fits its half sides, so one cell and size class holds one group at most.
    """
    usable = _finite("ra", "dec", "half_ra", "half_dec") & (F.col("half_ra") > 0) & (F.col("half_dec") > 0)
    whole, detections = detections, detections.filter(usable)
    same = ["ra", "dec", "half_ra", "half_dec", "size"]
    power = lambda c: F.floor(F.log2(F.col(c))).cast("int")
    checked = F.when((F.col("half_ra") < 16) & (F.col("half_dec") < 16), power("half_ra")).otherwise(
        F.raise_error(F.lit("footprints must be smaller than 16 degrees")).cast("int")
    )
    size_class = F.floor(F.log(F.col("size")) / math.log(1.0 + size_fraction * (1 - 1e-9))).cast("bigint")

    def cell(lx: Column, ly: Column) -> tuple[Column, Column]:
        return (
            F.floor(F.pmod(F.col("ra"), F.lit(WHOLE_CIRCLE)) * F.pow(F.lit(2.0), -lx)).cast("bigint"),
            F.floor(F.col("dec") * F.pow(F.lit(2.0), -ly)).cast("bigint"),
        )

    # Copies in every respect share their fate; the first stands for all.
    items = detections.groupBy(*same).agg(F.min("seq").alias("seq")).withColumn("_lx", checked).withColumn("_ly", power("half_dec"))
    # A power of two below 16 degrees divides the circle, so the ring has a whole number of cells.
    items = (
        items.withColumn("level", F.struct(F.col("_lx").alias("lx"), F.col("_ly").alias("ly")))
        .withColumn("cu", cell(F.col("_lx"), F.col("_ly"))[0])
        .withColumn("cv", cell(F.col("_lx"), F.col("_ly"))[1])
        .withColumn("ring", (F.lit(WHOLE_CIRCLE) * F.pow(F.lit(2.0), -F.col("_lx"))).cast("bigint"))
        .withColumn("kind", F.coalesce(F.when(F.col("size") > 0, size_class), F.lit(-(1 << 40)).cast("bigint")))
        .drop("_lx", "_ly")
    )
    items = cut_lineage(items)
    # Powers of two of plausible half sides: a handful of rows whatever the table holds.
    used = [(r[0], r[1]) for r in items.select("level.lx", "level.ly").distinct().collect()]
    grids = [
        F.struct(
            F.struct(F.lit(lx).alias("lx"), F.lit(ly).alias("ly")).alias("level"),
            cell(F.lit(lx), F.lit(ly))[0].alias("cu"),
            cell(F.lit(lx), F.lit(ly))[1].alias("cv"),
            F.lit(int(WHOLE_CIRCLE * 2.0**-lx)).cast("bigint").alias("ring"),
        )
        for lx, ly in used
    ]

    def match(f: Column) -> Column:
        gap = F.abs(F.pmod(F.col("ra") - f["ra"] + 180.0, F.lit(WHOLE_CIRCLE)) - 180.0)
        inside = (gap <= f["half_ra"]) & (F.abs(F.col("dec") - f["dec"]) <= f["half_dec"])
        return (f["seq"] <= F.col("seq")) & inside & coords.similar_size(f["size"], F.col("size"), size_fraction, size_floor)

    placed = first_come_groups(items, grids, same, match)
    keys = [detections[c].eqNullSafe(placed[c]) for c in same]
    grouped = detections.join(placed, keys).select(*[detections[c] for c in detections.columns], "group_seq")
    return grouped.unionByName(whole.filter(~usable).withColumn("group_seq", F.lit(None).cast("bigint")))


def with_group_ids(grouped: DataFrame) -> DataFrame:
    """Adds ``group_id``: 1, 2, ... in order of first arrival, null for rows without a group. Writes the input once, as it is read twice."""
    grouped = cut_lineage(grouped)
    ids = renumber(grouped.filter("group_seq is not null").select("group_seq").distinct(), [F.col("group_seq")], "group_id")
    return grouped.join(ids.withColumn("group_id", F.col("group_id") + 1), "group_seq", "left")


def group_summary(grouped: DataFrame) -> DataFrame:
    """One row per group with its first position and largest crop sides."""
    return grouped.groupBy("group_seq").agg(
        F.min("group_ra").alias("ra"),
        F.min("group_dec").alias("dec"),
        F.max("height").alias("max_height"),
        F.max("width").alias("max_width"),
    )


def raise_group_size(groups: DataFrame, larger: DataFrame) -> DataFrame:
    """Raise the recorded sides where larger crops were found."""
    top = larger.groupBy("group_seq").agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    return (
        groups.join(top, "group_seq", "left")
        .withColumn("max_height", F.greatest("max_height", "_h"))
        .withColumn("max_width", F.greatest("max_width", "_w"))
        .drop("_h", "_w")
    )


def group_instances(grouped: DataFrame) -> DataFrame:
    """Every detection with its running number (version) in its group. Writes the input once, as it is read twice."""
    return arrival_rank(cut_lineage(grouped), ["group_seq"], "seq", "version")


def instance_of(versions: DataFrame, lookups: DataFrame, tolerance_deg: float = 0.5 / 3600.0) -> DataFrame:
    """E1 lookup: for (lookup_id, ra, dec, file) the group whose first position is within the box, and the first
    instance of that file in it. Boxes are matched through cells several times as wide as the tolerance, so most lookups meet one cell.
    ``versions`` is read twice: a written table is best."""
    side = tolerance_deg * WIDE
    cell = lambda c: F.floor(c / side).cast("bigint")
    both = lambda c: F.explode(F.array_distinct(F.array(cell(F.col(c) - tolerance_deg * (1 + 1e-9)), cell(F.col(c) + tolerance_deg * (1 + 1e-9)))))
    groups = versions.select("group_seq", "group_ra", "group_dec").distinct()
    groups = groups.withColumn("cu", cell(F.col("group_ra"))).withColumn("cv", cell(F.col("group_dec")))
    asked = lookups.withColumn("cu", both("ra")).withColumn("cv", both("dec"))
    near = (F.abs(F.col("group_ra") - F.col("ra")) < tolerance_deg) & (F.abs(F.col("group_dec") - F.col("dec")) < tolerance_deg)
    hit = asked.join(groups.hint("merge"), ["cu", "cv"]).filter(near)
    one = hit.groupBy("lookup_id", "file").agg(F.min(F.struct("group_seq", "group_ra", "group_dec")).alias("g")).select(
        "lookup_id", "file", "g.*"
    )
    firsts = versions.groupBy("group_seq", "file").agg(F.min("version").alias("version"))
    return one.join(firsts, ["group_seq", "file"])


def store_statistics(grouped: DataFrame) -> DataFrame:
    """Totals over all groups; the ratio is 0 for an empty store. Writes the three columns it counts once: each count of different values is an
    aggregate of its own, as several in one would copy every row for each of them."""
    rows = cut_lineage(grouped.select("group_seq", "file", "band"))
    totals = rows.agg(F.countDistinct("group_seq").alias("total_groups"), F.count("*").alias("total_instances"))
    for column, name in (("file", "files_processed"), ("band", "unique_bands")):
        totals = with_row(totals, rows.select(column).distinct().agg(F.count(column).alias(name)))
    ratio = F.when(F.col("total_groups") > 0, F.col("total_instances") / F.col("total_groups")).otherwise(F.lit(0.0))
    return totals.withColumn("instances_per_group", ratio)


def attach_batch(known: DataFrame, batch: DataFrame, arcsec: float = 1.0) -> DataFrame:
    """Batch of a growing store: detections join known groups first, the rest form new ones.

    ``known``: (group_seq, group_ra, group_dec). Feeding the known founders with their arrival numbers, which are lower
    than the batch's, makes them win exactly as in one long run. Only founders near the batch enter.
    """
    # A flat match bounds both differences, so a founder in reach lies in a cell that the box around a position touches.
    reach = arcsec / coords.ARCSEC * (1 + 1e-9)
    cell = lambda c: F.floor(c / (reach * WIDE))
    cells = lambda df, ra, dec: df.withColumn("_u", cell(F.col(ra))).withColumn("_v", cell(F.col(dec)))
    both = lambda c: F.explode(F.array_distinct(F.array(cell(F.col(c) - reach), cell(F.col(c) + reach))))
    reached = batch.select(both("ra").alias("_u"), "dec").select("_u", both("dec").alias("_v"))
    near = cells(known, "group_ra", "group_dec").join(reached.distinct().hint("merge"), ["_u", "_v"], "left_semi")
    old = near.select(F.col("group_seq").alias("seq"), F.col("group_ra").alias("ra"), F.col("group_dec").alias("dec"))
    # The founders only take part in the grouping; the batch alone is joined with what it told.
    return _with_groups(batch, _placed(batch.select("seq", "ra", "dec").unionByName(old), arcsec))
