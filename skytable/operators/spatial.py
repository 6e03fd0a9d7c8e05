"""Sky joins.

A join within a distance becomes an equi-join on grid cells. Dense cells are the danger: a cell that holds a third of
a catalog would pair everything with everything. So equal positions collapse first, and a cell with many distinct
positions is split into sub-cells until each holds few. A left row walks down from its cell to sub-cells and drops
those that cannot hold its answer, so the work per left row stays small however dense the field is.

Cells are several times as wide as the distance, so most left rows meet one cell and are shuffled once. Joins of positions ask for a merge:
by the size of its file a catalog of a million rows counts as small enough for a broadcast, which the driver would have to hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.functions import coords
from skytable.session import cut_lineage

LEAF_POSITIONS = 256
SPLIT = 8
MAX_LEVELS = 12
SLACK = 1e-9
# Width of a cell in distances. A wide one copies fewer left rows to its neighbours (1 + 2 / width an axis), a narrow one compares fewer pairs; a cone
# search wants all pairs within its distance, so its cells are narrower.
MATCH_WIDTH = 16
CONE_WIDTH = 4


def _cell(axis: Column, size: float, level: int) -> Column:
    return F.floor(axis * (float(SPLIT**level) / size)).cast("bigint")


def _cells(axes: list[str], size: float, level: int) -> list[Column]:
    return [_cell(F.col(a), size, level).alias(f"c{i}") for i, a in enumerate(axes)]


def _parents(n: int) -> list[Column]:
    return [F.floor(F.col(f"c{i}") / SPLIT).cast("bigint").alias(f"p{i}") for i in range(n)]


def split_dense_cells(points: DataFrame, axes: list[str], size: float, leaf: int = LEAF_POSITIONS):
    """Cells per level with extent and row count, and each point with its leaf cell.

    Starts one small job per level (the largest cell count), normally just one: further levels exist only where cells
    hold more than ``leaf`` distinct positions.
    """
    keys = [f"c{i}" for i in range(len(axes))]
    extent = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    nodes, leaves = [], []
    rest = points
    for level in range(MAX_LEVELS + 1):
        placed = rest.select(*rest.columns, *_cells(axes, size, level))
        node = placed.groupBy(*keys).agg(F.count("*").alias("n"), *extent)
        last = level == MAX_LEVELS
        node = node.withColumn("is_leaf", F.lit(True) if last else F.col("n") <= leaf)
        nodes.append(node)
        largest = None if last else node.agg(F.max("n")).first()[0]
        if last or largest is None or largest <= leaf:
            leaves.append((level, placed))
            break
        light = node.filter("is_leaf").select(*keys)
        leaves.append((level, placed.join(light, keys, "left_semi")))
        heavy = node.filter("not is_leaf").select(*keys)
        rest = cut_lineage(placed.join(heavy, keys, "left_semi").drop(*keys))
    return nodes, leaves


def _cells_in_reach(df: DataFrame, axes: list[str], size: float, reach: float) -> DataFrame:
    """One row per top-level cell within ``reach`` (at most half of ``size``) on each axis: mostly one."""
    out = df
    for i, a in enumerate(axes):
        out = out.withColumn(f"c{i}", F.explode(F.array_distinct(F.array(_cell(F.col(a) - reach, size, 0), _cell(F.col(a) + reach, size, 0)))))
    return out


def _box_distance(axes: list[str], prefix: str) -> tuple[Column, Column]:
    """Nearest and farthest distance from a point to the extent of a cell."""
    low, high = [], []
    for a in axes:
        p, lo, hi = F.col(f"{prefix}{a}"), F.col(f"lo_{a}"), F.col(f"hi_{a}")
        gap = F.greatest(lo - p, p - hi, F.lit(0.0))
        far = F.greatest(F.abs(p - lo), F.abs(p - hi))
        low.append(gap * gap)
        high.append(far * far)
    total = lambda cols: F.sqrt(reduce(lambda x, y: x + y, cols))
    return total(low), total(high)


def nearest_pairs(left: DataFrame, right: DataFrame, arcsec: float, leaf: int = LEAF_POSITIONS) -> DataFrame:
    """Nearest right row of each distinct left position, kept within ``arcsec``.

    ``left`` needs (ra, dec), ``right`` (id, ra, dec). Ties go to the lowest right id. Starts the small jobs of
    :func:`split_dense_cells`.
    """
    axes = ["x", "y", "z"]
    reach = coords.chord(arcsec) * (1 + SLACK)
    size = reach * MATCH_WIDTH

    def on_sphere(df: DataFrame) -> DataFrame:
        for name, col in zip(axes, coords.unit_vector(F.col("ra"), F.col("dec"))):
            df = df.withColumn(name, col)
        return df

    # Equal positions have equal neighbours; the lowest id stands for its copies.
    points = on_sphere(right.filter("ra is not null and dec is not null").groupBy("ra", "dec").agg(F.min("id").alias("right_id")))
    points = points.withColumnRenamed("ra", "right_ra").withColumnRenamed("dec", "right_dec")
    spots = on_sphere(left.filter("ra is not null and dec is not null").select("ra", "dec").distinct())
    spots = spots.select("ra", "dec", *[F.col(a).alias(f"l_{a}") for a in axes])

    nodes, leaves = split_dense_cells(points, axes, size, leaf)
    keys = [f"c{i}" for i in range(3)]
    exact = coords.separation_arcsec(F.col("ra"), F.col("dec"), F.col("right_ra"), F.col("right_dec"))
    flat_gap = reduce(lambda p, q: p + q, [F.pow(F.col(f"l_{a}") - F.col(a), 2.0) for a in axes])

    pairs = []
    walk = _cells_in_reach(spots, [f"l_{a}" for a in axes], size, reach).withColumn("best", F.lit(reach))
    for level, (_, placed) in enumerate(leaves):
        last = level == len(leaves) - 1
        if len(leaves) > 1:
            near, far = _box_distance(axes, "l_")
            seen = walk.join(nodes[level].hint("merge"), keys).withColumn("near", near).withColumn("far", far)
            best = F.least(F.col("best"), F.min("far").over(W.partitionBy("ra", "dec")) * (1 + SLACK) + 1e-15)
            seen = seen.withColumn("best", best).filter(F.col("near") <= F.col("best") * (1 + SLACK) + 1e-15)
            if not last:
                seen = cut_lineage(seen)
            reached = seen.filter("is_leaf").select("ra", "dec", *[f"l_{a}" for a in axes], *keys)
        else:
            reached = walk.select("ra", "dec", *[f"l_{a}" for a in axes], *keys)
        hit = reached.join(placed.hint("merge"), keys).filter(F.sqrt(flat_gap) <= reach)
        pairs.append(hit.select("ra", "dec", "right_id", "right_ra", "right_dec", exact.alias("sep_arcsec")))
        if not last:
            # Children of the heavy cells this row can still profit from.
            child = nodes[level + 1].select(*keys, *_parents(3)).select(*keys, "p0", "p1", "p2")
            heavy = seen.filter("not is_leaf").select(
                "ra", "dec", *[f"l_{a}" for a in axes], "best", *[F.col(k).alias(f"p{i}") for i, k in enumerate(keys)]
            )
            walk = heavy.join(child.hint("merge"), ["p0", "p1", "p2"]).drop("p0", "p1", "p2")
    every = reduce(DataFrame.unionByName, pairs).filter(F.col("sep_arcsec") <= arcsec)
    first = F.min(F.struct("sep_arcsec", "right_id", "right_ra", "right_dec")).alias("m")
    return every.groupBy("ra", "dec").agg(first).select("ra", "dec", "m.*")


def nearest_match(left: DataFrame, right: DataFrame, arcsec: float = 1.0, leaf: int = LEAF_POSITIONS) -> DataFrame:
    """Each left row with its nearest right row within ``arcsec``; right rows may repeat."""
    if arcsec <= 0:
        raise ValueError("the tolerance must be greater than zero")
    pairs = nearest_pairs(left, right, arcsec, leaf)
    return left.join(pairs.hint("merge"), ["ra", "dec"])


def survey_overlaps(a: DataFrame, b: DataFrame, c: DataFrame, names: tuple[str, str, str], arcsec: float = 1.0) -> DataFrame:
    """Pairwise matches of three catalogs and the first catalog's rows matched in both others.

    Returns (overlap, id, ra, dec) in one table, one label per overlap.
    """
    na, nb, nc = names
    out = ["id", "ra", "dec"]
    ab = nearest_match(a, b, arcsec).select(*out)
    ac = nearest_match(a, c, arcsec).select(*out)
    bc = nearest_match(b, c, arcsec).select(*out)
    both = ab.join(ac.select("id").hint("merge"), "id", "left_semi").select(*out)
    labelled = [(f"{na}+{nb}", ab), (f"{na}+{nc}", ac), (f"{nb}+{nc}", bc), (f"{na}+{nb}+{nc}", both)]
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("overlap"), *out) for n, d in labelled])


def box_semi_join(left: DataFrame, right: DataFrame, degrees: float = 1e-4, leaf: int = LEAF_POSITIONS) -> DataFrame:
    """Left rows with any right row whose RA and Dec both differ by at most ``degrees``."""
    axes = ["x", "y"]
    keys = ["c0", "c1"]
    reach = degrees * (1 + SLACK)
    size = reach * MATCH_WIDTH
    ok = "ra is not null and dec is not null"
    points = right.filter(ok).select(F.col("ra").alias("x"), F.col("dec").alias("y")).distinct()
    spots = left.filter(ok).select("ra", "dec").distinct().select("ra", "dec", F.col("ra").alias("l_x"), F.col("dec").alias("l_y"))
    nodes, leaves = split_dense_cells(points, axes, size, leaf)
    exact = (F.abs(F.col("ra") - F.col("x")) <= degrees) & (F.abs(F.col("dec") - F.col("y")) <= degrees)

    found = []
    walk = _cells_in_reach(spots, ["l_x", "l_y"], size, reach)
    for level, (_, placed) in enumerate(leaves):
        last = level == len(leaves) - 1
        if len(leaves) > 1:
            # A cell whose whole extent is in the box settles the row; one outside the box is dropped.
            inside = reduce(
                lambda p, q: p & q,
                [(F.col(f"l_{a}") - F.col(f"lo_{a}") <= degrees) & (F.col(f"hi_{a}") - F.col(f"l_{a}") <= degrees)
                 & (F.col(f"hi_{a}") - F.col(f"l_{a}") >= -degrees) & (F.col(f"l_{a}") - F.col(f"lo_{a}") >= -degrees) for a in axes],
            )
            apart = reduce(
                lambda p, q: p | q,
                [(F.col(f"lo_{a}") - F.col(f"l_{a}") > reach) | (F.col(f"l_{a}") - F.col(f"hi_{a}") > reach) for a in axes],
            )
            seen = walk.join(nodes[level].hint("merge"), keys).filter(~apart).withColumn("inside", inside)
            seen = seen.withColumn("done", F.max("inside").over(W.partitionBy("ra", "dec")))
            if not last:
                seen = cut_lineage(seen)
            found.append(seen.filter("done").select("ra", "dec"))
            open_rows = seen.filter("not done")
            reached = open_rows.filter("is_leaf").select("ra", "dec", *keys)
        else:
            reached = walk.select("ra", "dec", *keys)
        found.append(reached.join(placed.hint("merge"), keys).filter(exact).select("ra", "dec"))
        if not last:
            child = nodes[level + 1].select(*keys, *_parents(2))
            heavy = open_rows.filter("not is_leaf").select("ra", "dec", "l_x", "l_y", F.col("c0").alias("p0"), F.col("c1").alias("p1"))
            walk = heavy.join(child.hint("merge"), ["p0", "p1"]).drop("p0", "p1")
    matched = reduce(DataFrame.unionByName, found).distinct()
    return left.join(matched.hint("merge"), ["ra", "dec"], "left_semi")


def cone_pairs(spots: DataFrame, centres: DataFrame, arcsec: float) -> DataFrame:
    """Pairs of distinct positions within ``arcsec``: ``spots`` (ra, dec) and ``centres`` (c_ra, c_dec, ...)."""
    reach = coords.chord(arcsec) * (1 + SLACK)
    size = reach * CONE_WIDTH
    keys = ["c0", "c1", "c2"]
    lx = spots
    for a, col in zip("xyz", coords.unit_vector(F.col("ra"), F.col("dec"))):
        lx = lx.withColumn(f"l_{a}", col)
    rx = centres
    for a, col in zip("xyz", coords.unit_vector(F.col("c_ra"), F.col("c_dec"))):
        rx = rx.withColumn(f"r_{a}", col)
    rx = rx.select(*rx.columns, *_cells(["r_x", "r_y", "r_z"], size, 0)).drop("r_x", "r_y", "r_z")
    lx = _cells_in_reach(lx, ["l_x", "l_y", "l_z"], size, reach).drop("l_x", "l_y", "l_z")
    sep = coords.separation_arcsec(F.col("ra"), F.col("dec"), F.col("c_ra"), F.col("c_dec"))
    return lx.join(rx.hint("merge"), keys).drop(*keys).withColumn("sep_arcsec", sep).filter(F.col("sep_arcsec") <= arcsec)


def search_rings(centres: DataFrame, arcsec: float, leaf: int = LEAF_POSITIONS) -> list[float]:
    """Radii to search in turn: just the full one where cells hold few centres, else halves of it, smallest first.

    Starts one small job per radius looked at (the largest cell count).
    """
    rings = [arcsec]
    axes = list(coords.unit_vector(F.col("c_ra"), F.col("c_dec")))
    while len(rings) <= MAX_LEVELS + 2:
        size = coords.chord(rings[0]) * (1 + SLACK) * CONE_WIDTH
        counts = centres.groupBy(*[_cell(a, size, 0).alias(f"c{i}") for i, a in enumerate(axes)]).agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0]
        if largest is None or largest <= leaf:
            break
        rings.insert(0, rings[0] / 2)
    return rings


def _rank_key(rank: Column) -> Column:
    """A rank as a number; a missing rank comes first, as it does in the order of structs."""
    return F.coalesce(rank.cast("double"), F.lit(float("-inf")))


def _best_cover(places: DataFrame, offered: DataFrame, arcsec: float) -> DataFrame:
    """Best covering offer of each position within the radius."""
    pairs = cone_pairs(places, offered, arcsec)
    if "known_rank" in places.columns:
        pairs = pairs.filter(F.col("known_rank").isNull() | (_rank_key(F.col("filter_rank")) < F.col("known_rank")))
    x, y, front = coords.sky_to_pixel(
        F.col("scale_deg"), F.col("crpix_x"), F.col("crpix_y"), F.col("ra"), F.col("dec"), F.col("crval_ra"), F.col("crval_dec")
    )
    covered = pairs.withColumn("px", x).withColumn("py", y).filter(
        front & coords.inside_image(F.col("px"), F.col("py"), F.col("width"), F.col("height"))
    )
    order = F.struct(
        "filter_rank", "sep_arcsec", F.col("offer.obs_id").alias("obs_id"), F.col("offer.product_rank").alias("product_rank"),
        F.col("offer.product_filename").alias("product_filename"), "px", "py",
    )
    return covered.groupBy("ra", "dec").agg(F.min(order).alias("b")).select("ra", "dec", "b.*")


def resolve_sources(
    spots: DataFrame, observations: DataFrame, products: DataFrame, radius_deg: float = 0.01, leaf: int = LEAF_POSITIONS
) -> DataFrame:
    """For each position the first product that covers it, over the observations within the radius.

    ``observations``: (obs_id, c_ra, c_dec, filter_rank), already filtered to mission, level, target and filter.
    ``products``: (obs_id, product_rank, product_filename, scale_deg, crpix_x, crpix_y, crval_ra, crval_dec, width,
    height). Order: filter rank (a missing one first), separation, observation id, product rank.

    Copies of one pointing with one image geometry cover the same sky, so only the best of them enters the join. Where
    pointings are dense the search goes outwards in rings: what a ring finds beats everything farther out of the same filter rank
    or a later one, so wider rings only see positions that a better rank could still win.
    """
    geometry = ["scale_deg", "crpix_x", "crpix_y", "crval_ra", "crval_dec", "width", "height"]
    pointing = ["c_ra", "c_dec", "filter_rank"]
    one = observations.groupBy("obs_id").agg(F.min(F.struct("filter_rank", "c_ra", "c_dec")).alias("o")).select("obs_id", "o.*")
    offered = (
        one.join(products.hint("merge"), "obs_id")
        .groupBy(*pointing, *geometry)
        .agg(F.min(F.struct("obs_id", "product_rank", "product_filename")).alias("offer"))
    )
    places = spots.select("ra", "dec").distinct()
    rings = search_rings(offered, radius_deg * coords.ARCSEC, leaf)
    if len(rings) == 1:
        best = _best_cover(places, offered, rings[0])
    else:
        offered = cut_lineage(offered)
        least = offered.agg(F.min(_rank_key(F.col("filter_rank")))).first()[0]
        best = cut_lineage(_best_cover(places, offered, rings[0]))
        for ring in rings[1:]:
            # What a smaller ring found can only be beaten by a better filter rank.
            known = places.join(best.select("ra", "dec", _rank_key(F.col("filter_rank")).alias("known_rank")).hint("merge"), ["ra", "dec"], "left")
            open_places = cut_lineage(known.filter(F.col("known_rank").isNull() | (F.col("known_rank") > F.lit(least))))
            if open_places.isEmpty():
                break
            wider = _best_cover(open_places, offered, ring)
            row = F.struct("filter_rank", "sep_arcsec", *[c for c in best.columns if c not in ("ra", "dec", "filter_rank", "sep_arcsec")])
            both = best.unionByName(wider).groupBy("ra", "dec").agg(F.min(row).alias("b"))
            best = cut_lineage(both.select("ra", "dec", "b.*").select(*best.columns))
    return spots.join(best.hint("merge"), ["ra", "dec"])
