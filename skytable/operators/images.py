"""Image operators over pixel tables (H1-H22, E12, B39, B42 use).

A pixel table is (image_id, h, w, y, x, v). Sums over an image are plain aggregates. Operations that look at
neighbours run on square tiles with a border, never on a whole image, so one giant mosaic spreads over many tasks.
Objects that cross tile borders are joined up afterwards.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytable.operators.quantiles import exact_quantiles, magnitude_chunk, running_before
from skytable.operators.ranking import rank_in_chunks
from skytable.session import cut_lineage

TILE = 256
# Thresholds of the image features and gates.
FLAT_VARIANCE = 1e-12
TINY = 1e-12
RADIAL_BINS = 8
FINE_SIGMA, MIDDLE_SIGMA, COARSE_SIGMA_RANGE = 1.0, 3.0, (4.0, 12.0)
TRUNCATE = 4.0
WHITE_LEVEL = 245
MIN_CONTRAST = 0.15
# Thresholds of the detection filters.
MIN_PIXELS, MIN_FLUX, MIN_SEMI_MAJOR, MAX_PEAK_SHARE, MAX_ELONGATION, MIN_SNR = 20, 0.0, 4.0, 0.5, 5.0, 7.0
CONCENTRATION_ENDS, MAX_STAR_RATIO, PSF_FACTOR, PSF_HALF_LIGHT, FLAT_PIXELS, MIN_KRON = (0.03, 0.75), 0.45, 1.5, 0.54, 4, 1.0
FEATURES = (
    "e1 e4 e16 coarse_to_fine directional_ratio saturated_fraction center_fraction outer_fraction interior_zero_frac "
    "quadrant_ratio max_quadrant_frac n_sources concentration asymmetry total_rise half_light_radius peak_offset_frac "
    "gini m20 snr kurtosis_val min_dim"
).split()


# ---- tiles -------------------------------------------------------------------------------------------------------


def to_tiles(pixels: DataFrame, border: int, tile: int = TILE) -> DataFrame:
    """Each pixel once per tile whose square, grown by ``border``, contains it: at most four times."""
    if border > tile:
        raise ValueError("the border must not exceed the tile")

    def places(at: str, size: str) -> Column:
        low = F.greatest(F.floor((F.col(at) - border) / tile), F.lit(0))
        high = F.least(F.floor((F.col(at) + border) / tile), F.floor((F.col(size) - 1) / tile))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return pixels.withColumn("ty", places("y", "h")).withColumn("tx", places("x", "w"))


def _tile_array(pdf: pd.DataFrame, border: int, tile: int) -> tuple[np.ndarray, int, int, int, int]:
    """Tile with its border; beyond the image edge the picture is mirrored."""
    h, w = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])
    y0, x0 = int(pdf["ty"].iloc[0]) * tile, int(pdf["tx"].iloc[0]) * tile
    y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
    ya, yb, xa, xb = max(y0 - border, 0), min(y1 + border, h), max(x0 - border, 0), min(x1 + border, w)
    part = np.zeros((yb - ya, xb - xa))
    part[pdf["y"].to_numpy() - ya, pdf["x"].to_numpy() - xa] = pdf["v"].to_numpy()
    before = (border - (y0 - ya), border - (x0 - xa))
    after = (border - (yb - y1), border - (xb - x1))
    return np.pad(part, ((before[0], after[0]), (before[1], after[1])), mode="symmetric"), y0, x0, y1 - y0, x1 - x0


def _gauss(sigma: float) -> np.ndarray:
    reach = int(TRUNCATE * sigma + 0.5)
    steps = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (steps / sigma) ** 2)
    return weights / weights.sum()


def _blur(image: np.ndarray, sigma: float, border: int, rows: int, cols: int) -> np.ndarray:
    """Separable blur of a padded tile; returns the inner part."""
    weights = _gauss(sigma)
    reach = len(weights) // 2
    cut = image[border - reach : border + rows + reach, border - reach : border + cols + reach]
    down = sum(wt * cut[i : i + rows, :] for i, wt in enumerate(weights))
    return sum(wt * down[:, i : i + cols] for i, wt in enumerate(weights))


def blur_energy(pixels: DataFrame, stats: DataFrame, tile: int = TILE) -> DataFrame:
    """Variance after a fine, a middle and a size-dependent blur: (image_id, var_1, var_4, var_16).

    ``stats``: (image_id, mean). The mean is taken off first; a blur keeps constants, so sums stay accurate.
    """
    low, high = COARSE_SIGMA_RANGE
    border = int(TRUNCATE * high + 0.5)
    centred = pixels.join(stats.select("image_id", "mean"), "image_id").withColumn("v", F.col("v") - F.col("mean")).drop("mean")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        image, _, _, rows, cols = _tile_array(pdf, border, tile)
        side = min(int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]))
        out = {"image_id": [pdf["image_id"].iloc[0]], "n": [rows * cols]}
        for name, sigma in (("1", FINE_SIGMA), ("4", MIDDLE_SIGMA), ("16", max(low, min(high, side / 5.0)))):
            soft = _blur(image, sigma, border, rows, cols)
            out[f"s_{name}"], out[f"q_{name}"] = [soft.sum()], [(soft * soft).sum()]
        return pd.DataFrame(out)

    id_type = pixels.schema["image_id"].dataType.simpleString()
    fields = ", ".join(f"s_{k} double, q_{k} double" for k in ("1", "4", "16"))
    parts = to_tiles(centred, border, tile).groupBy("image_id", "ty", "tx").applyInPandas(measure, f"image_id {id_type}, n long, {fields}")
    var = lambda k: (F.sum(f"q_{k}") / F.sum("n") - F.pow(F.sum(f"s_{k}") / F.sum("n"), 2.0)).alias(f"var_{k}")
    return parts.groupBy("image_id").agg(var("1"), var("4"), var("16"))


# ---- connected pixels --------------------------------------------------------------------------------------------


def _label_tile(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component number per marked pixel: runs of a row are linked to the overlapping runs of the row above."""
    runs, owner = [], []

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    reach = 1 if diagonal else 0
    above: list[int] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].view(np.int8), [0]))))
        here = []
        for a, b in zip(edges[::2], edges[1::2]):
            me = len(runs)
            runs.append((y, a, b))
            owner.append(me)
            here.append(me)
            for other in above:
                if runs[other][1] < b + reach and a < runs[other][2] + reach:
                    p, q = root(me), root(other)
                    owner[max(p, q)] = min(p, q)
        above = here
    labels = np.full(mask.shape, -1, dtype=np.int64)
    for i, (y, a, b) in enumerate(runs):
        labels[y, a:b] = root(i)
    return labels


def connected_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): the least node of each component. ``edges``: (keys, a, b) within a key.

    Each round hangs every node's larger neighbours and then its smaller ones on the least neighbour, which joins chains
    in about log(length) rounds. Edge lists are rewritten each round and cut from their history.
    """
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    now = cut_lineage(both)
    last = None
    while True:
        # Towards larger neighbours.
        sym = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        big = sym.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Towards smaller neighbours; every edge now points from larger to smaller.
        small_least = big.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        moved = big.join(small_least, [*keys, "u"])
        small = moved.filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_least.select(*keys, "u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small)
        # Edges are distinct, so an unchanged count and hash mean an unchanged set.
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first())
        if mark == last:
            break
        last = mark
    tops = now.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = now.select(*keys, F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return tops.unionByName(roots.join(tops.select(*keys, "node"), [*keys, "node"], "left_anti"))


def label_pixels(marked: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """Adds ``comp`` to each marked pixel: the least raster position of its connected component.

    Tiles are labelled on their own; pieces that touch across a tile border are then united.
    """
    id_type = marked.schema["image_id"].dataType.simpleString()

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["w"].iloc[0])
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        y, x = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        mask = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        mask[y, x] = True
        spot = pdf["y"].to_numpy().astype("i8") * w + pdf["x"].to_numpy()
        piece = pd.Series(_label_tile(mask, diagonal)[y, x])
        least = pd.Series(spot).groupby(piece.to_numpy()).min()
        return pdf.assign(comp=least.loc[piece].to_numpy())[["image_id", "h", "w", "y", "x", "v", "comp"]]

    placed = marked.select(
        "image_id", "h", "w", "y", "x", "v",
        F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"),
    )
    schema = f"image_id {id_type}, h int, w int, y int, x int, v double, comp long"
    labelled = placed.groupBy("image_id", "ty", "tx").applyInPandas(label, schema)
    labelled = cut_lineage(labelled)

    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    at_border = (F.col("y") % tile == tile - 1) | (F.col("x") % tile == tile - 1) | (F.col("x") % tile == 0) | (F.col("y") % tile == 0)
    rim = labelled.filter(at_border).select("image_id", "y", "x", "comp")
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    reach = rim.select("image_id", "y", "x", F.col("comp").alias("a"), F.explode(moves).alias("m")).select(
        "image_id", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "a"
    )
    edges = reach.join(rim.withColumnRenamed("comp", "b"), ["image_id", "y", "x"]).select("image_id", "a", "b").filter("a <> b").distinct()
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return labelled
    united = connected_components(edges, ["image_id"]).withColumnRenamed("node", "comp")
    joined = labelled.join(united, ["image_id", "comp"], "left")
    return joined.withColumn("comp", F.coalesce("root", "comp")).drop("root")


def count_sources(pixels: DataFrame, stats: DataFrame, tile: int = TILE) -> DataFrame:
    """Bright 4-connected spots (above mean + 3 sd) per image. ``stats``: (image_id, mean, var)."""
    level = stats.select("image_id", (F.col("mean") + 3.0 * F.sqrt("var")).alias("_level"))
    marked = pixels.join(level, "image_id").filter(F.col("v") > F.col("_level")).drop("_level")
    counted = label_pixels(marked, False, tile).groupBy("image_id").agg(F.countDistinct("comp").cast("double").alias("n_sources"))
    return stats.select("image_id").join(counted, "image_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0.0)))


def largest_component_box(pixels: DataFrame, threshold: float = WHITE_LEVEL, pad: int = 1, tile: int = TILE) -> DataFrame:
    """Box (left, top, right, bottom) of the largest dark component; the whole image when nothing is dark.

    Of equal components the one first met in raster order counts.
    """
    sizes = pixels.groupBy("image_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    parts = label_pixels(pixels.filter(F.col("v") < threshold), False, tile).groupBy("image_id", "comp").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    best = parts.groupBy("image_id").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct("area", -F.col("comp"))).alias("b"))
    return sizes.join(best, "image_id", "left").select(
        "image_id",
        F.coalesce(F.greatest(F.lit(0), F.col("b.x0") - pad), F.lit(0)).alias("left"),
        F.coalesce(F.greatest(F.lit(0), F.col("b.y0") - pad), F.lit(0)).alias("top"),
        F.coalesce(F.least(F.col("w"), F.col("b.x1") + 1 + pad), F.col("w")).alias("right"),
        F.coalesce(F.least(F.col("h"), F.col("b.y1") + 1 + pad), F.col("h")).alias("bottom"),
    )


# ---- preparation -------------------------------------------------------------------------------------------------


def _mirror(at: Column, size: Column) -> Column:
    return F.when(at < 0, -at - 1).when(at >= size, 2 * size - at - 1).otherwise(at)


def fill_missing(pixels: DataFrame) -> DataFrame:
    """H1: NaN pixels become the median of the 5x5 square around them (known values only), else the image mean, else 0."""
    bad = pixels.filter(F.isnan("v")).select("image_id", "h", "w", "y", "x")
    steps = F.array(*[F.lit(s) for s in range(-2, 3)])
    around = bad.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    near = around.select(
        "image_id", F.col("y").alias("_y"), F.col("x").alias("_x"),
        F.greatest(_mirror(F.col("y") + F.col("_dy"), F.col("h")), F.lit(0)).alias("y"),
        F.greatest(_mirror(F.col("x") + F.col("_dx"), F.col("w")), F.lit(0)).alias("x"),
    )
    known = pixels.filter(~F.isnan("v")).select("image_id", "y", "x", "v")
    # At most 25 values per missing pixel.
    medians = near.join(known, ["image_id", "y", "x"]).groupBy("image_id", "_y", "_x").agg(F.percentile("v", F.lit(0.5)).alias("_m"))
    medians = medians.select("image_id", F.col("_y").alias("y"), F.col("_x").alias("x"), "_m")
    means = known.groupBy("image_id").agg(F.avg("v").alias("_mean"))
    joined = pixels.join(medians, ["image_id", "y", "x"], "left").join(means, "image_id", "left")
    filled = F.when(F.isnan("v"), F.coalesce("_m", "_mean", F.lit(0.0))).otherwise(F.col("v"))
    return joined.select(*[filled.alias("v") if c == "v" else F.col(c) for c in pixels.columns])


def downsample(pixels: DataFrame, budget_bytes: int, pixel_bytes: int = 8) -> DataFrame:
    """H2: images over the budget shrink by ``ceil(sqrt(size / budget))`` through block means; whole blocks only."""
    ratio = F.col("h").cast("double") * F.col("w") * pixel_bytes / float(budget_bytes)
    k = F.when(ratio > 1, F.ceil(F.sqrt(ratio))).otherwise(1).cast("int")
    tagged = pixels.withColumn("_k", k).withColumn("_h", F.floor(F.col("h") / k).cast("int")).withColumn("_w", F.floor(F.col("w") / k).cast("int"))
    tagged = tagged.withColumn("_y", F.floor(F.col("y") / F.col("_k")).cast("int")).withColumn("_x", F.floor(F.col("x") / F.col("_k")).cast("int"))
    inside = tagged.filter((F.col("_y") < F.col("_h")) & (F.col("_x") < F.col("_w")))
    return inside.groupBy("image_id", F.col("_h").alias("h"), F.col("_w").alias("w"), F.col("_y").alias("y"), F.col("_x").alias("x")).agg(
        F.avg("v").alias("v")
    )


def background(pixels: DataFrame, mesh: int = 64) -> DataFrame:
    """H3: (image_id, my, mx, level, rms) per mesh square: median, and standard deviation as the spread.

    A square holds at most ``mesh``² pixels, so the exact percentile is bounded.
    """
    squares = pixels.filter(~F.isnan("v")).withColumn("my", F.floor(F.col("y") / mesh).cast("int")).withColumn("mx", F.floor(F.col("x") / mesh).cast("int"))
    keys = ["image_id", "my", "mx"]
    level = squares.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("level"), F.stddev_pop("v").alias("rms"))
    return level


def subtract_background(pixels: DataFrame, mesh: int = 64) -> tuple[DataFrame, DataFrame]:
    """H3: (pixels without background, (image_id, global_rms)). The global spread is the median over the squares."""
    levels = background(pixels, mesh)
    keys = ["image_id", "my", "mx"]
    squares = pixels.withColumn("my", F.floor(F.col("y") / mesh).cast("int")).withColumn("mx", F.floor(F.col("x") / mesh).cast("int"))
    # A square without any known pixel has no level; its pixels stay what they are.
    clean = squares.join(levels, keys, "left").select(*[(F.col("v") - F.coalesce("level", F.lit(0.0))).alias("v") if c == "v" else F.col(c) for c in pixels.columns])
    return clean, exact_quantiles(levels, ["image_id"], "rms", {"global_rms": 0.5})


def detect_objects(clean: DataFrame, rms: DataFrame, sigmas: float = 1.5, min_pixels: int = 5, tile: int = TILE) -> DataFrame:
    """H4: 8-connected pixels above ``sigmas`` times the global spread, with centroid, axes, angle, flux, peak and size."""
    marked = clean.join(rms, "image_id").filter(F.col("v") > F.lit(sigmas) * F.col("global_rms")).drop("global_rms")
    lit = label_pixels(marked, True, tile)
    v, x, y = F.col("v"), F.col("x").cast("double"), F.col("y").cast("double")
    raw = lit.groupBy("image_id", "comp").agg(
        F.count("*").alias("npix"), F.sum(v).alias("flux"), F.max(v).alias("peak"),
        (F.sum(v * x) / F.sum(v)).alias("x"), (F.sum(v * y) / F.sum(v)).alias("y"),
        F.sum(v * x * x).alias("_xx"), F.sum(v * y * y).alias("_yy"), F.sum(v * x * y).alias("_xy"),
    ).filter(F.col("npix") >= min_pixels)
    # Second moments about the centroid; a width of 1/12 pixel² keeps thin objects from degenerating.
    xx = F.greatest(F.col("_xx") / F.col("flux") - F.col("x") * F.col("x"), F.lit(1 / 12.0))
    yy = F.greatest(F.col("_yy") / F.col("flux") - F.col("y") * F.col("y"), F.lit(1 / 12.0))
    xy = F.col("_xy") / F.col("flux") - F.col("x") * F.col("y")
    m = raw.withColumn("_a", xx).withColumn("_b", yy).withColumn("_c", xy)
    half, gap = (F.col("_a") + F.col("_b")) / 2.0, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2.0, 2.0) + F.col("_c") * F.col("_c"))
    return m.select(
        "image_id", F.col("comp").alias("object"), "x", "y", F.sqrt(half + gap).alias("a"),
        F.sqrt(F.greatest(half - gap, F.lit(0.0))).alias("b"),
        (F.atan2(2.0 * F.col("_c"), F.col("_a") - F.col("_b")) / 2.0).alias("theta"), "flux", "peak", "npix",
    )


# ---- apertures and filters ---------------------------------------------------------------------------------------

APERTURE_CELL = 32


def pixels_near(detections: DataFrame, pixels: DataFrame, radius: Column, cell: int = APERTURE_CELL) -> DataFrame:
    """Detection rows with the pixels within ``radius`` of them: an equi-join on image cells."""
    boxed = detections.withColumn("_r", radius)
    span = lambda at: F.explode(F.sequence(F.floor((F.col(at) - F.col("_r")) / cell).cast("int"), F.floor((F.col(at) + F.col("_r")) / cell).cast("int")))
    asked = boxed.withColumn("_cy", span("y")).withColumn("_cx", span("x"))
    given = pixels.select(
        "image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v",
        F.floor(F.col("y") / cell).cast("int").alias("_cy"), F.floor(F.col("x") / cell).cast("int").alias("_cx"),
    )
    distance = F.sqrt(F.pow(F.col("px") - F.col("x"), 2.0) + F.pow(F.col("py") - F.col("y"), 2.0))
    return asked.join(given, ["image_id", "_cy", "_cx"]).withColumn("dist", distance).filter(F.col("dist") <= F.col("_r")).drop("_cy", "_cx", "_r")


def flat_top_pixels(detections: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, object, n_flat): pixels of the 5x5 box around a detection within 0.1% of its peak."""
    spot = detections.select("image_id", "object", F.col("x").cast("int").alias("_x"), F.col("y").cast("int").alias("_y"), "peak")
    steps = F.array(*[F.lit(s) for s in range(-2, 3)])
    box = spot.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    box = box.select("image_id", "object", "peak", (F.col("_y") + F.col("_dy")).alias("y"), (F.col("_x") + F.col("_dx")).alias("x"))
    tol = F.when(F.abs("peak") > TINY, F.abs("peak") * 0.001).otherwise(F.lit(TINY))
    hit = box.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    return hit.groupBy("image_id", "object").agg(F.count_if(F.abs(F.col("v") - F.col("peak")) < tol).alias("n_flat"))


def first_failed_filter() -> Column:
    """H6: name of the first filter a detection fails, or ``pass``.

    Reads npix, flux, a, b, peak, rms, concentration, r25, r50, r75, psf_fwhm, bright_floor, n_flat, kron_radius; a
    missing measure passes, as a filter that cannot be computed does.
    """
    c = F.col
    fails = [
        ("npix", c("npix") < MIN_PIXELS),
        ("flux", c("flux") <= MIN_FLUX),
        ("resolved", c("a") <= MIN_SEMI_MAJOR),
        ("artifact", c("peak") / F.greatest(c("flux"), F.lit(1e-10)) >= MAX_PEAK_SHARE),
        ("elongation", c("a") / F.greatest(c("b"), F.lit(0.01)) >= MAX_ELONGATION),
        ("snr", c("flux") / F.greatest(F.sqrt(c("npix").cast("double")) * c("rms"), F.lit(1e-10)) < MIN_SNR),
        ("concentration", (c("concentration") <= CONCENTRATION_ENDS[0]) | (c("concentration") >= CONCENTRATION_ENDS[1])),
        ("star", c("r25") / F.greatest(c("r75"), F.lit(0.1)) >= MAX_STAR_RATIO),
        ("psf", c("r50") <= PSF_FACTOR * PSF_HALF_LIGHT * c("psf_fwhm")),
        ("saturation", (c("peak") >= c("bright_floor")) & (c("n_flat") >= FLAT_PIXELS)),
        ("kron", c("kron_radius") < MIN_KRON),
    ]
    return reduce(lambda out, f: F.when(F.coalesce(f[1], F.lit(False)), f[0]).otherwise(out), reversed(fails), F.lit("pass"))


# ---- crops -------------------------------------------------------------------------------------------------------


def crop_pixels(boxes: DataFrame, pixels: DataFrame, cell: int = APERTURE_CELL) -> DataFrame:
    """H7: pixel table of the crops. ``boxes``: (crop_id, image_id, x_min, x_max, y_min, y_max), ends excluded."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor((F.col(hi) - 1) / cell).cast("int")))
    asked = boxes.filter("x_max > x_min and y_max > y_min").withColumn("_cy", span("y_min", "y_max")).withColumn("_cx", span("x_min", "x_max"))
    given = pixels.select(
        F.col("image_id"), F.col("y").alias("py"), F.col("x").alias("px"), "v",
        F.floor(F.col("y") / cell).cast("int").alias("_cy"), F.floor(F.col("x") / cell).cast("int").alias("_cx"),
    )
    hit = asked.join(given, ["image_id", "_cy", "_cx"]).filter("px >= x_min and px < x_max and py >= y_min and py < y_max")
    return hit.select(
        F.col("crop_id").alias("image_id"), (F.col("y_max") - F.col("y_min")).alias("h"), (F.col("x_max") - F.col("x_min")).alias("w"),
        (F.col("py") - F.col("y_min")).alias("y"), (F.col("px") - F.col("x_min")).alias("x"), "v",
    )


def standardize_crops(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """H8: crops brought to the size in ``targets`` (image_id, th, tw): a short axis is padded with NaN around the
    middle, a long one is cut around the middle; each axis on its own."""
    sized = pixels.join(targets, "image_id")
    shift = lambda size, want: F.when(F.col(want) >= F.col(size), F.floor((F.col(want) - F.col(size)) / 2)).otherwise(
        -F.floor((F.col(size) - F.col(want)) / 2)
    )
    moved = sized.select(
        "image_id", F.col("th").alias("h"), F.col("tw").alias("w"),
        (F.col("y") + shift("h", "th")).cast("int").alias("y"), (F.col("x") + shift("w", "tw")).cast("int").alias("x"), "v",
    ).filter("y >= 0 and y < h and x >= 0 and x < w")
    grid = targets.select("image_id", F.col("th").alias("h"), F.col("tw").alias("w"), F.explode(F.expr("sequence(0, th - 1)")).alias("y"))
    grid = grid.withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    joined = grid.join(moved.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    return joined.select("image_id", "h", "w", "y", "x", F.coalesce("v", F.lit(float("nan"))).alias("v"))


# ---- scaling and gates -------------------------------------------------------------------------------------------


def clip_scale(pixels: DataFrame, low: float, high: float, top: float = 1.0) -> DataFrame:
    """Clip each image to two percentiles and stretch to 0..top; a flat image becomes 0."""
    ends = exact_quantiles(pixels, ["image_id"], "v", {"_lo": low, "_hi": high})
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.least(F.greatest(F.col("v"), F.col("_lo")), F.col("_hi")) - F.col("_lo")) / span * top).otherwise(F.lit(0.0))
    return pixels.join(ends, "image_id").select(*[scaled.alias("v") if c == "v" else F.col(c) for c in pixels.columns])


def min_max_scale(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    """Stretch each image from its least to its largest value."""
    ends = pixels.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col("v") - F.col("_lo")) / span * top).otherwise(F.lit(0.0))
    return pixels.join(ends, "image_id").select(*[scaled.alias("v") if c == "v" else F.col(c) for c in pixels.columns])


def asinh_scale(pixels: DataFrame) -> DataFrame:
    """H10."""
    return pixels.withColumn("v", F.asinh("v"))


def contrast_gate(pixels: DataFrame) -> DataFrame:
    """Spread between the 0.5 and 99.5 percentiles, NaN share, and whether the spread suffices."""
    ends = exact_quantiles(pixels, ["image_id"], "v", {"_lo": 0.005, "_hi": 0.995})
    holes = pixels.groupBy("image_id").agg(F.avg(F.isnan("v").cast("double")).alias("nan_fraction"))
    spread = F.col("_hi") - F.col("_lo")
    return holes.join(ends, "image_id", "left").select(
        "image_id", spread.alias("contrast"), "nan_fraction", F.coalesce(spread >= MIN_CONTRAST, F.lit(False)).alias("accepted")
    )


# ---- morphology --------------------------------------------------------------------------------------------------


def _radius() -> tuple[Column, Column]:
    dx, dy = F.col("x") - F.col("w") / 2.0, F.col("y") - F.col("h") / 2.0
    return F.sqrt(dx * dx + dy * dy), F.sqrt(F.pow(F.col("w") / 2.0, 2.0) + F.pow(F.col("h") / 2.0, 2.0))


def image_sums(pixels: DataFrame) -> DataFrame:
    """H14-H21 in one aggregate per image: moments, extremes, quadrants, rings and the peak."""
    v, a = F.col("v"), F.abs("v")
    r, r_max = _radius()
    icy, icx = F.floor(F.col("h") / 2.0), F.floor(F.col("w") / 2.0)
    top, left = F.col("y") < icy, F.col("x") < icx
    quads = {"q0": top & left, "q1": top & ~left, "q2": ~top & left, "q3": ~top & ~left}
    inner = r < r_max * 0.5
    far = r > r_max * 0.7
    sums = [
        F.max("h").alias("h"), F.max("w").alias("w"), F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"),
        F.kurtosis(v).alias("kurt"), F.max(v).alias("v_max"), F.min(v).alias("v_min"), F.sum(a).alias("flux"),
        F.max(F.struct(v.alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("peak"),
        F.count_if(inner).alias("n_inner"), F.count_if(inner & (v == 0)).alias("n_zero"),
        F.sum(F.when(r < 3, a).otherwise(0.0)).alias("flux_r3"), F.sum(F.when(r < 8, a).otherwise(0.0)).alias("flux_r8"),
        F.stddev_pop(F.when(far, v)).alias("bg_std"),
        F.sum(a * r * r).alias("moment"),
    ]
    sums += [F.sum(F.when(cond, a).otherwise(0.0)).alias(k) for k, cond in quads.items()]
    for i in range(RADIAL_BINS):
        ring = (r >= r_max * (i / RADIAL_BINS)) & (r < r_max * ((i + 1) / RADIAL_BINS))
        sums += [F.sum(F.when(ring, a).otherwise(0.0)).alias(f"ring_{i}"), F.avg(F.when(ring, a)).alias(f"ring_mean_{i}")]
    return pixels.groupBy("image_id").agg(*sums)


def line_variances(pixels: DataFrame) -> DataFrame:
    """Variance of row means and of column means."""
    rows = pixels.groupBy("image_id", "y").agg(F.avg("v").alias("m")).groupBy("image_id").agg(F.var_pop("m").alias("row_var"))
    cols = pixels.groupBy("image_id", "x").agg(F.avg("v").alias("m")).groupBy("image_id").agg(F.var_pop("m").alias("col_var"))
    return rows.join(cols, "image_id")


def asymmetry(pixels: DataFrame) -> DataFrame:
    """Sum of differences to the image turned by 180 degrees. A pixel and its partner meet in one group of two."""
    i = F.col("y").cast("bigint") * F.col("w") + F.col("x")
    j = F.col("h").cast("bigint") * F.col("w") - 1 - i
    signed = F.when(i < j, F.col("v")).when(i > j, -F.col("v")).otherwise(F.lit(0.0))
    pairs = pixels.groupBy("image_id", F.least(i, j).alias("pair")).agg(F.abs(F.sum(signed)).alias("d"))
    return pairs.groupBy("image_id").agg((2.0 * F.sum("d")).alias("diff"))


def half_light_radius(pixels: DataFrame, sums: DataFrame) -> DataFrame:
    """Least radius that holds half of the flux. Pixels of one radius are summed first."""
    r4 = F.pow(2 * F.col("x") - F.col("w"), F.lit(2.0)) + F.pow(2 * F.col("y") - F.col("h"), F.lit(2.0))
    rings = pixels.groupBy("image_id", r4.cast("bigint").alias("r4")).agg(F.sum(F.abs("v")).alias("s"))
    run = running_before(rings, ["image_id"], [F.col("r4")], F.floor(F.sqrt("r4") / 64), {"before": "s"})
    half = run.join(sums.select("image_id", "flux"), "image_id").filter(F.col("before") + F.col("s") >= 0.5 * F.col("flux"))
    return half.groupBy("image_id").agg((F.sqrt(F.min("r4")) / 2.0).alias("half_light_radius"))


def gini(pixels: DataFrame, sums: DataFrame) -> DataFrame:
    """Inequality of pixel flux. Equal values are counted first; a run of c values after k others adds the
    ranks k+1..k+c."""
    counts = pixels.groupBy("image_id", F.abs("v").alias("a")).agg(F.count("*").alias("c"))
    run = running_before(counts, ["image_id"], [F.col("a")], magnitude_chunk(F.col("a")), {"k": "c"})
    weighted = F.sum(F.col("a") * (F.col("c") * F.col("k") + F.col("c") * (F.col("c") + 1) / 2.0))
    ranked = run.groupBy("image_id").agg(weighted.alias("ra"))
    value = 2.0 * F.col("ra") / (F.col("n") * F.col("flux")) - (F.col("n") + 1) / F.col("n")
    return ranked.join(sums.select("image_id", "n", "flux"), "image_id").select(
        "image_id", F.when((F.col("flux") > TINY) & (F.col("n") > 1), value).otherwise(F.lit(0.0)).alias("gini")
    )


def bright_moment(pixels: DataFrame, sums: DataFrame, share: float = 0.2) -> DataFrame:
    """Log ratio of the second moment of the brightest pixels, which hold ``share`` of the flux, to the whole.

    Pixels enter by brightness while the running flux stays within the share; the brightest enters in any case. Of
    equal pixels the last in raster order enters first.
    """
    i = F.col("y").cast("bigint") * F.col("w") + F.col("x")
    r, _ = _radius()
    lit = pixels.select("image_id", F.abs("v").alias("a"), i.alias("i"), (F.abs("v") * r * r).alias("m"))
    # Only pixels that can enter matter: no pixel above the share enters except the brightest.
    runs = lit.groupBy("image_id", "a").agg(F.count("*").alias("c"), F.sum("m").alias("m"), (F.col("a") * F.count("*")).alias("s"))
    order = [F.col("a").desc()]
    run = running_before(runs, ["image_id"], order, -magnitude_chunk(F.col("a")), {"before": "s"})
    run = run.join(sums.select("image_id", "flux"), "image_id").withColumn("room", share * F.col("flux") - F.col("before"))
    whole = (F.col("s") <= F.col("room")) & (F.col("a") > 0)
    some = F.when(F.col("a") > 0, F.floor(F.col("room") / F.col("a"))).otherwise(0)
    inside = run.groupBy("image_id").agg(
        F.sum(F.when(whole, F.col("m"))).alias("m_whole"),
        F.max(F.when(~whole & (F.col("a") > 0), F.struct("a", F.greatest(some, F.lit(0)).alias("k")))).alias("cut"),
        F.count_if(whole).alias("n_whole"),
    )
    cut = inside.select("image_id", F.col("cut.a").alias("a"), F.when(F.col("n_whole") == 0, F.greatest(F.col("cut.k"), F.lit(1))).otherwise(F.col("cut.k")).alias("k"))
    tied = lit.join(cut.filter("k > 0"), ["image_id", "a"])
    ranked = rank_in_chunks(tied, ["image_id"], [F.col("i").desc()], -F.floor(F.col("i") / 65536), "rank")
    extra = ranked.filter("rank <= k").groupBy("image_id").agg(F.sum("m").alias("m_part"))
    joined = sums.select("image_id", "moment", "flux").join(inside.select("image_id", "m_whole"), "image_id").join(extra, "image_id", "left")
    m20 = F.coalesce("m_whole", F.lit(0.0)) + F.coalesce("m_part", F.lit(0.0))
    value = F.when((F.col("flux") > TINY) & (F.col("moment") > TINY) & (m20 > 0), F.log10(m20 / F.col("moment"))).otherwise(F.lit(0.0))
    return joined.select("image_id", value.alias("m20"))


def saturation(pixels: DataFrame, sums: DataFrame) -> DataFrame:
    """Share of pixels within 5% of the range below the maximum."""
    level = sums.select("image_id", (F.col("v_max") - 0.05 * (F.col("v_max") - F.col("v_min"))).alias("_t"))
    return pixels.join(level, "image_id").groupBy("image_id").agg(F.avg((F.col("v") >= F.col("_t")).cast("double")).alias("saturated_fraction"))


def simple_features(sums: DataFrame) -> DataFrame:
    """Features that follow from :func:`image_sums` alone."""
    c = F.col
    over = lambda top, bottom, other=0.0: F.when(bottom > TINY, top / bottom).otherwise(F.lit(other))
    quads = [c(f"q{i}") for i in range(4)]
    most, fewest = F.greatest(*quads), F.least(*quads)
    ring = lambda i: F.coalesce(c(f"ring_mean_{i}"), F.lit(0.0))
    rise = reduce(lambda s, i: s + F.greatest(ring(i) - ring(i - 1), F.lit(0.0)), range(1, RADIAL_BINS), F.lit(0.0))
    outer = reduce(lambda s, i: s + c(f"ring_{i}"), range(RADIAL_BINS // 2, RADIAL_BINS), F.lit(0.0))
    off = F.sqrt(F.pow(-c("peak.nx") - c("w") / 2.0, 2.0) + F.pow(-c("peak.ny") - c("h") / 2.0, 2.0))
    r_max = F.sqrt(F.pow(c("w") / 2.0, 2.0) + F.pow(c("h") / 2.0, 2.0))
    return sums.select(
        "image_id",
        F.least("h", "w").cast("double").alias("min_dim"),
        over(c("ring_0"), c("flux")).alias("center_fraction"),
        over(outer, c("flux")).alias("outer_fraction"),
        F.when(c("n_inner") > 0, c("n_zero") / c("n_inner")).otherwise(F.lit(0.0)).alias("interior_zero_frac"),
        over(most, fewest, 100.0).alias("quadrant_ratio"),
        over(most, c("flux")).alias("max_quadrant_frac"),
        over(c("flux_r3"), c("flux_r8")).alias("concentration"),
        over(rise, ring(0)).alias("total_rise"),
        F.when(r_max > 0, off / r_max).otherwise(F.lit(0.0)).alias("peak_offset_frac"),
        F.when(F.coalesce(c("bg_std"), F.lit(0.0)) > TINY, c("v_max") / c("bg_std")).otherwise(F.lit(0.0)).alias("snr"),
        F.when(F.sqrt("var") > TINY, c("kurt")).otherwise(F.lit(0.0)).alias("kurtosis_val"),
    )


PIXEL_SCHEMA = T.StructType(
    [T.StructField("image_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("h", "w", "y", "x")]
    + [T.StructField("v", T.DoubleType())]
)
