"""Image features and apertures from tile rows.

A tile row is (image_id, h, w, y0, x0, rows, cols, values), so an image of any size is many rows. One shuffle brings to every tile the rims of
its neighbours and the pixels that the image turned by 180 degrees has there; one pass over each tile then gives sums that merge
over an image: moments, rings, quadrants, blurred variances, row and column sums, and differences to the turned image. A second
pass counts what depends on those. Images of one tile send nothing but themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators import images
from skytable.operators.images import COARSE_SIGMA_RANGE, FEATURES, FINE_SIGMA, FLAT_VARIANCE, MIDDLE_SIGMA, RADIAL_BINS, TILE, TINY, TRUNCATE, _blur
from skytable.session import cut_lineage

BORDER = int(TRUNCATE * COARSE_SIGMA_RANGE[1] + 0.5)
_PLACE = ["h", "w", "y0", "x0", "rows", "cols"]
OWN, RIM, TURNED = 0, 1, 2


def tile_rows(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Tile rows of a pixel table; pixels without a row are 0."""
    ty, tx = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    held = pixels.groupBy("image_id", "h", "w", ty.alias("ty"), tx.alias("tx"))
    held = held.agg(F.array_sort(F.collect_list(F.struct(((F.col("y") % tile) * tile + F.col("x") % tile).cast("int").alias("at"), "v"))).alias("given"))
    y0, x0 = F.col("ty") * tile, F.col("tx") * tile
    rows, cols = F.least(F.lit(tile), F.col("h") - y0), F.least(F.lit(tile), F.col("w") - x0)
    sized = held.select("image_id", "h", "w", y0.alias("y0"), x0.alias("x0"), rows.cast("int").alias("rows"), cols.cast("int").alias("cols"), "given")
    whole = F.size("given") == F.col("rows") * F.col("cols")
    known = F.map_from_entries("given")
    places = F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), lambda i: F.floor(i / F.col("cols")).cast("int") * tile + i % F.col("cols"))
    padded = F.transform(places, lambda p: F.coalesce(F.element_at(known, p.cast("int")), F.lit(0.0)))
    return sized.select("image_id", *_PLACE, F.when(whole, F.col("given.v")).otherwise(padded).alias("values"))


def pixel_rows(tiles: DataFrame) -> DataFrame:
    """The pixel table of tile rows."""
    wide = tiles.select("image_id", *_PLACE, F.posexplode("values").alias("at", "v"))
    y, x = F.col("y0") + F.floor(F.col("at") / F.col("cols")).cast("int"), F.col("x0") + F.col("at") % F.col("cols")
    return wide.select("image_id", "h", "w", y.alias("y"), x.cast("int").alias("x"), "v")


def cleaned(tiles: DataFrame) -> DataFrame:
    """Missing values as 0, infinite ones as the greatest finite."""
    top = float(np.finfo("f8").max)
    value = lambda v: F.greatest(F.least(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(top)), F.lit(-top))
    return tiles.withColumn("values", F.transform("values", value))


def _arrays(batch: pa.RecordBatch, name: str = "values") -> list[np.ndarray]:
    lists = batch.column(name)
    flat, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _pieces(values: np.ndarray, h: int, w: int, y0: int, x0: int, tile: int, border: int, kind: int) -> Iterator[tuple]:
    """The parts of a rectangle that tiles, grown by ``border``, hold: (tile row, tile column, kind, y, x, part)."""
    rows, cols = values.shape
    span = lambda at, size, most: range(max(0, (at - border) // tile), min(-(-most // tile), (at + size - 1 + border) // tile + 1))
    for ty in span(y0, rows, h):
        for tx in span(x0, cols, w):
            own = (ty, tx) == (y0 // tile, x0 // tile)
            a, b = max(y0, ty * tile - border), min(y0 + rows, ty * tile + tile + border)
            c, d = max(x0, tx * tile - border), min(x0 + cols, tx * tile + tile + border)
            if a < b and c < d:
                yield ty, tx, OWN if own and kind == RIM else kind, a, c, values[a - y0 : b - y0, c - x0 : d - x0]


def _moments(values: np.ndarray) -> tuple[int, float, float, float, float]:
    """Count, mean, and the sums of the second to fourth powers of differences to it."""
    if not values.size:
        return 0, 0.0, 0.0, 0.0, 0.0
    mean = float(values.mean())
    d = values - mean
    q = d * d
    return values.size, mean, float(q.sum()), float((q * d).sum()), float((q * q).sum())


_SUMS = ["flux", "n_inner", "n_zero", "flux_r3", "flux_r8", "moment", "diff", *[f"q{i}" for i in range(4)], *[f"ring_{i}" for i in range(RADIAL_BINS)], *[f"count_{i}" for i in range(RADIAL_BINS)]]
# Groups of values whose moments merge: all pixels, the far ones, and the three blurred images.
_MERGED = ["all", "far", "b1", "b4", "b16"]
_PART = [
    *[f"{c} double" for c in _SUMS],
    *[f"{g}_{m} double" for g in _MERGED for m in ("n", "mean", "m2", "m3", "m4")],
    "v_max double",
    "v_min double",
    "peak struct<v:double,ny:int,nx:int>",
    "y0 int",
    "x0 int",
    "row_sums array<double>",
    "col_sums array<double>",
]


def _measured(grown: np.ndarray, turned: np.ndarray, h: int, w: int, y0: int, x0: int, rows: int, cols: int) -> dict:
    """Sums of one tile; ``grown`` has its rims, mirrored where the image ends."""
    own = grown[BORDER : BORDER + rows, BORDER : BORDER + cols]
    a = np.abs(own)
    dy, dx = np.arange(y0, y0 + rows)[:, None] - h / 2.0, np.arange(x0, x0 + cols)[None, :] - w / 2.0
    r2 = dy * dy + dx * dx
    r, r_max = np.sqrt(r2), float(np.sqrt((w / 2.0) ** 2 + (h / 2.0) ** 2))
    inner = r < r_max * 0.5
    ring = np.searchsorted(r_max * np.arange(RADIAL_BINS + 1) / RADIAL_BINS, r.ravel(), "right") - 1
    fluxes, counts = np.bincount(ring, a.ravel(), RADIAL_BINS + 1), np.bincount(ring, minlength=RADIAL_BINS + 1)
    top, left = np.arange(y0, y0 + rows) < h // 2, np.arange(x0, x0 + cols) < w // 2
    quarters = [a[np.ix_(t, c)].sum() for t in (top, ~top) for c in (left, ~left)]
    at = int(own.argmax())
    shift = float(own.mean())
    blurs = [_blur(grown - shift, s, BORDER, rows, cols) for s in (FINE_SIGMA, MIDDLE_SIGMA, max(COARSE_SIGMA_RANGE[0], min(COARSE_SIGMA_RANGE[1], min(h, w) / 5.0)))]
    sums = [a.sum(), inner.sum(), (own[inner] == 0).sum(), a[r < 3].sum(), a[r < 8].sum(), (a * r2).sum(), np.abs(own - turned).sum(), *quarters, *fluxes[:RADIAL_BINS], *counts[:RADIAL_BINS]]
    out = dict(zip(_SUMS, map(float, sums), strict=True))
    for group, values, add in zip(_MERGED, (own, own[r > r_max * 0.7], *blurs), (0.0, 0.0, shift, shift, shift), strict=True):
        n, mean, *powers = _moments(values)
        out |= dict(zip([f"{group}_{m}" for m in ("n", "mean", "m2", "m3", "m4")], map(float, (n, mean + add, *powers)), strict=True))
    out |= {"v_max": float(own.max()), "v_min": float(own.min()), "peak": {"v": float(own.flat[at]), "ny": -(y0 + at // cols), "nx": -(x0 + at % cols)}}
    return out | {"y0": y0, "x0": x0, "row_sums": own.sum(1).tolist(), "col_sums": own.sum(0).tolist()}


def tile_sums(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The mergeable sums of every tile, after one shuffle of tiles and rims."""
    id_type = tiles.schema["image_id"].dataType.simpleString()
    keys = ["image_id", "h", "w", "ty", "tx"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (values, place) in enumerate(zip(_arrays(batch), batch.select(_PLACE).to_pylist(), strict=True)):
                h, w, y0, x0, rows, cols = place.values()
                values = values.reshape(rows, cols)
                found = list(_pieces(values, h, w, y0, x0, tile, BORDER, RIM))
                found += _pieces(values[::-1, ::-1], h, w, h - y0 - rows, w - x0 - cols, tile, 0, TURNED)
                columns = list(zip(*[(ty, tx, kind, y, x, *p.shape, p.ravel().tolist()) for ty, tx, kind, y, x, p in found], strict=True))
                ids = batch.column("image_id").take(pa.array([k] * len(found)))
                kinds = [pa.int32()] * 7 + [pa.list_(pa.float64())]
                same = [pa.array([v] * len(found), pa.int32()) for v in (h, w)]
                yield pa.RecordBatch.from_arrays([ids, *same, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [*keys, "kind", "y", "x", "rows", "cols", "values"])

    dealt = tiles.mapInArrow(deal, f"image_id {id_type}, h int, w int, ty int, tx int, kind int, y int, x int, rows int, cols int, values array<double>")
    dealt = dealt.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", "kind")
    names = [f.split(" ", 1)[0] for f in _PART]
    arrow = pa.schema([(n, {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}.get(f.split(" ", 1)[1], pa.struct([("v", pa.float64()), ("ny", pa.int32()), ("nx", pa.int32())]))) for n, f in zip(names, _PART, strict=True)])

    def one(key: tuple, pieces: list[tuple]) -> dict:
        _, h, w, ty, tx = key
        y0, x0 = ty * tile, tx * tile
        rows, cols = min(tile, h - y0), min(tile, w - x0)
        ya, xa, yb, xb = max(0, y0 - BORDER), max(0, x0 - BORDER), min(h, y0 + rows + BORDER), min(w, x0 + cols + BORDER)
        inside, turned = np.zeros((yb - ya, xb - xa)), np.zeros((rows, cols))
        for kind, y, x, part in pieces:
            into, oy, ox = (turned, y0, x0) if kind == TURNED else (inside, ya, xa)
            into[y - oy : y - oy + part.shape[0], x - ox : x - ox + part.shape[1]] = part
        pad = ((BORDER - (y0 - ya), BORDER - (yb - y0 - rows)), (BORDER - (x0 - xa), BORDER - (xb - x0 - cols)))
        return _measured(np.pad(inside, pad, mode="symmetric"), turned, h, w, y0, x0, rows, cols)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, done = None, [], []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([d for _, d in done], arrow)
            heads = [pa.array([k[i] for k, _ in done], t) for i, t in ((0, id_kind), (1, pa.int32()), (2, pa.int32()))]
            return pa.RecordBatch.from_arrays([*heads, *made.columns], ["image_id", "h", "w", *names])

        for batch in batches:
            id_kind = batch.schema.field("image_id").type
            for values, r in zip(_arrays(batch), batch.drop_columns(["values"]).to_pylist(), strict=True):
                own = tuple(r[k] for k in keys)
                if own != key:
                    if key is not None:
                        done.append((key, one(key, pieces)))
                    key, pieces = own, []
                    if len(done) >= 64:
                        yield flush()
                        done = []
                pieces.append((r["kind"], r["y"], r["x"], values.reshape(r["rows"], r["cols"])))
        if key is not None:
            done.append((key, one(key, pieces)))
            yield flush()

    return dealt.mapInArrow(measure, f"image_id {id_type}, h int, w int, {', '.join(_PART)}")


def merged(parts: DataFrame) -> DataFrame:
    """One row per image, in the form of :func:`skytable.operators.images.image_sums`, with blurred and line variances."""
    n, mean = lambda g: F.col(f"{g}_n"), lambda g: F.col(f"{g}_mean")
    means = parts.groupBy("image_id").agg(*[F.try_divide(F.sum(n(g) * mean(g)), F.sum(n(g))).alias(f"{g}_to") for g in _MERGED])
    d = lambda g: mean(g) - F.col(f"{g}_to")
    second = {g: F.sum(F.when(n(g) > 0, F.col(f"{g}_m2") + n(g) * d(g) * d(g))) for g in _MERGED}
    fourth = F.sum(F.col("all_m4") + 4.0 * d("all") * F.col("all_m3") + 6.0 * d("all") * d("all") * F.col("all_m2") + n("all") * F.pow(d("all"), 4.0))
    aggregates = [F.sum(c).alias(c) for c in _SUMS] + [F.try_divide(second[g], F.sum(n(g))).alias(f"{g}_var") for g in _MERGED]
    aggregates += [F.max("h").alias("h"), F.max("w").alias("w"), F.sum(n("all")).cast("bigint").alias("n"), F.max("all_to").alias("mean"), fourth.alias("m4")]
    aggregates += [F.max("v_max").alias("v_max"), F.min("v_min").alias("v_min"), F.max("peak").alias("peak")]
    whole = parts.join(means, "image_id").groupBy("image_id").agg(*aggregates)

    def lines(sums: str, start: str, other: str, name: str) -> DataFrame:
        each = parts.select("image_id", start, other, F.posexplode(sums).alias("k", "s")).groupBy("image_id", (F.col(start) + F.col("k")).alias("line"))
        each = each.agg((F.sum("s") / F.first(other)).alias("m"))
        return each.groupBy("image_id").agg(F.var_pop("m").alias(name))

    whole = whole.join(lines("row_sums", "y0", "w", "row_var"), "image_id").join(lines("col_sums", "x0", "h", "col_var"), "image_id")
    kurt = F.when(F.col("all_var") > 0, F.col("m4") / F.col("n") / (F.col("all_var") * F.col("all_var")) - 3.0)
    rings = [F.try_divide(F.col(f"ring_{i}"), F.col(f"count_{i}")).alias(f"ring_mean_{i}") for i in range(RADIAL_BINS)]
    return whole.select("*", F.col("all_var").alias("var"), kurt.alias("kurt"), F.sqrt("far_var").alias("bg_std"), *rings)


# ---- apertures ---------------------------------------------------------------------------------------------------

# Radii in point-spread widths with their least values, radii without a known width, factors of the semi-major axis, their
# ends, and the ellipse of the Kron radius.
PSF_INNER, PSF_OUTER, PLAIN_RADII = (1.5, 1.5), (4.0, 4.0), (3.0, 8.0)
FLUX_REACH, PSF_REACH, REACH_ENDS, KRON_REACH = 6.0, 8.0, (5.0, 200.0), 6.0
_CIRCLES = ["inner", "outer", "flux", "half"]


# So many pixels of apertures are measured in one call.
CALL_PIXELS = 1 << 20


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``first`` to ``first + count - 1`` of every entry, and the entry of each number."""
    entry = np.repeat(np.arange(len(count)), count)
    return np.arange(len(entry)) - (np.cumsum(count) - count)[entry] + first[entry], entry


def _apertures(tiles: list[np.ndarray], tile: np.ndarray, place: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, tuple]:
    """The parts of detections' sums that lie in one tile each, for all of them at once: ``tile`` and ``place`` (y0, x0, rows, cols) tell each detection's.

    Sums (circles, then the two Kron sums) by detection, which detections reach their tile, and the light by squared distance: (detection, distance, light)
    in order. A circle takes one difference of prefix sums for each row.
    """
    n, ends = len(tile), []
    for at, start, size in (("y", "y0", "rows"), ("x", "x0", "cols")):
        low = np.maximum(place[start], np.ceil(s[at] - s["reach"]).astype(np.int64))
        high = np.minimum(place[start] + place[size] - 1, np.floor(s[at] + s["reach"]).astype(np.int64))
        ends += [low, np.maximum(high - low + 1, 0)]
    ya, tall, xa, broad = ends
    reached = (tall > 0) & (broad > 0)
    tall = np.where(reached, tall, 0)
    sizes = np.array([t.size for t in tiles], dtype=np.int64)
    flat, starts = np.concatenate([t.ravel() for t in tiles]), (np.cumsum(sizes) - sizes)[tile]
    # Every row of a tile has one prefix sum more than pixels.
    before = [np.zeros((t.shape[0], t.shape[1] + 1)) for t in tiles]
    for t, sums in zip(tiles, before, strict=True):
        np.cumsum(t, axis=1, out=sums[:, 1:])
    longer = np.array([t.size for t in before], dtype=np.int64)
    runs, run_starts = np.concatenate([t.ravel() for t in before]), (np.cumsum(longer) - longer)[tile]

    y, of = _ranges(ya, tall)
    dy, line = y - s["y"][of], run_starts[of] + (y - place["y0"][of]) * (place["cols"][of] + 1)
    sums = []
    for c in _CIRCLES:
        radius, cols = s[f"r_{c}"][of], place["cols"][of]
        inside = np.abs(dy) <= radius
        half = np.sqrt(np.maximum(radius * radius - dy**2, 0.0))
        low = np.clip(np.ceil(s["x"][of] - half).astype(np.int64) - place["x0"][of], 0, cols)
        high = np.clip(np.floor(s["x"][of] + half).astype(np.int64) + 1 - place["x0"][of], 0, cols)
        light = runs[line + np.maximum(low, high)] - runs[line + low]
        sums.append(np.bincount(of[inside], light[inside], n))

    x, row = _ranges(xa[of], broad[of])
    of, y = of[row], y[row]
    v = flat[starts[of] + (y - place["y0"][of]) * place["cols"][of] + x - place["x0"][of]]
    wide, high = x - s["x"][of], dy[row]
    square = wide * wide + high * high
    cos, sin = np.cos(s["theta"])[of], np.sin(s["theta"])[of]
    a, b = np.maximum(s["a"], 0.01)[of], np.maximum(s["b"], 0.01)[of]
    ell = np.sqrt(((wide * cos + high * sin) / a) ** 2 + ((high * cos - wide * sin) / b) ** 2)
    held = (ell <= KRON_REACH) & (square <= s["reach"][of] ** 2)
    sums += [np.bincount(of[held], (ell * v)[held], n), np.bincount(of[held], v[held], n)]
    near = square <= np.maximum(s["r_flux"], s["r_half"])[of] ** 2
    of, square, v = of[near], square[near], v[near]
    order = np.lexsort((square, of))
    of, square, v = of[order], square[order], v[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (square[1:] != square[:-1])
    return sums, reached, (of[new], square[new], np.bincount(np.cumsum(new) - 1, v, int(new.sum())))


def aperture_measures(detections: DataFrame, tiles: DataFrame, psf: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """H5: (image_id, object, concentration, r25, r50, r75, kron_radius, compact) of every detection. A pixel counts by its centre.

    ``psf``: (image_id, psf_fwhm) in pixels; the two circles of the concentration follow it where it is known. Pixels at one distance count together.
    Where the flux in a circle is not positive its radii are null; where a Kron sum is not positive the radius is 0, which is compact. Apertures end
    at 200 pixels, so what a detection sends is bounded; a tile and its detections meet once.
    """
    known = detections.select("image_id", "object", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "a", "b", "theta")])
    known = known.join(psf.select("image_id", F.col("psf_fwhm").cast("double").alias("fwhm")), "image_id", "left") if psf is not None else known.withColumn("fwhm", F.lit(None).cast("double"))
    reach = lambda factor: F.greatest(F.lit(REACH_ENDS[0]), F.least(factor * F.col("a"), F.lit(REACH_ENDS[1])))
    inner, outer = (F.when(F.col("fwhm").isNull(), F.lit(plain)).otherwise(F.greatest(F.lit(ends[0]), ends[1] * F.col("fwhm"))) for ends, plain in zip((PSF_INNER, PSF_OUTER), PLAIN_RADII, strict=True))
    known = known.select("*", inner.alias("r_inner"), outer.alias("r_outer"), reach(FLUX_REACH).alias("r_flux"), reach(PSF_REACH).alias("r_half"))
    known = known.withColumn("reach", F.greatest("r_outer", "r_flux", "r_half"))
    # An image has no tiles before 0.
    known = known.filter((F.col("x") + F.col("reach") >= 0) & (F.col("y") + F.col("reach") >= 0))
    span = lambda at: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - F.col("reach")) / tile).cast("int")), F.floor((F.col(at) + F.col("reach")) / tile).cast("int")))
    spot = ["object", "x", "y", "a", "b", "theta", "reach", *[f"r_{c}" for c in _CIRCLES]]
    asked = known.withColumn("ty", span("y")).withColumn("tx", span("x"))
    asked = asked.select("image_id", "ty", "tx", F.struct(*spot).alias("spot"))
    at_tile = [F.floor(F.col(c) / tile).cast("int").alias(t) for c, t in (("y0", "ty"), ("x0", "tx"))]
    held = tiles.select("image_id", *at_tile, F.struct(*_PLACE).alias("place"), "values")
    # A tile comes before the detections near it.
    both = held.unionByName(asked, allowMissingColumns=True).repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", F.col("spot").isNotNull())
    id_type, object_type = (dict(known.dtypes)[c] for c in ("image_id", "object"))

    def told(batch: pa.RecordBatch, rows: list[int], of: list[int], tiles: list[np.ndarray], places: list[dict]) -> pa.RecordBatch:
        """The parts of the spots in some rows of a batch, each with the number of its tile."""
        picked = batch.take(pa.array(rows, pa.int64())).column("spot")
        number = {c: picked.field(c).to_numpy(zero_copy_only=False) for c in spot[1:]}
        place = {c: np.array([places[i][c] for i in of], dtype=np.int64) for c in _PLACE[2:]}
        sums, reached, (owner, square, light) = _apertures(tiles, np.array(of, dtype=np.int64), place, number)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]), pa.int32())
        columns = [batch.column("image_id").take(pa.array(rows, pa.int64())), *[picked.field(c) for c in ("object", "r_flux", "r_half")], *[pa.array(v, pa.float64()) for v in sums]]
        columns += [pa.ListArray.from_arrays(ends, pa.array(v, pa.float64())) for v in (square, light)]
        names = ["image_id", "object", "r_flux", "r_half", *_CIRCLES, "kron_top", "kron_bottom", "at", "light"]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(reached))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, place = None, None, None
        for batch in batches:
            is_tile = batch.column("spot").is_null().to_pylist()
            reaches = batch.column("spot").field("reach").to_pylist()
            places, rows, of, tiles, at, pixels = batch.column("place").to_pylist(), [], [], [], [], 0
            for k, own in enumerate(zip(*[batch.column(c).to_pylist() for c in ("image_id", "ty", "tx")], strict=True)):
                if is_tile[k]:
                    key, place = own, places[k]
                    values = np.asarray(batch.column("values")[k].values).reshape(place["rows"], place["cols"])
                elif own == key:
                    if not tiles or tiles[-1] is not values:
                        tiles.append(values)
                        at.append(place)
                        pixels += values.size
                    rows.append(k)
                    of.append(len(tiles) - 1)
                    pixels += min(values.size, int(2 * reaches[k] + 1) ** 2)
                    if pixels >= CALL_PIXELS:
                        yield told(batch, rows, of, tiles, at)
                        rows, of, tiles, at, pixels = [], [], [], [], 0
            if rows:
                yield told(batch, rows, of, tiles, at)

    numbers = ", ".join(f"{c} double" for c in ["r_flux", "r_half", *_CIRCLES, "kron_top", "kron_bottom"])
    parts = both.mapInArrow(measure, f"image_id {id_type}, object {object_type}, {numbers}, at array<double>, light array<double>")
    # The distances of a detection in all its tiles, put together and in order.
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "light"))))
    whole = parts.groupBy("image_id", "object").agg(
        F.max("r_flux").alias("r_flux"), F.max("r_half").alias("r_half"), *[F.sum(c).alias(c) for c in [*_CIRCLES, "kron_top", "kron_bottom"]], pairs.alias("profile")
    )
    shares = {"r25": (0.25, "flux"), "r50": (0.5, "half"), "r75": (0.75, "flux")}
    kinds = dict(whole.dtypes)
    passed = ["image_id", "object", *_CIRCLES, "kron_top", "kron_bottom"]

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in shares}
            numbers = batch.select(["r_flux", "r_half", "flux", "half"]).to_pylist()
            for profile, r in zip(batch.column("profile"), numbers, strict=True):
                inner = profile.values
                square, light = np.asarray(inner.field("at")), np.asarray(inner.field("light"))
                run = np.cumsum(light)
                last = np.append(square[1:] != square[:-1], True) if len(square) else np.zeros(0, bool)
                square, run = square[last], run[last]
                for name, (share, total) in shares.items():
                    hit = np.flatnonzero((run >= share * r[total]) & (square <= r[f"r_{total}"] ** 2)) if r[total] > 0 else ()
                    out[name].append(float(np.sqrt(square[hit[0]])) if len(hit) else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *[pa.array(v, pa.float64()) for v in out.values()]], [*passed, *out])

    done = whole.mapInArrow(radii, ", ".join([*[f"{c} {kinds[c]}" for c in passed], *[f"{c} double" for c in shares]]))
    positive = (F.col("kron_top") > 0) & (F.col("kron_bottom") > 0)
    kron = F.when(positive, F.col("kron_top") / F.col("kron_bottom")).otherwise(F.lit(0.0))
    return done.select("image_id", "object", (F.col("inner") / F.greatest("outer", F.lit(1e-10))).alias("concentration"), *shares, kron.alias("kron_radius"), (kron < images.MIN_KRON).alias("compact"))


# ---- all features ------------------------------------------------------------------------------------------------


def _level_counts(tiles: DataFrame, sums: DataFrame) -> DataFrame:
    """Second pass: pixels near the maximum, and those above three deviations, of every tile."""
    levels = sums.select("image_id", (F.col("v_max") - 0.05 * (F.col("v_max") - F.col("v_min"))).alias("near"), (F.col("mean") + 3.0 * F.sqrt("var")).alias("level"))
    both = tiles.join(levels, "image_id")
    indexed = F.transform("values", lambda v, i: F.when(v > F.col("level"), i))
    bright = F.filter(indexed, lambda i: i.isNotNull())
    return both.select("image_id", *_PLACE, F.size(F.filter("values", lambda v: v >= F.col("near"))).alias("near"), bright.alias("bright"))


def morphology(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The 22 features per image. A flat image has all features 0 but its size.

    Starts jobs while the plan is built: sums and marked pixels are tables on shared storage.
    """
    clean = cleaned(tiles)
    sums = cut_lineage(merged(cut_lineage(tile_sums(clean, tile))))
    lively = sums.filter(F.col("var") >= FLAT_VARIANCE)
    live = clean.join(lively.select("image_id"), "image_id", "left_semi")
    counted = cut_lineage(_level_counts(clean, lively))
    near = counted.groupBy("image_id").agg(F.sum("near").alias("near"))
    marked = counted.select("image_id", *_PLACE, F.explode("bright").alias("at"))
    y, x = F.col("y0") + F.floor(F.col("at") / F.col("cols")).cast("int"), F.col("x0") + F.col("at") % F.col("cols")
    marked = marked.select("image_id", "h", "w", y.alias("y"), x.cast("int").alias("x"), F.lit(1.0).alias("v"))
    sources = images.label_pixels(marked, False, tile).groupBy("image_id").agg(F.countDistinct("comp").cast("double").alias("n_sources"))
    c = F.col
    over = lambda top, bottom, other=0.0: F.when(bottom > TINY, top / bottom).otherwise(F.lit(other))
    energy = {f"e{k}": c(f"b{k}_var") / c("var") for k in ("1", "4", "16")}
    direct = lively.select(
        "image_id",
        *[e.alias(k) for k, e in energy.items()],
        over(energy["e16"], energy["e1"]).alias("coarse_to_fine"),
        (F.greatest("row_var", "col_var") / F.greatest(F.least("row_var", "col_var"), F.lit(TINY))).alias("directional_ratio"),
        over(c("diff"), 2.0 * c("flux")).alias("asymmetry"),
        c("n").alias("_n"),
    )
    pixels = pixel_rows(live)
    parts = [direct, near, images.simple_features(lively), sources, images.half_light_radius(pixels, lively), images.gini(pixels, lively), images.bright_moment(pixels, lively)]
    size = sums.select("image_id", F.least("h", "w").cast("double").alias("_side"))
    full = reduce(lambda a, b: a.join(b, "image_id", "left"), parts, size).withColumn("saturated_fraction", c("near") / c("_n"))

    def value(name: str) -> Column:
        return F.coalesce(name, "_side" if name == "min_dim" else F.lit(0.0)).alias(name)

    return full.select("image_id", *[value(f) for f in FEATURES])
