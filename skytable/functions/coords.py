"""Sphere and image-plane expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 3600.0
HOURS_TO_DEGREES = 15.0


def _num(text: Column) -> Column:
    return text.try_cast("double")


def sexagesimal_ra(text: Column) -> Column:
    """``HH:MM:SS.s`` to degrees; null when a part is missing or not a number."""
    p = F.split(F.trim(text), ":")
    return (_num(F.get(p, F.lit(0))) + _num(F.get(p, F.lit(1))) / 60.0 + _num(F.get(p, F.lit(2))) / 3600.0) * HOURS_TO_DEGREES


def sexagesimal_dec(text: Column) -> Column:
    """``±DD:MM:SS.s`` to degrees. The sign comes from the text, so ``-00:30:00`` stays negative."""
    clean = F.trim(text)
    sign = F.when(clean.startswith("-"), -1.0).otherwise(1.0)
    p = F.split(F.regexp_replace(clean, "^[+-]+", ""), ":")
    return sign * (_num(F.get(p, F.lit(0))) + _num(F.get(p, F.lit(1))) / 60.0 + _num(F.get(p, F.lit(2))) / 3600.0)


def grid_key(value: Column, decimals: int) -> Column:
    """Integer grid position; replaces a rounded float as join key."""
    return F.floor(value * float(10**decimals) + 0.5).cast("bigint")


def fixed_text(value: Column, decimals: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value with ties to even.

    The JVM formatter rounds the shortest decimal form instead, which differs for values such as 38.495. Below 1024 a
    double is a whole multiple of 2^-52, so decimal arithmetic is exact; larger values use the formatter.
    """
    unit = 1 << 52
    size = F.abs(value)
    scaled = (size * float(unit)).cast("bigint").cast("decimal(20,0)") * F.lit(10**decimals).cast("decimal(10,0)")
    whole = F.floor(scaled / F.lit(unit).cast("decimal(18,0)")).cast("bigint")
    rest = scaled - whole.cast("decimal(20,0)") * F.lit(unit).cast("decimal(18,0)")
    half = F.lit(unit // 2).cast("decimal(18,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    units = whole + up.cast("int")
    sign = F.when((value < 0), F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(
        sign,
        F.floor(units / 10**decimals).cast("string"),
        F.lit("."),
        F.lpad((units % 10**decimals).cast("string"), decimals, "0"),
    )
    return F.when(size < 1024, exact).otherwise(F.format_string(f"%.{decimals}f", value))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation (haversine)."""
    dlat = F.radians(dec2 - dec1) / 2.0
    dlon = F.radians(ra2 - ra1) / 2.0
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.degrees(2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * ARCSEC


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def chord(arcsec: float) -> float:
    """Straight-line distance between two unit vectors that far apart."""
    return 2.0 * math.sin(math.radians(arcsec / ARCSEC) / 2.0)


def flat_match(ra1: Column, dec1: Column, ra2: Column, dec2: Column, arcsec: float) -> Column:
    """Small-angle match on the flat plane: raw box first, then the scaled distance. RA does not wrap."""
    tol = arcsec / ARCSEC
    dra, ddec = ra1 - ra2, dec1 - dec2
    scaled = dra * F.cos(F.radians((dec1 + dec2) / 2.0))
    return (F.abs(dra) <= tol) & (F.abs(ddec) <= tol) & (F.sqrt(scaled * scaled + ddec * ddec) <= tol)


def degrees_text(value: Column, is_ra: bool) -> Column:
    """``22h14m55.00s`` or ``+45d22m30.00s``; hours and minutes truncate, seconds may print as 60.00."""
    size = F.abs(value)
    whole_of = size / HOURS_TO_DEGREES if is_ra else size
    whole = F.floor(whole_of).cast("int")
    minutes = F.floor((whole_of - whole) * 60.0).cast("int")
    seconds = ((whole_of - whole) * 60.0 - minutes) * 60.0
    if is_ra:
        return F.format_string("%02dh%02dm%05.2fs", whole, minutes, seconds)
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(sign, F.format_string("%02dd%02dm%05.2fs", whole, minutes, seconds))


def coords_text(ra: Column, dec: Column) -> Column:
    """Legacy ``RA..._DEC...`` prefix."""
    return F.concat(F.lit("RA"), degrees_text(ra, True), F.lit("_DEC"), degrees_text(dec, False))


def pixel_to_sky(pixel_area: Column, ref_x: Column, ref_y: Column, x: Column, y: Column, ra0: Column, dec0: Column):
    """Tangent-plane pixel position to (ra, dec).

    ``x, y`` count from 0 and the reference pixel from 1; RA grows against x.
    """
    scale = F.radians(F.sqrt(pixel_area) / ARCSEC)
    xi = -(x + 1.0 - ref_x) * scale
    eta = (y + 1.0 - ref_y) * scale
    r0, d0 = F.radians(ra0), F.radians(dec0)
    den = F.cos(d0) - eta * F.sin(d0)
    ra = F.degrees(r0 + F.atan2(xi, den))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + den * den)))
    return F.pmod(ra, F.lit(360.0)), dec


def sky_to_pixel(scale_deg: Column, crpix_x: Column, crpix_y: Column, ra: Column, dec: Column, ra0: Column, dec0: Column):
    """Inverse of :func:`pixel_to_sky`; also returns whether the point is on the visible half of the sphere."""
    r, d = F.radians(ra - ra0), F.radians(dec)
    d0 = F.radians(dec0)
    den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(r)
    step = F.radians(scale_deg)
    xi = F.cos(d) * F.sin(r) / den
    eta = (F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(r)) / den
    return crpix_x - 1.0 - xi / step, crpix_y - 1.0 + eta / step, den > 0


def inside_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Half-pixel bounds: a pixel owns the square half a step around its centre."""
    return (x >= -0.5) & (x < width - 0.5) & (y >= -0.5) & (y < height - 0.5)


def centre_distance(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Squared distance to the image centre in units of the image size."""
    dx = (x - (width - 1.0) / 2.0) / F.greatest(width, F.lit(1))
    dy = (y - (height - 1.0) / 2.0) / F.greatest(height, F.lit(1))
    return dx * dx + dy * dy


def object_size(a: Column, b: Column, pixel_area: Column):
    """(width, height, diameter) in arcsec from the axes in pixels."""
    step = F.sqrt(pixel_area)
    w, h = a * step, b * step
    return w, h, F.sqrt(w * w + h * h)


def rough_distance(diameter_arcsec: Column) -> Column:
    """Distance in light years for a typical 50,000 light-year object; null for size 0."""
    return F.try_divide(F.lit(50000.0), diameter_arcsec / ARCSEC) * 60.0


def crop_box(x: Column, y: Column, a: Column, b: Column, width: Column, height: Column, padding: float) -> dict[str, Column]:
    """Thumbnail box around a detection, clipped to the image."""
    half = (F.lit(padding) * F.greatest(a, b)).cast("int")
    cx, cy = x.cast("int"), y.cast("int")
    return {
        "x_min": F.greatest(F.lit(0), cx - half),
        "x_max": F.least(width, cx + half),
        "y_min": F.greatest(F.lit(0), cy - half),
        "y_max": F.least(height, cy + half),
    }


def crop_reason(x, y, box_w, box_h, width, height, nan_fraction, min_size=20, max_size=200, margin=10, max_nan=0.02) -> Column:
    """First reason a crop is refused, else ``ok``."""
    cx, cy = x.cast("int"), y.cast("int")
    near_edge = (cx < margin) | (cx >= width - margin) | (cy < margin) | (cy >= height - margin)
    return (
        F.when(near_edge, "edge")
        .when((box_w < min_size) | (box_h < min_size), "small")
        .when((box_w > max_size) | (box_h > max_size), "large")
        .when(nan_fraction > max_nan, "nan")
        .otherwise("ok")
    )


def footprint(x, y, width, height, pixel_area, ref_x, ref_y, ra0, dec0) -> dict[str, Column]:
    """RA/Dec interval covered by a crop centred at pixel (x, y)."""
    lo_ra, lo_dec = pixel_to_sky(pixel_area, ref_x, ref_y, x + width / 2.0, y - height / 2.0, ra0, dec0)
    hi_ra, hi_dec = pixel_to_sky(pixel_area, ref_x, ref_y, x - width / 2.0, y + height / 2.0, ra0, dec0)
    return {"ra_lo": lo_ra, "ra_hi": hi_ra, "dec_lo": lo_dec, "dec_hi": hi_dec}


def in_footprint(ra, dec, ra_lo, ra_hi, dec_lo, dec_hi) -> Column:
    """Interval test; ``ra_lo > ra_hi`` means the interval crosses RA 0."""
    in_ra = F.when(ra_lo <= ra_hi, (ra >= ra_lo) & (ra <= ra_hi)).otherwise((ra >= ra_lo) | (ra <= ra_hi))
    return in_ra & (dec >= dec_lo) & (dec <= dec_hi)


def similar_size(group_size: Column, size: Column, fraction: float = 0.5, floor_arcsec: float = 1.0) -> Column:
    """Sizes agree within a fraction of the group's, or within a floor; an unknown size agrees with all."""
    near = F.abs(group_size - size) <= F.greatest(F.lit(fraction) * group_size, F.lit(floor_arcsec))
    return F.coalesce(near, F.lit(True))
