"""File and object names as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions.coords import fixed_text

# The instrument names that may stand in the third field of a product file name.
INSTRUMENTS = ["nircam", "niriss", "niri", "miri", "fgs"]

# Name patterns of the data.
BAND_PATTERN = r"(?i)(f\d+[a-z]?(?:-f\d+[a-z]?)*)"
CLEAR_PATTERN = r"(?i)(clearp?)"
REPORT_NAME_PATTERN = r"^t(\d+_\d+)([+-])(\d+_\d+)_[ri]$"
STRICT_NAME_PATTERN = r"^(-?\d+)_(\d+)_(-?\d+)_(\d+)_(f\w+)_(v\d+)$"
LEGACY_NAME_PATTERN = (
    r"^RA([+-]?\d+)h([+-]?\d+)m([\d.]+)s[^_]*_DEC(.)(\d+)d(\d+)m([\d.]+)s[^_]*_v(\d+)$"
)
SUBARRAY_PATTERN = r"(?i)-sub\d+p?$"
BRIGHT_SKY_PATTERN = r"(?i)-brightsky$"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.fits$", "")


def object_file_name(ra: Column, dec: Column, band: Column, version: Column, instrument: Column | None = None) -> Column:
    """``RA_DEC_[instrument_]band_vN.fits`` with six decimals."""
    middle = band if instrument is None else F.concat_ws("_", instrument, band)
    return F.format_string("%s_%s_%s_v%d.fits", fixed_text(ra, 6), fixed_text(dec, 6), middle, version)


def parse_object_file_name(name: Column) -> Column:
    """Struct (ra, dec, waveband, version), null when any part fails.

    The band is the second last field, so an instrument before it is tolerated.
    """
    p = F.split(stem(name), "_")
    version_text = F.element_at(p, -1)
    version = F.substring(version_text, 2, 20).try_cast("int")
    ra, dec = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    good = (F.size(p) >= 4) & version_text.startswith("v") & version.isNotNull() & ra.isNotNull() & dec.isNotNull()
    fields = F.struct(ra.alias("ra"), dec.alias("dec"), F.get(p, F.size(p) - 2).alias("waveband"), version.alias("version"))
    return F.when(good, fields)


def parse_legacy_name(name: Column) -> Column:
    """Struct (ra, dec, version) from ``RA..h..m..s_DEC±..d..m..s_vN``; Dec is positive only after a plus sign."""
    base = stem(name)

    def g(i: int) -> Column:
        return F.regexp_extract(base, LEGACY_NAME_PATTERN, i)

    ra = (g(1).try_cast("double") + g(2).try_cast("double") / 60.0 + g(3).try_cast("double") / 3600.0) * 15.0
    sign = F.when(g(4) == "+", 1.0).otherwise(-1.0)
    dec = sign * (g(5).try_cast("double") + g(6).try_cast("double") / 60.0 + g(7).try_cast("double") / 3600.0)
    version = g(8).try_cast("int")
    return F.when(
        version.isNotNull() & ra.isNotNull() & dec.isNotNull(),
        F.struct(ra.alias("ra"), dec.alias("dec"), version.alias("version")),
    )


def parse_report_name(name: Column) -> Column:
    """Struct (ra, dec) from ``t045_8870+0_5025_r``; null when the shape differs."""
    # One match rewrites the name as "45.887 0.5025"; a name of another shape has no blank and gives no numbers.
    plain = F.translate(F.regexp_replace(F.trim(name), REPORT_NAME_PATTERN, "$1 $2$3"), "_", ".")
    ra = F.substring_index(plain, " ", 1).try_cast("double")
    dec = F.substring_index(plain, " ", -1).try_cast("double")
    return F.when(plain.contains(" ") & ra.isNotNull() & dec.isNotNull(), F.struct(ra.alias("ra"), dec.alias("dec")))


def underscore_to_file(name: Column, mode: str = "scan") -> Column:
    """``218_144041_-44_192128_f115w_v1`` to ``218.144041_-44.192128_f115w_v1.fits``.

    ``scan`` looks for the filter field and the first negative field; ``strict`` wants the exact shape. Null on failure.
    """
    if mode == "strict":
        out = F.regexp_replace(name, STRICT_NAME_PATTERN, "$1.$2_$3.$4_$5_$6.fits")
        return F.when(name.rlike(STRICT_NAME_PATTERN), out)
    p = F.split(name, "_")
    spots = F.sequence(F.lit(0), F.size(p) - 1)
    filters = F.filter(spots, lambda i: F.get(p, i).startswith("f") & F.get(p, i).rlike(r"\d"))
    filter_at = F.get(filters, F.lit(0))
    negatives = F.filter(spots, lambda i: (i >= 1) & (i < filter_at) & F.get(p, i).startswith("-"))
    dec_at = F.coalesce(F.get(negatives, F.lit(0)), F.lit(2))
    dec_at = F.least(dec_at, filter_at)
    ra = F.array_join(F.slice(p, F.lit(1), dec_at), ".")
    dec = F.array_join(F.slice(p, dec_at + 1, filter_at - dec_at), ".")
    dec = F.regexp_replace(dec, r"^-\.", "-")
    tail = F.array_join(F.slice(p, filter_at + 1, F.size(p) - filter_at), "_")
    return F.when(filter_at.isNotNull(), F.concat(ra, F.lit("_"), dec, F.lit("_"), tail, F.lit(".fits")))


def structure_image_path(coord_stem: Column, telescope: Column, pair: Column, band: str) -> Column:
    """Panel image of the structure tool; one telescope also carries its band in folder and file."""
    flat = F.translate(coord_stem, ".", "_")
    folder = F.when(telescope == "SDSS", F.concat(flat, F.lit("_" + band))).otherwise(flat)
    return F.concat_ws(
        "/",
        F.concat_ws("_", pair, telescope),
        folder,
        F.concat(folder, F.lit("-J_logSpiralArcs-merged.png")),
    )


def waveband(name: Column, mode: str = "short") -> Column:
    """Waveband of a product file name.

    ``short`` takes the first filter pattern of the field; ``full`` keeps the whole field in lower case.
    """
    p = F.split(stem(name), "_")
    field = F.element_at(p, -2)
    if mode == "full":
        found = F.lower(field)
    else:
        found = F.lower(
            F.coalesce(
                F.nullif(F.regexp_extract(field, BAND_PATTERN, 1), F.lit("")),
                F.nullif(F.regexp_extract(field, CLEAR_PATTERN, 1), F.lit("")),
                F.lit("unclassified"),
            )
        )
    return F.when((F.size(p) >= 4) & (F.element_at(p, -1) == "i2d"), found).otherwise("unclassified")


def instrument(name: Column) -> Column:
    """Third field when it is a known instrument, else null."""
    third = F.lower(F.get(F.split(stem(name), "_"), F.lit(2)))
    return F.when(third.isin(INSTRUMENTS), third)


def is_plain_band(band: Column) -> Column:
    """Neither a subarray nor a bright-sky variant."""
    return ~band.rlike(SUBARRAY_PATTERN) & ~band.rlike(BRIGHT_SKY_PATTERN)


def in_requested_bands(band: Column, requested: str) -> Column:
    """Comma-separated request, compared in lower case."""
    return F.lower(band).isin([b.strip().lower() for b in requested.split(",")])


def score_text(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    plain = F.trim(value).try_cast("decimal(38,18)").cast("string")
    cut = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(cut.isin("-0", ""), F.lit("0")).otherwise(cut)


def download_url(uri: Column, base: str) -> Column:
    return F.concat(F.lit(base), uri)


def readable_bytes(size: Column) -> Column:
    """``12.00 KB`` and so on, up to TB."""
    out = F.lit(None).cast("string")
    units = ["TB", "GB", "MB", "KB", "B"]
    for power, unit in zip((4, 3, 2, 1, 0), units):
        scaled = F.concat(fixed_text(size / float(1024**power), 2), F.lit(f" {unit}"))
        out = scaled if power == 4 else F.when(size / float(1024**power) < 1024, scaled).otherwise(out)
    return out


def level_text(value: Column) -> Column:
    """Calibration level as text: ``3.0`` becomes ``3``, other numbers and words stay, missing becomes blank."""
    clean = F.trim(value.cast("string"))
    number = clean.try_cast("double")
    missing = value.isNull() | (clean == "") | (F.lower(clean) == "nan")
    return (
        F.when(missing, "")
        .when(number == F.floor(number), F.floor(number).cast("string"))
        .otherwise(clean)
    )


def coalesce_columns(df: DataFrame, aliases: list[str]) -> Column:
    """First present and filled alias, in order; blank when the table has none of them."""
    present = [F.col(f"`{a}`").cast("string") for a in aliases if a in df.columns]
    return F.coalesce(*present) if present else F.lit("")


def score_bin(score: Column, bins: int = 10) -> Column:
    """Label such as ``0.1-0.2``; a score of 1 belongs to the last bin."""
    low = F.least(F.floor(score * bins).cast("int"), F.lit(bins - 1))
    return F.format_string("%.1f-%.1f", low / float(bins), (low + 1) / float(bins))


def shard_number(one_based: Column, capacity: int) -> Column:
    """Shard of the i-th record when each holds ``capacity``."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return (F.floor((one_based - 1) / float(capacity)) + 1).cast("bigint")
