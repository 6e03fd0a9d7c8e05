"""Expressions on names, coordinates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, detections, haversine, view
from skytable.functions import coords, names
from skytable.operators import stats
from skytable.plans import catalogs
from skytable.sources import tables

R = Registry()
Q = "'"

SEXA = (
    "select id, (cast(split_part(ra_text, ':', 1) as double) + cast(split_part(ra_text, ':', 2) as double) / 60 + cast(split_part(ra_text, ':', 3) as double) / 3600) * 15 as ra, "
    "(case when dec_text like '-%' then -1 else 1 end) * (cast(split_part(ltrim(dec_text, '+-'), ':', 1) as double) + cast(split_part(dec_text, ':', 2) as double) / 60 "
    "+ cast(split_part(dec_text, ':', 3) as double) / 3600) as dec from sexa"
)


@R.add("B1_B2_sexagesimal", ["sexa"], f"x as ({SEXA}) select id, round(ra, 9) as ra, round(dec, 9) as dec from x")
def sexagesimal(spark, folder):
    s = view(spark, folder, "sexa")
    return s.select(
        "id", F.round(coords.sexagesimal_ra(F.col("ra_text")), 9).alias("ra"), F.round(coords.sexagesimal_dec(F.col("dec_text")), 9).alias("dec")
    )


@R.add("N5_catalog_loaders", ["sexa"], f"x as ({SEXA}) select id, round(ra, 9) as ra, round(dec, 9) as dec, 'GZH-' || 'deep' || cast(id % 3 as varchar) as survey from x")
def loaders(spark, folder):
    s = view(spark, folder, "sexa").withColumn("imaging", F.concat(F.lit("  deep"), (F.col("id") % 3).cast("string"), F.lit(" ")))
    m = catalogs.master_catalog(s, "ra_text", "dec_text", catalogs.imaging_label(F.col("imaging")), sexagesimal=True)
    return m.select("id", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"), "survey")


@R.add(
    "N4_superclean",
    ["truth"],
    "select id, ra, dec from truth where try_cast(fraction as double) >= 0.9 and try_cast(fraction as double) < 1.0 and try_cast(votes as double) >= 5",
)
def superclean(spark, folder):
    return catalogs.superclean(view(spark, folder, "truth"), "fraction", "votes").select("id", "ra", "dec")


@R.add(
    "B3_degrees_text",
    ["cat_a"],
    "p as (select id, abs(ra + 0.00123) / 15 as hv, abs(dec + 0.00123) as dv, dec + 0.00123 < 0 as neg from cat_a), "
    "q as (select *, cast(floor(hv) as int) as h, cast(floor((hv - floor(hv)) * 60) as int) as hm, cast(floor(dv) as int) as d, cast(floor((dv - floor(dv)) * 60) as int) as dm from p) "
    "select id, printf('RA%02dh%02dm%05.2fs', h, hm, ((hv - h) * 60 - hm) * 60) || '_DEC' || case when neg then '-' else '+' end || "
    "printf('%02dd%02dm%05.2fs', d, dm, ((dv - d) * 60 - dm) * 60) as name from q",
)
def degrees_text(spark, folder):
    return view(spark, folder, "cat_a").select("id", coords.coords_text(F.col("ra") + 0.00123, F.col("dec") + 0.00123).alias("name"))


LEGACY = (
    "'RA' || lpad(cast(id % 24 as string), 2, '0') || 'h' || lpad(cast(id % 60 as string), 2, '0') || 'm' || cast(id % 50 as string) || '.5s_DEC' || "
    "case when id % 2 = 0 then '+' else '-' end || cast(id % 90 as string) || 'd' || cast(id % 60 as string) || 'm' || cast(id % 40 as string) || '.25s' || "
    "case when id % 11 = 0 then '_vx' else '_v' || cast(id % 5 as string) end || '.fits'"
)


@R.add(
    "B4_parse_legacy_name",
    ["cat_a"],
    "select id, case when id % 11 = 0 then null else round((id % 24 + (id % 60) / 60 + (id % 50 + 0.5) / 3600) * 15, 8) end as ra, "
    "case when id % 11 = 0 then null else round((case when id % 2 = 0 then 1 else -1 end) * (id % 90 + (id % 60) / 60 + (id % 40 + 0.25) / 3600), 8) end as dec, "
    "case when id % 11 = 0 then null else cast(id % 5 as int) end as version from cat_a",
)
def legacy(spark, folder):
    n = view(spark, folder, "cat_a").select("id", F.expr(LEGACY).alias("name")).withColumn("p", names.parse_legacy_name(F.col("name")))
    return n.select("id", F.round("p.ra", 8).alias("ra"), F.round("p.dec", 8).alias("dec"), F.col("p.version").alias("version"))


@R.add(
    "B5_B6_object_file_names",
    ["cat_a"],
    "p as (select id, printf('%.6f_%.6f_%s_v%d.fits', ra, dec, case when id % 2 = 0 then 'nircam_' else '' end || 'f' || cast(id % 500 as varchar) || 'w', id % 4 + 1) as name from cat_a) "
    "select id, name, round(cast(split_part(name, '_', 1) as double), 6) as ra, round(cast(split_part(name, '_', 2) as double), 6) as dec, "
    "'f' || cast(id % 500 as varchar) || 'w' as waveband, cast(id % 4 + 1 as int) as version from p",
)
def object_names(spark, folder):
    a = view(spark, folder, "cat_a")
    band = F.concat(F.lit("f"), (F.col("id") % 500).cast("string"), F.lit("w"))
    version = (F.col("id") % 4 + 1).cast("int")
    plain = names.object_file_name(F.col("ra"), F.col("dec"), band, version)
    full = names.object_file_name(F.col("ra"), F.col("dec"), band, version, F.lit("nircam"))
    n = a.select("id", F.when(F.col("id") % 2 == 0, full).otherwise(plain).alias("name")).withColumn("p", names.parse_object_file_name(F.col("name")))
    return n.select("id", "name", F.round("p.ra", 6).alias("ra"), F.round("p.dec", 6).alias("dec"), "p.waveband", "p.version")


@R.add(
    "B7_parse_report_name",
    ["truth_report", "cat_a"],
    "select row_id, case when row_id % 13 = 0 then null else round(a.ra, 4) end as ra, case when row_id % 13 = 0 then null else round(a.dec, 4) end as dec "
    "from truth_report t join cat_a a on a.id = t.row_id",
)
def report_names(spark, folder):
    t = view(spark, folder, "truth_report").withColumn("p", names.parse_report_name(F.col("name")))
    return t.select("row_id", F.round("p.ra", 4).alias("ra"), F.round("p.dec", 4).alias("dec"))


UNDER = (
    "cast(id % 360 as string) || '_' || cast(100000 + id as string) || '_' || case when id % 2 = 0 then '-' else '' end || cast(id % 90 as string) || '_' || "
    "cast(200000 + id as string) || '_' || case when id % 7 = 0 then 'clear' else 'f' || cast(id % 400 as string) || 'w' end || '_v1'"
)


@R.add(
    "B8_underscore_names",
    ["cat_a"],
    "p as (select id, case when id % 7 = 0 then null else cast(id % 360 as varchar) || '.' || cast(100000 + id as varchar) || '_' || case when id % 2 = 0 then '-' else '' end || "
    "cast(id % 90 as varchar) || '.' || cast(200000 + id as varchar) || '_f' || cast(id % 400 as varchar) || 'w_v1.fits' end as scan from cat_a) select id, scan, scan as strict from p",
)
def underscore_names(spark, folder):
    n = view(spark, folder, "cat_a").select("id", F.expr(UNDER).alias("n"))
    return n.select("id", names.underscore_to_file(F.col("n")).alias("scan"), names.underscore_to_file(F.col("n"), "strict").alias("strict"))


@R.add(
    "B9_structure_paths",
    ["cat_a"],
    "p as (select id, replace(printf('%.6f_%.6f', ra, dec), '.', '_') as s, case when id % 2 = 0 then 'SDSS' else 'JWST' end as t from cat_a) "
    "select id, 'pair_' || t || '/' || s || case when t = 'SDSS' then '_r' else '' end || '/' || s || case when t = 'SDSS' then '_r' else '' end || "
    "'-J_logSpiralArcs-merged.png' as path from p",
)
def structure_paths(spark, folder):
    a = view(spark, folder, "cat_a")
    tele = F.when(F.col("id") % 2 == 0, "SDSS").otherwise("JWST")
    return a.select("id", names.structure_image_path(F.format_string("%.6f_%.6f", "ra", "dec"), tele, F.lit("pair"), "r").alias("path"))


BAND = (
    "case when file_name not like '%\\_i2d.fits' escape '\\' then 'unclassified' else coalesce(nullif(lower(regexp_extract(field, '(f[0-9]+[a-z]?(?:-f[0-9]+[a-z]?)*)', 1, 'i')), ''), "
    "nullif(lower(regexp_extract(field, '(clearp?)', 1, 'i')), ''), 'unclassified') end"
)
BANDS = (
    f"b as (select id, file_name, split_part(file_name, '_', 5) as field from manifest_files), c as (select id, file_name, {BAND} as waveband, "
    "case when file_name like '%\\_i2d.fits' escape '\\' then lower(field) else 'unclassified' end as full_band, "
    "case when lower(split_part(file_name, '_', 4)) = 'zz' then 1 end as zz, lower(split_part(file_name, '_', 3)) as third from b) "
)


@R.add(
    "B10_B11_waveband_instrument",
    ["manifest_files"],
    # The third field of these names is the exposure, so the second expression shifts it away as archive names do.
    BANDS + "select id, waveband, full_band, case when lower(split_part(file_name, '_', 4)) in ('nircam', 'niriss', 'niri', 'miri', 'fgs') "
    "then lower(split_part(file_name, '_', 4)) end as instrument from c",
)
def wavebands(spark, folder):
    m = view(spark, folder, "manifest_files")
    short = F.regexp_replace("file_name", "^(jw[^_]*)_([^_]*)_", "$1-$2_")
    return m.select(
        "id", names.waveband(F.col("file_name")).alias("waveband"), names.waveband(F.col("file_name"), "full").alias("full_band"),
        names.instrument(short).alias("instrument"),
    )


@R.add(
    "B12_plain_requested_bands",
    ["manifest_files"],
    BANDS + "select id, full_band from c where not regexp_matches(full_band, '-sub[0-9]+p?$', 'i') and not regexp_matches(full_band, '-brightsky$', 'i') "
    "and lower(full_band) in ('clear-f150w', 'clear', 'clear-f200w-sub64')",
)
def plain_bands(spark, folder):
    m = view(spark, folder, "manifest_files").select("id", names.waveband(F.col("file_name"), "full").alias("full_band"))
    return m.filter(names.is_plain_band(F.col("full_band")) & names.in_requested_bands(F.col("full_band"), "Clear-F150W, clear, clear-f200w-sub64"))


@R.add(
    "D5_files_per_band",
    ["manifest_files"],
    BANDS + ", e as (select *, coalesce(case when lower(split_part(file_name, '_', 4)) in ('nircam', 'niriss', 'niri', 'miri', 'fgs') "
    "then lower(split_part(file_name, '_', 4)) end, 'unknown') as instrument from c) "
    "select instrument, waveband, count(*) as files, count(*) filter (where waveband = 'unclassified') as unclassified from e group by grouping sets ((instrument, waveband), ())",
)
def files_per_band(spark, folder):
    m = view(spark, folder, "manifest_files")
    short = F.regexp_replace("file_name", "^(jw[^_]*)_([^_]*)_", "$1-$2_")
    f = m.select(F.coalesce(names.instrument(short), F.lit("unknown")).alias("instrument"), names.waveband(F.col("file_name")).alias("waveband"))
    return stats.files_per_band(f).drop("level")


@R.add(
    "B13_grid_keys",
    ["cat_b"],
    "select id, cast(floor(ra * 1e4 + 0.5) as bigint) as k4, cast(floor(dec * 1e6 + 0.5) as bigint) as k6 from cat_b",
)
def grid_keys(spark, folder):
    return view(spark, folder, "cat_b").select("id", coords.grid_key(F.col("ra"), 4).alias("k4"), coords.grid_key(F.col("dec"), 6).alias("k6"))


@R.add(
    "B14_score_text",
    ["lines"],
    "p as (select l_orderkey, l_linenumber, cast(cast(round(l_discount * 100) as bigint) as varchar) as c from lines) "
    "select l_orderkey, l_linenumber, case when c = '0' then '0' when length(c) = 1 then '0.0' || c else '0.' || rtrim(c, '0') end as score_text from p",
)
def score_text(spark, folder):
    t = F.concat(F.lit(" "), F.format_string("%.6f", "l_discount"))
    return view(spark, folder, "lines").select("l_orderkey", "l_linenumber", names.score_text(t).alias("score_text"))


@R.add("B15_download_url", ["products"], "select id, 'https://archive.example/file?uri=' || uri as url from products")
def download_url(spark, folder):
    return view(spark, folder, "products").select("id", names.download_url(F.col("uri"), "https://archive.example/file?uri=").alias("url"))


SIZE = "l_extendedprice * pow(1024e0, l_linenumber % 5)"


@R.add(
    "B16_readable_bytes",
    ["lines"],
    f"p as (select l_orderkey, l_linenumber, {SIZE} as b from lines) select l_orderkey, l_linenumber, case when b < 1024 then printf('%.2f B', b) "
    "when b / 1024 < 1024 then printf('%.2f KB', b / 1024) when b / pow(1024, 2) < 1024 then printf('%.2f MB', b / pow(1024, 2)) "
    "when b / pow(1024, 3) < 1024 then printf('%.2f GB', b / pow(1024, 3)) else printf('%.2f TB', b / pow(1024, 4)) end as size from p",
)
def readable(spark, folder):
    return view(spark, folder, "lines").select("l_orderkey", "l_linenumber", names.readable_bytes(F.expr(SIZE)).alias("size"))


@R.add(
    "B17_level_text",
    ["products"],
    "select id, case when calib_level is null then '' when calib_level = '3.0' then '3' else calib_level end as level from products",
)
def level_text(spark, folder):
    return view(spark, folder, "products").select("id", names.level_text(F.col("calib_level")).alias("level"))


@R.add("B18_coalesce_columns", ["products"], "select id, coalesce(filename, uri) as first_found, '' as none_found from products")
def coalesced(spark, folder):
    p = view(spark, folder, "products")
    return p.select("id", names.coalesce_columns(p, ["missing", "filename", "uri"]).alias("first_found"), names.coalesce_columns(p, ["nothing"]).alias("none_found"))


@R.add(
    "B19_score_bins",
    ["lines"],
    "p as (select l_orderkey, l_linenumber, least(cast(floor(l_discount * 10 * 10) as int), 9) as b from lines) "
    "select l_orderkey, l_linenumber, printf('%.1f-%.1f', b / 10, (b + 1) / 10) as bin from p",
)
def score_bins(spark, folder):
    return view(spark, folder, "lines").select("l_orderkey", "l_linenumber", names.score_bin(F.col("l_discount") * 10).alias("bin"))


@R.add(
    "B35_B36_separations",
    ["cat_b", "cat_a"],
    f"select b.id, round({haversine('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 5) as sep, abs(a.ra - b.ra) <= 1/3600 and abs(a.dec - b.dec) <= 1/3600 and "
    "sqrt(pow((a.ra - b.ra) * cos(radians((a.dec + b.dec) / 2)), 2) + pow(a.dec - b.dec, 2)) <= 1/3600 as flat from cat_b b join cat_a a on a.id = b.id * 7",
)
def separations(spark, folder):
    a = view(spark, folder, "cat_a").select(F.col("id").alias("k"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    j = view(spark, folder, "cat_b").join(a, F.col("k") == F.col("id") * 7)
    p = [F.col(c) for c in ("ra", "dec", "ra2", "dec2")]
    return j.select("id", F.round(coords.separation_arcsec(*p), 5).alias("sep"), coords.flat_match(*p, 1.0).alias("flat"))


TAN = (
    "s as (select id, radians(ra) as r0, radians(dec) as d0, -(cast(id % 400 as double) + 1 - 100) * radians(0.06 / 3600) as xi, "
    "(cast(id % 300 as double) + 1 - 80) * radians(0.06 / 3600) as eta from cat_a), "
    "t as (select *, cos(d0) - eta * sin(d0) as den from s) "
)


@R.add(
    "B37_pixel_to_sky",
    ["cat_a"],
    TAN + "select id, round(((degrees(r0 + atan2(xi, den)) % 360) + 360) % 360, 8) as ra, round(degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + den * den))), 8) as dec from t",
)
def pixel_to_sky(spark, folder):
    a = view(spark, folder, "cat_a")
    ra, dec = coords.pixel_to_sky(
        F.lit(0.0036), F.lit(100.0), F.lit(80.0), (F.col("id") % 400).cast("double"), (F.col("id") % 300).cast("double"), F.col("ra"), F.col("dec")
    )
    return a.select("id", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@R.add(
    "B38_H9_sizes_and_distance",
    ["lines"],
    "p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + 1) * 0.06 as w, (l_linenumber + 1) * 0.06e0 as h from lines) "
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w, 6) as width, round(h, 6) as height, round(sqrt(w * w + h * h), 6) as diameter, "
    "round(50000 / (sqrt(w * w + h * h) / 3600) * 60, 2) as distance from p",
)
def sizes(spark, folder):
    w, h, d = coords.object_size(F.col("l_quantity") + 1, F.col("l_linenumber") + 1.0, F.lit(0.0036))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return view(spark, folder, "lines").select(
        *keys, F.round(w, 6).alias("width"), F.round(h, 6).alias("height"), F.round(d, 6).alias("diameter"), F.round(coords.rough_distance(d), 2).alias("distance")
    )


BOXES = (
    "p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 1000 as x, l_suppkey * 7 % 800 as y, cast(floor(3.5 * greatest(l_quantity, l_linenumber)) as int) as half from lines), "
    "q as (select *, greatest(0, x - half) as x_min, least(1000, x + half) as x_max, greatest(0, y - half) as y_min, least(800, y + half) as y_max from p) "
)


@R.add(
    "B39_crop_gates",
    ["lines"],
    BOXES + "select l_orderkey, l_linenumber, l_partkey, l_suppkey, x_max - x_min as box_w, y_max - y_min as box_h, case when x < 10 or x >= 990 or y < 10 or y >= 790 then 'edge' "
    "when x_max - x_min < 20 or y_max - y_min < 20 then 'small' when x_max - x_min > 200 or y_max - y_min > 200 then 'large' when (l_partkey % 100) / 1000 > 0.02 then 'nan' else 'ok' end as reason from q",
)
def crop_gates(spark, folder):
    lines = view(spark, folder, "lines").withColumn("x", F.col("l_partkey") % 1000).withColumn("y", F.col("l_suppkey") * 7 % 800)
    x, y = F.col("x"), F.col("y")
    box = coords.crop_box(x, y, F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(1000), F.lit(800), 3.5)
    boxed = lines.select("*", *[c.cast("bigint").alias(n) for n, c in box.items()])
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    why = coords.crop_reason(x, y, w, h, F.lit(1000), F.lit(800), F.col("l_partkey") % 100 / 1000.0)
    return boxed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("box_w"), h.alias("box_h"), why.alias("reason"))


@R.add(
    "B40_B41_footprint_and_size",
    ["cat_b", "cat_a"],
    "p as (select b.id, b.ra, b.dec, case when a.ra - 0.002 < 0 then a.ra - 0.002 + 360 else a.ra - 0.002 end as lo, a.ra + 0.0001 as hi, a.dec - 0.0002 as dlo, a.dec + 0.0001 as dhi "
    "from cat_b b join cat_a a on a.id = b.id * 7) select id, (case when lo <= hi then ra >= lo and ra <= hi else ra >= lo or ra <= hi end) and dec >= dlo and dec <= dhi as inside, "
    "case when id % 9 = 0 then true else abs(id % 10 - id % 8) <= greatest(0.5 * (id % 10), 1) end as similar from p",
)
def footprint_tests(spark, folder):
    a = view(spark, folder, "cat_a").select(F.col("id").alias("k"), F.pmod(F.col("ra") - 0.002, F.lit(360.0)).alias("lo"), (F.col("ra") + 0.0001).alias("hi"), F.col("dec").alias("d"))
    j = view(spark, folder, "cat_b").join(a, F.col("k") == F.col("id") * 7)
    inside = coords.in_footprint(F.col("ra"), F.col("dec"), F.col("lo"), F.col("hi"), F.col("d") - 0.0002, F.col("d") + 0.0001)
    size = F.when(F.col("id") % 9 != 0, (F.col("id") % 8).cast("double"))
    return j.select("id", inside.alias("inside"), coords.similar_size((F.col("id") % 10).cast("double"), size).alias("similar"))


@R.add(
    "B42_sky_to_pixel",
    ["cat_b", "cat_a"],
    "p as (select b.id, radians(b.dec) as d, radians(a.dec) as d0, radians(b.ra - a.ra) as r from cat_b b join cat_a a on a.id = b.id * 7), "
    "q as (select *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(r) as den from p), "
    "t as (select id, 1.0 - cos(d) * sin(r) / den / radians(1e-4) as x, 1.0 + (sin(d) * cos(d0) - cos(d) * sin(d0) * cos(r)) / den / radians(1e-4) as y from q) "
    "select id, round(x, 3) as x, round(y, 3) as y, x >= -0.5 and x < 4.5 and y >= -0.5 and y < 3.5 as inside, round(pow((x - 2) / 5, 2) + pow((y - 1.5) / 4, 2), 4) as centre from t",
)
def sky_to_pixel(spark, folder):
    a = view(spark, folder, "cat_a").select(F.col("id").alias("k"), F.col("ra").alias("r0"), F.col("dec").alias("d0"))
    j = view(spark, folder, "cat_b").join(a, F.col("k") == F.col("id") * 7)
    x, y, _ = coords.sky_to_pixel(F.lit(1e-4), F.lit(2.0), F.lit(2.0), F.col("ra"), F.col("dec"), F.col("r0"), F.col("d0"))
    p = j.select("id", x.alias("x"), y.alias("y"))
    args = (F.col("x"), F.col("y"), F.lit(5), F.lit(4))
    return p.select(
        "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), coords.inside_image(*args).alias("inside"), F.round(coords.centre_distance(*args), 4).alias("centre")
    )


@R.add(
    "E10_A12_shards",
    ["detections"],
    "select seq, cast(floor(seq / 10000) + 1 as bigint) as shard from detections",
)
def shards(spark, folder):
    d = detections(spark, folder).withColumn("number", F.col("seq") + 1)
    path = _fresh(spark, "shards")
    tables.write_shards(d.select("seq", "number"), path, "number", 10000)
    return spark.read.schema("seq bigint, number bigint, shard bigint").parquet(path).select("seq", "shard")


@R.add("D17_discovery", ["detections"], "select count(*) as total_members, count(distinct file) as group_count from detections")
def discovery(spark, folder):
    return stats.discovery_summary(detections(spark, folder).withColumnRenamed("file", "source"))


@R.add("D17_discovery_json")
def discovery_json(spark, folder):
    return stats.discovery_json(detections(spark, folder).withColumnRenamed("file", "source"))


def _fresh(spark, name: str) -> str:
    """A new folder on shared storage."""
    import uuid

    from skytable.session import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/skytable-{name}-{uuid.uuid4().hex}"
