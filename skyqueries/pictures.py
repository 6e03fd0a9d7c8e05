"""Image operators over the 8 x 8 pixel table, and FITS decoding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, pixels, sql_with, table
from skytable.operators import images, tiles
from skytable.session import shared_dir
from skytable.sources import fits, fits_tiles

R = Registry()

P = ["pixels"]
RAD = "sqrt(pow(x - 4, 2) + pow(y - 4, 2))"
RMAX = "sqrt(32)"


def rounded(df, n=6, keys=("image_id",)):
    return df.select(*keys, *[F.round(c, n).alias(c) for c in df.columns if c not in keys])


def _sums(spark, folder):
    p = pixels(spark, folder)
    return p, images.image_sums(p)


@R.add(
    "H16_H18_H19_H21_simple_features",
    P,
    "s as (select image_id, sum(abs(v)) as flux, count(*) filter (where {r} < {m} * 0.5) as n_in, count(*) filter (where {r} < {m} * 0.5 and v = 0) as n_zero, "
    "sum(abs(v)) filter (where y < 4 and x < 4) as q0, sum(abs(v)) filter (where y < 4 and x >= 4) as q1, sum(abs(v)) filter (where y >= 4 and x < 4) as q2, sum(abs(v)) filter (where y >= 4 and x >= 4) as q3, "
    "sum(abs(v)) filter (where {r} < 3) as r3, sum(abs(v)) filter (where {r} < 8) as r8, max(v) as vmax, stddev_pop(v) filter (where {r} > {m} * 0.7) as bg, "
    "avg(v) as mu, stddev_pop(v) as sd, arg_max(y, v) as py, arg_max(x, v) as px, {rings} from pixels group by 1), "
    "k as (select p.image_id, avg(pow((v - mu) / sd, 4)) - 3 as kurt from pixels p join s using (image_id) group by 1) "
    "select image_id, 8.0::double as min_dim, round(r0 / flux, 6) as center_fraction, round((coalesce(r4, 0) + coalesce(r5, 0) + coalesce(r6, 0) + coalesce(r7, 0)) / flux, 6) as outer_fraction, "
    "round(n_zero / n_in, 6) as interior_zero_frac, round(greatest(q0, q1, q2, q3) / least(q0, q1, q2, q3), 6) as quadrant_ratio, round(greatest(q0, q1, q2, q3) / flux, 6) as max_quadrant_frac, "
    "round(r3 / r8, 6) as concentration, round(({rise}) / m0, 6) as total_rise, round(sqrt(pow(px - 4, 2) + pow(py - 4, 2)) / {m}, 6) as peak_offset_frac, round(vmax / bg, 6) as snr, round(kurt, 6) as kurtosis_val "
    "from s join k using (image_id)".format(
        r=RAD,
        m=RMAX,
        rings=", ".join(
            f"sum(abs(v)) filter (where {RAD} >= {RMAX} * {i / 8} and {RAD} < {RMAX} * {(i + 1) / 8}) as r{i}, "
            f"coalesce(avg(abs(v)) filter (where {RAD} >= {RMAX} * {i / 8} and {RAD} < {RMAX} * {(i + 1) / 8}), 0) as m{i}"
            for i in range(8)
        ),
        rise=" + ".join(f"greatest(m{i} - m{i - 1}, 0)" for i in range(1, 8)),
    ),
)
def simple(spark, folder):
    return rounded(images.simple_features(_sums(spark, folder)[1]))


@R.add(
    "H14_directional_ratio",
    P,
    "r as (select image_id, var_pop(m) as rv from (select image_id, y, avg(v) as m from pixels group by 1, 2) group by 1), c as (select image_id, var_pop(m) as cv from (select image_id, x, avg(v) as m from pixels group by 1, 2) group by 1) "
    "select image_id, round(rv, 9) as row_var, round(cv, 9) as col_var from r join c using (image_id)",
)
def directional(spark, folder):
    return rounded(images.line_variances(pixels(spark, folder)), 9)


@R.add("H15_saturated_fraction", P, "s as (select image_id, max(v) - 0.05::double * (max(v) - min(v)) as t from pixels group by 1) select image_id, round(avg(case when v >= t then 1.0 else 0.0 end), 6) as saturated_fraction from pixels join s using (image_id) group by 1")
def saturated(spark, folder):
    p, s = _sums(spark, folder)
    return rounded(images.saturation(p, s))


@R.add("H19_asymmetry", P, "select a.image_id, round(sum(abs(a.v - b.v)), 6) as diff from pixels a join pixels b on a.image_id = b.image_id and b.y = 7 - a.y and b.x = 7 - a.x group by 1")
def asym(spark, folder):
    return rounded(images.asymmetry(pixels(spark, folder)))


@R.add(
    "H20_half_light_radius",
    P,
    f"o as (select image_id, {RAD} as r, sum(abs(v)) over (partition by image_id order by {RAD}) as c, sum(abs(v)) over (partition by image_id) as t from pixels) "
    "select image_id, round(min(r), 6) as half_light_radius from o where c >= 0.5 * t group by 1",
)
def half_light(spark, folder):
    p, s = _sums(spark, folder)
    return rounded(images.half_light_radius(p, s))


@R.add(
    "H20_gini",
    P,
    "o as (select image_id, abs(v) as a, row_number() over (partition by image_id order by abs(v)) as i from pixels) select image_id, round(2 * sum(i * a) / (64 * sum(a)) - 65 / 64, 6) as gini from o group by 1",
)
def gini(spark, folder):
    p, s = _sums(spark, folder)
    return rounded(images.gini(p, s))


@R.add(
    "H20_bright_moment",
    P,
    f"o as (select image_id, abs(v) as a, abs(v) * pow({RAD}, 2) as m, sum(abs(v)) over (partition by image_id order by abs(v) desc, y * 8 + x desc) as c, row_number() over (partition by image_id order by abs(v) desc, y * 8 + x desc) as i, "
    "sum(abs(v)) over (partition by image_id) as t from pixels) select image_id, round(log10(sum(m) filter (where c <= 0.2 * t or i = 1) / sum(m)), 6) as m20 from o group by 1",
)
def bright(spark, folder):
    p, s = _sums(spark, folder)
    return rounded(images.bright_moment(p, s))


# Weight of source pixel j for target pixel i: the kernel folded at the edges of an 8-pixel axis.
BLUR = (
    "k as (select s.g, s.sigma, i.i, case when (i.i + o.o + 800) % 16 < 8 then (i.i + o.o + 800) % 16 else 15 - (i.i + o.o + 800) % 16 end as j, exp(-0.5 * pow(o.o / s.sigma, 2)) as w "
    "from (values ('1', 1.0::double), ('4', 3.0::double), ('16', 4.0::double)) s(g, sigma), (select unnest(range(8)) as i) i, (select unnest(range(-16, 17)) as o) o where abs(o.o) <= floor(4 * s.sigma + 0.5)), "
    "n as (select g, i, sum(w) as w from k group by 1, 2), m as (select k.g, k.i, k.j, sum(k.w) / min(n.w) as w from k join n on n.g = k.g and n.i = k.i group by 1, 2, 3), "
    "d as (select p.image_id, m.g, m.i as y, p.x, sum(m.w * p.v) as v from pixels p join m on m.j = p.y group by 1, 2, 3, 4), "
    "b as (select d.image_id, d.g, d.y, m.i as x, sum(m.w * d.v) as v from d join m on m.g = d.g and m.j = d.x group by 1, 2, 3, 4) "
)


@R.add(
    "H13_blur_energy",
    P,
    BLUR + "select image_id, round(var_pop(v) filter (where g = '1'), 8) as var_1, round(var_pop(v) filter (where g = '4'), 8) as var_4, round(var_pop(v) filter (where g = '16'), 8) as var_16 from b group by 1",
)
def blur(spark, folder):
    p, s = _sums(spark, folder)
    return rounded(images.blur_energy(p, s), 8)


# Components on an 8 x 8 grid by spreading the least raster position to neighbours until nothing changes.
def components(mask: str, diagonal: bool) -> str:
    near = "abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    return (
        f"mk as (select image_id, y, x, v, y * 8 + x as i from pixels join st using (image_id) where {mask}), "
        f"ed as (select a.image_id, a.i as i, b.i as j from mk a join mk b on a.image_id = b.image_id and {near}), "
        "rc(image_id, i, j) as (select image_id, i, j from ed union select rc.image_id, rc.i, ed.j from rc join ed on ed.image_id = rc.image_id and ed.i = rc.j), "
        "lb as (select image_id, i, min(j) as comp from rc group by 1, 2) "
    )


def recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


ST = "st as (select image_id, avg(v) as mean, var_pop(v) as var from pixels group by 1), "


@R.add(
    "H17_bright_sources",
    P,
    ST + components("v > mean + 0.5 * sqrt(var)", False)
    + "select st.image_id, cast(count(distinct comp) as double) as n_sources from st left join lb on lb.image_id = st.image_id group by 1 "
    "union all select -1 - image_id, 0.0::double from st where image_id % 5 = 0",
)
def sources(spark, folder):
    p, s = _sums(spark, folder)
    # These images are noise: half a deviation in place of three gives components to count.
    level = s.select("image_id", (F.col("mean") - 2.5 * F.sqrt("var")).alias("mean"), "var")
    # Besides all images, copies of a fifth of them with a level that no pixel reaches.
    copy = -1 - F.col("image_id")
    p = p.unionByName(p.filter("image_id % 5 = 0").withColumn("image_id", copy))
    level = level.unionByName(level.filter("image_id % 5 = 0").select(copy.alias("image_id"), (F.col("mean") + 1e9).alias("mean"), "var"))
    return images.count_sources(p, level)


R.sql["H17_bright_sources"] = recursive(R.sql["H17_bright_sources"])


@R.add(
    "H12_largest_component_box",
    P,
    ST + components("v < 0.05::double", False) + ", g as (select lb.image_id, comp, count(*) as area, min(lb.i % 8) as x0, max(lb.i % 8) as x1, min(lb.i // 8) as y0, max(lb.i // 8) as y1 from lb group by 1, 2), "
    "b as (select *, row_number() over (partition by image_id order by area desc, comp) as rn from g) "
    "select st.image_id, cast(coalesce(greatest(0, x0 - 1), 0) as int) as \"left\", cast(coalesce(greatest(0, y0 - 1), 0) as int) as top, cast(coalesce(least(8, x1 + 2), 8) as int) as \"right\", "
    "cast(coalesce(least(8, y1 + 2), 8) as int) as bottom from st left join b on b.image_id = st.image_id and rn = 1",
)
def component_box(spark, folder):
    return images.largest_component_box(pixels(spark, folder), 0.05)


R.sql["H12_largest_component_box"] = recursive(R.sql["H12_largest_component_box"])

HOLES = "hp as (select image_id, h, w, y, x, case when (image_id * 7 + y * 3 + x) % 11 = 0 then null else v end as v from pixels) "


def holes(spark, folder):
    bad = (F.col("image_id") * 7 + F.col("y") * 3 + F.col("x")) % 11 == 0
    return pixels(spark, folder).withColumn("v", F.when(bad, F.lit(float("nan"))).otherwise(F.col("v")))


@R.add(
    "H1_fill_missing",
    P,
    HOLES + ", o as (select unnest(range(-2, 3)) as o), nb as (select a.image_id, a.y, a.x, case when a.y + dy.o < 0 then -(a.y + dy.o) - 1 when a.y + dy.o >= 8 then 15 - a.y - dy.o else a.y + dy.o end as yy, "
    "case when a.x + dx.o < 0 then -(a.x + dx.o) - 1 when a.x + dx.o >= 8 then 15 - a.x - dx.o else a.x + dx.o end as xx from hp a, o dy, o dx where a.v is null), "
    "md as (select nb.image_id, nb.y, nb.x, quantile_cont(p.v, 0.5) as m from nb join hp p on p.image_id = nb.image_id and p.y = nb.yy and p.x = nb.xx where p.v is not null group by 1, 2, 3) "
    "select hp.image_id, hp.y, hp.x, round(coalesce(hp.v, md.m), 6) as v from hp left join md using (image_id, y, x)",
)
def fill(spark, folder):
    return rounded(images.fill_missing(holes(spark, folder)).select("image_id", "y", "x", "v"), 6, ("image_id", "y", "x"))


@R.add("H2_downsample", P, "select image_id, cast(y // 3 as int) as y, cast(x // 3 as int) as x, round(avg(v), 6) as v from pixels where y < 6 and x < 6 group by 1, 2, 3")
def downsample(spark, folder):
    small = images.downsample(pixels(spark, folder), 100)
    return small.select("image_id", "y", "x", F.round("v", 6).alias("v"))


@R.add(
    "H3_background",
    P,
    "b as (select image_id, y // 4 as my, x // 4 as mx, median(v) as level, stddev_pop(v) as rms from pixels group by 1, 2, 3), g as (select image_id, median(rms) as g from b group by 1) "
    "select p.image_id, p.y, p.x, round(p.v - b.level, 6) as v, round(g.g, 6) as global_rms from pixels p join b on b.image_id = p.image_id and b.my = p.y // 4 and b.mx = p.x // 4 join g on g.image_id = p.image_id",
)
def subtract(spark, folder):
    clean, rms = images.subtract_background(pixels(spark, folder), 4)
    return clean.join(rms, "image_id").select("image_id", "y", "x", F.round("v", 6).alias("v"), F.round("global_rms", 6).alias("global_rms"))


def _detected(spark, folder):
    p = pixels(spark, folder)
    rms = p.groupBy("image_id").agg(F.stddev_pop("v").alias("global_rms"))
    return p, rms, images.detect_objects(p, rms, 0.3, 3)


@R.add(
    "H4_detect_objects",
    P,
    ST + components("v > 0.3 * sqrt(var)", True) + ", ob as (select lb.image_id, comp as object, count(*) as npix, sum(v) as flux, max(v) as peak, sum(v * x) / sum(v) as x, sum(v * y) / sum(v) as y, "
    "sum(v * x * x) / sum(v) as xx, sum(v * y * y) / sum(v) as yy, sum(v * x * y) / sum(v) as xy from lb join mk on mk.image_id = lb.image_id and mk.i = lb.i group by 1, 2 having count(*) >= 3), "
    "mo as (select *, greatest(xx - x * x, 1.0 / 12) as a2, greatest(yy - y * y, 1.0 / 12) as b2, xy - x * y as c2 from ob), "
    "ev as (select *, (a2 + b2) / 2 as hf, sqrt(pow((a2 - b2) / 2, 2) + c2 * c2) as gp from mo) "
    "select image_id, cast(object as bigint) as object, npix, round(flux, 6) as flux, round(peak, 6) as peak, round(x, 6) as x, round(y, 6) as y, round(sqrt(hf + gp), 5) as a, round(sqrt(greatest(hf - gp, 0)), 4) as b from ev",
)
def detect(spark, folder):
    d = _detected(spark, folder)[2]
    return d.select(
        "image_id", "object", "npix", *[F.round(c, 6).alias(c) for c in ("flux", "peak", "x", "y")], F.round("a", 5).alias("a"), F.round("b", 4).alias("b")
    )


R.sql["H4_detect_objects"] = recursive(R.sql["H4_detect_objects"])


@R.add("H5_H6_apertures_and_filters")
def filtered(spark, folder):
    p, rms, d = _detected(spark, folder)
    psf = d.select("image_id").distinct().select("image_id", F.lit(2.0).alias("psf_fwhm"))
    a = tiles.aperture_measures(d, tiles.tile_rows(p), psf)
    flat = images.flat_top_pixels(d, p)
    bright_floor = images.exact_quantiles(p.filter("v > 0"), ["image_id"], "v", {"bright_floor": 0.99})
    full = d.join(a, ["image_id", "object"], "left").join(flat, ["image_id", "object"], "left").join(rms.withColumnRenamed("global_rms", "rms"), "image_id")
    full = full.join(bright_floor, "image_id", "left").join(psf, "image_id", "left")
    return full.select("image_id", "object", images.first_failed_filter().alias("label"))


FILTERS = (
    "case when l_suppkey < 10 then 'npix' when l_tax - 0.01 <= 0 then 'flux' when l_quantity <= 4 then 'resolved' when l_discount / greatest(l_tax - 0.01, 1e-10) >= 0.5 then 'artifact' "
    "when l_quantity / greatest(l_linenumber, 0.01) >= 5 then 'elongation' when (l_tax - 0.01) / greatest(sqrt(l_suppkey * 2) * 0.0001, 1e-10) < 7 then 'snr' else 'pass' end"
)


@R.add("H6_D13_filter_labels", None, f"select {FILTERS} as label, count(*) as n from (select l_suppkey, l_quantity, l_linenumber, l_tax::double as l_tax, l_discount / 100 as l_discount from lineitem) group by 1")
def filter_labels(spark, folder):
    from skytable.operators import stats

    c = F.col
    missing = F.lit(None).cast("double")
    rows = table(spark, folder, "lineitem").select(
        (c("l_suppkey") * 2).alias("npix"), (c("l_tax") - 0.01).alias("flux"), c("l_quantity").alias("a"), c("l_linenumber").cast("double").alias("b"),
        (c("l_discount") / 100).alias("peak"), F.lit(0.0001).alias("rms"), *[missing.alias(n) for n in ("concentration", "r25", "r50", "r75", "psf_fwhm", "bright_floor", "kron_radius")],
        F.lit(None).cast("bigint").alias("n_flat"),
    )
    return stats.label_counts(rows.select(images.first_failed_filter().alias("label")), "label")


# Two spots on each image, of which a tenth are black; half of the images have a known point spread.
SPOTS = (
    "l as (select image_id, y, x, case when image_id % 10 = 0 then 0 else abs(v) + 0.01::double end as v from pixels), "
    "o as (select image_id, object, 3.5::double + (image_id % 2) * 0.5::double + object as x, 3 + (image_id % 3) * 0.5::double as y, 0.7::double + (image_id % 5) * 0.2::double as a, "
    "(0.7::double + (image_id % 5) * 0.2::double) / (1 + image_id % 3) as b, (image_id % 7) * 0.1::double as theta, case when image_id % 2 = 0 then 1.1::double end as fwhm "
    "from (select distinct image_id from pixels), (select unnest([0, 1]) as object)), "
    "r as (select *, case when fwhm is null then 3.0::double else greatest(1.5, 1.5 * fwhm) end as r_in, case when fwhm is null then 8.0::double else greatest(4.0, 4 * fwhm) end as r_out, "
    "greatest(5.0, least(6 * a, 200)) as r_f, greatest(5.0, least(8 * a, 200)) as r_h from o), "
    "n as (select r.*, l.v, pow(l.x - r.x, 2) + pow(l.y - r.y, 2) as d2, sqrt(pow(((l.x - r.x) * cos(theta) + (l.y - r.y) * sin(theta)) / a, 2) + pow(((l.y - r.y) * cos(theta) - (l.x - r.x) * sin(theta)) / b, 2)) as ell "
    "from r join l using (image_id)), "
    "t as (select *, sum(v) over (partition by image_id, object order by d2) as run, sum(v) filter (where d2 <= r_f * r_f) over (partition by image_id, object) as f_all, "
    "sum(v) filter (where d2 <= r_h * r_h) over (partition by image_id, object) as h_all from n), "
    "g as (select image_id, object, sum(v) filter (where d2 <= r_in * r_in) / greatest(sum(v) filter (where d2 <= r_out * r_out), 1e-10) as concentration, "
    "sqrt(min(d2) filter (where f_all > 0 and run >= 0.25 * f_all and d2 <= r_f * r_f)) as r25, sqrt(min(d2) filter (where h_all > 0 and run >= 0.5 * h_all and d2 <= r_h * r_h)) as r50, "
    "sqrt(min(d2) filter (where f_all > 0 and run >= 0.75 * f_all and d2 <= r_f * r_f)) as r75, "
    "coalesce(sum(ell * v) filter (where ell <= 6 and d2 <= pow(greatest(r_out, r_f, r_h), 2)) / nullif(sum(v) filter (where ell <= 6 and d2 <= pow(greatest(r_out, r_f, r_h), 2)), 0), 0) as kron from t group by 1, 2) "
)


@R.add(
    "H5_aperture_measures",
    P,
    SPOTS + "select image_id, object, round(concentration, 6) as concentration, round(r25, 6) as r25, round(r50, 6) as r50, round(r75, 6) as r75, round(kron, 6) as kron_radius, kron < 1 as compact from g",
)
def aperture(spark, folder):
    p = pixels(spark, folder).withColumn("v", F.when(F.col("image_id") % 10 == 0, 0.0).otherwise(F.abs("v") + 0.01))
    i = F.col("image_id")
    spots = p.select("image_id").distinct().withColumn("object", F.explode(F.array(F.lit(0), F.lit(1))))
    a = F.lit(0.7) + (i % 5) * 0.2
    spots = spots.select("image_id", "object", (F.lit(3.5) + (i % 2) * 0.5 + F.col("object")).alias("x"), (F.lit(3.0) + (i % 3) * 0.5).alias("y"), a.alias("a"), (a / (1 + i % 3)).alias("b"), ((i % 7) * 0.1).alias("theta"))
    psf = spots.select("image_id").distinct().filter(i % 2 == 0).withColumn("psf_fwhm", F.lit(1.1))
    # Tiles of three pixels: an aperture lies in up to nine of them.
    return rounded(tiles.aperture_measures(spots, tiles.tile_rows(p, 3), psf, 3).drop("compact"), keys=("image_id", "object")).withColumn("compact", F.col("kron_radius") < 1)


def _boxes(spark, folder):
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id as crop_id", "vec_id as image_id", "cast(vec_id % 3 as int) as x_min", "cast(vec_id % 3 + 4 as int) as x_max", "cast(vec_id % 4 as int) as y_min", "cast(vec_id % 4 + 3 as int) as y_max"
    )


@R.add("H7_crop_pixels", P, "select image_id, cast(y - image_id % 4 as int) as y, cast(x - image_id % 3 as int) as x, round(v, 6) as v from pixels where x >= image_id % 3 and x < image_id % 3 + 4 and y >= image_id % 4 and y < image_id % 4 + 3")
def crops(spark, folder):
    return images.crop_pixels(_boxes(spark, folder), pixels(spark, folder)).select("image_id", "y", "x", F.round("v", 6).alias("v"))


@R.add(
    "H8_standardize_crops",
    P,
    "g as (select image_id, yy.y as y, xx.x as x from (select distinct image_id from pixels), (select cast(unnest(range(10)) as int) as y) yy, (select cast(unnest(range(5)) as int) as x) xx) "
    "select g.image_id, g.y, g.x, round(coalesce(p.v, 999), 6) as v from g left join pixels p on p.image_id = g.image_id and p.y = g.y - 1 and p.x = g.x + 1",
)
def standardized(spark, folder):
    p = pixels(spark, folder)
    targets = table(spark, folder, "embeddings").selectExpr("vec_id as image_id", "10 as th", "5 as tw")
    # NaN padding shows as 999 in the comparison.
    return images.standardize_crops(p, targets).select("image_id", "y", "x", F.round(F.nanvl("v", F.lit(999.0)), 6).alias("v"))


@R.add(
    "H10_clip_scale",
    P,
    "q as (select image_id, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from pixels group by 1) select p.image_id, y, x, round((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255, 4) as v from pixels p join q using (image_id)",
)
def clip(spark, folder):
    return images.clip_scale(pixels(spark, folder), 0.05, 0.95, 255.0).select("image_id", "y", "x", F.round("v", 4).alias("v"))


@R.add(
    "H10_min_max_and_asinh",
    P,
    "q as (select image_id, min(asinh(v)) as lo, max(asinh(v)) as hi from pixels group by 1) select p.image_id, y, x, round((asinh(v) - lo) / (hi - lo) * 255, 4) as v from pixels p join q using (image_id)",
)
def min_max(spark, folder):
    return images.min_max_scale(images.asinh_scale(pixels(spark, folder))).select("image_id", "y", "x", F.round("v", 4).alias("v"))


@R.add(
    "H11_contrast_gate",
    P,
    HOLES + "select image_id, round(quantile_cont(v, 0.995) - quantile_cont(v, 0.005), 6) as contrast, round(count(*) filter (where v is null) / count(*), 6) as nan_fraction, "
    "quantile_cont(v, 0.995) - quantile_cont(v, 0.005) >= 0.15 as accepted from hp group by 1",
)
def gate(spark, folder):
    g = images.contrast_gate(holes(spark, folder))
    return g.select("image_id", F.round("contrast", 6).alias("contrast"), F.round("nan_fraction", 6).alias("nan_fraction"), "accepted")


@R.add("H11_flat_top_pixels", P, "m as (select image_id, max(v) as peak, arg_max(y, v) as py, arg_max(x, v) as px from pixels group by 1) select p.image_id, count(*) filter (where abs(v - peak) < abs(peak) * 0.001) as n_flat from pixels p join m using (image_id) where abs(y - py) <= 2 and abs(x - px) <= 2 group by 1")
def flat_tops(spark, folder):
    p, s = _sums(spark, folder)
    d = s.select("image_id", F.lit(1).alias("object"), (-F.col("peak.nx")).alias("x"), (-F.col("peak.ny")).alias("y"), F.col("peak.v").alias("peak"))
    return images.flat_top_pixels(d, p).select("image_id", "n_flat")


def unrounded(name: str) -> str:
    """The SQL of a query without the rounding of its results."""
    text = R.sql[name]
    while (at := text.find("round(")) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}({text[at + len('round(') : end - 1].rpartition(',')[0]}){text[end:]}"
    return text


@R.add("H22_morphology")
def morphology(spark, folder):
    return rounded(tiles.morphology(tiles.tile_rows(pixels(spark, folder))))


@R.add("H22_morphology_of_mosaics")
def mosaic_morphology(spark, folder):
    """Each eight images in a row and two rows are one image; tiles are smaller than it."""
    k = F.floor(F.col("image_id") / 16)
    place = F.col("image_id") - k * 16
    p = pixels(spark, folder).select(
        k.alias("image_id"), F.lit(16).alias("h"), F.lit(64).alias("w"), (F.col("y") + F.floor(place / 8) * 8).cast("int").alias("y"), (F.col("x") + (place % 8) * 8).cast("int").alias("x"), "v"
    )
    return rounded(tiles.morphology(tiles.tile_rows(p, 48), 48))


SOURCES_3 = recursive(
    sql_with(P, ST + components("v > mean + 3 * sqrt(var)", False) + "select st.image_id, cast(count(distinct comp) as double) as n_sources from st left join lb on lb.image_id = st.image_id group by 1")
)
SIMPLE = "min_dim center_fraction outer_fraction interior_zero_frac quadrant_ratio max_quadrant_frac concentration total_rise peak_offset_frac snr kurtosis_val".split()
R.sql["H22_morphology"] = sql_with(
    P,
    "f as (select image_id, sum(abs(v)) as flux, var_pop(v) as var from pixels group by 1) select f.image_id, "
    "round(var_1 / var, 6) as e1, round(var_4 / var, 6) as e4, round(var_16 / var, 6) as e16, round(case when var_1 / var > 1e-12 then var_16 / var_1 else 0 end, 6) as coarse_to_fine, "
    "round(greatest(row_var, col_var) / greatest(least(row_var, col_var), 1e-12), 6) as directional_ratio, round(saturated_fraction, 6) as saturated_fraction, "
    "round(n_sources, 6) as n_sources, round(diff / (2 * flux), 6) as asymmetry, round(half_light_radius, 6) as half_light_radius, round(gini, 6) as gini, round(m20, 6) as m20, "
    + ", ".join(f"round({c}, 6) as {c}" for c in SIMPLE)
    + " from f "
    + " ".join(
        f"join ({unrounded(q)}) using (image_id)"
        for q in "H16_H18_H19_H21_simple_features H14_directional_ratio H15_saturated_fraction H19_asymmetry H20_half_light_radius H20_gini H20_bright_moment H13_blur_energy".split()
    )
    + f" join ({SOURCES_3}) using (image_id)",
)


# ---- FITS bytes written from the vectors and read back ----


def fits_files(spark, folder):
    e = table(spark, folder, "embeddings")
    v = F.transform("embedding", lambda p: F.round(p.cast("double") * 1e6).cast("bigint"))
    num = lambda n: F.lpad(F.lit(str(n)), 20, " ")
    cards = [
        ("SIMPLE", F.lpad(F.lit("T"), 20, " ")), ("BITPIX", num(32)), ("NAXIS", num(2)), ("NAXIS1", num(8)), ("NAXIS2", num(8)), ("BSCALE", num("1.0E-6")),
        ("INSTRUME", F.concat(F.lit("'NIRCAM"), F.col("label").cast("string"), F.lit("'  / camera"))), ("VECID", F.concat(F.lpad(F.col("vec_id").cast("string"), 20, " "), F.lit(" / id"))),
    ]
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".fits")).alias("path"), fits.encode_image(cards, v).alias("content"))


@R.add("A6_instrument", None, "select 'v' || cast(vec_id as varchar) || '.fits' as path, 'NIRCAM' || cast(label as varchar) as instrument from embeddings")
def instrument(spark, folder):
    return fits.instrument_of(fits_files(spark, folder))


@R.add("A6_header_cards", None, "select 'v' || cast(vec_id as varchar) || '.fits' as path, 'INSTRUME' as keyword, 'NIRCAM' || cast(label as varchar) as value, 'camera' as comment from embeddings union all select 'v' || cast(vec_id as varchar) || '.fits', 'VECID', cast(vec_id as varchar), 'id' from embeddings")
def cards(spark, folder):
    return fits.first_header_cards(fits_files(spark, folder)).filter(F.col("keyword").isin("INSTRUME", "VECID")).select("path", "keyword", "value", "comment")


@R.add(
    "A7_merge_headers",
    None,
    "select 'v' || cast(vec_id as varchar) || '.fits' as path, 'INSTRUME' as keyword, case when label % 2 = 0 then 'sci' else 'NIRCAM' || cast(label as varchar) end as value from embeddings",
)
def merged(spark, folder):
    primary = fits.first_header_cards(fits_files(spark, folder)).filter("keyword = 'INSTRUME'").withColumn("hdu", F.lit("PRIMARY"))
    sci = primary.filter(F.right("value", F.lit(1)).cast("int") % 2 == 0).withColumn("hdu", F.lit("SCI")).withColumn("value", F.lit("sci"))
    return fits.merge_headers(primary.unionByName(sci)).select("path", "keyword", "value")


@R.add("A8_load_pixels", None, "select 'v' || cast(vec_id as varchar) || '.fits' as path, cast(8 as int) as h, cast(8 as int) as w, round(list_sum(list_transform(embedding, lambda e: round(e::double * 1e6) / 1e6)), 6) as total from embeddings")
def load(spark, folder):
    images_ = fits.load_pixels(fits_files(spark, folder))
    return images_.select("path", "h", "w", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, p: s + p), 6).alias("total"))


@R.add(
    "A8_image_tiles",
    None,
    "select 'v' || cast(vec_id as varchar) || '.fits' as path, 4::bigint as tiles, 64::bigint as pixels, round(list_sum(list_transform(embedding, lambda e: round(e::double * 1e6) / 1e6)), 6) as total, "
    "null::varchar as reason from embeddings union all select 'cut' || cast(vec_id as varchar) || '.fits', 0, 0, null, 'data end early' from embeddings where vec_id % 50 = 0",
)
def image_tiles(spark, folder):
    root = f"{shared_dir(spark).rstrip('/')}/skytable-images-{uuid.uuid4().hex}"
    files = fits_files(spark, folder)
    cut = files.filter(F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 50 == 0)
    cut = cut.select(F.regexp_replace("path", "v(\\d+)", "cut$1").alias("path"), F.substring("content", 1, fits.BLOCK + 100).alias("content"))
    fits_tiles.write_files(files.select("path", "content").unionByName(cut), root).count()
    read = fits_tiles.read_tiles(spark, root, 4)
    total = F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda s, v: s + v)), 6)
    grouped = read.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("path")).agg(
        F.count("values").alias("tiles"), F.coalesce(F.sum(F.size("values")).cast("bigint"), F.lit(0)).alias("pixels"), total.alias("total"), F.max("reason").alias("reason")
    )
    return grouped.withColumn("pixels", F.when(F.col("tiles") > 0, F.col("pixels")).otherwise(F.lit(0)).cast("bigint"))
