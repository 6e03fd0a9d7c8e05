"""Sky joins and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, detections, haversine, view
from skytable.functions import coords
from skytable.operators import grouping, manifests, ranking, spatial
from skytable.session import cut_lineage

R = Registry()


def near(a: str, b: str, out: str) -> str:
    """Nearest matches within one arcsec by comparing everything in the same declination band."""
    sep = haversine("a.ra", "a.dec", "b.ra", "b.dec")
    return (
        f"{out}_p as (select a.id as id, a.ra as ra, a.dec as dec, b.id as right_id, {sep} as sep from {a} a join {b} b "
        f"on abs(a.dec - b.dec) <= 0.0003 and {sep} <= 1.0), "
        f"{out} as (select * from (select *, row_number() over (partition by id order by sep, right_id) as rn from {out}_p) where rn = 1)"
    )


@R.add("C1_nearest_match", ["cat_a", "cat_b"], near("cat_a", "cat_b", "m") + " select id, right_id, round(sep, 5) as sep_arcsec from m")
def nearest(spark, folder):
    m = spatial.nearest_match(view(spark, folder, "cat_a"), view(spark, folder, "cat_b"), 1.0)
    return m.select("id", "right_id", F.round("sep_arcsec", 5).alias("sep_arcsec"))


@R.add(
    "C2_survey_overlaps",
    ["cat_a", "cat_b", "cat_c"],
    ", ".join([near("cat_a", "cat_b", "ab"), near("cat_a", "cat_c", "ac"), near("cat_b", "cat_c", "bc")])
    + " select 'a+b' as overlap, id, ra, dec from ab union all select 'a+c', id, ra, dec from ac union all select 'b+c', id, ra, dec from bc "
    "union all select 'a+b+c', id, ra, dec from ab where id in (select id from ac)",
)
def overlaps(spark, folder):
    cats = [view(spark, folder, n) for n in ("cat_a", "cat_b", "cat_c")]
    return spatial.survey_overlaps(*cats, ("a", "b", "c"), 1.0)


@R.add(
    "G2_matched_in_both",
    ["cat_a", "cat_b", "cat_c"],
    ", ".join([near("cat_a", "cat_b", "ab"), near("cat_a", "cat_c", "ac")]) + " select id from ab intersect select id from ac",
)
def both(spark, folder):
    a, b, c = [view(spark, folder, n) for n in ("cat_a", "cat_b", "cat_c")]
    return manifests.matched_in_both(spatial.nearest_match(a, b), spatial.nearest_match(a, c), "id")


@R.add(
    "C3_box_semi_join",
    ["cat_a", "cat_c"],
    "select a.id, a.ra, a.dec from cat_a a where exists (select 1 from cat_c c where abs(a.ra - c.ra) <= 0.0001 and abs(a.dec - c.dec) <= 0.0001)",
)
def box(spark, folder):
    return spatial.box_semi_join(view(spark, folder, "cat_a"), view(spark, folder, "cat_c"), 1e-4).select("id", "ra", "dec")


OBS = (
    "select 'c' || cast(id as string) as obs_id, ra + 0.0005e0 as c_ra, dec - 0.0005e0 as c_dec, cast(id % 3 as int) as filter_rank, id from {c} "
    "union all select 'o' || cast(id as string) as obs_id, ra as c_ra, dec as c_dec, cast(id % 3 as int) as filter_rank, id from {a}"
)
PRODUCTS = (
    "select obs_id, cast(id % 2 as int) as product_rank, obs_id || '_i2d.fits' as product_filename, 1e-4 as scale_deg, "
    "(20 + (id % 5) * 15) / 2e0 as crpix_x, 25e0 as crpix_y, c_ra as crval_ra, c_dec as crval_dec, 20 + (id % 5) * 15 as width, "
    "cast(50 as bigint) as height from {o}"
)


@R.add(
    "C6_resolve_sources",
    ["cat_a", "cat_b", "cat_c"],
    f"o as ({OBS.format(a='cat_a', c='cat_c')}), pr as ({PRODUCTS.format(o='o')}), "
    f"pairs as (select b.id, b.ra, b.dec, o.obs_id, o.filter_rank, {haversine('b.ra', 'b.dec', 'o.c_ra', 'o.c_dec')} as sep, pr.* exclude (obs_id) "
    f"from cat_b b join o on abs(b.dec - o.c_dec) <= 0.0101 and {haversine('b.ra', 'b.dec', 'o.c_ra', 'o.c_dec')} <= 36.0 join pr on pr.obs_id = o.obs_id), "
    "t as (select *, sin(radians(dec)) * sin(radians(crval_dec)) + cos(radians(dec)) * cos(radians(crval_dec)) * cos(radians(ra - crval_ra)) as den from pairs), "
    "u as (select *, crpix_x - 1 - cos(radians(dec)) * sin(radians(ra - crval_ra)) / den / radians(scale_deg) as px, "
    "crpix_y - 1 + (sin(radians(dec)) * cos(radians(crval_dec)) - cos(radians(dec)) * sin(radians(crval_dec)) * cos(radians(ra - crval_ra))) / den / radians(scale_deg) as py from t), "
    "k as (select *, row_number() over (partition by id order by filter_rank, sep, obs_id, product_rank) as rn from u "
    "where den > 0 and px >= -0.5 and px < width - 0.5 and py >= -0.5 and py < height - 0.5) "
    "select id, obs_id, product_filename, round(sep, 4) as sep_arcsec from k where rn = 1",
)
def resolve(spark, folder):
    a, b, c = [view(spark, folder, n) for n in ("cat_a", "cat_b", "cat_c")]
    obs = spark.sql(OBS.format(a="{a}", c="{c}"), a=a, c=c)
    products = spark.sql(PRODUCTS.format(o="{o}"), o=obs)
    got = spatial.resolve_sources(b, obs.drop("id"), products)
    return got.select("id", "obs_id", "product_filename", F.round("sep_arcsec", 4).alias("sep_arcsec"))


# By construction the detections of one (k1, k2) lie within 0.36 arcsec and no two such sets come near each other.
GROUPED = (
    "g as (select *, min(seq) over (partition by k1, k2) as group_seq from detections), "
    "f as (select d.*, s.ra as group_ra, s.dec as group_dec from g d join detections s on s.seq = d.group_seq) "
)


@R.add("D1_position_groups", ["detections"], GROUPED + "select seq, group_seq, round(group_ra, 6) as group_ra, round(group_dec, 6) as group_dec from f")
def position_groups(spark, folder):
    g = grouping.group_detections(detections(spark, folder), 1.0)
    return g.select("seq", "group_seq", F.round("group_ra", 6).alias("group_ra"), F.round("group_dec", 6).alias("group_dec"))


@R.add(
    "D2_group_summary",
    ["detections"],
    GROUPED + "select group_seq, round(min(group_ra), 6) as ra, round(min(group_dec), 6) as dec, max(height) as max_height, max(width) as max_width from f group by 1",
)
def group_summary(spark, folder):
    s = grouping.group_summary(grouping.group_detections(detections(spark, folder), 1.0))
    return s.select("group_seq", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), "max_height", "max_width")


@R.add("D1_group_ids", ["detections"], GROUPED + "select seq, dense_rank() over (order by group_seq) as group_id from f")
def group_ids(spark, folder):
    # What is not asked for need not be written.
    grouped = grouping.group_detections(detections(spark, folder), 1.0).select("seq", "group_seq")
    return grouping.with_group_ids(grouped).select("seq", "group_id")


@R.add(
    "D2_raise_group_size",
    ["detections"],
    GROUPED + "select group_seq, max(case when file = 'F' then height end) as first_height, max(height) as max_height from f group by 1 having count(*) filter (where file = 'F') > 0",
)
def raise_size(spark, folder):
    # Read twice below.
    g = cut_lineage(grouping.group_detections(detections(spark, folder), 1.0).select("group_seq", "group_ra", "group_dec", "file", "height", "width"))
    start = grouping.group_summary(g.filter("file = 'F'")).withColumn("first_height", F.col("max_height"))
    return grouping.raise_group_size(start, g.filter("file <> 'F'")).select("group_seq", "first_height", "max_height")


@R.add(
    "D3_E1_instances_with_version",
    ["detections"],
    GROUPED + "select group_seq, seq, band, file, row_number() over (partition by group_seq order by seq) as version from f",
)
def instances(spark, folder):
    grouped = grouping.group_detections(detections(spark, folder), 1.0).select("group_seq", "seq", "band", "file")
    return grouping.group_instances(grouped).select("group_seq", "seq", "band", "file", "version")


@R.add(
    "D4_store_statistics",
    ["detections"],
    GROUPED + "select count(distinct group_seq) as total_groups, count(*) as total_instances, count(distinct file) as files_processed, "
    "count(distinct band) as unique_bands, count(*) / count(distinct group_seq) as instances_per_group from f",
)
def store_statistics(spark, folder):
    return grouping.store_statistics(grouping.group_detections(detections(spark, folder), 1.0))


@R.add(
    "E1_version_lookup",
    ["detections"],
    GROUPED + ", v as (select *, row_number() over (partition by group_seq order by seq) as version from f) "
    "select group_seq as lookup_id, file, group_seq, min(version) as version from v group by group_seq, file",
)
def version_lookup(spark, folder):
    # Read three times below.
    versions = cut_lineage(grouping.group_instances(grouping.group_detections(detections(spark, folder), 1.0)))
    asked = versions.select(F.col("group_seq").alias("lookup_id"), F.col("group_ra").alias("ra"), F.col("group_dec").alias("dec"), "file").distinct()
    return grouping.instance_of(versions, asked).select("lookup_id", "file", "group_seq", "version")


@R.add(
    "E2_next_version",
    ["detections"],
    "t as (select *, cast(floor(ra * 1e4 + 0.5) as bigint) as kr from detections), old as (select kr, band, cast(max(height) as bigint) as top from t where file = 'F' group by 1, 2), "
    "n as (select *, row_number() over (partition by kr, band order by seq) as place from t where file <> 'F') "
    "select n.seq, coalesce(old.top, 0) + n.place as version from n left join old on n.kr = old.kr and n.band = old.band",
)
def next_version(spark, folder):
    d = detections(spark, folder).withColumn("kr", coords.grid_key(F.col("ra"), 4))
    existing = d.filter("file = 'F'").withColumn("version", F.col("height"))
    return ranking.next_versions(d.filter("file <> 'F'"), existing, ["kr", "band"], "seq").select("seq", "version")


@R.add(
    "E4_largest_crop",
    ["detections"],
    "r as (select *, row_number() over (partition by file, cast(floor(ra * 1e6 + 0.5) as bigint), cast(floor(dec * 1e6 + 0.5) as bigint) "
    "order by height * width desc, seq) as rn from detections) select seq, file, height, width from r where rn = 1",
)
def largest_crop(spark, folder):
    return ranking.largest_crop(detections(spark, folder)).select("seq", "file", "height", "width")


@R.add(
    "C13_footprint_groups",
    ["detections"],
    # Footprints of 0.0002 degrees and one size per (k1, k2): sets stay apart by construction.
    "select seq, min(seq) over (partition by k1, k2) as group_seq from detections",
)
def footprint_groups(spark, folder):
    d = detections(spark, folder)
    sized = d.withColumn("half_ra", F.lit(2e-4)).withColumn("half_dec", F.lit(2e-4)).withColumn("size", 1.0 + (F.col("k1") % 3).cast("double"))
    return grouping.group_by_footprint(sized).select("seq", "group_seq")
