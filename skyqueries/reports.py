"""Report reading, cleaning and features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, view
from skytable.functions import report
from skytable.operators import manifests, models, stats
from skytable.plans import reports
from skytable.session import shared_dir
from skytable.sources import tables

R = Registry()
COLUMNS = (
    "index P_CW P_ACW name fit_state warnings star_mask_used noise_mask_used chirality_maj chirality_alenWtd badBulgeFitFlag bulgeAxisRatio "
    "diskMinAxsLen iptSz covarFit likOfCtr totalArcLength top2_chirality_agreement chirality_votes_maj sorted_agreeing_pangs bar_used cropRad"
).split()


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skytable-{name}-{uuid.uuid4().hex}"


TRIMMED = "t as (select " + ", ".join(f"trim(coalesce({c}, '')) as {c}" for c in COLUMNS) + " from raw_report) "
BAD = "(" + " or ".join(f"{c} in ('-Inf', 'Inf', 'NaN', '-inf', 'inf', 'nan')" for c in COLUMNS) + ")"
BLANK = "(" + " or ".join(f"{c} = ''" for c in COLUMNS[4:23]) + ")"
REASON = f"case when {BAD} then 'bad_value' when fit_state = 'input rejected' then 'input_rejected' when {BLANK} then 'blank_key' else 'kept' end"
WORD = {
    **{c: f"case {c} when 'Z-wise' then 'Zwise' when 'S-wise' then 'Swise' else {c} end" for c in ("chirality_maj", "chirality_alenWtd")},
    **{
        c: f"case {c} when 'unavailable' then 'none' when 'aggressive-exclusive' then 'aggressiveexclusive' when 'conservative-exclusive' then "
        f"'conservativeexclusive' else {c} end"
        for c in ("star_mask_used", "noise_mask_used")
    },
    **{c: f"case {c} when 'true' then 'True' when 'false' then 'False' else {c} end" for c in ("badBulgeFitFlag", "bar_used")},
    "top2_chirality_agreement": "case top2_chirality_agreement when '''one-long''' then '''onelong''' when '''all-short''' then '''allshort''' "
    "when '<2 arcs' then '''<2_arcs''' else top2_chirality_agreement end",
    "covarFit": "replace(covarFit, ';', ' ')",
}
UNDERSCORED = {c: f"replace({c}, ' ', '_')" for c in ("chirality_votes_maj", "sorted_agreeing_pangs")}
KEPT = [c for c in COLUMNS if c != "cropRad"]


def cleaned_sql(mode: str) -> str:
    out = []
    for c in KEPT:
        text = WORD.get(c, c)
        if mode != "panstarrs":
            text = UNDERSCORED.get(c, text)
        if mode == "infer":
            text = f"case when {c} = '0+5.6e-09i' then '0' else {text} end"
        out.append(f"{text} as {c}")
    return TRIMMED + f", k as (select * from t where {REASON} = 'kept'), c as (select {', '.join(out)} from k) "


def _sanitize(mode):
    def run(spark, folder):
        return reports.sanitize_report(view(spark, folder, "raw_report"), mode)

    return run


for _mode in ("train", "infer", "panstarrs"):
    R.add(f"N3_sanitize_report_{_mode}", ["raw_report"], cleaned_sql(_mode) + "select * from c")(_sanitize(_mode))


@R.add("D14_drop_reasons", ["raw_report"], TRIMMED + f"select {REASON} as reason, count(*) as n from t group by 1")
def drop_reasons(spark, folder):
    return reports.sanitize_counts(view(spark, folder, "raw_report"))


@R.add(
    "B20_B23_clean_loose",
    ["raw_report"],
    "t as (select index, replace(replace(trim(chirality_maj), 'Z-wise', 'Zwise'), 'S-wise', 'Swise') as chirality_maj, replace(trim(star_mask_used), 'unavailable', 'none') as star_mask_used, "
    "replace(replace(replace(trim(top2_chirality_agreement), '<2 arcs', '<2_arcs'), 'one-long', 'onelong'), 'all-short', 'allshort') as top2_chirality_agreement, "
    "replace(trim(covarFit), ' ', '_') as covarFit, trim(bulgeAxisRatio) as bulgeAxisRatio from raw_report) select * from t where not contains(bulgeAxisRatio, 'Inf')",
)
def clean_loose(spark, folder):
    cols = ["index", "chirality_maj", "star_mask_used", "top2_chirality_agreement", "covarFit", "bulgeAxisRatio"]
    return reports.clean_loose(view(spark, folder, "raw_report").select(*cols))


@R.add(
    "B23_shell_words",
    ["raw_report"],
    "select index, replace(star_mask_used, 'unavailable', '_') as star, replace(replace(noise_mask_used, 'unavailable', 'none'), 'conservative-exclusive', 'conservativeexclusive') as noise from raw_report",
)
def shell_words(spark, folder):
    return view(spark, folder, "raw_report").select(
        "index", report.renamed_words(F.col("star_mask_used"), "star_mask_used", "shell").alias("star"),
        report.renamed_words(F.col("noise_mask_used"), "noise_mask_used", "shell").alias("noise"),
    )


ARRAYS = (
    "e as (select index, string_split(trim(replace(replace(iptSz, '[', ''), ']', '')), ' ') as s, string_split(replace(replace(replace(covarFit, ';', ' '), '[', ''), ']', ''), ' ') as c, "
    "case sorted_agreeing_pangs when '[1 2 3]' then [1.0, 2.0, 3.0] when '4_5' then [4.0, 5.0] else [7.0, 'nan'::double] end as p from raw_report) "
)


@R.add(
    "B28_B29_expand_arrays",
    ["raw_report"],
    ARRAYS + "select index, cast(s[1] as double) as iptSz_0, cast(s[2] as double) as iptSz_1, "
    + ", ".join(f"cast(list_filter(c, lambda x: x <> '')[{i + 1}] as double) as covarFit_{i}" for i in range(7))
    + ", cast(p[1] as double) as sorted_agreeing_pangs_0, case when isnan(p[2]) then null else cast(p[2] as double) end as sorted_agreeing_pangs_1, cast(p[3] as double) as sorted_agreeing_pangs_2 from e",
)
def expand_arrays(spark, folder):
    raw = view(spark, folder, "raw_report").select("index", "iptSz", F.translate("covarFit", ";", " ").alias("covarFit"), "sorted_agreeing_pangs")
    wide = report.expand_arrays(raw, report.array_widths(raw))
    # NaN marks a bad token; the comparison shows it as null.
    return wide.withColumn("sorted_agreeing_pangs_1", F.nanvl("sorted_agreeing_pangs_1", F.lit(None).cast("double")))


@R.add("B27_real_part", ["raw_report"], "select index, case when likOfCtr = '0+5.6e-09i' then '0' else likOfCtr end as value from raw_report")
def real_part(spark, folder):
    return view(spark, folder, "raw_report").select("index", report.real_part(F.col("likOfCtr")).alias("value"))


@R.add(
    "B30_B32_align_features",
    ["raw_report"],
    "select index, coalesce(try_cast(diskMinAxsLen as double), 0) as diskMinAxsLen, 0.0::double as absent, coalesce(try_cast(likOfCtr as double), 0) as likOfCtr, "
    "cast(P_CW as double) + cast(P_ACW as double) as P_spiral from raw_report",
)
def align(spark, folder):
    raw = view(spark, folder, "raw_report")
    typed = report.spirality(raw.withColumn("P_CW", F.col("P_CW").cast("double")).withColumn("P_ACW", F.col("P_ACW").cast("double")))
    features = report.feature_columns(["name", "P_CW", " diskMinAxsLen", "absent", "likOfCtr", "_skip", "split"])
    return report.align_features(typed, features, ["index", "P_spiral"])


@R.add(
    "B33_non_galaxy",
    ["raw_report"],
    "select index, coalesce(try_cast(diskMinAxsLen as double), 0) < 5 and coalesce(try_cast(totalArcLength as double), 0) < 50 and coalesce(try_cast(likOfCtr as double), -999) < -10 as flagged from raw_report",
)
def non_galaxy(spark, folder):
    raw = view(spark, folder, "raw_report")
    return raw.select("index", report.is_non_galaxy(raw).alias("flagged"))


SCORED = (
    "p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 as predicted_P_spiral, l_tax * l_quantity as tree_std, l_linenumber = 7 as flagged_non_galaxy from lines), "
    "b as (select quantile_cont(tree_std, 0.9) as bar from p where not flagged_non_galaxy), "
    "s as (select p.*, tree_std > b.bar and predicted_P_spiral >= 0.5 and predicted_P_spiral < 0.75 as low_confidence from p, b) "
)


def scored_rows(spark, folder):
    p = view(spark, folder, "lines").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("predicted_P_spiral"),
        (F.col("l_tax") * F.col("l_quantity")).alias("tree_std"), (F.col("l_linenumber") == 7).alias("flagged_non_galaxy"),
    )
    return models.flag_low_confidence(p)


@R.add("B34_low_confidence", ["lines"], SCORED + "select l_orderkey, l_linenumber, l_partkey, l_suppkey, tree_std, low_confidence from s")
def low_confidence(spark, folder):
    return scored_rows(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tree_std", "low_confidence")


@R.add(
    "D12_prediction_summary",
    ["lines"],
    SCORED + "select count(*) as total, count(*) filter (where flagged_non_galaxy) as non_galaxies, count(*) filter (where not flagged_non_galaxy) as galaxies, "
    "min(predicted_P_spiral) filter (where not flagged_non_galaxy) as p_min, max(predicted_P_spiral) filter (where not flagged_non_galaxy) as p_max, "
    "round(avg(predicted_P_spiral) filter (where not flagged_non_galaxy), 8) as p_mean, min(tree_std) filter (where not flagged_non_galaxy) as std_min, "
    "max(tree_std) filter (where not flagged_non_galaxy) as std_max, round(quantile_cont(tree_std, 0.9) filter (where not flagged_non_galaxy), 8) as std_p90, "
    "count(*) filter (where low_confidence) as low_confidence from s",
)
def prediction_summary(spark, folder):
    s = stats.prediction_summary(scored_rows(spark, folder))
    return s.withColumn("p_mean", F.round("p_mean", 8)).withColumn("std_p90", F.round("std_p90", 8))


@R.add("A13_write_predictions", ["lines"], SCORED + "select count(*) as n, round(sum(tree_std), 4) as spread, count(*) filter (where low_confidence) as low from s")
def write_predictions(spark, folder):
    path = fresh(spark, "predictions")
    tables.write_predictions(scored_rows(spark, folder).withColumn("name", F.col("l_orderkey").cast("string")), f"{path}/out.parquet")
    back = spark.read.schema("name string, predicted_P_spiral double, tree_std double, flagged_non_galaxy boolean, low_confidence boolean").csv(f"{path}/out.csv", header=True)
    return back.agg(F.count("*").alias("n"), F.round(F.sum("tree_std"), 4).alias("spread"), F.count_if("low_confidence").alias("low"))


@R.add("A14_write_by_bin", ["lines"], "select printf('%.1f-%.1f', b / 10, (b + 1) / 10) as bin, count(*) as n from (select least(cast(floor(l_discount * 10 * 10) as int), 9) as b from lines) group by 1")
def write_by_bin(spark, folder):
    from skytable.functions.names import score_bin

    path = fresh(spark, "bins")
    tables.write_by_label(view(spark, folder, "lines").select("l_orderkey", score_bin(F.col("l_discount") * 10).alias("bin")), path, "bin")
    return spark.read.schema("l_orderkey bigint, bin string").parquet(path).groupBy("bin").agg(F.count("*").alias("n"))


@R.add("A1_catalog_csv", ["cat_a"], 'select id, round(ra, 6) as ra, round(dec, 6) as dec from cat_a')
def catalog_csv(spark, folder):
    path = fresh(spark, "catalog")
    tables.write_csv(view(spark, folder, "cat_a").select("id", F.col("ra").alias(" ra"), F.col("dec").alias("dec ")), path)
    back = tables.read_catalog(spark, path, "id bigint, ` ra` double, `dec ` double")
    return back.select("id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@R.add("A15_write_overlap", ["cat_a"], 'select round(ra, 6) as "RA", round(dec, 6) as "DEC" from cat_a')
def write_overlap(spark, folder):
    path = fresh(spark, "overlap")
    tables.write_overlap(view(spark, folder, "cat_a"), path)
    return tables.read_catalog(spark, path, "RA double, DEC double").select(F.round("RA", 6).alias("RA"), F.round("DEC", 6).alias("DEC"))


TYPED = [c for c in KEPT if c != "index"]


@R.add(
    "A2_typed_report",
    ["raw_report"],
    cleaned_sql("train") + "select name, cast(P_CW as double) as P_CW, cast(badBulgeFitFlag as boolean) as badBulgeFitFlag, cast(bulgeAxisRatio as double) as bulgeAxisRatio, "
    "try_cast(likOfCtr as double) as likOfCtr, covarFit from c",
)
def typed_report(spark, folder):
    path = fresh(spark, "report")
    tables.write_csv(view(spark, folder, "raw_report"), path)
    raw = tables.read_report(spark, path, COLUMNS)
    typed = reports.typed_report(reports.sanitize_report(raw, "train"))
    return typed.select("name", "P_CW", "badBulgeFitFlag", "bulgeAxisRatio", "likOfCtr", "covarFit")


def renamed(spark, folder: str, name) -> None:
    """Give every data file of a written folder, sub-folders included, the name that ``name`` makes of its path below the folder and its number."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = [], fs.listFiles(top, True)
    while listing.hasNext():
        found.append(listing.next().getPath())
    for k, path in enumerate(sorted((p for p in found if p.getName().startswith("part-")), key=lambda p: p.toString())):
        below = path.getParent().toString().removeprefix(fs.makeQualified(top).toString()).strip("/")
        to = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name(below, k)}")
        fs.mkdirs(to.getParent())
        if not fs.rename(path, to):
            raise OSError(f"cannot rename {path}")


TAKEN = ["index", "name", "P_CW", "fit_state", "cropRad"]


@R.add("A3_combine_reports", ["raw_report"], 'select "index", name, P_CW, trim(fit_state) as fit_state, cropRad from raw_report')
def combine(spark, folder):
    root = fresh(spark, "tree")
    raw = view(spark, folder, "raw_report")
    number = F.col("index").cast("bigint")
    # Three orders of the columns, one of them with a column that the others lack.
    for k, order in enumerate((COLUMNS, COLUMNS[::-1], sorted(COLUMNS))):
        part = raw.filter(number % 3 == k).select(*order)
        tables.write_csv(part.withColumn("more", F.lit("a, b")) if k == 2 else part, f"{root}/order{k}")
    # Arc tables share the tree and are to be left out; so do files with a header alone.
    tables.write_csv(raw.select("name", F.lit("1").alias("arc_length")), f"{root}/arcs")
    renamed(spark, f"{root}/arcs", lambda below, k: f"galaxy{k}_arcs.csv")
    tables.write_csv(raw.filter("false").select(*COLUMNS), f"{root}/none")
    return tables.combine_reports(spark, root, TAKEN)


def variation_tree(spark, folder: str) -> str:
    """One ``galaxy.csv`` for each value of P_CW: two orders of columns, and lines with too many fields, with too few, and blank ones."""
    root = fresh(spark, "variations")
    raw = view(spark, folder, "raw_report").withColumn("number", F.col("index").cast("bigint"))
    orders = [COLUMNS, [*COLUMNS[::-1]]]
    flip = F.col("P_CW").isin("0.1", "0.4")
    line = lambda cols: F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cols])
    whole = [line([F.col(c) for c in order]) for order in orders]
    long = [F.concat(w, F.lit(",more")) for w in whole]
    short = [line([F.col(c) for c in order[:-3]]) for order in orders]
    texts = [F.when(F.col("number") % 10 == 0, x).when(F.col("number") % 10 == 1, y).when(F.col("number") % 10 == 2, F.concat(w, F.lit("\n"))).otherwise(w) for w, x, y in zip(whole, long, short, strict=True)]
    rows = raw.select(F.col("P_CW").alias("object"), F.lit(1).alias("place"), F.when(flip, texts[1]).otherwise(texts[0]).alias("value"))
    tops = raw.select("P_CW").distinct().select(F.col("P_CW").alias("object"), F.lit(0), F.when(flip, F.lit(", ".join(orders[1]))).otherwise(F.lit(",".join(orders[0]))))
    lines = rows.union(tops).repartition("object").sortWithinPartitions("object", "place")
    lines.select("object", "value").write.partitionBy("object").text(root)
    renamed(spark, root, lambda below, k: f"{below.removeprefix('object=')}/2-OUT/galaxy.csv")
    return root


@R.add(
    "A4_variation_reports",
    ["raw_report"],
    "select P_CW as object_id, \"index\" as row_index, case when cast(\"index\" as bigint) % 10 = 1 and P_CW not in ('0.1', '0.4') then null else cropRad end as cropRad, "
    "case when cast(\"index\" as bigint) % 10 = 1 and P_CW not in ('0.1', '0.4') then null else bar_used end as bar_used "
    "from raw_report where trim(fit_state) = 'OK' and cast(\"index\" as bigint) % 10 <> 0 and not (cast(\"index\" as bigint) % 10 = 1 and P_CW in ('0.1', '0.4'))",
)
def variations(spark, folder):
    # Short lines of the flipped order lack the index itself.
    found = tables.read_variations(spark, variation_tree(spark, folder), [*TAKEN, "bar_used"])
    return found.filter("index is not null").select("object_id", F.col("index").alias("row_index"), "cropRad", "bar_used")


@R.add(
    "A4_rejected_lines",
    ["raw_report"],
    "select P_CW as object_id, 'too many fields' as reason, count(*) as n from raw_report where cast(\"index\" as bigint) % 10 = 0 group by 1",
)
def rejected(spark, folder):
    found = tables.rejected_lines(spark, variation_tree(spark, folder), TAKEN, "", tables.VARIED)
    return found.groupBy(F.regexp_extract("file_path", r"([^/]+)/2-OUT/galaxy\.csv$", 1).alias("object_id"), "reason").agg(F.count("*").alias("n"))


@R.add(
    "A10_portal_uris",
    ["manifest_files"],
    "select 'mast:' || file_name as uri from manifest_files where file_name like '%\\_i2d.fits' escape '\\'",
)
def portal(spark, folder):
    path = fresh(spark, "portal")
    m = view(spark, folder, "manifest_files")
    top = spark.createDataFrame([(-5, "# portal export"), (-4, ""), (-3, "# a, b"), (-2, "#"), (-1, 'note, "x, y", dataURI , size')], "id long, value string")
    rows = m.select("id", F.concat(F.lit('"a, ""b""",c,'), F.lit("mast:"), "file_name", F.lit(",3")).alias("value"))
    # One file: lines are put in order in one task here, because the export is one file; the reader splits it.
    rows.union(top).coalesce(1).sortWithinPartitions("id").select("value").write.text(path)
    return tables.portal_uris(spark, path)


@R.add(
    "A9_download_manifest",
    ["products"],
    "p as (select coalesce(uri, '') as u, coalesce(filename, '') as f, coalesce(calib_level, '') as l from products) "
    "select u as data_uri, f as product_filename, 'named' as layout from p where l = '2' and u <> '' and f <> '' and false union all "
    "select u, f, 'named' from p where replace(l, '.0', '') = '3' and u <> '' and f <> '' union all select u, f, 'legacy' from p where replace(l, '.0', '') = '3' and u <> '' and f <> ''",
)
def download_manifest(spark, folder):
    p = view(spark, folder, "products")
    text = [F.coalesce(c, F.lit("")) for c in (F.col("uri"), F.col("filename"), F.replace("calib_level", F.lit(".0"), F.lit("")))]
    named = tables.manifest_rows(p.select(F.array(*text).alias("fields")), [" dataURI", "productFilename", "calib_level "])
    blank = F.lit("")
    legacy_fields = F.array(*[{6: text[0], 14: text[1], 18: text[2]}.get(i, blank) for i in range(20)])
    legacy = tables.manifest_rows(p.select(legacy_fields.alias("fields")), ["a", "b"])
    return named.withColumn("layout", F.lit("named")).unionByName(legacy.withColumn("layout", F.lit("legacy")))


@R.add(
    "A11_source_manifest",
    ["cat_a"],
    "select cast(ra as varchar) as ra, cast(dec as varchar) as dec, case when id % 2 = 0 then 'Hubble' else 'JWST' end as scope, '' as provider, 'p' || cast(id as varchar) as path, "
    "'' as ext, 'SCI' as ext_name, '' as product_filename, '' as obs_id, '' as target_name, '' as filter, case when id % 3 = 0 then 'x' else '' end as note, "
    "case when id % 5 = 0 then 'y' else '' end as seen from (select id, printf('%.6f', ra) as ra, printf('%.6f', dec) as dec from cat_a)",
)
def source_manifest(spark, folder):
    a = view(spark, folder, "cat_a")
    from skytable.functions.coords import fixed_text

    rows = a.select(
        fixed_text(F.col("ra"), 6).alias("ra"), fixed_text(F.col("dec"), 6).alias("dec"), F.when(F.col("id") % 2 == 0, "Hubble").otherwise("JWST").alias("scope"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("SCI").alias("ext_name"),
        F.map_filter(
            F.create_map(F.lit("seen"), F.when(F.col("id") % 5 == 0, "y"), F.lit("note"), F.when(F.col("id") % 3 == 0, "x")), lambda k, v: v.isNotNull()
        ).alias("extras"),
    )
    return tables.source_manifest(rows, tables.extra_fields(rows))


@R.add(
    "A5_image_listing",
    ["manifest_files"],
    "select count(*) as n from manifest_files where file_name like '%.fits'",
)
def image_listing(spark, folder):
    # The names of the manifest stand for a listing; the vote between kinds runs on them.
    m = view(spark, folder, "manifest_files").select(F.concat(F.lit("s3/"), F.upper("file_name")).alias("path"))
    extra = m.select(F.regexp_replace("path", "(?i)_i2d.fits$", ".png").alias("path")).filter(F.col("path").endswith(".png"))
    return tables.majority_images(m.unionByName(extra)).agg(F.count("*").alias("n"))


@R.add(
    "D15_drift_report",
    ["raw_report"],
    "u as (select 'chirality_maj' as \"column\", chirality_maj as value from raw_report union all select 'warnings', case when trim(warnings) = '' then null else warnings end from raw_report), "
    "n as (select \"column\", value, count(*) as n from u group by 1, 2) select \"column\", 'null' as state, value, n from n where value is null union all "
    "select \"column\", 'unseen', value, n from n where value is not null and not (\"column\" = 'chirality_maj' and value in (select chirality_alenWtd from raw_report))",
)
def drift(spark, folder):
    raw = view(spark, folder, "raw_report").withColumn("warnings", F.when(F.trim("warnings") != "", F.col("warnings")))
    classes = models.fit_encoder(raw.select(F.col("chirality_alenWtd").alias("chirality_maj")), ["chirality_maj"])
    return stats.drift_report(raw, classes, ["chirality_maj", "warnings"])


@R.add(
    "D16_null_counts",
    ["products"],
    "select unnest(['filename', 'uri', 'calib_level', 'obs_collection']) as \"column\", unnest([count(*) - count(filename), count(*) - count(uri), count(*) - count(calib_level), "
    "count(*) - count(obs_collection)]) as nulls from products",
)
def nulls(spark, folder):
    return stats.null_counts(view(spark, folder, "products").select("filename", "uri", "calib_level", "obs_collection"))


@R.add(
    "L1_L2_encode",
    ["raw_report"],
    "k as (select value, row_number() over (order by value) - 1 as code from (select distinct chirality_alenWtd as value from raw_report)) "
    "select index, cast(coalesce(k.code, 0) as int) as chirality_maj from raw_report r left join k on k.value = r.chirality_maj",
)
def encode(spark, folder):
    raw = view(spark, folder, "raw_report")
    encoder = models.fit_encoder(raw.select(F.col("chirality_alenWtd").alias("chirality_maj")), ["chirality_maj"])
    return models.encode(raw.select("index", "chirality_maj"), encoder, ["chirality_maj"])


@R.add("G3_work_list", ["manifest_files"], "o as (select file_name, min(id) as id from manifest_files where size > 25 group by 1), n as (select distinct file_name from manifest_files where file_name not in (select file_name from o)) "
       "select cast(0 as int) as block, id, file_name from o union all select 1, null, file_name from n")
def work_list(spark, folder):
    m = view(spark, folder, "manifest_files")
    return manifests.extend_work_list(m.filter("size > 25"), m, "file_name", "id")
