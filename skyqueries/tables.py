"""Manifests, lookups, ranks, summaries and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, detections, haversine, view
from skytable.functions import report
from skytable.operators import lookup, manifests, models, ranking, sampling, spatial, stats
from skytable.plans import spirality
from skytable.sources.tables import MANIFEST_COLUMNS

R = Registry()

# ---- manifests ----

BATCHED = "x as (select *, id % 7 as batch from products) "
ENRICH_OBS = "ob as (select * from (select *, row_number() over (partition by fileSetName order by id) as rn from observations) where rn = 1) "


def normalized(source: str, batch: str, enriched: bool) -> str:
    join = " left join ob on ob.fileSetName = x.dataset" if enriched else ""
    level = "coalesce(x.calib_level, ob.productLevel)" if enriched else "x.calib_level"
    pick = {
        "target_name": "ob.targprop" if enriched else "''",
        "filters": "ob.opticalElements" if enriched else "''",
        "proposal_id": "ob.program" if enriched else "''",
        "dataRights": "ob.access" if enriched else "''",
    }
    return (
        f"j as (select x.id, {batch} as batch, trim(coalesce(x.uri, '')) as uri, trim(coalesce(x.filename, '')) as fn, x.dataset as obsID, "
        f"{pick['target_name']} as target_name, 'JWST' as obs_collection, replace(coalesce({level}, ''), '.0', '') as lv, x.category as productType, x.dataproduct_type as kind, "
        f"x.instrume as instrume, '' as exp_type, {pick['filters']} as filters, {pick['proposal_id']} as proposal_id, x.size as size, {pick['dataRights']} as dataRights from {source} x{join}), "
        "fl as (select batch, max(lv <> '') as has_level, max(kind <> '') as has_kind from j group by 1), "
        "kp as (select j.*, case when has_level then lv else '3' end as level from j join fl using (batch) where fn like '%\\_i2d.fits' escape '\\' "
        "and (case when has_level then lv else '3' end) = '3' and (not has_kind or kind = 'image')), "
        "nn as (select *, row_number() over (partition by batch, fn order by id) as rn from kp) "
    )


NORM_OUT = (
    "case when uri = '' then 'mast:JWST/product/' || fn else uri end as dataURI, fn as productFilename, obsID, target_name, obs_collection, level as calib_level, productType, "
    "kind as dataproduct_type, instrume, exp_type, filters, proposal_id, size, dataRights from nn where rn = 1"
)


@R.add("N1_normalize_products", ["products"], normalized("products", "0", False) + f"select {NORM_OUT}")
def normalize(spark, folder):
    return manifests.normalize_products(view(spark, folder, "products"), "id")


@R.add("N2_export_manifest", ["products", "observations"], f"{BATCHED}, {ENRICH_OBS}, " + normalized("x", "x.batch", True) + f"select batch, {NORM_OUT}")
def export(spark, folder):
    p = view(spark, folder, "products").withColumn("batch", F.col("id") % 7)
    return manifests.export_manifest(p, view(spark, folder, "observations"), "id", "batch")


@R.add(
    "C5_enrich_products",
    ["products", "observations"],
    ENRICH_OBS + "select x.id, x.dataset, ob.targprop as target_name_obs, ob.program as proposal_id_obs, ob.access as dataRights_obs, ob.productLevel as calib_level_obs, "
    "ob.opticalElements as filters_obs from products x left join ob on ob.fileSetName = x.dataset",
)
def enrich(spark, folder):
    e = manifests.enrich_products(view(spark, folder, "products"), view(spark, folder, "observations"), "id")
    return e.select("id", "dataset", "target_name_obs", "proposal_id_obs", "dataRights_obs", "calib_level_obs", "filters_obs")


@R.add(
    "G1_F1_merge_manifests",
    ["products"],
    "p as (select id, coalesce(filename, '') as fn, uri, 0 as part from products where dataproduct_type = 'image' union all select id, coalesce(filename, ''), 'second', 1 from products), "
    "r as (select *, row_number() over (partition by fn order by part, id) as rn from p) select uri as dataURI, fn as productFilename from r where rn = 1",
)
def merge(spark, folder):
    p = view(spark, folder, "products")
    blank = [F.lit("").alias(c) for c in MANIFEST_COLUMNS if c not in ("dataURI", "productFilename")]
    name = F.coalesce("filename", F.lit("")).alias("productFilename")
    first = p.filter("dataproduct_type = 'image'").select("id", F.col("uri").alias("dataURI"), name, *blank)
    second = p.select("id", F.lit("second").alias("dataURI"), name, *blank)
    return manifests.merge_manifests([first, second], "id").select("dataURI", "productFilename")


RANK = (
    "case when lower(f) like '%\\_drc.fits' escape '\\' then 0 when lower(f) like '%\\_drz.fits' escape '\\' then 1 when lower(f) like '%\\_flc.fits' escape '\\' then 2 "
    "when lower(f) like '%\\_flt.fits' escape '\\' then 3 else 4 end, case when lv = 3 then 0 else 1 end, case when contains(f, '_f814w_') then 0 else 1 end, "
    "case when contains(f, 'skycell') or contains(f, '_all_') or contains(f, '_total_') then 1 else 0 end, f"
)
HST = (
    "select p_partkey as id, p_brand as obs_id, 'hst_' || cast(p_partkey as string) || case p_partkey % 3 when 0 then '_f814w_' when 1 then '_all_' else '_f606w_skycell_' end || "
    "case p_partkey % 5 when 0 then 'x_flc.fits' when 1 then 'x_drz.fits' when 2 then 'x_drc.fits' when 3 then 'x_flt.fits' else 'x_spt.fits' end as f, "
    "cast(p_size % 3 + 1 as int) as lv from {part}"
)


@R.add("E5_best_product", None, f"with h as ({HST.replace('{part}', 'part')}), r as (select *, row_number() over (partition by obs_id order by {RANK}) as rn from h) select obs_id, f from r where rn = 1")
def best_product(spark, folder):
    from skyqueries.inputs import table

    h = spark.sql(HST, part=table(spark, folder, "part"))
    return ranking.first_per_key(h, ["obs_id"], [ranking.product_rank(F.col("f"), F.col("lv"))]).select("obs_id", "f")


@R.add(
    "E5_best_mosaic",
    ["manifest_files"],
    "m as (select *, 'jw' || lpad(cast((id * 13) % 50 as varchar), 6, '0') as obs_id from manifest_files), "
    "r as (select *, row_number() over (partition by obs_id order by case when file_name = obs_id || '_i2d.fits' then 0 else 1 end, case when contains(lower(file_name), '_nrc') then 1 else 0 end, file_name) as rn from m) "
    "select obs_id, file_name from r where rn = 1",
)
def best_mosaic(spark, folder):
    m = view(spark, folder, "manifest_files").withColumn("obs_id", F.concat(F.lit("jw"), F.lpad(((F.col("id") * 13) % 50).cast("string"), 6, "0")))
    return ranking.first_per_key(m, ["obs_id"], [ranking.mosaic_product_rank(F.col("file_name"), F.col("obs_id"))]).select("obs_id", "file_name")


@R.add(
    "E3_keep_first_and_last",
    ["products"],
    "select filename, min(id) as first_id, max(id) as last_id from products where filename is not null group by 1",
)
def keep_first(spark, folder):
    p = view(spark, folder, "products").filter("filename is not null").select("filename", "id")
    first = ranking.first_per_key(p, ["filename"], [F.col("id")]).withColumnRenamed("id", "first_id")
    last = ranking.first_per_key(p, ["filename"], [F.col("id")], last=True).withColumnRenamed("id", "last_id")
    return first.join(last, "filename")


@R.add("E11_F1_renumber", ["manifest_files"], "select file_name, id, row_number() over (order by file_name, id) - 1 as number from manifest_files")
def renumbered(spark, folder):
    m = view(spark, folder, "manifest_files").select("file_name", "id")
    return ranking.renumber(m, [F.col("file_name"), F.col("id")], "number")


# ---- lookups ----


def c4(value: str) -> str:
    return (
        "k as (select *, cast(floor(ra * 1e4 + 0.5) as bigint) as kr, cast(floor(dec * 1e4 + 0.5) as bigint) as kd from truth), "
        f"l as (select kr, kd, arg_max({value}, id) as v from k group by 1, 2), "
        "n as (select t.row_id, t.name, cast(floor(a.ra * 1e4 + 0.5) as bigint) as kr, cast(floor(a.dec * 1e4 + 0.5) as bigint) as kd from truth_report t join cat_a a on a.id = t.row_id where t.name not like 'bad%') "
        "select n.row_id, n.name, l.v as P_CW, '0' as P_ACW from n join l using (kr, kd)"
    )


@R.add("C4_match_ground_truth", ["truth", "truth_report", "cat_a"], c4("fraction"))
def ground_truth(spark, folder):
    m = lookup.match_ground_truth(view(spark, folder, "truth_report"), view(spark, folder, "truth"), "fraction", "id")
    return m.select("row_id", "name", "P_CW", "P_ACW")


@R.add("C4_match_ground_truth_second_value", ["truth", "truth_report", "cat_a"], c4("votes"))
def ground_truth_votes(spark, folder):
    m = lookup.match_ground_truth(view(spark, folder, "truth_report"), view(spark, folder, "truth"), "votes", "id")
    return m.select("row_id", "name", "P_CW", "P_ACW")


LABELS = (
    "select doc_id, case when quality = 1 then '1-galaxies' else '1-not-galaxies' end as label_dir, cast(doc_id as string) || '.png' as score_filename from {labels}"
)
MAPPING = (
    "select case when l.quality = 1 then '1-galaxies' else '1-not-galaxies' end as label_dir, cast(d.doc_id - d.n_chars % 2 as string) || '.png' as score_filename, "
    "case when d.n_chars % 7 = 0 then ' ' when d.n_chars % 7 = 1 then 'a_b' else '1_' || cast(d.doc_id % 100 as string) || '_2_5_f150w_v1' end as source_name "
    "from {documents} d join {labels} l on d.doc_id = l.doc_id"
)
FILES = "select '1.' || cast(doc_id % 90 as string) || '_2.5_f150w_v1.fits' as fits_path, doc_id % 90 <> 5 as readable from {documents}"


def _plain(text: str) -> str:
    return text.replace("{labels}", "labels").replace("{documents}", "documents")


@R.add(
    "C7_label_sources",
    None,
    f"with lab as ({_plain(LABELS)}), map as ({_plain(MAPPING)}), fil as (select fits_path, max(readable) as readable from ({_plain(FILES)}) group by 1), "
    "per as (select label_dir, score_filename, count(*) as n, min(trim(source_name)) as s from map group by 1, 2), "
    "j as (select lab.*, per.n, per.s, case when n = 1 and regexp_matches(s, '^1_[0-9]+_2_5_f150w_v1$') then '1.' || split_part(s, '_', 2) || '_2.5_f150w_v1.fits' end as fits_path from lab left join per using (label_dir, score_filename)) "
    "select doc_id, case when n is null then 'missing_mapping' when n > 1 then 'duplicate_mapping' when s = '' then 'missing_source_name' when j.fits_path is null then 'invalid_source_name' "
    "when fil.readable is null then 'missing_fits' when not fil.readable then 'unreadable_fits' else 'accepted' end as reason from j left join fil on fil.fits_path = j.fits_path",
)
def label_sources(spark, folder):
    from skyqueries.inputs import table

    given = {t: table(spark, folder, t) for t in ("labels", "documents")}
    labels, mapping, files = spark.sql(LABELS, labels=given["labels"]), spark.sql(MAPPING, **given), spark.sql(FILES, documents=given["documents"])
    return lookup.label_sources(labels, mapping, files).select("doc_id", "reason")


@R.add(
    "C8_ensemble_predictions",
    ["scored"],
    "u as (select l_orderkey, min(p) as p from scored where split = 'test' group by 1), v as (select l_orderkey, max(pred) as q from scored where split = 'test' and l_linenumber > 2 group by 1) "
    "select cast(u.l_orderkey as varchar) as name, round(case when q is null then u.p else (u.p + q) / 2 end, 8) as P_spiral_predicted from u left join v using (l_orderkey)",
)
def ensemble(spark, folder):
    s = view(spark, folder, "scored").withColumn("name", F.col("l_orderkey").cast("string"))
    one = s.groupBy("name", "split").agg(F.min("p").alias("P_spiral_predicted"))
    two = s.filter("l_linenumber > 2").groupBy("name", "split").agg(F.max("pred").alias("P_spiral_predicted"))
    return lookup.ensemble_predictions([one, two]).select("name", F.round("P_spiral_predicted", 8).alias("P_spiral_predicted"))


@R.add(
    "C9_name_for_score",
    ["lines", "cat_b"],
    "p as (select 'n' || cast(l_orderkey as varchar) as name, round(l_extendedprice) as sc from lines), g as (select sc, min(name) as lo, max(name) as hi from p group by 1) "
    "select id, case when id < 1000 then 'forced' when lo = hi then lo end as name, case when id < 1000 then 'ok' when lo = hi then 'ok' when lo is null then 'missing' else 'ambiguous' end as state "
    "from cat_b left join g on g.sc = cat_b.id",
)
def name_for_score(spark, folder):
    b = view(spark, folder, "cat_b").select("id", F.concat(F.col("id").cast("string"), F.lit(".00")).alias("score"))
    p = view(spark, folder, "lines").select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("name"), F.round("l_extendedprice").cast("bigint").cast("string").alias("score"))
    forced = b.filter("id < 1000").select(F.col("id").cast("string").alias("score_text"), F.lit("forced").alias("name"))
    return lookup.name_for_score(b, p, forced).select("id", "name", "state")


@R.add(
    "C11_pending_work",
    ["manifest_files"],
    "select id, case when file_name in (select file_name from manifest_files where size > 25) then 'skipped' else 'pending' end as status from manifest_files",
)
def pending(spark, folder):
    m = view(spark, folder, "manifest_files")
    return lookup.pending_work(m, m.filter("size > 25"), ["file_name"]).select("id", "status")


@R.add(
    "C11_reusable_sources",
    ["cat_a"],
    "select id, id % 2 = 0 and id % 3 <> 0 and id % 5 <> 0 as usable from cat_a",
)
def reusable(spark, folder):
    rows = view(spark, folder, "cat_a").select(
        "id", F.when(F.col("id") % 2 == 0, "Hubble").otherwise("JWST").alias("scope"), F.when(F.col("id") % 3 != 0, "p").alias("path"),
        F.when(F.col("id") % 5 != 0, "sci").alias("ext_name"),
    )
    return rows.select("id", lookup.reusable_source("Hubble", F.lit(True)).alias("usable"))


@R.add("C12_map_back", ["scored", "raw_report"], "select cast(index as bigint) as row_id, name, cast(index as bigint) * 2 as score from raw_report where trim(fit_state) = 'OK'")
def map_back(spark, folder):
    raw = view(spark, folder, "raw_report").withColumn("row_id", F.col("index").cast("bigint"))
    results = report.trimmed(raw, ["fit_state"]).filter("fit_state = 'OK'").select("row_id", (F.col("row_id") * 2).alias("score"))
    return lookup.map_back(results, raw.select("row_id", "name"), "row_id")


@R.add(
    "C10_with_label_value",
    ["lines", "truth"],
    "select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, cast(t.fraction as double) as p from lines l join truth t on t.id = l.l_partkey where l.l_partkey not in (select id from truth where votes = 'n/a')",
)
def with_label(spark, folder):
    v = view(spark, folder, "lines").withColumn("object_id", F.col("l_partkey").cast("string"))
    t = view(spark, folder, "truth")
    labels = t.select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("object_id"), F.col("fraction").cast("double").alias("p"), "id")
    held = t.filter("votes = 'n/a'").select(F.col("id").cast("string").alias("object_id"))
    return lookup.with_label_value(v, labels, held, "id").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p")


# ---- summaries ----


@R.add(
    "D6_bin_histogram",
    ["lines"],
    "c as (select least(cast(floor(l_discount * 10 * 10) as int), 9) as bin, count(*) as n from lines group by 1), r as (select cast(unnest(range(10)) as int) as bin) "
    "select r.bin, coalesce(c.n, 0) as n, (select max(n) from c) as max_n from r left join c using (bin)",
)
def histogram(spark, folder):
    return stats.bin_histogram(view(spark, folder, "lines").withColumn("p", F.col("l_discount") * 10), "p")


def bucket_counts(n: int, closed: bool) -> str:
    out = []
    for i in range(n):
        lo, hi = round(i / n, 3), round((i + 1) / n, 3)
        upper = "" if closed and i == n - 1 else f" and p < {hi}::double"
        out.append(f"count(*) filter (where p >= {lo}::double{upper})")
    return ", ".join(out)


@R.add(
    "D7_smallest_bucket",
    ["scored"],
    f"o as (select least({bucket_counts(10, False)}) as original from scored), l as (select list_min(list_filter([{bucket_counts(10, True)}], lambda n: n > 0)) as later from scored) "
    "select original, later from o, l",
)
def smallest(spark, folder):
    s = view(spark, folder, "scored")
    a = stats.smallest_bucket(s, "p", 10, "original").select(F.col("smallest").alias("original"))
    b = stats.smallest_bucket(s, "p", 10, "later")
    return a.withColumn("later", b.scalar())


@R.add(
    "D8_regression_metrics",
    ["scored"],
    "select split, count(*) as n, round(1 - sum(pow(p - pred, 2)) / (var_pop(p) * count(*)), 8) as r2, round(sqrt(avg(pow(p - pred, 2))), 8) as rmse, round(avg(abs(p - pred)), 8) as mae from scored group by 1",
)
def regression(spark, folder):
    m = stats.regression_metrics(view(spark, folder, "scored"), "p", "pred", ["split"])
    return m.select("split", "n", *[F.round(c, 8).alias(c) for c in ("r2", "rmse", "mae")])


@R.add(
    "D9_high_score_rmse",
    ["scored"],
    "select round(sqrt(avg(pow(p - pred, 2))), 8) as rmse_all, "
    + ", ".join(f"round(sqrt(avg(pow(p - pred, 2)) filter (where pred >= {c}::double)), 8) as rmse_{round(c * 10)}" for c in (0.6, 0.7, 0.8))
    + " from scored where split = 'test'",
)
def high_scores(spark, folder):
    m = stats.high_score_rmse(view(spark, folder, "scored"), "p", "pred")
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@R.add(
    "D10_distinct_high_rmse",
    ["scored"],
    "d as (select distinct p, pred, l_orderkey from scored where split = 'test' and p >= 0.4::double) select count(*) as n, round(sqrt(avg(pow(p - pred, 2))), 8) as rmse from d",
)
def distinct_high(spark, folder):
    s = view(spark, folder, "scored").select("p", "pred", "l_orderkey", "split")
    m = stats.distinct_high_rmse(s, "p", "pred")
    return m.withColumn("rmse", F.round("rmse", 8))


@R.add(
    "D11_classification_report",
    ["labelled"],
    "c as (select count(*) filter (where quality = 0 and toxic = 0) as tn, count(*) filter (where quality = 0 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic = 0) as fn, "
    "count(*) filter (where quality = 1 and toxic = 1) as tp from labelled) select *, (tp + tn) / (tp + tn + fp + fn) as accuracy, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, "
    "case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, "
    "case when tn + fn > 0 then tn / (tn + fn) else 0 end as precision_0, case when tn + fp > 0 then tn / (tn + fp) else 0 end as recall_0, "
    "case when 2 * tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end as f1_0 from c",
)
def classification(spark, folder):
    return stats.classification_report(view(spark, folder, "labelled"), "quality", "toxic")


@R.add("D11_misclassified", ["labelled"], "select id, quality, toxic from labelled where quality <> toxic")
def misclassified(spark, folder):
    return stats.misclassified(view(spark, folder, "labelled"), "quality", "toxic").select("id", "quality", "toxic")


@R.add(
    "D18_throughput",
    ["progress"],
    "w as (select worker, count(*) as files, count(*) filter (where is_error) as galaxies, sum(bytes_read) as bytes_read, cast(max(user_id) as double) as el from progress group by 1), "
    "r as (select *, case when el > 0 then bytes_read / el / 1048576 else 0 end as mb from w) "
    "select worker, cast(sum(files) as bigint) as files, cast(sum(galaxies) as bigint) as galaxies, round(sum(bytes_read), 4) as bytes_read, round(sum(mb), 10) as mb_per_s from r group by grouping sets ((worker), ())",
)
def throughput(spark, folder):
    p = view(spark, folder, "progress").select(
        "worker", F.lit(1).alias("files"), F.col("is_error").cast("int").alias("galaxies"), "bytes_read", F.col("user_id").cast("double").alias("elapsed_seconds")
    )
    t = stats.throughput(p)
    return t.withColumn("bytes_read", F.round("bytes_read", 4)).withColumn("mb_per_s", F.round("mb_per_s", 10))


@R.add(
    "D18_eta",
    ["progress"],
    "w as (select worker, count(*) as done, max(user_id) as el from progress group by 1), s as (select worker, cast(floor((50000 - done) / (done / el)) as bigint) as s, el from w) "
    "select worker, case when el = 0 then 'N/A' else case when s >= 86400 then cast(s // 86400 as varchar) || case when s // 86400 = 1 then ' day, ' else ' days, ' end else '' end || "
    "printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) end as eta from s",
)
def eta(spark, folder):
    w = view(spark, folder, "progress").groupBy("worker").agg(F.count("*").alias("done"), F.max("user_id").alias("el"))
    return w.select("worker", stats.eta_text(F.col("done"), F.lit(50000), F.col("el")).alias("eta"))


@R.add(
    "D19_footprint_report",
    ["detections"],
    "g as (select k1, k2, count(*) as c, sum(height * width * 8) as b from detections group by 1, 2) select count(*) as num_groups, cast(sum(c) as bigint) as num_crops, cast(sum(b) as bigint) as total_size, "
    "avg(b) as bytes_per_group, sum(b) / sum(c) as bytes_per_crop from g",
)
def footprint_report(spark, folder):
    return stats.footprint_report(detections(spark, folder).withColumn("group_seq", F.struct("k1", "k2")))


RESULTS = "select l_orderkey as model, case when l_linenumber = 3 then 'failed' else 'success' end as status, l_tax + l_discount / 1e3 as val_rmse, l_discount as val_r2, l_partkey, l_suppkey from lines"


@R.add("D20_grid_summary", ["lines"], f"r as ({RESULTS}) select count(*) filter (where status = 'success') as successful, count(*) filter (where status <> 'success') as failed, "
       "min(val_rmse) filter (where status = 'success') as best_rmse, max(val_r2) filter (where status = 'success') as best_r2 from r")
def grid_summary(spark, folder):
    r = spark.sql(RESULTS.replace("from lines", "from {lines}"), lines=view(spark, folder, "lines"))
    return stats.grid_summary(r)


@R.add("F2_best_models", ["lines"], f"r as (select min(val_rmse) as val_rmse, model, status from ({RESULTS}) group by model, status) select model, val_rmse from r where status = 'success' order by val_rmse, model limit 10")
def best_models(spark, folder):
    r = spark.sql(RESULTS.replace("from lines", "from {lines}"), lines=view(spark, folder, "lines"))
    return stats.best_models(r.groupBy("model", "status").agg(F.min("val_rmse").alias("val_rmse"))).select("model", "val_rmse")


@R.add("F3_recent_errors", ["progress"], "select worker, cast(event_id as varchar) as file from progress where is_error order by ts desc, worker, cast(event_id as varchar) limit 5")
def recent_errors(spark, folder):
    e = view(spark, folder, "progress").filter("is_error").select("worker", F.col("event_id").cast("string").alias("file"), F.col("ts").alias("time"))
    return stats.recent_errors(e).select("worker", "file")


@R.add("F5_first_rows", ["cat_a"], "select id, ra, dec from cat_a order by dec, id limit 25")
def first_rows(spark, folder):
    return sampling.first_rows(view(spark, folder, "cat_a"), ["dec", "id"], 25)


@R.add("F5_random_rows")
def random_rows(spark, folder):
    return sampling.random_rows(view(spark, folder, "cat_a"), ["id"], 25, 42)


@R.add(
    "F6_cone_candidates",
    ["cat_a", "cat_b"],
    f"select b.id, a.id as candidate, round({haversine('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 4) as sep from cat_b b join cat_a a on abs(a.dec - b.dec) <= 0.0101 "
    f"and {haversine('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 36.0",
)
def cone(spark, folder):
    b = view(spark, folder, "cat_b")
    a = view(spark, folder, "cat_a").select(F.col("id").alias("candidate"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"))
    got = spatial.cone_pairs(b, a, 36.0)
    return got.select("id", "candidate", F.round("sep_arcsec", 4).alias("sep")).orderBy("id", "sep", "candidate")


@R.add("D13_label_counts", ["labelled"], "select source, count(*) as n from labelled group by 1")
def label_counts(spark, folder):
    return stats.label_counts(view(spark, folder, "labelled"), "source")


# ---- splits: which rows are drawn is a seeded hash, so the checks compare sizes ----

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@R.add(
    "E6_validation_sizes",
    ["scored"],
    "x as (select *, least(greatest(cast(ceil((p - (select min(p) from scored)) / (((select max(p) from scored) - (select min(p) from scored)) / 10)) as int) - 1, 0), 9) as b from scored) "
    "select cast(sum(greatest(1, floor(n * 0.2))) as bigint) as n from (select b, count(*) as n from x group by 1)",
)
def validation_sizes(spark, folder):
    s = view(spark, folder, "scored").withColumn("name", F.concat_ws("_", *IDS))
    # Equal rows share a name and are drawn together, so distinct row ids are counted.
    return sampling.validation_names(s.dropDuplicates(["name"]), "p", ["name"]).agg(F.count("*").alias("n"))


@R.add(
    "E7_bucket_split_sizes",
    ["scored"],
    f"q as (select unnest([{bucket_counts(5, True)}]) as n from scored), m as (select cast(floor(min(n) * 0.8::double) as bigint) as k from q where n > 0) "
    "select 'train' as split, cast(sum(least(k, n)) as bigint) as n from q, m union all select 'test', cast(sum(n - least(k, n)) as bigint) from q, m",
)
def bucket_sizes(spark, folder):
    return sampling.bucket_split(view(spark, folder, "scored"), "p", IDS, 5).groupBy("split").agg(F.count("*").alias("n"))


@R.add(
    "E8_deficit_sizes",
    ["scored", "truth"],
    "o as (select least(cast(floor(p * 10) as int), 9) as b, count(*) as n from scored group by 1), t as (select max(n) as top from o), v as (select least(cast(floor(cast(fraction as double) * 10) as int), 9) as b, "
    "count(*) as n from truth join lines on lines.l_partkey = truth.id group by 1), r as (select cast(unnest(range(10)) as int) as b) "
    "select r.b as bin, least(v.n, t.top - coalesce(o.n, 0)) as n from r join v using (b) left join o using (b), t where t.top - coalesce(o.n, 0) > 0".replace("join lines", "join lineitem").replace("lines.l_partkey", "lineitem.l_partkey"),
)
def deficit_sizes(spark, folder):
    s = view(spark, folder, "scored")
    t = view(spark, folder, "truth").select(F.col("id").alias("l_partkey"), F.col("fraction").cast("double").alias("p"))
    v = view(spark, folder, "lines").join(t, "l_partkey")
    got = sampling.fill_deficit(v, s, "p", IDS)
    return got.groupBy(stats.bin_of(F.col("P_CW")).alias("bin")).agg(F.count("*").alias("n"))


@R.add(
    "E9_capped_sample_sizes",
    ["detections"],
    "f as (select band, file, least(count(*), 500) as n from detections group by 1, 2) select band, least(cast(sum(n) as bigint), 800) as n from f group by 1",
)
def capped(spark, folder):
    return ranking.capped_sample(detections(spark, folder), ["band"], "file", ["seq"], 500, 800, 7).groupBy("band").agg(F.count("*").alias("n"))


@R.add(
    "L3_standardize",
    ["scored"],
    "m as (select avg(p) filter (where split = 'train') as a, stddev_pop(p) filter (where split = 'train') as s, avg(l_extendedprice) filter (where split = 'train') as b, "
    "stddev_pop(l_extendedprice) filter (where split = 'train') as t from scored) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((p - a) / s, 6) as p, round((l_extendedprice - b) / t, 6) as l_extendedprice from scored, m",
)
def standardized(spark, folder):
    s = models.standardize(view(spark, folder, "scored"), ["p", "l_extendedprice"], F.col("split") == "train")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("p", 6).alias("p"), F.round("l_extendedprice", 6).alias("l_extendedprice"))


def _training(spark, folder):
    original = view(spark, folder, "truth").select(
        F.col("id").cast("string").alias("name"), F.col("fraction").cast("double").alias("P_CW"), F.lit(0.0).alias("P_ACW"), F.col("ra").alias("feature"), "id"
    )
    labels = original.select(F.col("name").alias("object_id"), F.col("P_CW").alias("p"), "id")
    variations = view(spark, folder, "lines").withColumn("object_id", F.col("l_partkey").cast("string")).withColumn("feature", F.col("l_extendedprice"))
    return spirality.build_training_set(original.drop("id"), variations, labels, ["name"], IDS, "id")


@R.add(
    "L13_G4_training_set_validation_size",
    ["truth"],
    "x as (select cast(fraction as double) as p from truth), b as (select least(greatest(cast(ceil((p - (select min(p) from x)) / (((select max(p) from x) - (select min(p) from x)) / 10)) as int) - 1, 0), 9) as b from x) "
    "select cast(sum(greatest(1, floor(n * 0.2))) as bigint) as n from (select b, count(*) as n from b group by 1)",
)
def training_validation(spark, folder):
    return _training(spark, folder)[1].agg(F.count("*").alias("n"))


@R.add("L13_G4_training_set")
def training_set(spark, folder):
    return _training(spark, folder)[0].groupBy(stats.bin_of(F.col("P_CW")).alias("bin")).agg(F.count("*").alias("n"))
