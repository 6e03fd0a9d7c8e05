"""Models on the given tables (L4-L12, F4). Forests are random, so only their table shape and counts are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, pixels, table, view
from skyqueries.reports import COLUMNS, cleaned_sql, fresh
from skytable.functions import report
from skytable.operators import images, models, sampling, stats
from skytable.plans import spirality
from skytable.session import cut_lineage

R = Registry()
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _rows(spark, folder):
    lines = view(spark, folder, "lines").withColumn("P_spiral", F.least(F.lit(1.0), F.col("l_discount") * 8 + F.col("l_tax")))
    # A fit reads its input many times, so the split is written once.
    return cut_lineage(sampling.bucket_split(lines, "P_spiral", IDS, 2))


def _forest(spark, folder, trees=10):
    rows = _rows(spark, folder)
    return rows, models.fit_forest(rows.filter("split = 'train'"), FEATURES, "P_spiral", trees, 3, 6)


@R.add("L4_L9_forest_with_spread", None, "select count(*) as n from lineitem")
def forest(spark, folder):
    rows, model = _forest(spark, folder)
    scored = models.predict_spread(model, rows)
    return scored.filter("tree_std >= 0 and prediction between 0 and 1").agg(F.count("*").alias("n"))


# Seven values of the only feature, one target each: every tree that learns them all gives each row its target, and the trees agree.
@R.add(
    "L9_known_leaves",
    None,
    "select l_linenumber, count(*) as n, round(1e0 / l_linenumber, 6) as least, round(1e0 / l_linenumber, 6) as most, cast(0 as double) as spread "
    "from lineitem group by l_linenumber",
)
def known_leaves(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_linenumber", (F.lit(1.0) / F.col("l_linenumber")).alias("target"))
    scored = models.predict_spread(models.fit_forest(lines, ["l_linenumber"], "target", 20, None, 6), lines)
    shown = lambda c, name: F.round(c, 6).alias(name)
    return scored.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), shown(F.min("prediction"), "least"), shown(F.max("prediction"), "most"), shown(F.max("tree_std"), "spread")
    )


@R.add("L4_D8_forest_metrics")
def forest_metrics(spark, folder):
    rows, model = _forest(spark, folder)
    return stats.regression_metrics(model.transform(rows), "P_spiral", "prediction", ["split"])


@R.add("L5_boosted_metrics")
def boosted(spark, folder):
    rows = _rows(spark, folder)
    model = models.fit_boosted(rows.filter("split = 'train'"), FEATURES, "P_spiral", 5, 4)
    return stats.regression_metrics(model.transform(rows), "P_spiral", "prediction", ["split"])


@R.add("F4_feature_importance")
def importance(spark, folder):
    return models.feature_importance(_forest(spark, folder)[1], spark)


@R.add("L6_grid_search")
def grid(spark, folder):
    lines = view(spark, folder, "lines").withColumn("P_spiral", F.least(F.lit(1.0), F.col("l_discount") * 8 + F.col("l_tax")))
    return models.grid_search(lines, FEATURES, "P_spiral", IDS, trees=[5, 10], per_split=[2, 4], buckets=[1, 2], depth=5)


DOC = ["n_chars", "lang_code", "source_code"]


def _documents(spark, folder):
    d = view(spark, folder, "labelled")
    encoder = models.fit_encoder(d.select(F.col("lang").alias("lang_code"), F.col("source").alias("source_code")), ["lang_code", "source_code"])
    coded = models.encode(d.withColumn("lang_code", F.col("lang")).withColumn("source_code", F.col("source")), encoder, ["lang_code", "source_code"])
    return coded.select("id", "quality", F.col("n_chars").cast("double").alias("n_chars"), *[F.col(c).cast("double").alias(c) for c in DOC[1:]])


@R.add("L7_cross_validation", ["labelled"], "select quality, count(*) as n from labelled group by 1")
def cross_validation(spark, folder):
    cv = models.cross_validated(_documents(spark, folder), DOC, "quality", ["id"], 5, 10, 5)
    return cv.groupBy("quality").agg(F.count("*").alias("n"))


@R.add("L7_class_weights", ["labelled"], "select quality, (select count(*) from labelled) / (2 * count(*)) as weight from labelled group by 1")
def weights(spark, folder):
    return models.balanced_weights(view(spark, folder, "labelled"), "quality").select("quality", "weight").distinct()


@R.add("L8_classify_images")
def classify(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") % 2).alias("label"))
    rows = images.simple_features(images.image_sums(pixels(spark, folder))).join(labels, "image_id")
    features = [c for c in rows.columns if c not in ("image_id", "label")]
    model = models.fit_classifier(rows, features, "label", 10, 5)
    return models.classify(model, rows).groupBy("label", "predicted").agg(F.count("*").alias("n"))


REPORT_FEATURES = ["diskMinAxsLen", "likOfCtr", "totalArcLength", "chirality_maj", "bulgeAxisRatio", "iptSz_0", "iptSz_1", "covarFit_0", "absent"]
REPORT_TEXT = ["chirality_maj"]
WIDTHS = {"iptSz": 2, "chirality_votes_maj": 2, "sorted_agreeing_pangs": 3}


def _cleaned_report(spark, folder):
    from skytable.plans.reports import sanitize_report

    # Read for the classes, the fit and the scores.
    return cut_lineage(sanitize_report(view(spark, folder, "raw_report").select(*COLUMNS), "infer"))


def _report_model(spark, folder, clean=None):
    clean = _cleaned_report(spark, folder) if clean is None else clean
    encoder = models.fit_encoder(clean, REPORT_TEXT)
    rows = spirality.prepare_features(clean, encoder, REPORT_TEXT, REPORT_FEATURES, WIDTHS, ["name", "P_CW", "P_ACW"])
    rows = report.spirality(rows.withColumn("P_CW", F.col("P_CW").cast("double")).withColumn("P_ACW", F.col("P_ACW").cast("double")))
    rows = cut_lineage(rows)
    return models.fit_forest(rows, REPORT_FEATURES, "P_spiral", 8, 4, 6), encoder


@R.add("L10_score_reports")
def score(spark, folder):
    clean = _cleaned_report(spark, folder)
    model, encoder = _report_model(spark, folder, clean)
    return spirality.score_cleaned(clean, model, encoder, REPORT_TEXT, REPORT_FEATURES, WIDTHS)


@R.add("L11_evaluate_reports")
def evaluate(spark, folder):
    model, encoder = _report_model(spark, folder)
    raw = view(spark, folder, "raw_report").withColumn("row_id", F.col("index").cast("bigint")).drop("P_CW", "P_ACW", "index")
    return spirality.evaluate_reports(
        raw, view(spark, folder, "truth"), "fraction", "id", model, encoder, REPORT_TEXT, REPORT_FEATURES, WIDTHS, "row_id"
    )[1]


@R.add("L12_save_and_load", ["raw_report"], cleaned_sql("infer") + "select count(*) as n from c")
def save_and_load(spark, folder):
    model, encoder = _report_model(spark, folder)
    path = fresh(spark, "model")
    models.save_model(model, encoder, path)
    loaded, codes = models.load_model(spark, [f"{path}-missing", path])
    return spirality.score_reports(view(spark, folder, "raw_report"), loaded, codes, REPORT_TEXT, REPORT_FEATURES, WIDTHS).agg(F.count("*").alias("n"))
