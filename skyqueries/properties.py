"""What must hold of results that are random or made by a model: rows, ranges, sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries import learning, streams, tables, texts
from skyqueries.inputs import Registry, view
from skyqueries.reports import cleaned_sql
from skytable.operators import sampling

R = Registry()


@R.add("D17_discovery_json_fields", ["detections"], "select ra, dec, height, width, file as source, count(*) as n from detections group by 1, 2, 3, 4, 5")
def json_fields(spark, folder):
    kinds = "struct<ra:double,dec:double,height:double,width:double,source:string>"
    read = texts.discovery_json(spark, folder).select(F.from_json("json", kinds).alias("j")).select("j.*")
    return read.groupBy("ra", "dec", "height", "width", "source").agg(F.count("*").alias("n"))


@R.add("F5_random_rows_properties", None, "select 25 as n, 25 as known, 25 as again")
def random_rows(spark, folder):
    """So many different rows of the table, and the same ones again for the same seed."""
    first, all_rows = tables.random_rows(spark, folder), view(spark, folder, "cat_a")
    again = sampling.random_rows(all_rows.repartition(7, "id"), ["id"], 25, 42)
    known = first.join(all_rows, "id", "left_semi").select("id").distinct().agg(F.count("*").alias("known"))
    same = first.join(again, "id", "left_semi").agg(F.count("*").alias("again"))
    n = first.agg(F.count("*").alias("n"))
    return n.select("n", known.scalar().alias("known"), same.scalar().alias("again"))


ORDERED = "select count(*) as n, true as ordered from lines"


def _ordered(metrics):
    good = (F.col("r2") <= 1) & (F.col("mae") <= F.col("rmse") + 1e-9) & (F.col("mae") >= 0)
    return metrics.agg(F.sum("n").alias("n"), F.bool_and(good).alias("ordered"))


@R.add("L4_D8_forest_metric_properties", ["lines"], ORDERED)
def forest_metrics(spark, folder):
    return _ordered(learning.forest_metrics(spark, folder))


@R.add("L5_boosted_metric_properties", ["lines"], ORDERED)
def boosted_metrics(spark, folder):
    return _ordered(learning.boosted(spark, folder))


@R.add("F4_importance_properties", None, f"select {len(learning.FEATURES)} as features, true as shares")
def importance(spark, folder):
    got = learning.importance(spark, folder).filter(F.col("feature").isin(learning.FEATURES))
    shares = (F.abs(F.sum("importance") - 1) < 1e-9) & (F.min("importance") >= 0)
    return got.agg(F.countDistinct("feature").alias("features"), shares.alias("shares"))


@R.add("L6_grid_properties", None, "select 8 as models, 8 as fitted")
def grid(spark, folder):
    got = learning.grid(spark, folder)
    fitted = (F.col("status") == "success") & (F.col("val_r2") <= 1) & (F.col("val_rmse") >= 0)
    return got.agg(F.countDistinct("model", "trees", "features", "buckets").alias("models"), F.count_if(fitted).alias("fitted"))


@R.add("L8_classified_rows", None, "select cast(label % 2 as int) as label, count(*) as n from embeddings group by 1")
def classified(spark, folder):
    got = learning.classify(spark, folder).filter(F.col("predicted").isin(0, 1))
    return got.groupBy(F.col("label").cast("int").alias("label")).agg(F.sum("n").alias("n"))


SCORED = cleaned_sql("infer") + "select name, count(*) as n from c group by 1"


def _named(scored):
    fair = F.col("predicted_P_spiral").between(0, 1) & (F.col("tree_std") >= 0) & F.col("low_confidence").isNotNull()
    return scored.filter(fair).groupBy("name").agg(F.count("*").alias("n"))


@R.add("L10_scored_names", ["raw_report"], SCORED)
def scored(spark, folder):
    return _named(learning.score(spark, folder))


@R.add("S5_stream_scored_names", ["raw_report"], SCORED)
def stream_scored(spark, folder):
    return _named(streams.scoring(spark, folder))
