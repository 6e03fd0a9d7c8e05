"""Splits, folds and draws name their rank ``_rank``; the queries on them give whole results on rows of our own."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skytable.operators import ranking, sampling


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,200 lines of uneven discounts, 60 customers, 240 documents with labels."""
    at, r, n = tmp_path_factory.mktemp("tables"), np.random.default_rng(5), 1200
    lines = pd.DataFrame({
        "l_orderkey": np.arange(n) // 4, "l_partkey": r.integers(1, 90, n), "l_suppkey": r.integers(1, 9, n), "l_linenumber": (np.arange(n) % 4 + 1).astype("int32"),
        "l_quantity": r.integers(1, 50, n).astype(float), "l_extendedprice": r.uniform(900, 9000, n).round(2), "l_discount": r.choice(11, n, p=[0.3, *[0.07] * 9, 0.07]) / 100.0,
        "l_tax": r.integers(0, 9, n) / 100.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": pd.Timestamp("2020-01-01"),
    })
    lines.loc[lines.l_discount == 0.07, "l_discount"] = 0.01
    lines.loc[0, "l_discount"] = 0.07
    k = np.arange(1, 61)
    customers = pd.DataFrame({"c_custkey": k, "c_name": "c", "c_nationkey": (k % 5).astype("int32"), "c_acctbal": 1.0, "c_mktsegment": "m"})
    d = np.arange(240)
    documents = pd.DataFrame({"doc_id": d, "text": "words", "lang": np.where(d % 3 == 0, "en", "fr"), "source": np.where(d % 4 == 0, "web", "book"), "n_chars": d * 7 % 500})
    labels = pd.DataFrame({"doc_id": d, "quality": (d % 7 > 1).astype("int32"), "toxic": (d % 2).astype("int32")})
    for name, rows in (("lineitem", lines), ("customer", customers), ("documents", documents), ("labels", labels)):
        spark.createDataFrame(rows).coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def rows_of(spark, folder, name):
    return [r.asDict() for r in entry.queries()[name](spark, folder).collect()]


def expected(folder, name):
    db = duckdb.connect()
    for t in ("lineitem", "customer", "documents", "labels"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = db.sql(entry.oracle_sql()[name])
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def agree(spark, folder, name):
    text = lambda rows: sorted(str(sorted(r.items())) for r in rows)
    assert text(rows_of(spark, folder, name)) == text(expected(folder, name))


@pytest.mark.parametrize("name", ["_rank", "_n", "place"])
def test_a_rank_may_have_any_name(spark, name):
    rows = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    got = ranking.random_rank(rows, ["k"], ["id"], 3, name, bits=3)
    assert got.columns == ["id", "k", name]
    found = got.groupBy("k").agg(F.sort_array(F.collect_list(name)).alias("all"), F.count("*").alias("n")).collect()
    assert sorted(r.n for r in found) == [66, 67, 67] and all(r["all"] == list(range(1, r.n + 1)) for r in found)


def test_validation_sizes(spark, folder):
    agree(spark, folder, "E6_validation_sizes")
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.monotonically_increasing_id().cast("string").alias("name"), (F.col("l_discount") * 10).alias("p"))
    held = sampling.validation_names(rows, "p", ["name"])
    names = rows.withColumn("b", sampling.observed_bin(F.col("p"), F.lit(0.0), F.lit(1.0)))
    quota = {r.b: max(1, int(r.n * 0.2)) for r in names.groupBy("b").agg(F.count("*").alias("n")).collect()}
    assert {r.b: r.n for r in names.join(held, "name").groupBy("b").agg(F.count("*").alias("n")).collect()} == quota and 1 in quota.values()


def test_bucket_split_sizes(spark, folder):
    agree(spark, folder, "E7_bucket_split_sizes")
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("p", F.col("l_discount") * 10)
    split = sampling.bucket_split(rows, "p", ["l_orderkey", "l_linenumber"], 5)
    assert split.columns == [*rows.columns, "split"] and split.drop("split").exceptAll(rows).count() == 0 and split.count() == rows.count()


def test_deficit_sizes(spark, folder):
    agree(spark, folder, "E8_deficit_sizes")


def test_importance_properties(spark, folder):
    agree(spark, folder, "F4_importance_properties")


def test_feature_importance(spark, folder):
    got = rows_of(spark, folder, "F4_feature_importance")
    # The target is made of the discount and a little of the tax.
    assert {r["feature"] for r in got} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"} and sum(r["importance"] for r in got) == pytest.approx(1)
    assert [r["feature"] for r in got][0] == "l_discount" and got[0]["importance"] > 0.8


def test_training_set(spark, folder):
    got = {r["bin"]: r["n"] for r in rows_of(spark, folder, "L13_G4_training_set")}
    p = {k: (k * 37) % 101 / 1e2 for k in range(1, 61)}
    bins = pd.Series({k: min(int(np.floor(v * 10)), 9) for k, v in p.items()})
    lines = pd.read_parquet(f"{folder}/lineitem.parquet")
    top = bins.value_counts().max()
    held = entry.queries()["L13_G4_training_set_validation_size"](spark, folder).first().n
    lack = top - bins.value_counts().reindex(range(10), fill_value=0)
    offered = lines.l_partkey[lines.l_partkey <= 60].map(bins).value_counts().reindex(range(10), fill_value=0)
    # Every bin is filled up as far as there are variations; which of them are held back is drawn.
    assert (offered > 20).all() and sum(got.values()) == 60 - held + lack.sum()
    assert all(got[b] <= top and got[b] >= lack[b] for b in got)


def test_training_set_validation_size(spark, folder):
    agree(spark, folder, "L13_G4_training_set_validation_size")


def test_forest_metric_properties(spark, folder):
    agree(spark, folder, "L4_D8_forest_metric_properties")


def test_forest_with_spread(spark, folder):
    agree(spark, folder, "L4_L9_forest_with_spread")


def split_sizes(folder):
    """Rows of the two splits of ``least(1, 8 * discount + tax)`` in two buckets."""
    lines = pd.read_parquet(f"{folder}/lineitem.parquet")
    high = (np.minimum(1.0, lines.l_discount * 8 + lines.l_tax) >= 0.5).sum()
    keep = int(min(high, len(lines) - high) * 0.8)
    return {"train": 2 * keep, "test": len(lines) - 2 * keep}


def test_forest_metrics(spark, folder):
    got = rows_of(spark, folder, "L4_D8_forest_metrics")
    assert {r["split"]: r["n"] for r in got} == split_sizes(folder) and all(0.8 < r["r2"] <= 1 and r["mae"] <= r["rmse"] for r in got)


def test_boosted_metric_properties(spark, folder):
    agree(spark, folder, "L5_boosted_metric_properties")


def test_boosted_metrics(spark, folder):
    got = rows_of(spark, folder, "L5_boosted_metrics")
    assert {r["split"]: r["n"] for r in got} == split_sizes(folder) and all(0.9 < r["r2"] <= 1 and r["mae"] <= r["rmse"] for r in got)


def test_grid_properties(spark, folder):
    agree(spark, folder, "L6_grid_properties")


def test_grid_search(spark, folder):
    got = rows_of(spark, folder, "L6_grid_search")
    assert {(r["trees"], r["features"], r["buckets"]) for r in got} == {(t, f, b) for t in (5, 10) for f in (2, 4) for b in (1, 2)} and len(got) == 8
    assert all(r["status"] == "success" and r["error"] is None and r["train_r2"] <= 1 and r["val_rmse"] >= 0 for r in got)


def test_cross_validation(spark, folder):
    agree(spark, folder, "L7_cross_validation")
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    dealt = sampling.fold_number(rows, "quality", ["doc_id"]).groupBy("quality", "fold").agg(F.count("*").alias("n")).collect()
    for label in (0, 1):
        sizes = [r.n for r in dealt if r.quality == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sum(sizes) == rows.filter(F.col("quality") == label).count()
