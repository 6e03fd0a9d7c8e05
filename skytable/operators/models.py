"""Encoders, forests and scoring."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.operators import sampling, stats
from skytable.operators.quantiles import exact_quantiles
from skytable.operators.scalars import with_row
from skytable.session import cut_lineage, forget_written, scratch_path

# The grid of the published model search.
GRID_TREES = [10, 30, 50, 70, 90, 110, 130, 150]
GRID_FEATURES = [10, 30, 50, 70, 90, 110, 130]
GRID_BUCKETS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def fit_encoder(df: DataFrame, columns: list[str]) -> DataFrame:
    """L1: (column, value, code): the classes of each text column in sorted order, coded from 0.

    Values are reduced to their distinct set before the numbering, so the window sees classes, not rows.
    """
    classes = stats.long_form(df, columns).filter("value is not null").distinct()
    code = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1
    return classes.withColumn("code", code)


def encode(df: DataFrame, encoder: DataFrame, columns: list[str]) -> DataFrame:
    """L1, L2: text columns replaced by their codes; unseen or missing values become class 0.

    A class table per column is one row per class; Spark picks a broadcast by its measured size.
    """
    out = df
    for c in columns:
        side = encoder.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(side, out[f"`{c}`"].cast("string") == side[f"_v_{c}"], "left").drop(f"_v_{c}")
        out = out.withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(0))).drop(f"_c_{c}")
    return out


def standardize(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """L3: (x - mean) / population sd, both from the train rows; a constant column becomes 0."""
    aggs = []
    for c in columns:
        x = F.when(train, F.col(c))
        aggs += [F.avg(x).alias(f"_m_{c}"), F.stddev_pop(x).alias(f"_s_{c}")]
    joined = with_row(df, df.agg(*aggs))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


# Rows of a task while trees grow: they are held as objects, some hundred bytes each, with the number of trees.
FIT_ROWS = 500_000


def _dealt(train: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a fit reads, dealt into parts of bounded size: a file of packed numbers grows some twenty times as it becomes objects."""
    rows = train.select(*dict.fromkeys(columns))
    parts = rows.count() // FIT_ROWS + 1
    return rows.repartition(parts) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def fit_forest(train: DataFrame, features: list[str], target: str, trees: int = 150, per_split: int | None = None, depth: int = 10, seed: int = 42) -> PipelineModel:
    """L4: random forest regressor. ``per_split`` is the number of features tried per split."""
    strategy = "all" if per_split is None else str(min(per_split, len(features)))
    forest = RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy=strategy, seed=seed, cacheNodeIds=False
    )
    return Pipeline(stages=[_assembler(features), forest]).fit(_dealt(train, [*features, target]))


def fit_boosted(train: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Gradient-boosted regressor."""
    boosted = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembler(features), boosted]).fit(_dealt(train, [*features, target]))


def leaf_values(forest: RandomForestRegressionModel, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Values of all leaves, tree after tree, and where each tree's begin.

    The order within a tree is that of the leaf numbers the model gives. Read from the saved model's node table; as large as the model, which the
    driver holds anyway.
    """
    path = scratch_path(spark)
    forest.write().save(path)
    leaves = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0").select("treeID", "nodeData.id", "nodeData.prediction").toPandas()
    forget_written(spark, [path])
    leaves = leaves.sort_values(["treeID", "id"])
    counts = np.bincount(leaves["treeID"], minlength=forest.getNumTrees)
    return leaves["prediction"].to_numpy(), np.concatenate([[0], np.cumsum(counts)[:-1]])


def predict_spread(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``prediction`` and ``tree_std``, the population spread of the single trees' predictions.

    The model finds the leaves of a row in all trees at once; their values come from one flat table. The plan does not grow with the trees.
    Saves the model's nodes once while the plan is built.
    """
    forest = model.stages[-1].copy().setLeafCol("_leaf")
    shared = rows.sparkSession.sparkContext.broadcast(leaf_values(forest, rows.sparkSession))

    @F.pandas_udf("double")
    def spread(leaves: pd.Series) -> pd.Series:
        values, begins = shared.value
        if leaves.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(values[np.stack(leaves.to_numpy()).astype(np.int64) + begins].std(axis=1))

    out = forest.transform(PipelineModel(model.stages[:-1]).transform(rows))
    return out.withColumn("tree_std", spread(vector_to_array("_leaf"))).drop("_leaf", "features")


def flag_low_confidence(scored: DataFrame, quantile: float = 0.9, low: float = 0.5, high: float = 0.75) -> DataFrame:
    """Spread above the quantile over rows not flagged, and a middling prediction."""
    bar = exact_quantiles(scored.filter(~F.col("flagged_non_galaxy")), [], "tree_std", {"_bar": quantile})
    # One row, or none when everything was flagged; then the bar is 0.
    joined = with_row(scored, bar)
    test = (F.col("tree_std") > F.coalesce("_bar", F.lit(0.0))) & (F.col("predicted_P_spiral") >= low) & (F.col("predicted_P_spiral") < high)
    return joined.withColumn("low_confidence", test).drop("_bar")


def score_spirality(model: PipelineModel, rows: DataFrame, flagged: str = "flagged_non_galaxy") -> DataFrame:
    """Predictions with spread; flagged rows get 0 for both."""
    scored = predict_spread(model, rows)
    zero = lambda c: F.when(F.col(flagged), F.lit(0.0)).otherwise(F.col(c))
    return scored.withColumn("predicted_P_spiral", zero("prediction")).withColumn("tree_std", zero("tree_std")).drop("prediction")


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """importance per feature, largest first. As many rows as the model has features."""
    names = model.stages[0].getInputCols()
    rows = [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def grid_search(
    data: DataFrame, features: list[str], target: str, ids: list[str], trees=GRID_TREES, per_split=GRID_FEATURES, buckets=GRID_BUCKETS,
    depth: int = 10, seed: int = 42, parallel: int = 4,
) -> DataFrame:
    """One row per parameter set with its scores, or ``failed`` and the error.

    Each bucket split is written once, with the columns that fits read, and shared by them; fits run side by side as Spark jobs. The
    result has one row per model.
    """
    spark = data.sparkSession
    needed, read = list(dict.fromkeys([*features, target, *ids])), list(dict.fromkeys([*features, target, "split"]))
    splits = {b: cut_lineage(sampling.bucket_split(data.select(*needed), target, ids, b, seed=seed).select(*read)) for b in buckets}

    def one(spec: tuple[int, int, int]) -> tuple:
        t, f, b = spec
        name = f"{t}_{f}_{b}"
        try:
            rows = splits[b]
            model = fit_forest(rows.filter("split = 'train'"), features, target, t, f, depth, seed)
            scored = model.transform(rows)
            got = {r["split"]: r for r in stats.regression_metrics(scored, target, "prediction", ["split"]).collect()}
            tr, te = got["train"], got["test"]
            return (name, t, f, b, "success", tr["r2"], tr["rmse"], te["r2"], te["rmse"], None)
        except Exception as problem:  # noqa: BLE001  a failed model becomes a row, the search goes on
            return (name, t, f, b, "failed", None, None, None, None, str(problem)[:500])

    specs = [(t, f, b) for b in buckets for t in trees for f in per_split]
    with ThreadPool(parallel) as pool:
        rows = pool.map(one, specs)
    return spark.createDataFrame(
        rows,
        "model string, trees int, features int, buckets int, status string, train_r2 double, train_rmse double, val_r2 double, "
        "val_rmse double, error string",
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Row weight n / (classes * n_class)."""
    per = df.groupBy(label).agg(F.count("*").alias("_nc"))
    total = per.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    weights = with_row(per, total).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(weights, label)


def fit_classifier(train: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest classifier with balanced classes; at least two rows per leaf."""
    forest = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[_assembler(features), forest]).fit(balanced_weights(train, label))


def cross_validated(df: DataFrame, features: list[str], label: str, ids: list[str], folds: int = 5, trees: int = 200, depth: int = 10, seed: int = 42) -> DataFrame:
    """Every row predicted by the model that did not see its fold."""
    dealt = cut_lineage(sampling.fold_number(df, label, ids, folds, seed))
    parts = []
    for k in range(folds):
        model = fit_classifier(dealt.filter(F.col("fold") != k), features, label, trees, depth, seed)
        parts.append(model.transform(dealt.filter(F.col("fold") == k)).select(*dealt.columns, F.col("prediction").cast("int").alias("prediction")))
    return reduce(DataFrame.unionByName, parts)


def classify(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of the positive class and the class at a threshold."""
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(rows).withColumn("probability_galaxy", p)
    return scored.select(*rows.columns, "probability_galaxy", (F.col("probability_galaxy") >= threshold).cast("int").alias("predicted"))


def save_model(model: PipelineModel, encoder: DataFrame, path: str) -> None:
    """Model and encoder side by side."""
    model.write().overwrite().save(f"{path}/model")
    encoder.write.mode("overwrite").parquet(f"{path}/encoder")


def load_model(spark, candidates: list[str]) -> tuple[PipelineModel, DataFrame]:
    """The first folder of the list that holds a model."""
    tried = []
    for path in candidates:
        try:
            return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/encoder")
        except Exception as problem:  # noqa: BLE001  a missing folder is not an error until all are
            tried.append(f"{path}: {type(problem).__name__}")
    raise FileNotFoundError("no model found: " + "; ".join(tried))
