"""Spirality jobs: training set, inference and evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.functions import report as R
from skytable.operators import lookup, models, sampling, stats
from skytable.plans.reports import sanitize_report
from skytable.session import cut_lineage


def build_training_set(
    original: DataFrame, variations: DataFrame, labels: DataFrame, ids: list[str], variation_ids: list[str], arrival: str, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, validation). Validation is stratified; train is filled up per bin with variations of other objects."""
    targeted = R.spirality(original)
    held = sampling.validation_names(targeted, "P_spiral", ids, seed=seed)
    labelled = lookup.with_label_value(variations, labels, held.withColumnRenamed("name", "object_id"), arrival)
    extra = sampling.fill_deficit(labelled, targeted, "P_spiral", variation_ids, seed)
    return sampling.assemble_training(original, held, extra)


def prepare_features(clean: DataFrame, encoder: DataFrame, text_columns: list[str], features: list[str], widths: dict[str, int], keep: list[str]) -> DataFrame:
    """B29, L2, B32 in order: expand arrays, encode text, align to the training columns."""
    wide = R.expand_arrays(clean, widths)
    present = [c for c in text_columns if c in wide.columns and c in features]
    return R.align_features(models.encode(wide, encoder, present), features, keep)


def score_reports(
    raw: DataFrame, model: PipelineModel, encoder: DataFrame, text_columns: list[str], features: list[str], widths: dict[str, int]
) -> DataFrame:
    """Raw report to (name, predicted_P_spiral, tree_std, flagged_non_galaxy, low_confidence)."""
    return score_cleaned(sanitize_report(raw, "infer"), model, encoder, text_columns, features, widths)


def score_cleaned(
    clean: DataFrame, model: PipelineModel, encoder: DataFrame, text_columns: list[str], features: list[str], widths: dict[str, int]
) -> DataFrame:
    """L10 of a report that is cleaned already. Rows are scored once and written, as the bar of low confidence reads them too."""
    flagged = clean.withColumn("flagged_non_galaxy", R.is_non_galaxy(clean))
    rows = prepare_features(flagged, encoder, text_columns, features, widths, ["name", "flagged_non_galaxy"])
    told = models.score_spirality(model, rows).select("name", "predicted_P_spiral", "tree_std", "flagged_non_galaxy")
    scored = models.flag_low_confidence(cut_lineage(told))
    return scored.select("name", "predicted_P_spiral", "tree_std", "flagged_non_galaxy", "low_confidence")


def evaluate_reports(
    raw: DataFrame, truth: DataFrame, value: str, arrival: str, model: PipelineModel, encoder: DataFrame, text_columns: list[str],
    features: list[str], widths: dict[str, int], row_id: str,
) -> tuple[DataFrame, DataFrame]:
    """(predictions beside the truth, R2/RMSE/MAE). Row ids travel through cleaning to find the way back."""
    matched = lookup.match_ground_truth(raw, truth, value, arrival)
    clean = sanitize_report(matched, "panstarrs", carry=[row_id, "P_CW", "P_ACW"])
    target = (F.col("P_CW").try_cast("double") + F.col("P_ACW").try_cast("double")).alias("P_spiral")
    rows = prepare_features(clean, encoder, text_columns, features, widths, [row_id, "P_CW", "P_ACW"])
    scored = model.transform(rows).select(row_id, target, F.col("prediction").alias("P_spiral_predicted"))
    back = lookup.map_back(scored, raw.select(row_id, "name"), row_id)
    return back, back.agg(*stats.regression_aggregates(F.col("P_spiral"), F.col("P_spiral_predicted")))
