"""Summaries (D5-D20, F2-F4). All are aggregates with map-side combine."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators.quantiles import exact_quantiles
from skytable.operators.scalars import with_row

BINS = 10


def files_per_band(files: DataFrame) -> DataFrame:
    """File counts per (instrument, waveband) with a total row; ``unclassified`` counts files without a band."""
    return files.rollup("instrument", "waveband").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("waveband") == "unclassified").alias("unclassified"),
        F.grouping_id().alias("level"),
    ).filter("level in (0, 3)")


def bin_of(p: Column, bins: int = BINS) -> Column:
    """Fixed-width bin; the last one is closed."""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def bin_histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Rows per bin, empty bins included, and the largest count."""
    spark = df.sparkSession
    counts = df.filter(F.col(column) >= 0).groupBy(bin_of(F.col(column), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return with_row(full, counts.agg(F.max("n").alias("max_n")))


def edge(i: int, buckets: int) -> float:
    """Bucket border, rounded to three decimals as the splits do."""
    return round(i * (1 / buckets), 3)


def bucket_of(p: Column, buckets: int, closed: bool) -> Column:
    """Bucket number, null outside; ``closed`` lets the last bucket take everything from its lower border up."""
    out = F.lit(None).cast("int")
    for i in reversed(range(buckets)):
        inside = p >= edge(i, buckets)
        if not (closed and i == buckets - 1):
            inside = inside & (p < edge(i + 1, buckets))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def smallest_bucket(df: DataFrame, column: str, buckets: int, mode: str = "original") -> DataFrame:
    """``original`` leaves 1.0 out of the last bucket and counts empty buckets; ``later`` does neither."""
    counts = df.agg(*[F.count_if(bucket_of(F.col(column), buckets, mode != "original") == i).alias(f"b{i}") for i in range(buckets)])
    each = F.array(*[F.col(f"b{i}") for i in range(buckets)])
    if mode != "original":
        each = F.filter(each, lambda n: n > 0)
    return counts.select(F.array_min(each).alias("smallest"))


def regression_aggregates(y: Column, pred: Column, keep: Column | None = None) -> list[Column]:
    keep = F.lit(True) if keep is None else keep
    err = F.when(keep, y - pred)
    yy = F.when(keep, y)
    return [
        F.count(err).alias("n"),
        (1.0 - F.try_divide(F.sum(err * err), F.var_pop(yy) * F.count(yy))).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    ]


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """R2, RMSE and MAE per split. R2 is null where the target is constant."""
    return df.groupBy(*by).agg(*regression_aggregates(F.col(y), F.col(pred)))


def high_score_rmse(df: DataFrame, y: str, pred: str, cuts=(0.6, 0.7, 0.8)) -> DataFrame:
    """Test RMSE overall and over predictions from each cut up, in one pass."""
    err = F.pow(F.col(y) - F.col(pred), 2.0)
    cols = [F.sqrt(F.avg(err)).alias("rmse_all")]
    cols += [F.sqrt(F.avg(F.when(F.col(pred) >= c, err))).alias(f"rmse_{round(c * 10)}") for c in cuts]
    return df.filter("split = 'test'").agg(*cols)


def distinct_high_rmse(df: DataFrame, y: str, pred: str, cut: float = 0.4) -> DataFrame:
    """RMSE over the distinct test rows with a target from ``cut`` up."""
    rows = df.filter((F.col("split") == "test") & (F.col(y) >= cut)).distinct()
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2.0))).alias("rmse"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Confusion counts and scores of a 0/1 classifier in one row."""
    cell = lambda t, p: F.count_if((F.col(y) == t) & (F.col(pred) == p))
    base = df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return base.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fn).alias("precision_0"),
        _ratio(tn, tn + fp).alias("recall_0"),
        _ratio(2.0 * tn, 2.0 * tn + fp + fn).alias("f1_0"),
    )


def misclassified(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Rows the classifier got wrong."""
    return df.filter(F.col(y) != F.col(pred))


def prediction_summary(df: DataFrame) -> DataFrame:
    """Counts and ranges over rows that were not flagged, and the spread threshold, in one row."""
    ok = ~F.col("flagged_non_galaxy")
    p, s = F.when(ok, F.col("predicted_P_spiral")), F.when(ok, F.col("tree_std"))
    threshold = exact_quantiles(df.filter(ok), [], "tree_std", {"std_p90": 0.9})
    summary = df.agg(
        F.count("*").alias("total"),
        F.count_if(~ok).alias("non_galaxies"),
        F.count_if(ok).alias("galaxies"),
        F.min(p).alias("p_min"),
        F.max(p).alias("p_max"),
        F.avg(p).alias("p_mean"),
        F.min(s).alias("std_min"),
        F.max(s).alias("std_max"),
        F.count_if("low_confidence").alias("low_confidence"),
    )
    return with_row(summary, threshold)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of several text columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def drift_report(df: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the nulls and the values no training class knows, with counts.

    ``classes``: (column, value). Values are counted before the join, so it sees each value once.
    """
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    nulls = counts.filter("value is null").select("column", F.lit("null").alias("state"), "value", "n")
    unseen = counts.filter("value is not null").join(classes, ["column", "value"], "left_anti")
    return nulls.unionByName(unseen.select("column", F.lit("unseen").alias("state"), "value", "n"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, most first."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("nulls"), "column")


def discovery_summary(df: DataFrame) -> DataFrame:
    """Objects found and the sources they come from."""
    return df.agg(F.count("*").alias("total_members"), F.countDistinct("source").alias("group_count"))


def discovery_json(df: DataFrame) -> DataFrame:
    """One JSON text per object."""
    return df.select(F.to_json(F.struct("ra", "dec", "height", "width", "source")).alias("json"))


def duration_text(seconds: Column) -> Column:
    """``H:MM:SS``, with the days in front when there are any. Below zero the days are negative and the clock counts on from them, as in
    Python's ``timedelta``: ten seconds too many are ``-1 day, 23:59:50``."""
    whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("bigint")
    days = F.floor(whole / 86400)
    s = F.pmod(whole, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)
    day_word = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days != 0, F.concat(days.cast("string"), day_word, clock)).otherwise(clock)


def eta_text(done: Column, total: Column, elapsed: Column) -> Column:
    return F.when((done == 0) | (elapsed == 0), "N/A").otherwise(duration_text((total - done) / (done / elapsed)))


def throughput(workers: DataFrame) -> DataFrame:
    """Per worker and in total (worker null) files, galaxies, bytes and MB/s.

    ``workers``: (worker, files, galaxies, bytes_read, elapsed_seconds); rates of workers add up.
    """
    per = workers.groupBy("worker").agg(
        F.sum("files").alias("files"),
        F.sum("galaxies").alias("galaxies"),
        F.sum("bytes_read").alias("bytes_read"),
        F.max("elapsed_seconds").alias("elapsed"),
    )
    rate = F.when(F.col("elapsed") > 0, F.col("bytes_read") / F.col("elapsed") / 1024.0 / 1024.0).otherwise(F.lit(0.0))
    rated = per.withColumn("mb_per_s", rate)
    return rated.rollup("worker").agg(
        F.sum("files").alias("files"),
        F.sum("galaxies").alias("galaxies"),
        F.sum("bytes_read").alias("bytes_read"),
        F.sum("mb_per_s").alias("mb_per_s"),
    )


def footprint_report(crops: DataFrame) -> DataFrame:
    """Groups, crops and pixel bytes, with averages."""
    per = crops.groupBy("group_seq").agg(F.count("*").alias("crops"), F.sum(F.col("height") * F.col("width") * 8).alias("bytes"))
    return per.agg(
        F.count("*").alias("num_groups"),
        F.sum("crops").alias("num_crops"),
        F.sum("bytes").alias("total_size"),
        F.avg("bytes").alias("bytes_per_group"),
        (F.sum("bytes") / F.sum("crops")).alias("bytes_per_crop"),
    )


def grid_summary(results: DataFrame) -> DataFrame:
    """Models by outcome and the best validation scores."""
    good = F.col("status") == "success"
    return results.agg(
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        F.min(F.when(good, F.col("val_rmse"))).alias("best_rmse"),
        F.max(F.when(good, F.col("val_r2"))).alias("best_r2"),
    )


def best_models(results: DataFrame, n: int = 10) -> DataFrame:
    """a top-n report over successful models."""
    return results.filter("status = 'success'").orderBy("val_rmse", "model").limit(n)


def recent_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """the latest errors over all workers."""
    return errors.orderBy(F.desc("time"), "worker", "file").limit(n)


