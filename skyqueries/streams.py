"""Streams drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyqueries.inputs import Registry, detections, view
from skyqueries.learning import REPORT_FEATURES, REPORT_TEXT, WIDTHS, _report_model
from skyqueries.reports import fresh
from skytable.plans import spirality
from skytable.session import apply_settings
from skytable.streaming import jobs

R = Registry()


def _stream(spark, folder, name):
    """A given table as a stream of files."""
    apply_settings(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return jobs.table_stream(spark, folder, schema, f"{name}.parquet")


def _progress(df):
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("worker"), F.col("value").alias("bytes_read"),
        (F.col("event_type") == "error").alias("is_error"),
    )


@R.add(
    "S2_progress_windows",
    ["progress"],
    "select worker, cast(epoch(date_trunc('minute', ts)) as bigint) as window_start, count(*) as events, round(sum(bytes_read), 4) as bytes_read, cast(count(*) filter (where is_error) as bigint) as errors from progress group by 1, 2",
)
def windows(spark, folder):
    w = jobs.run_to_table(jobs.progress_windows(_progress(_stream(spark, folder, "events")), "3650 days"), key=["window_start", "worker"])
    return w.select("worker", F.col("window_start").cast("bigint").alias("window_start"), "events", F.round("bytes_read", 4).alias("bytes_read"), "errors")


@R.add(
    "S3_worker_freshness",
    ["progress"],
    "m as (select worker, max(ts) as t from progress group by 1), n as (select epoch(timestamp '2024-01-31 00:00:00') as now) "
    "select worker, case when now - epoch(t) < 60 then 'fresh' when now - epoch(t) < 120 then 'working' else 'stalled' end as status from m, n",
)
def fresh_workers(spark, folder):
    s = jobs.worker_freshness(_progress(_stream(spark, folder, "events")), F.lit("2024-01-31 00:00:00"))
    return jobs.run_to_table(s, key=["worker"]).select("worker", "status")


@R.add(
    "S3_silent_workers",
    ["progress"],
    "m as (select cast(worker as varchar) as worker, max(ts) as t from progress group by 1), n as (select max(t) - interval 10 minute as now from m), "
    "g as (select worker, t, floor(epoch(t) * 1000) / 1000 as s, epoch(now) as e from m, n) "
    "select worker, case when e < s + 60 then 'fresh' when e < s + 120 then 'working' else 'stalled' end as status from g",
)
def silent_workers(spark, folder):
    # Landings in the order of time, one a batch; the last one moves the watermark past the workers that have fallen silent.
    apply_settings(spark)
    e = _progress(spark.read.parquet(f"{folder}/events.parquet"))
    path = fresh(spark, "progress")
    edges = e.agg(F.expr("percentile_approx(ts, array(0.25, 0.5, 0.75), 1000)")).first()[0]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = e if low is None else e.filter(F.col("ts") > F.lit(low))
        (part if high is None else part.filter(F.col("ts") <= F.lit(high))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    told = jobs.run_to_table(jobs.worker_states(stream, "10 minutes"), each=lambda batch: batch)
    return told.groupBy("worker").agg(F.max_by("status", "since").alias("status"))


@R.add("S6_distinct_products", ["progress"], "select count(distinct user_id) as n from progress")
def distinct_products(spark, folder):
    e = _stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("jw"), F.col("user_id").cast("string")).alias("productFilename"))
    return jobs.run_to_table(jobs.distinct_products(e, "ts", "60 days")).agg(F.count("*").alias("n"))


@R.add(
    "S7_retry_ledger",
    ["progress"],
    "f as (select cast(user_id as varchar) as file, ts, event_id, case when event_id % 4 = 0 then 'MemoryError' else 'bad header' end as error from progress where is_error), "
    "l as (select file, count(*) filter (where error = 'bad header') as failures, count(*) filter (where error <> 'bad header') as memory_errors, arg_max(error, ts) as last_error from f group by 1) "
    "select file, failures, memory_errors, last_error, case when failures >= 3 then 'failed' when last_error = 'MemoryError' then 'skipped' else 'retry' end as state from l",
)
def ledger(spark, folder):
    e = _stream(spark, folder, "events").filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("file"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 4 == 0, "MemoryError").otherwise("bad header").alias("error"),
    )
    return jobs.run_to_table(jobs.retry_ledger(e), key=["file"]).select("file", "failures", "memory_errors", "last_error", "state")


@R.add("S1_new_files", None, "select cast(1 as bigint) as files, count(*) as n from events")
def new_rows(spark, folder):
    s = _stream(spark, folder, "events").select("event_id", F.col("_metadata.file_path").alias("file"))
    return jobs.run_to_table(s).agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))


@R.add("S4_group_stream", ["detections"], "select seq, min(seq) over (partition by k1, k2) as group_seq from detections")
def group_stream(spark, folder):
    # Arrival order cut into three landings of eight files each; a batch takes one landing.
    d = detections(spark, folder)
    path = fresh(spark, "landing")
    rows = d.count()
    for part in range(3):
        d.filter((F.col("seq") >= rows * part // 3) & (F.col("seq") < rows * (part + 1) // 3)).repartition(8, "seq").write.mode("append").parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 8).parquet(path)
    return jobs.group_stream(stream).select("seq", "group_seq")


@R.add("S5_stream_scoring")
def scoring(spark, folder):
    model, encoder = _report_model(spark, folder)
    path = fresh(spark, "reports")
    view(spark, folder, "raw_report").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    score = lambda batch: spirality.score_reports(batch, model, encoder, REPORT_TEXT, REPORT_FEATURES, WIDTHS)
    return jobs.run_to_table(stream, each=score)
