"""Streams over landed files and progress events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytable.operators.grouping import attach_batch
from skytable.session import shared_dir

# Freshness limits in seconds and the retry limit.
FRESH, WORKING = 60, 120
MAX_FAILURES = 3


def new_files(spark: SparkSession, root: str, pattern: str = "*.[fF][iI][tT][sS]", files_per_batch: int = 1000) -> DataFrame:
    """Files as they appear under a tree; the stream's checkpoint remembers the ones seen."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )


def table_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Rows of Parquet files as they appear."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def progress_windows(events: DataFrame, delay: str, width: str = "1 minute") -> DataFrame:
    """Per worker and time window the events, bytes and errors. ``events``: (ts, worker, bytes_read, is_error).

    Events later than ``delay`` are left out by a stream, so the caller has to state it.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "worker")
        .agg(F.count("*").alias("events"), F.sum("bytes_read").alias("bytes_read"), F.sum(F.col("is_error").cast("long")).alias("errors"))
        .select(F.col("window.start").alias("window_start"), "worker", "events", "bytes_read", "errors")
    )


def freshness(age_seconds: Column) -> Column:
    """State by the age of the last event; without a usable time a worker is waiting."""
    return F.when(age_seconds.isNull(), "waiting").when(age_seconds < FRESH, "fresh").when(age_seconds < WORKING, "working").otherwise("stalled")


def worker_freshness(events: DataFrame, now: Column) -> DataFrame:
    """S3: state of each worker at a reference time. Works on tables and on streams (update mode)."""
    last = events.groupBy("worker").agg(F.max("ts").alias("last_update"))
    age = now.cast("timestamp").cast("double") - F.col("last_update").cast("double")
    return last.withColumn("status", freshness(age))


def worker_states(events: DataFrame, delay: str) -> DataFrame:
    """S3 as a stream: (worker, since, status) whenever a worker's state changes, also to ``working`` and ``stalled`` without any event of its own.

    Time is the watermark, which the events of all workers move: the latest event less ``delay``. A worker's state holds its last event; a
    timer at the age of the next state fires once the watermark has passed it. Events without a time are left out. ``events``: (ts, worker).
    """
    limits = [(FRESH, "working"), (WORKING, "stalled")]
    schema = "worker string, since timestamp, status string"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        last, told = state.get if state.exists else (None, -1)
        rows = []

        def tell(until: int) -> None:
            """States that have come by a time are told at once, the next one by a timer."""
            nonlocal told
            while told < len(limits) and last + limits[told][0] * 1000 <= until:
                rows.append((key[0], last + limits[told][0] * 1000, limits[told][1]))
                told += 1

        if not state.hasTimedOut:
            latest = max(int(b["ts"].max().value // 1_000_000) for b in batches)
            if last is None or latest > last:
                if last is not None:
                    tell(min(now, latest - 1))
                last, told = latest, 0
                rows.append((key[0], last, "fresh"))
        tell(now)
        state.update((last, told))
        if told < len(limits):
            state.setTimeoutTimestamp(last + limits[told][0] * 1000)
        if rows:
            made = pd.DataFrame(rows, columns=["worker", "since", "status"])
            yield made.assign(since=pd.to_datetime(made["since"], unit="ms"))

    known = events.filter("ts is not null").withWatermark("ts", delay).select("ts", F.col("worker").cast("string").alias("worker"))
    return known.groupBy("worker").applyInPandasWithState(follow, schema, "last long, told int", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_products(products: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The first arrival of each file name; the state forgets names older than the delay."""
    return products.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["productFilename"])


def retry_ledger(failures: DataFrame) -> DataFrame:
    """Per file the counted failures and the state. ``failures``: (file, ts, error).

    Memory errors do not count and park the file; three counted failures are final.
    """
    memory = F.lower("error").contains("memory")
    counted = failures.groupBy("file").agg(
        F.count_if(~memory).alias("failures"), F.count_if(memory).alias("memory_errors"),
        F.max_by("error", F.struct("ts", "error")).alias("last_error"),
        F.max_by(memory, F.struct("ts", "error")).alias("_parked"),
    )
    state = F.when(F.col("failures") >= MAX_FAILURES, "failed").when(F.col("_parked"), "skipped").otherwise("retry")
    return counted.withColumn("state", state).drop("_parked")


def run_to_table(stream: DataFrame, key: list[str] | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drain a stream into a table on shared storage and return it.

    Append streams go to a file sink. With ``key`` the stream runs in update mode: each batch adds its changed rows and
    the newest row per key is returned.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/skytable-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    target = f"{base}/rows"
    if key is None and each is None:
        query = writer.outputMode("append").format("parquet").option("path", target).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        # One folder per batch: a batch that is run again replaces itself.
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = writer.outputMode("update" if key else "append").foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(target)
    if key is None:
        return rows.drop("batch")
    row = F.struct(*[c for c in rows.columns if c not in (*key, "batch")])
    return rows.groupBy(*key).agg(F.max_by(row, "batch").alias("_r")).select(*key, "_r.*")


# Height in degrees of the bands of declination in which founders are stored.
BAND_DEGREES = 3.0


def group_stream(detections: DataFrame, store: str | None = None, arcsec: float = 1.0) -> DataFrame:
    """Detections join groups as they arrive; each batch sees the groups of all earlier ones.

    ``seq`` must grow from batch to batch. ``store`` is a folder of the caller, with the stream's checkpoint, the rows of each batch, and the founders of groups by
    band of declination; started again on it, the stream goes on where it stopped, and a batch that is run again replaces its own folders and
    does not see them. A batch reads the founders of the bands that it touches only. Without ``store`` a new one is made.
    """
    spark = detections.sparkSession
    base = store or f"{shared_dir(spark).rstrip('/')}/skytable-groups-{uuid.uuid4().hex}"
    rows, founders = f"{base}/rows", f"{base}/founders"
    # A range without rows is made by no Python worker.
    empty = spark.range(0).selectExpr("id as group_seq", "cast(id as double) as group_ra", "cast(id as double) as group_dec")
    layout = "group_seq long, group_ra double, group_dec double, batch long, band long"
    band = lambda dec: F.floor(F.col(dec) / BAND_DEGREES)

    def attach(batch: DataFrame, number: int) -> None:
        known = empty
        if number > 0:
            # At most 180 / BAND_DEGREES numbers.
            touched = {r[0] for r in batch.select(band("dec")).distinct().collect() if r[0] is not None}
            near = sorted(touched | {b - 1 for b in touched} | {b + 1 for b in touched})
            earlier = spark.read.schema(layout).parquet(founders).filter((F.col("batch") < number) & F.col("band").isin(near))
            known = earlier.select("group_seq", "group_ra", "group_dec")
        attached = attach_batch(known, batch, arcsec)
        attached.write.mode("overwrite").parquet(f"{rows}/batch={number}")
        # A group's first detection carries the group's own number.
        new = spark.read.schema(attached.schema).parquet(f"{rows}/batch={number}").filter("seq = group_seq")
        new = new.select("group_seq", "group_ra", "group_dec", band("group_dec").alias("band"))
        new.repartition("band").write.mode("overwrite").partitionBy("band").parquet(f"{founders}/batch={number}")

    writer = detections.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(attach).start().awaitTermination()
    return spark.read.parquet(rows).drop("batch")
