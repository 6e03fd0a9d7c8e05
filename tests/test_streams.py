"""Streams that notice silence, and a group store that goes on after a stop."""

import datetime
import random

from pyspark.sql import functions as F

from skytable.operators.grouping import group_detections
from skytable.streaming import jobs

ZERO = datetime.datetime(2024, 1, 1)


def landed(spark, folder, batches, schema):
    """A stream of one batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_silent_worker(spark, tmp_path) -> None:
    at = lambda s: ZERO + datetime.timedelta(seconds=s)
    batches = [
        [("a", at(0)), ("b", at(0)), ("c", None)],
        [("b", at(30)), ("b", at(70))],
        [("b", at(100))],
        [("b", at(130)), ("d", at(10))],
        [("a", at(131)), ("b", at(140))],
    ]
    stream = landed(spark, tmp_path / "in", batches, "worker string, ts timestamp")
    told = jobs.run_to_table(jobs.worker_states(stream, "0 seconds"), each=lambda b: b).collect()
    seconds = lambda t: (t - ZERO).total_seconds()
    got = {w: [(seconds(t), s) for _, t, s in sorted((r["worker"], r["since"], r["status"]) for r in told if r["worker"] == w)] for w in ("a", "b")}
    # Worker a falls silent: its states change without an event of its own, until it comes back.
    assert got["a"] == [(0, "fresh"), (60, "working"), (120, "stalled"), (131, "fresh")]
    assert all(s == "fresh" for _, s in got["b"]) and got["b"][-1] == (140, "fresh")
    assert "c" not in {r["worker"] for r in told}


def test_group_store_goes_on(spark, tmp_path) -> None:
    rng = random.Random(3)
    rows = []
    for k in range(60):
        ra, dec = rng.uniform(0, 0.3), rng.uniform(-0.3, 0.3)
        rows += [(ra + rng.uniform(-2e-4, 2e-4), dec + rng.uniform(-2e-4, 2e-4)) for _ in range(rng.choice([1, 2, 6]))]
    # A group over the border of two bands.
    rows += [(1.0, -0.0001), (1.0, 0.0001), (1.0, 3.0), (1.0, 2.99995)]
    rng.shuffle(rows)
    schema = "seq long, ra double, dec double"
    numbered = [(i, *r) for i, r in enumerate(rows)]
    cuts = [numbered[k : k + 40] for k in range(0, len(numbered), 40)]
    whole = {r["seq"]: r["group_seq"] for r in group_detections(spark.createDataFrame(numbered, schema)).collect()}
    store = str(tmp_path / "store")
    # Stopped after two batches, then started again on the same store with more files.
    jobs.group_stream(landed(spark, tmp_path / "in", cuts[:2], schema), store)
    got = jobs.group_stream(landed(spark, tmp_path / "in", cuts[2:], schema), store)
    assert {r["seq"]: r["group_seq"] for r in got.collect()} == whole
    # Started once more without new files it changes nothing.
    again = jobs.group_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), store)
    assert again.count() == len(rows) and again.filter(F.col("seq") == F.col("group_seq")).count() == len(set(whole.values()))
