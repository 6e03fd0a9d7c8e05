"""Remaining time as the reference prints it, also where more is done than was expected."""

from datetime import timedelta

from pyspark.sql import functions as F

from skytable.operators import stats


def test_durations_are_those_of_timedelta(spark):
    seconds = [0.0, 59.9, 3700.0, 86400.0, 200000.7, -0.5, -10.0, -1499.6, -86400.0, -90000.2, -300000.0]
    got = spark.createDataFrame([(s,) for s in seconds], "s double").select("s", stats.duration_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == {s: str(timedelta(seconds=int(s))) for s in seconds}
