"""Rows of a fit are dealt into parts of bounded size, with the columns that it reads."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from skytable.operators import models


@pytest.mark.parametrize("fit", [models.fit_forest, models.fit_boosted])
def test_training_rows_are_dealt(spark, monkeypatch, fit):
    monkeypatch.setattr(models, "FIT_ROWS", 50, raising=False)
    given = []
    plain = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: given.append(df) or plain(self, df, *a))
    rows = spark.range(2000, numPartitions=1).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    fit(rows, ["x"], "y", 2, depth=2)
    sizes = [n for n in given[0].select("x").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 100 and given[0].columns == ["x", "y"]
