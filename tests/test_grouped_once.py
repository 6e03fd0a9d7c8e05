"""Grouping is long work: operators that read its result twice write it first."""

import pytest
from pyspark.sql import functions as F

from skytable.operators import grouping

ROWS = "seq bigint, group_seq bigint, group_ra double, group_dec double, file string"


@pytest.mark.parametrize("step", [grouping.with_group_ids, grouping.group_instances])
def test_input_is_computed_once(spark, step):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(seq):
        seen.add(1)
        return seq

    rows = spark.createDataFrame([(i, i // 4, 10.0 + i // 4, 5.0, "a") for i in range(40)], ROWS)
    got = step(rows.withColumn("group_seq", counted("group_seq")))
    assert got.count() == 40 and got.agg(F.count("*"), F.max("seq")).first()[0] == 40
    assert seen.value == 40


def test_a_lookup_meets_one_cell(spark):
    versions = spark.createDataFrame([(0, 0, 10.0, 5.0, "a", 1), (4, 4, 10.0 + 0.49 / 3600, 6.0, "a", 1)], ROWS + ", version bigint")
    asked = spark.createDataFrame([(1, 10.0 + 0.4 / 3600, 5.0, "a"), (2, 10.0, 6.0 - 0.49 / 3600, "a"), (3, 10.0 + 0.51 / 3600, 5.0, "a")], "lookup_id bigint, ra double, dec double, file string")
    got = grouping.instance_of(versions, asked)
    assert {(r.lookup_id, r.group_seq) for r in got.collect()} == {(1, 0), (2, 4)}
    # The cell and its eight neighbours were listed for every lookup before.
    assert "array_distinct" in got._jdf.queryExecution().executedPlan().toString()
