"""Steps of grouping and ranking that keep the work of a large table small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.operators import grouping, ranking
from tests.test_settle import TOLERANCE, block


def test_only_founders_by_open_rows_are_asked_again():
    rows = block(400, 0.1, 3)
    open_row = np.array(rows["seq"]) == 0
    rows = rows.set_column(7, "own", grouping.pa.array(~open_row))
    got = grouping._settle(rows, TOLERANCE).to_pylist()
    cu, cv = (np.array(rows[c])[open_row][0] for c in ("cu", "cv"))
    unsettled = [(r["cu"], r["cv"]) for r in got if r["home_seq"] is None] + [(cu, cv)]
    near = lambda r: any(abs(r["cu"] - u) <= 2 and abs(r["cv"] - v) <= 2 for u, v in unsettled)
    assert [r["by_open"] for r in got] == [near(r) for r in got]
    assert sum(r["by_open"] for r in got) < 20


def test_rows_without_a_group_have_no_number(spark):
    rows = spark.createDataFrame([(0, 0), (1, None), (2, 2), (3, 0)], "seq bigint, group_seq bigint")
    got = {r.seq: r.group_id for r in grouping.with_group_ids(rows).collect()}
    assert got == {0: 1, 1: None, 2: 2, 3: 1}


def test_ranks_join_no_rows(spark):
    rows = spark.createDataFrame([(i % 3 or None, i) for i in range(60)], "k bigint, seq bigint")
    got = ranking.arrival_rank(rows, ["k"], "seq", "n", rows=7)
    assert all(r.n == r.seq // 3 + 1 for r in got.collect()) and got.count() == 60
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_totals_copy_no_rows(spark):
    rows = spark.createDataFrame([(i // 2, "a", str(i % 3)) for i in range(10)], "group_seq bigint, file string, band string")
    got = grouping.store_statistics(rows)
    assert got.first().asDict() == {"total_groups": 5, "total_instances": 10, "files_processed": 1, "unique_bands": 3, "instances_per_group": 2.0}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert grouping.store_statistics(rows.filter("false")).first().instances_per_group == 0


def test_a_batch_alone_is_joined_with_its_groups(spark):
    known = spark.createDataFrame([(0, 10.0, 5.0), (1, 20.0, 5.0)], "group_seq bigint, group_ra double, group_dec double")
    batch = spark.createDataFrame([(5, 10.0001, 5.0, "a"), (6, 30.0, 5.0, "b"), (7, None, 5.0, "c"), (8, 20.0, 5.0, "d")], "seq bigint, ra double, dec double, file string")
    got = grouping.attach_batch(known, batch)
    assert got.columns == ["seq", "ra", "dec", "file", "group_seq", "group_ra", "group_dec"]
    assert {r.seq: r.group_seq for r in got.collect()} == {5: 0, 6: 6, 7: None, 8: 1}
    assert "_new" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_a_crowd_of_footprints_takes_many_rounds(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, float(10 + x), float(5 + y), 2e-4, 2e-4, 2.0) for i, (x, y) in enumerate(r.uniform(0, 0.004, (150, 2)))]
    want, founders = {}, []
    for s, ra, dec, a, b, _ in rows:
        want[s] = next((f for f, fra, fdec in founders if abs(ra - fra) <= a and abs(dec - fdec) <= b), s)
        founders += [(s, ra, dec)] if want[s] == s else []
    items = spark.createDataFrame(rows, "seq bigint, ra double, dec double, half_ra double, half_dec double, size double")
    got = grouping.group_by_footprint(items)
    assert {x.seq: x.group_seq for x in got.collect()} == want
