"""Many different vectors with the same cosine."""

from __future__ import annotations

import random

from skytable.llm import nearest


def test_scaled_copies_go_to_the_least_ids(spark) -> None:
    """Of 60 vectors that differ in scale only, the five of least id are the neighbours, in whatever order the rows come."""
    rng = random.Random(12)
    base = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(1000 + i, [c * 2.0**k for c in base]) for i, k in enumerate(rng.sample(range(-30, 30), 60))]
    rows += [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(100)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        for query, best in ((1000, [1001, 1002, 1003, 1004, 1005]), (1059, [1000, 1001, 1002, 1003, 1004])):
            got = nearest.nearest(vectors, vectors.where(f"vec_id = {query}")).orderBy("rank").collect()
            assert [r["vec_id"] for r in got] == best and len({r["score"] for r in got}) == 1


def test_repeated_query_ids(spark) -> None:
    """An id whose first row takes no part is still asked; of several usable rows the least vector is."""
    rows = [(0, None), (0, [1.0, 0.0]), (0, [0.0, 0.0]), (0, [float("nan"), 1.0]), (0, [2.0, 0.0]), (0, [1.0, None]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    for order in (rows, rows[::-1]):
        vectors = spark.createDataFrame(order, "vec_id bigint, embedding array<double>")
        got = nearest.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [1, 2, 3]
