"""Scores are needed for the bar of low confidence and for the rows: they are made once."""

from skyqueries import learning


def test_scores_are_written(spark):
    got = learning.score(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.columns == ["name", "predicted_P_spiral", "tree_std", "flagged_non_galaxy", "low_confidence"]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
