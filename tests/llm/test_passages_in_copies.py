"""Copies of a document that hold a passage which another document held first."""

from __future__ import annotations

import random

import pytest

from skytable.llm import chunk_dedup


@pytest.mark.parametrize("own_words", [100, 30])
def test_shared_passage_in_copies(spark, own_words: int) -> None:
    """The passage (60 words) goes from both copies, the copies' own text stays in the first of them, whichever is longer."""
    rng = random.Random(own_words)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(n))
    passage, before, after = prose(60), prose(own_words), prose(own_words)
    copied = f"{before} {passage} {after}"
    rows = [(5, f"{prose(40)} {passage} {prose(40)}"), (100, copied), (200, copied)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(docs).collect()}
    inner = " ".join(passage.split()[18:-18])
    assert left[5] == rows[0][1]
    assert inner not in left[100] and inner not in left[200]
    assert before in left[100] and after in left[100]
    assert before not in left[200] and after not in left[200]
