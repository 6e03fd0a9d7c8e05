"""The learning sample of the toxicity operator and the memory that training holds."""

from __future__ import annotations

import gc
import random
import tracemalloc

from skytable.llm import toxicity


def test_sample_is_not_cut(spark) -> None:
    """Up to 3,000 labelled texts of a class, and texts of up to 20,000 characters, are learnt from."""
    rows = [(i, "short text" if i else "long " * 3_900) for i in range(2_500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id bigint, toxic int")
    texts, _ = toxicity.sample(docs, labels)
    assert len(texts) == len(rows) and max(map(len, texts)) == 19_500


def test_scoring_leaves_no_arrays() -> None:
    """Hashes of subsequences are freed at once, not when the garbage collector runs."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 12))) for _ in range(20_000)]
    model = toxicity.train(["a b"], [True])
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        toxicity.word_scores(model, words)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < 2e6 and most < 60e6


def test_landmarks_are_sparse() -> None:
    """The landmarks take room for the subsequences that they have, not for each bin times each landmark."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)) for _ in range(400)]
    tracemalloc.start()
    try:
        made = toxicity._Landmarks(words)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert made.kernel(words[:3]).shape == (3, 400) and held < 10e6


def test_sample_is_full_and_bounded(spark) -> None:
    """Long texts take no place of the sample, and rows that share an id count once."""
    rows = [(i, "x" * (300 if i % 4 else 30)) for i in range(200)] + [(8, f"another text {k % 50}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    texts, toxic = toxicity.sample(docs, labels, most=20, longest=100)
    assert sum(toxic) == 20 and len(texts) == 40
    texts, toxic = toxicity.sample(docs, labels, most=100, longest=100)
    assert sum(toxic) == 25 and len(texts) == 50 and max(map(len, texts)) <= 100
