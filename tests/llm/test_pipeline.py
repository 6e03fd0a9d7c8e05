"""The pipeline's stages one after another, each against its own input."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from skytable.llm import byte_bpe

from test_llm_texts import SCHEMA, base_by_hand, classes_by_hand, n_classes, near_rows, spans_by_hand


def test_stages(spark, tmp_path) -> None:
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in near_rows()]
    rows += [(1000 + i, f"{prose(60)} mail me{i}@acme.com or +1 (555) 010-{1000 + i} {prose(20)}", rng.choice(["en", "de"]), rng.choice(["src0", "src1"]), 1) for i in range(200)]
    rows += [(2000 + i, f"{prose(60)} ### $$$ %%% &&& *** ### $$$ %%% &&& *** ### $$$ %%%", "en", "src0", 1) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).withColumn("__own", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
        if name != "encoded":
            assert tables[-1].columns == docs.columns
    rules, near, private, mixed, encoded = ([tuple(r) for r in t.collect()] for t in tables[1:])
    failed = Counter(r[:2] for r in rows if base_by_hand(r[1])[-1])
    assert not failed & Counter(r[:2] for r in rules)
    assert {r[0] for r in rules} >= set(range(1000, 1200)) and not {r[0] for r in rules} & set(range(2000, 2005))
    assert len(near) == n_classes([r[:2] for r in rules])
    assert not any(n for _, _, n in classes_by_hand([r[:2] for r in near]))
    assert len(private) == len(near) and not any(spans_by_hand(r[1]) for r in private) and all(r[4] == len(r[1]) for r in private)
    assert not Counter(mixed) - Counter(private) and 0.4 < len(mixed) / len(private) < 1
    entries = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert Counter((i, b"".join(entries[k] for k in ids).decode(), n) for i, n, ids in encoded) == Counter((r[0], r[1], len(next(byte_bpe.ByteBpe(entries, public_tokenizers.PATTERN).encode([r[1]])))) for r in mixed)
