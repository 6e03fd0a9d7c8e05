"""The corpus pipeline: quality rules, near copies, personal data, mixing to target weights, byte-level BPE.

Each stage is a function of (spark, docs, folder); what it returns is written as Parquet and read again as the next one's documents. All but the last
return the columns of ``documents``; the last one returns a row of ids for each document that is left.

A stage's working tables on shared storage are deleted when the next stage begins: its result has been written by then.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.llm import byte_bpe, jaccard_join, mixing, quality, sanitise
from skytable.llm.common import prepare
from skytable.session import forget_written, shared_dir, written_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: list[str] = []


def _stage(build: Stage) -> Stage:
    @functools.wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        prepare(spark)
        forget_written(spark, _working)
        before = set(written_tables())
        made = build(spark, docs, folder)
        _working[:] = [t for t in written_tables() if t not in before]
        return made

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the robust distances keep."""
    return quality.keep_good(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies: the one of least id, and of equal ids the one of least text hash."""
    return jaccard_join.representatives(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts with personal data, and terms that disclose it, replaced; ``n_chars`` is that of the new text."""
    columns = docs.columns
    clean = sanitise.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*columns) if "n_chars" in columns else clean


@_stage
def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics."""
    return mixing.sample(docs, mixing.SOURCE_TARGETS, mixing.LANG_TARGETS, mixing.TOPIC_TARGETS, mixing.BUDGET)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document; the ids decode to the text."""
    entries = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = byte_bpe.encode(docs, entries, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixed", mixed),
    ("encoded", encoded),
]

# Robust estimates, raking and BPE are not expressible in SQL; a brute-force version checks the stages in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is a table in the shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
