"""URL filters: stated rules, and for URLs without a rule a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table; its size bound is a parameter. Scoring is one pass over the URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the model's verdict on those;
texts of any length are read whole; repeated URLs are judged each; an empty table gives an empty table; with no labelled
URL, or with one class only, the model judges by the (smoothed) share of blocked labels; a tie (probability 0.5) blocks; only
the id and url columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches

# Lengths of the n-grams, weights of the model (a power of two), labelled URLs used at most.
GRAMS = (3, 4, 5)
BINS = 1 << 17
MOST_LABELLED = 4000


class Rule(NamedTuple):
    """A host with its subdomains and the beginning of a path, as in ``example.com/de/``."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits; null if none does."""
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(host: str, path: str) -> np.ndarray:
    """Bins of the distinct n-grams of both parts; part and borders are part of a gram."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(mark + part[i : i + n] for i in range(max(1, len(part) - n + 1)))
    return np.unique(np.fromiter((zlib.crc32(g.encode()) & BINS - 1 for g in found), np.int64, len(found)))


def fit(hosts: list[str], paths: list[str], blocked: list[bool], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept: logistic regression by adaptive gradient steps in a fixed order."""
    weights, squares = np.zeros(BINS + 1), np.full(BINS + 1, 1e-8)
    y = np.asarray(blocked, dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    weights[BINS] = np.log(share / (1 - share))
    if len(set(blocked)) < 2:
        return weights
    found = [np.append(grams(h, p), BINS) for h, p in zip(hosts, paths, strict=True)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(found)):
            at = found[i]
            scale = 1 / np.sqrt(len(at))
            step = (1 / (1 + np.exp(-weights[at].sum() * scale)) - y[i]) * scale + decay * weights[at]
            squares[at] += step * step
            weights[at] -= rate * step / np.sqrt(squares[at])
    return weights


def probability(weights: np.ndarray, host: str, path: str) -> float:
    """Probability that a URL is to be blocked."""
    at = np.append(grams(host, path), BINS)
    if not weights[:BINS].any():
        return float(1 / (1 + np.exp(-weights[BINS])))
    return float(1 / (1 + np.exp(-np.clip(weights[at].sum() / np.sqrt(len(at)), -500, 500))))


def train(labelled: DataFrame, most: int = MOST_LABELLED, url_col: str = "url", block_col: str = "block") -> np.ndarray:
    """Fit on at most ``most`` different labelled URLs, those of least hash; conflicting labels of a URL count as blocked."""
    urls = labelled.select(labelled[url_col].alias("url"), labelled[block_col].cast("boolean").alias("block")).dropna()
    known = urls.groupBy("url").agg(F.max("block").alias("block")).orderBy(F.xxhash64("url"), "url").limit(most)
    got = known.select(host_of(F.col("url")), path_of(F.col("url")), "block").collect()
    return fit([r[0] for r in got], [r[1] for r in got], [r[2] for r in got])


def judge(
    pages: DataFrame, rules: list[Rule], weights: np.ndarray, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` of every URL.

    The model is broadcast: ``BINS`` weights whatever the input.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def process():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            found = pa.array([probability(known, h, p) for h, p in pairs], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns, found], ["page_id", "host", "path", "p_block"])

        return step

    scored = map_batches(rows, f"page_id {kind}, host string, path string, p_block double", process)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[x for r in rules for x in (F.lit(r.text), F.lit("block" if r.block else "allow"))]) if rules else None
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    verdict = F.coalesce(by_rule[F.col("rule")], by_model) if rules else by_model
    return scored.withColumn("rule", rule).withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "p_block")
