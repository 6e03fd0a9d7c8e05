"""Mixing sources to target weights: token weights are raked to source, language and topic marginals, documents are then sampled.

Iterative proportional fitting works on the cells of the three attributes. Each cell holds tokens and a sampling probability; in turn every
source, language and topic scales its cells' probabilities so that its expected tokens meet its target, with probabilities
capped at one, until nothing moves. A document is kept if a uniform number made from its id and text lies below its cell's
probability, so the sample is the same however the table is partitioned.

Categories without a target are taken together as ``other``, so the cells are bounded by the targets' size, (sources + 1) x (languages + 1) x (topics + 1),
whatever the data: they are what reaches the driver, and what is broadcast.

A document's topic is found in its words: each word has one of a few bins, and the topic is the bin that the document uses most
against the share of that bin in all documents of the language. No topic labels are needed, and documents of like vocabulary share a topic.

Defined cases: a null text, or one without words, has no tokens and the topic ``none``; null sources and languages are ``other``; targets of categories that
have no tokens are shared out among the others in proportion; where targets cannot be met, the fit stops at the nearest it
reaches; repeated rows with equal ids are kept or left together; an empty table gives an empty table; columns to keep are named by the caller.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import fresh_name, map_batches, texts_of
from skytable.session import cut_lineage

TOPICS = 8
OTHER, NO_TOPIC = "other", "none"
_REMEMBERED = 400_000


class _Bins(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % TOPICS
        return b


class Fit(NamedTuple):
    """Shares of the topic bins by language, and the cells' sampling probabilities."""

    lift: dict[str, list[float]]
    probability: dict[tuple[str, str, str], float]


def profile(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with ``__tokens`` (words), ``__bins`` (words of each topic bin) and ``__mark`` (hash of the text)."""
    taken = docs.select(*[docs[c].alias(f"__keep_{i}") for i, c in enumerate(keep)], docs[text_col].alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])

    def process():
        bins = _Bins()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, marks = [], []
            for text in texts_of(batch, "__text"):
                words = text.lower().split()
                counts.append(np.bincount(np.fromiter(map(bins.__getitem__, words), np.int64, len(words)), minlength=TOPICS))
                marks.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
            table = np.stack(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * TOPICS, pa.int32()), pa.array(table.ravel(), pa.int64()))
            columns = [*batch.columns[:-1], pa.array(table.sum(1), pa.int64()), lists, pa.array(marks, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__tokens", "__bins", "__mark"])

        return step

    made = map_batches(taken, f"{kinds}{', ' * bool(kinds)}__tokens bigint, __bins array<bigint>, __mark bigint", process)
    return made.select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], "__tokens", "__bins", "__mark")


def _category(value: Column, targets: dict[str, float]) -> Column:
    """A value with a target, or ``other``."""
    return F.when(value.isin(list(targets)), value).otherwise(F.lit(OTHER)) if targets else F.lit(OTHER)


def topic_of(lang: Column, lift: dict[str, list[float]]) -> Column:
    """The bin that is used most against its share in the language; the first of equals."""
    tables = F.create_map(*[x for k, v in lift.items() for x in (F.lit(k), F.array(*[F.lit(float(s)) for s in v]))]) if lift else None
    if tables is None:
        return F.lit(NO_TOPIC)
    # Negative places make the first of equal bins the greatest struct.
    scored = F.zip_with(F.col("__bins"), tables[lang], lambda n, s: n / s)
    best = F.array_max(F.transform(scored, lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
    return F.when(F.col("__tokens") > 0, F.concat(F.lit("t"), (-best["i"]).cast("string"))).otherwise(F.lit(NO_TOPIC))


def rake(mass: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Sampling probabilities of the cells; ``targets`` has the token shares along each axis, ``budget`` the expected share of all tokens."""
    p = np.where(mass > 0, budget, 0.0)
    wanted = []
    for axis, shares in enumerate(targets):
        other = tuple(a for a in range(mass.ndim) if a != axis)
        shares = np.where(mass.sum(other) > 0, shares, 0.0)
        total = shares.sum()
        wanted.append(shares / total * budget * mass.sum() if total > 0 else None)
    for _ in range(rounds):
        before = p.copy()
        for axis, goal in enumerate(wanted):
            if goal is None:
                continue
            other = tuple(a for a in range(mass.ndim) if a != axis)
            now = (mass * p).sum(other)
            ratio = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            p = np.minimum(1.0, p * ratio.reshape([-1 if a == axis else 1 for a in range(mass.ndim)]))
        if np.abs(p - before).max(initial=0) < tolerance:
            break
    return p


def fit(
    docs: DataFrame, sources: dict[str, float], langs: dict[str, float], topics: dict[str, float], budget: float, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None
) -> tuple[Fit, DataFrame]:
    """The fit, and the profiled table it came from (kept columns, ``__source``, ``__lang``, ``__tokens``, ``__bins``, ``__mark``)."""
    named = docs.withColumns({"__source": docs[source_col].cast("string"), "__lang": docs[lang_col].cast("string")})
    profiled = cut_lineage(profile(named, [*(keep or []), "__source", "__lang"], text_col))
    lang = _category(F.col("__lang"), langs)
    sums = profiled.groupBy(lang.alias("lang")).agg(*[F.sum(F.col("__bins")[i]).alias(f"b{i}") for i in range(TOPICS)]).collect()
    lift = {r["lang"]: [(r[f"b{i}"] + 1) / (sum(r[f"b{j}"] for j in range(TOPICS)) + TOPICS) for i in range(TOPICS)] for r in sums}
    cells = profiled.select(_category(F.col("__source"), sources).alias("source"), lang.alias("lang"), "__tokens", "__bins")
    cells = cells.withColumn("topic", topic_of(F.col("lang"), lift)).groupBy("source", "lang", "topic").agg(F.sum("__tokens").alias("tokens"))
    found = {(r["source"], r["lang"], r["topic"]): float(r["tokens"]) for r in cells.collect()}
    axes = [[*t, OTHER] for t in (sources, langs)] + [[*topics, NO_TOPIC]]
    shares = [np.array([*t.values(), max(0.0, 1 - sum(t.values()))]) for t in (sources, langs, topics)]
    mass = np.zeros([len(a) for a in axes])
    for cell, tokens in found.items():
        mass[tuple(a.index(c) if c in a else len(a) - 1 for a, c in zip(axes, cell, strict=True))] += tokens
    p = rake(mass, shares, budget)
    chosen = {cell: float(p[tuple(a.index(c) if c in a else len(a) - 1 for a, c in zip(axes, cell, strict=True))]) for cell in found}
    # Cells of texts without words hold no tokens; they are sampled at the overall rate.
    return Fit(lift, {c: v if found[c] > 0 else budget for c, v in chosen.items()}), profiled


def drawn(profiled: DataFrame, found: Fit, sources: dict[str, float], langs: dict[str, float], id_col: str, seed: int) -> DataFrame:
    """Adds ``__topic``, ``__p`` and ``__drawn`` to a profiled table with ``__source`` and ``__lang``."""
    spark = profiled.sparkSession
    lang, source = _category(F.col("__lang"), langs), _category(F.col("__source"), sources)
    rows = profiled.withColumns({"__cs": source, "__cl": lang}).withColumn("__topic", topic_of(F.col("__cl"), found.lift))
    cells = spark.createDataFrame([(*c, p) for c, p in found.probability.items()], "__cs string, __cl string, __topic string, __p double")
    rows = rows.join(F.broadcast(cells), ["__cs", "__cl", "__topic"], "left").withColumn("__p", F.coalesce("__p", F.lit(0.0)))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__mark")), 11) / F.lit(float(1 << 53))
    return rows.withColumn("__drawn", uniform < F.col("__p"))


def mix(docs: DataFrame, sources: dict[str, float], langs: dict[str, float], topics: dict[str, float], budget: float, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``probability`` and ``kept`` of every document."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    found, profiled = fit(named, sources, langs, topics, budget, keep=["doc_id", "source", "lang"])
    rows = drawn(profiled, found, sources, langs, "doc_id", seed)
    return rows.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__p").alias("probability"), F.col("__drawn").alias("kept"))


def sample(docs: DataFrame, sources: dict[str, float], langs: dict[str, float], topics: dict[str, float], budget: float, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents of the sample, with their columns. Texts are profiled again rather than written or shuffled."""
    found, _ = fit(docs, sources, langs, topics, budget, source_col, lang_col, text_col)
    names = {c: fresh_name(["__source", "__lang", "__tokens", "__bins", "__mark", "__cs", "__cl", "__topic", "__p", "__drawn"], c) for c in docs.columns}
    kept = docs.select(*[docs[c].alias(n) for c, n in names.items()]).withColumns({"__source": F.col(names[source_col]).cast("string"), "__lang": F.col(names[lang_col]).cast("string")})
    rows = drawn(profile(kept, [*names.values(), "__source", "__lang"], names[text_col]), found, sources, langs, names[id_col], seed)
    return rows.where("__drawn").select(*[F.col(n).alias(c) for c, n in names.items()])


# Production targets: the largest source gives a fifth, the other nineteen four hundredths each, what else there is the
# rest; English a little over half; topics alike. Seven tenths of the tokens are kept.
SOURCE_TARGETS = {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)}
LANG_TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.11}
TOPIC_TARGETS = {f"t{i}": 1 / TOPICS for i in range(TOPICS)}
BUDGET = 0.7
