"""Personal data: spans of stated patterns, and terms that reveal the entities found.

Entities are the values that the patterns find. How strongly a word reveals an entity is estimated from the corpus: with
``p(e)`` the share of different texts that hold the entity, and ``p(e|t)`` the share of the texts with the word in which it stands in a window around the entity, the
disclosure is the pointwise mutual information over the information of the entity,
``ln(p(e|t) / p(e)) / -ln p(e)``: 1 if the word occurs near the entity only, 0 if it is independent. It counts only if the word stands in
enough different windows; one occurrence, and copies of it, reveal nothing about the next. A word above the lower threshold is
generalised (to what kind of word it is), above the upper one it is removed: wherever it stands, also far from the entity and in texts
that do not spell the entity out.

Texts that hold a word are counted in one more pass over all texts, for the words with support,
which a bitmap lets through; it is exact after the aggregation. The passes share no state, so a lost task is simply run again.

Defined cases: a null text counts as empty and stays null when sanitised; texts are read whole and in time proportional to their length; repeated rows are
judged each (equal windows support a word once); an empty table gives an empty table; columns to be kept are named by the caller and may have any name but
those of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches, texts_of
from skytable.llm.keyfilter import Known, bitmap
from skytable.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
# Words on each side of an entity, different windows needed, and the two thresholds of disclosure.
REACH, SUPPORT = 8, 3
GENERALISE, REMOVE = 0.7, 0.9
# Different terms counted in memory before a task hands its counts on.
MOST_COUNTS = 200_000

# Patterns of the base kinds (fixed values). The address and number patterns are anchored at the start of a run, where
# the leftmost match must begin, so that a long run is not tried from each of its characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    """Check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within a kind, in order."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Long parts are compared without leading zeros; more than three digits are too large.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _entity(kind: int, value: str) -> bytes:
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_128_digest(f"{kind}:{value}".encode())


def words_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of the words outside all spans, in order; spans are in order of their start."""
    found, at, reach = [], 0, 0
    for m in _TERM.finditer(text):
        start, end = m.span()
        # Every span that begins before the word ends; the furthest end of them tells whether one covers part of it.
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= start:
            found.append((start, end))
    return found


def windows(text: str, spans: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[tuple[bytes, int, list[str]]]:
    """(entity, hash of the words around it, the different words) of every span, in one pass over spans and words."""
    terms, found, at = [text[a:b].lower() for a, b in words], [], 0
    for start, kind, end in spans:
        while at < len(words) and words[at][0] < start:
            at += 1
        # Words are outside spans, so the next one begins behind this span.
        near = terms[max(0, at - REACH) : at + REACH]
        window = xxhash.xxh3_64_intdigest(" ".join(near).encode("utf-8", "surrogatepass")) - (1 << 63)
        found.append((_entity(kind, text[start:end]), window, list(dict.fromkeys(near))))
    return found


def _mark(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.binary()), ("window", pa.int64()), ("terms", pa.list_(pa.string()))])


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Base spans of every text, a digest of it, the columns to be kept, and the entities with their windows and the words in them.

    A table on shared storage.
    """
    taken = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"), *[docs[c].alias(f"__keep_{i}") for i, c in enumerate(keep)])
    passed = [c for c in taken.columns if c != "__text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields if f.name in passed)

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "__text")
            spans = [base_spans(t) for t in texts]
            words = [words_of(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
            near = [windows(t, s, w) if s else [] for t, s, w in zip(texts, spans, words, strict=True)]
            rows = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans]
            close = [[{"entity": e, "window": w, "terms": t} for e, w, t in n] for n in near]
            made = [pa.array([_mark(t) for t in texts], pa.binary()), pa.array(rows, pa.list_(_SPAN)), pa.array(close, pa.list_(_NEAR))]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *made], [*passed, "__mark", "__base", "__near"])

        return step

    return cut_lineage(map_batches(taken, f"{kinds}, __mark binary, __base {_SPANS}, __near array<struct<entity:binary,window:bigint,terms:array<string>>>", process))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _texts_with(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """``term`` and the number of different texts that hold it, for the given terms and a few others.

    A text is one row with all its terms; copies are told apart by their digest, and what is left is counted inside its task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def process():
        known = Known(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = {}
            for text in texts_of(batch, "__text"):
                if found := set(filter(known.__getitem__, _TERM.findall(text.lower()))):
                    held[_mark(text)] = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.string()))], ["mark", "terms"])

        return step

    def counted(batches):
        counts = Counter()
        for batch in batches:
            counts.update(batch.column("terms").flatten().to_pylist())
            if len(counts) > MOST_COUNTS:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    held = map_batches(docs.select(docs[text_col].alias("__text")), "mark binary, terms array<string>", process)
    once = held.groupBy("mark").agg(F.any_value("terms").alias("terms")).select("terms")
    return once.mapInArrow(counted, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("held_by"))


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def _disclosure(together, held_by, named_by, total: int):
    """Pointwise mutual information of a term and an entity over the information of the entity, from numbers of different texts."""
    given = F.least(together / held_by, F.lit(1.0))
    share = F.least(named_by / F.lit(total), F.lit(0.5))
    return F.lit(1.0) - F.log(given) / F.log(share)


def disclosures(marked: DataFrame, docs: DataFrame, text_col: str, support: int = SUPPORT, least: float | None = None) -> DataFrame:
    """``entity``, ``term`` and ``disclosure`` of all pairs with enough support; with ``least``, of those that reach it.

    Only entities with enough different windows can have such pairs, so only their words are paired. The texts in which a term stands near any of them
    are some of the texts that hold it, so their number bounds the disclosure from above: with ``least``, what stays below it even so is not
    counted in all texts. Those are the common words, which most texts hold.
    """
    near = marked.where(F.size("__near") > 0).select("__mark", F.explode("__near").alias("x")).select(F.col("__mark").alias("mark"), "x.*").distinct()
    seen = near.groupBy("entity", "window").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("windows")).where(F.col("windows") >= support)
    near = cut_lineage(near.join(seen.select("entity"), "entity"))
    both = near.select("entity", "mark", "window", F.explode("terms").alias("term"))
    # Near copies of a text share their windows, and so support a word once.
    backed = both.groupBy("entity", "term", "window").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    together = both.groupBy("entity", "term", "mark").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("together"))
    pairs = cut_lineage(backed.join(together, ["entity", "term"]))
    entities = near.groupBy("entity", "mark").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("named_by"))
    total = marked.groupBy("__mark").agg(F.lit(1).alias("one")).count() or 1
    pairs = pairs.join(entities, "entity")
    if least is not None:
        met = both.groupBy("term", "mark").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("met_by"))
        # A little below the bound, so that rounding drops no pair that reaches it.
        reach = _disclosure(F.col("together"), F.col("met_by"), F.col("named_by"), total) >= least - 1e-9
        pairs = cut_lineage(pairs.join(met, "term").where(reach).drop("met_by"))
    counts = _texts_with(docs, pairs.select("term").distinct(), text_col)
    known = pairs.join(counts, "term")
    known = known.select("entity", "term", _disclosure(F.col("together"), F.col("held_by"), F.col("named_by"), total).alias("disclosure"))
    return known if least is None else known.where(F.col("disclosure") >= least)


def _term_spans(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``__mark`` and ``__terms`` (spans) of every different text that holds a found term outside its base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("term")))

    def process():
        known = Known(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch, "__text"):
                if any(map(known.__getitem__, set(_TERM.findall(text.lower())))):
                    mark = _mark(text)
                    rows += [(mark, text[a:b].lower(), a, b) for a, b in words_of(text, base_spans(text)) if known[text[a:b].lower()]]
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["__mark", "term", "start", "end"])

        return step

    held = map_batches(docs.select(docs[text_col].alias("__text")), "__mark binary, term string, start int, end int", process)
    once = held.join(found, "term").groupBy("__mark", "start", "end").agg(F.max("kind").cast("int").alias("kind"))
    return once.groupBy("__mark").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__found"))


def _found(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """As :func:`find`, with the columns of ``keep`` as ``__keep_0`` and so on."""
    keep = keep or []
    marked = _marked(docs, id_col, text_col, keep)
    found = disclosures(marked, docs, text_col, support, generalise)
    found = cut_lineage(found.groupBy("term").agg(F.max(F.when(F.col("disclosure") >= remove, TERM + 1).otherwise(TERM)).alias("kind")))
    names = ["doc_id", *[f"__keep_{i}" for i in range(len(keep))]]
    # Without such terms the base spans are all.
    if found.isEmpty():
        return marked.select(*names, F.col("__base").alias("base"), F.col("__base").alias("spans"))
    terms = cut_lineage(_term_spans(docs, found, text_col))
    both = marked.join(terms, "__mark", "left").withColumn("spans", F.array_sort(F.concat("__base", F.coalesce("__found", F.array().cast(_SPANS)))))
    return both.select(*names, F.col("__base").alias("base"), "spans")


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end; kind 4 is a term, 5 a term to be removed) of every text.

    Starts jobs while the plan is built. Where no term exceeds a threshold, texts are not read again.
    """
    return _found(docs, generalise, remove, support, id_col, text_col)


def listed(spans, names: tuple[str, ...] = (*KINDS, "term", "term")):
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[dict]) -> str:
    """The text with every span replaced; of overlapping spans the whole is replaced by the first one's word."""
    out, at = [], 0
    for s in spans:
        start, end, kind = s["start"], s["end"], s["kind"]
        if start < at:
            if end > at:
                at = end
            continue
        out.append(text[at:start])
        if kind < TERM:
            out.append(f"[{KINDS[kind].upper()}]")
        elif kind == TERM:
            out.append("[NAME]" if text[start].isupper() else "[WORD]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their texts sanitised; other columns stay as they are."""
    columns = docs.columns
    found = _found(docs, id_col=id_col, text_col=text_col, keep=columns)
    names = [f"__keep_{i}" for i in range(len(columns))]
    text = names[[c.lower() for c in columns].index(text_col.lower())]
    plain = found.where(F.size("spans") == 0).select(*names)
    touched = found.where(F.size("spans") > 0).select(*names, "spans")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist(), strict=True)
            new = pa.array([t if t is None else redact(t, s) for t, s in pairs], pa.string())
            return pa.RecordBatch.from_arrays([new if n == text else batch.column(n) for n in names], names)

        return step

    whole = plain.unionByName(map_batches(touched, schema, process))
    return whole.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])


def digest_of(spans) -> object:
    """SHA-256 of the listed spans."""
    return F.sha2(listed(spans), 256)


def plain_digest(text: str) -> str:
    """The same for one text, without Spark."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()
