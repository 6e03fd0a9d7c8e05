"""Similarity join of texts on word shingles: MinHash candidates, Bayesian pruning, exact verification.

Texts with equal shingle sets are one class from the start. Bands of MinHash values propose candidates: classes that share a bucket, in bands short
enough that a pair at the threshold is missed with a probability of ``(1 - t^rows)^bands``, 4e-7 by default, and a more similar one with much less. Candidate
pairs compare their MinHash values a few at a time; with ``m`` of ``n`` equal and no prior knowledge of the similarity, the probability that it
reaches ``t`` is P(Binomial(n + 1, t) <= m), and a pair is dropped once that is below the tolerance. The rest are verified on the whole shingle
sets.

Pairs are compared in blocks. Buckets that overlap form a component; a component is compared all with all in blocks, or bucket by bucket where
that ships fewer rows (then a pair counts in the first bucket it shares). Either way a block holds a bounded number of classes and
shingles, a group of near copies spreads over as many tasks as it has pairs of blocks, and a block returns one row for
each member: its links and the least class it is linked to. No pair leaves a block and no bucket is cut.

Words are runs of letters and digits in lower case. Defined cases: a text of fewer words than a shingle is one shingle; a text without
words (null, empty) is a class of its own without links; repeated rows count as copies; a null id is a row like any other, and a class's id is its
least id; an empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches, texts_of
from skytable.llm.components import components
from skytable.llm.keyfilter import Known, bitmap
from skytable.session import cut_lineage

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 4
# A pair is dropped below this posterior probability; values are compared STEP at a time.
TOLERANCE, STEP = 1e-9, 16
# Classes and shingles that one block holds on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 1536, 1 << 20
# Words that a task remembers the hash of.
_REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Words in lower case."""
    return _WORD.findall(text.lower())


def shingles_of(text: str, hashes: dict[str, int], width: int = WIDTH) -> np.ndarray:
    """The set of hashed shingles, sorted; empty for a text without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    many = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        s = np.full(many, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + many])
    return np.unique(s)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, count), dtype=np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """MinHash values of a set; the greatest value for the empty set."""
    a, b = _multipliers(count)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        least = np.minimum(least, ((part * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return least


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band, different between bands."""
    cut = sig[..., : bands * rows].reshape(*sig.shape[:-1], bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:-1])
    for k in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + cut[..., k])
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Least number of equal values among ``n`` with which a pair goes on."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def sketches(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``digest`` of the shingle set (null if empty), its size ``n``, and ``bands``."""
    taken = docs.select(docs[id_col].alias("doc_id"), mark_of(docs[text_col]).alias("mark"), docs[text_col].alias("text"))
    kind = taken.schema["doc_id"].dataType.simpleString()

    def process():
        hashes = _WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, sizes, found = [], [], []
            for text in texts_of(batch):
                s = shingles_of(text, hashes, width)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                found.append(band_hashes(signature(s, bands * rows), bands, rows).view(np.int64))
            flat = pa.array(np.concatenate(found), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * bands, pa.int32()), flat)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "digest", "n", "bands"])

        return step

    return map_batches(taken, f"doc_id {kind}, mark bigint, digest binary, n bigint, bands array<bigint>", process)


def mark_of(text: Column) -> Column:
    """Hash of a text; with the id it names a row."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _key() -> Column:
    return F.concat_ws("/", F.col("doc_id").cast("string"), F.col("mark").cast("string")).alias("key")


def _blocks(classes: Column, shingles: Column) -> Column:
    """How many blocks a group is cut into."""
    return F.greatest(F.ceil(classes / BLOCK_CLASSES), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _groups(classes: DataFrame) -> DataFrame:
    """``digest``, ``group``, ``band`` (-1: compare all), ``blocks`` of every class that shares a bucket, and the class's columns."""
    cells = classes.select("digest", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = cells.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"), F.min("digest").alias("leader")).where("classes > 1")
    shared = cut_lineage(cells.join(buckets, "bucket").select("digest", "n", "band", "bucket", "leader", "classes", "shingles"))
    roots = components(shared.select(F.col("digest").alias("u"), F.col("leader").alias("v")))
    # Every class that shares a bucket has a component, the root included.
    rooted = shared.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    rooted = cut_lineage(rooted)
    # The plan of each component is a table of its own, so that joins on a large component's root can be split.
    members = cut_lineage(rooted.select("digest", "root", "n").distinct())
    sizes = members.groupBy("root").agg(F.count("*").alias("all_classes"), F.sum("n").alias("all_shingles"))
    by_bucket = rooted.groupBy("root").agg(F.sum(_blocks(F.col("classes"), F.col("shingles")).cast("double")).alias("cost"))
    plan = sizes.join(by_bucket, "root").withColumn("all_blocks", _blocks(F.col("all_classes"), F.col("all_shingles")))
    plan = cut_lineage(plan.select("root", "all_blocks", (F.col("all_classes") * F.col("all_blocks") <= F.col("cost")).alias("whole")))
    whole = members.join(plan.where("whole"), "root").select("digest", F.hex("root").alias("group"), F.lit(-1).alias("band"), F.col("all_blocks").alias("blocks"))
    single = rooted.join(plan.where("not whole"), "root").select("digest", F.col("bucket").cast("string").alias("group"), "band", _blocks(F.col("classes"), F.col("shingles")).alias("blocks"))
    return whole.unionByName(single)


def _candidate_shingles(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``digest`` and ``shingles`` of the rows that stand for the wanted classes (their ``doc_id`` and ``mark``), and of a few others."""

    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(_key())))
    taken = docs.select(docs[id_col].alias("doc_id"), mark_of(docs[text_col]).alias("mark"), docs[text_col].alias("text")).select(_key(), "text")

    def process():
        hashes, known = _WordHashes(), Known(shared.value, 0)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles_of(t, hashes, width) for k, t in zip(batch.column("key").to_pylist(), texts_of(batch), strict=True) if known[k]]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

        return step

    return map_batches(taken, "digest binary, shingles binary", process)


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, threshold: float, bands: int, rows: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``sets``) of the linked pairs between two lists of places, or within one list if they are the same list."""
    count = bands * rows
    sigs = np.stack([signature(s, count) for s in sets])
    sizes = np.array([len(s) for s in sets])
    least = {n: least_matches(n, threshold, tolerance) for n in range(STEP, count + 1, STEP)}
    matches = np.zeros((len(left), len(right)), np.uint8)
    for k in range(min(STEP, count)):
        matches += sigs[left, k][:, None] == sigs[right, k][None, :]
    alive = matches >= least.get(STEP, 0)
    if left is right:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    seen, a, b = matches[i, j].astype(np.int32), left[i], right[j]
    for n in range(2 * STEP, count + 1, STEP):
        if not len(a):
            break
        seen = seen + (sigs[a, n - STEP : n] == sigs[b, n - STEP : n]).sum(1)
        on = seen >= least[n]
        seen, a, b = seen[on], a[on], b[on]
    # A set much smaller than the other cannot reach the threshold.
    on = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[on], b[on]
    if band > 0 and len(a):
        hashes = band_hashes(sigs, bands, rows)
        on = ~(hashes[a, :band] == hashes[b, :band]).any(1)
        a, b = a[on], b[on]
    if not len(a):
        return a, b
    # Exact: mark one set, count the marks in its partners.
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked, linked = np.zeros(len(values), bool), np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(a)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(a)], strict=True):
        own = ids[starts[a[lo]] : starts[a[lo] + 1]]
        marked[own] = True
        partners = b[lo:hi]
        begin = np.concatenate([[0], np.cumsum(sizes[partners])])
        at = np.arange(begin[-1]) + np.repeat(starts[partners] - begin[:-1], sizes[partners])
        common = np.add.reduceat(marked[ids[at]].astype(np.int64), begin[:-1])
        linked[lo:hi] = common >= threshold * (len(own) + sizes[partners] - common) - 1e-9
        marked[own] = False
    return a[linked], b[linked]


def _links(rows: DataFrame, threshold: float, bands: int, rows_per_band: int, tolerance: float) -> DataFrame:
    """``digest``, ``links`` and ``root`` from every block; rows hold digest, copies, shingles, group, band, own, low, high, cell."""

    def run(block: pa.Table) -> pa.Table:
        keys = list(zip(block["group"].to_pylist(), block["low"].to_pylist(), block["high"].to_pylist(), strict=True))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        digest, copies, own, band = (block[c].to_pylist() for c in ("digest", "copies", "own", "band"))
        shingles = block["shingles"]
        out: list[tuple[bytes, int, bytes]] = []
        at = 0
        while at < len(order):
            upto = at
            members: dict[bytes, int] = {}
            while upto < len(order) and keys[order[upto]] == keys[order[at]]:
                members.setdefault(digest[order[upto]], order[upto])
                upto += 1
            _, low, high = keys[order[at]]
            chosen, at = list(members.values()), upto
            sets = [np.frombuffer(shingles[r].as_py(), np.uint64) for r in chosen]
            block_of = np.array([own[r] for r in chosen])
            left = np.flatnonzero(block_of == low)
            right = left if low == high else np.flatnonzero(block_of == high)
            if not len(left) or not len(right):
                continue
            a, b = compare(sets, left, right, band[chosen[0]], threshold, bands, rows_per_band, tolerance)
            if not len(a):
                continue
            weight = np.array([copies[r] for r in chosen], np.int64)
            links = np.bincount(a, weight[b], len(chosen)) + np.bincount(b, weight[a], len(chosen))
            # Number the members by digest, so that the least place of a component is its least digest.
            rank = np.argsort(np.argsort([digest[r] for r in chosen]))
            label = rank.copy()
            while True:
                least = label.copy()
                np.minimum.at(least, a, label[b])
                np.minimum.at(least, b, label[a])
                if (least == label).all():
                    break
                label = least
            of_rank = {rank[i]: digest[r] for i, r in enumerate(chosen)}
            out += [(digest[chosen[i]], int(links[i]), of_rank[label[i]]) for i in np.flatnonzero(links)]
        columns = [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())]
        return pa.Table.from_arrays(columns, ["digest", "links", "root"])

    return rows.groupBy("cell").applyInArrow(run, "digest binary, links bigint, root binary")


def near_copies(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``class_id`` (least id of its connected class that is not null), ``n_links`` (documents at or above the threshold, copies included) and
    ``class_digest`` of every row. The digest names one class even where ids come again; it is null for texts without words, which link to nothing.

    Starts jobs while the plan is built. Sketches, buckets, components and links are tables on shared storage.
    """
    sketched, known = _classes(docs, threshold, width, bands, rows, tolerance, id_col, text_col)
    result = sketched.select("doc_id", "digest").join(known, "digest", "left")
    links = F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    return result.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), links, F.coalesce("root", "digest").alias("class_digest"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("mark"))).alias("first")


def _classes(docs: DataFrame, threshold: float, width: int, bands: int, rows: int, tolerance: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches, and ``digest``, ``root``, ``class_id`` and ``n_links`` of every shingle set with a copy or a link."""
    sketched = cut_lineage(sketches(docs, width, bands, rows, id_col, text_col))
    # The row that stands for a class: least id, null after all others, then least text hash.
    classes = sketched.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), _first(), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = cut_lineage(classes)
    groups = cut_lineage(_groups(classes))
    wanted = groups.select("digest").distinct().join(classes.select("digest", "copies", "first", "n"), "digest")
    wanted = cut_lineage(wanted.select("digest", "copies", "n", "first.doc_id", "first.mark"))
    found = _candidate_shingles(docs, wanted, width, id_col, text_col)
    total = groups.join(wanted.select("digest", "n"), "digest").agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    cells = 1 + int(total) // BLOCK_SHINGLES * 4
    placed = groups.join(wanted.select("digest", "copies"), "digest").withColumn("own", F.pmod(F.xxhash64("digest", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("digest", "copies", "group", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("group", "low", "high"), F.lit(cells)))
    links = cut_lineage(_links(found.join(placed, "digest"), threshold, bands, rows, tolerance))
    roots = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    linked = links.groupBy("digest").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "copies", "least_id").join(linked, "digest", "left").where("copies > 1 or links is not null")
    known = known.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ids = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return sketched, cut_lineage(known.join(ids, "root").select("digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def representatives(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with one of each class left: that of least id (null after all others), and of equal ids that of least text hash.

    Only rows that a bitmap of fixed size lets through (those that go, and few others) take part in a join; the others stay where
    they are read.
    """
    sketched, known = _classes(docs, threshold, width, bands, rows, tolerance, id_col, text_col)
    members = cut_lineage(sketched.select("doc_id", "mark", "digest").join(known.where("n_links > 0").select("digest", "root"), "digest").select("doc_id", "mark", "root"))
    first = members.groupBy("root").agg(_first())
    # What one row of each key is to do: go, or stay once.
    keys = members.groupBy("root", "doc_id", "mark").count().join(first, "root")
    keys = keys.withColumn("goes", ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("mark").eqNullSafe(F.col("first.mark"))))
    keys = cut_lineage(keys.where("goes or count > 1").select(_key(), "goes"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select("key")))
    columns = docs.columns
    named = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(columns)], F.concat_ws("/", docs[id_col].cast("string"), mark_of(docs[text_col]).cast("string")).alias("__key"))
    keys = keys.withColumnRenamed("key", "__known")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)

    def passing(hit: bool):
        def process():
            known = Known(shared.value, 0)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([known[k] == hit for k in batch.column("__key").to_pylist()], pa.bool_()))

            return step

        return process

    rest = map_batches(named, schema, passing(False))
    looked_up = map_batches(named, schema, passing(True)).join(keys, F.col("__key") == F.col("__known"), "left")
    # Rows of one key have equal ids and texts.
    once = looked_up.where("not goes").dropDuplicates(["__key"])
    kept = rest.unionByName(looked_up.where("goes is null").select(rest.columns)).unionByName(once.select(rest.columns))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)])
