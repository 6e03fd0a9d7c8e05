"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables projects the unit vectors on Gaussian directions, shifts and floors them to a bucket. A query visits, in each
table, the bucket it falls in and perturbed ones (each coordinate moved by -1, 0 or +1) in the order of their estimated success: least sum of
squared distances from the query to the walls it must cross comes first. What the visited buckets hold is ranked by exact
cosine.

Equal vectors are one entry with their least ids, so a vector that a third of all rows share is one entry. A bucket with
many entries is cut into chunks of bounded size, and its queries go to each chunk; nothing is capped. A task compares the
queries of a chunk with its entries as one matrix product and returns a few rows for each query.
A query that found too few neighbours is compared with all entries, in blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
different lengths are different spaces; equal scores go to the smaller id; rows with the query's id are not its neighbours; a
table with fewer neighbours than asked for gives all; an empty table gives an empty table; only the id and vector columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from heapq import nsmallest
from itertools import product
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytable.llm.common import map_batches
from skytable.session import cut_lineage

TABLES, WIDTH = 6, 1.4
# Entries of a chunk, on average.
CHUNK = 4096
# How far rounding may move a cosine of the matrix product; entries so close to the last one asked for are all scored exactly.
MARGIN = 1e-9


def projections_for(rows: int) -> int:
    """Directions of one table; more rows get finer buckets."""
    return max(4, round(log2(max(rows, 2)) / 4))


def probes_for(projections: int) -> int:
    """Buckets visited in one table; finer buckets need more of them for the same recall."""
    return min(3**projections, round(24 * 2.5 ** (projections - 4)))


def directions(size: int, table: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of one table for vectors of a length."""
    made = np.random.default_rng((size, table, projections))
    return made.normal(size=(size, projections)), made.uniform(0, width, projections)


def places(units: np.ndarray, table: int, projections: int, width: float) -> np.ndarray:
    """Positions in units of buckets; their floor is the bucket."""
    a, b = directions(units.shape[1], table, projections, width)
    return (units @ a + b) / width


def probe_order(place: np.ndarray, probes: int) -> np.ndarray:
    """Buckets to visit for each query, best first: (queries, probes, projections)."""
    moves = np.array(list(product((0, -1, 1), repeat=place.shape[1])))
    home = np.floor(place)
    low = place - home
    cost = sum(np.where(moves[:, m] < 0, low[:, [m]], np.where(moves[:, m] > 0, 1 - low[:, [m]], 0.0)) ** 2 for m in range(place.shape[1]))
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return home[:, None, :] + moves[best]


def bucket_numbers(buckets: np.ndarray, size: int, table: int) -> list[int]:
    """One number for each bucket, different between tables and vector lengths."""
    flat = np.ascontiguousarray(buckets.reshape(-1, buckets.shape[-1]).astype(np.int64))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=size * 1000 + table) - (1 << 63) for row in flat]


def _usable(vectors: list) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or len(v) == 0 or any(c is None for c in v) else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and (x != 0).any() else None)
    return out


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of rows, on the vectors as given, in an order of summation that does not depend on the batch."""
    scale_q, scale_x = np.abs(q).max(1, keepdims=True), np.abs(x).max(1, keepdims=True)
    q, x = q / np.exp2(np.floor(np.log2(scale_q))), x / np.exp2(np.floor(np.log2(scale_x)))
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _by_length(vectors: list[np.ndarray]):
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.array([len(v) for v in vectors])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, np.stack([vectors[i] for i in at])


def _entries(vectors: DataFrame, id_col: str, vector_col: str, per_entry: int) -> DataFrame:
    """``digest``, ``vector`` and ``ids`` (the least few) of every different usable vector."""
    taken = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")).where("vec_id is not null")

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _usable(batch.column("vector").to_pylist())
            keep = [i for i, v in enumerate(found) if v is not None]
            # Adding zero makes minus zero zero, which is equal to it.
            digests = pa.array([xxhash.xxh3_128_digest((found[i] + 0.0).tobytes()) for i in keep], pa.binary())
            at = pa.array(keep, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vector").take(at), digests], ["vec_id", "vector", "digest"])

        return step

    usable = map_batches(taken, "vec_id bigint, vector array<double>, digest binary", process)
    # The rank limit is applied before the shuffle too, so a vector with very many copies sends a few rows from each task.
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    least = usable.dropDuplicates(["digest", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= per_entry)
    return least.groupBy("digest").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _best(queries: pa.Table, entries: pa.Table, neighbours: int) -> pa.Table:
    """The nearest entries' ids of each query of one chunk."""
    out_q, out_v, out_s = [], [], []
    if queries.num_rows and entries.num_rows:
        # A query can reach one chunk through several buckets only where bucket numbers collide.
        q_ids, first = np.unique(np.array(queries["query_id"].to_pylist(), np.int64), return_index=True)
        q_rows, e_rows = queries["vector"].combine_chunks(), entries["vector"].combine_chunks()
        q_all = [np.array(q_rows[int(i)].as_py()) for i in first]
        e_all = [np.array(v) for v in e_rows.to_pylist()]
        ids = entries["ids"].to_pylist()
        spaces = {size: (at, x, _units(x)) for size, at, x in _by_length(e_all)}
        for size, q_at, q in _by_length(q_all):
            if size not in spaces:
                continue
            e_at, x, unit = spaces[size]
            for lo in range(0, len(q), 512):
                near = _units(q[lo : lo + 512]) @ unit.T
                # One more than asked for, as one may be the query's own entry; and whatever equals the last of them but for rounding.
                many = min(neighbours + 1, near.shape[1])
                least = np.partition(near, near.shape[1] - many, axis=1)[:, -many] - MARGIN
                for k, row_near in enumerate(near):
                    row, cols = lo + k, np.flatnonzero(row_near >= least[k])
                    scores = _cosines(np.repeat(q[row][None], len(cols), 0), x[cols])
                    own = int(q_ids[q_at[row]])
                    named = nsmallest(neighbours, ((-s, v) for s, c in zip(scores, cols, strict=True) for v in ids[e_at[c]] if v != own))
                    out_q += [own] * len(named)
                    out_v += [v for _, v in named]
                    out_s += [-s for s, _ in named]
    return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])


def _nearest_of(found: DataFrame, neighbours: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= neighbours)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    neighbours: int = 5,
    tables: int = TABLES,
    width: float = WIDTH,
    projections: int | None = None,
    probes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the nearest rows found for each query.

    ``queries`` has the columns of ``vectors``. Starts jobs while the plan is built: entries, queries and found pairs are tables on shared storage.
    """
    entries = cut_lineage(_entries(vectors, id_col, vector_col, neighbours + 1))
    asked = queries.select(queries[id_col].cast("bigint").alias("query_id"), queries[vector_col].cast("array<double>").alias("vector"))
    # Vectors that take no part go first; then the least one stands for an id that comes again.
    usable = F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    asked = asked.where(F.col("query_id").isNotNull() & usable).groupBy("query_id").agg(F.min("vector").alias("vector"))
    projections = projections or projections_for(entries.count())
    probes = probes or probes_for(projections)

    def dealt():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, numbers = [], []
            for size, rows, x in _by_length([np.array(v) for v in batch.column("vector").to_pylist()]):
                for t in range(tables):
                    at += rows.tolist()
                    numbers += bucket_numbers(np.floor(places(_units(x), t, projections, width)), size, t)
            rows = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[batch.column(c).take(rows) for c in ("digest", "vector", "ids")]], ["bucket", "digest", "vector", "ids"])

        return step

    def probed():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _usable(batch.column("vector").to_pylist())
            keep = [i for i, v in enumerate(found) if v is not None]
            at, numbers = [], []
            for size, rows, x in _by_length([found[i] for i in keep]) if keep else ():
                for t in range(tables):
                    order = probe_order(places(_units(x), t, projections, width), probes)
                    at += np.repeat(np.array(keep)[rows], order.shape[1]).tolist()
                    numbers += bucket_numbers(order, size, t)
            rows = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[batch.column(c).take(rows) for c in ("query_id", "vector")]], ["bucket", "query_id", "vector"])

        return step

    members = map_batches(entries, "bucket bigint, digest binary, vector array<double>, ids array<bigint>", dealt)
    visits = map_batches(asked, "bucket bigint, query_id bigint, vector array<double>", probed)
    chunks = cut_lineage(members.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    cut = chunks.select("bucket", F.col("chunks").alias("pieces"))
    members = members.join(cut, "bucket").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("pieces"))).drop("pieces", "digest")
    visits = visits.join(chunks, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks").cast("bigint") - 1))).drop("chunks")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, neighbours)

    schema = "query_id bigint, vec_id bigint, score double"
    found = visits.groupBy("bucket", "chunk").cogroup(members.groupBy("bucket", "chunk")).applyInArrow(compared, schema)
    best = cut_lineage(_nearest_of(found, neighbours))
    # Queries with too few neighbours: all entries, in blocks. Usually there are none.
    full = best.groupBy("query_id").count().where(F.col("count") >= neighbours)
    short = cut_lineage(asked.join(full, "query_id", "left_anti"))
    blocks = max(1, -(-entries.count() // CHUNK)) if not short.isEmpty() else 0
    if blocks:
        every = entries.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(blocks)))

        def usable(left: pa.Table, right: pa.Table) -> pa.Table:
            keep = [v is not None for v in _usable(left["vector"].to_pylist())]
            return _best(left.filter(pa.array(keep, pa.bool_())), right, neighbours)

        spread = short.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        more = spread.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(usable, schema)
        best = _nearest_of(best.select("query_id", "vec_id", "score").unionByName(more), neighbours)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
