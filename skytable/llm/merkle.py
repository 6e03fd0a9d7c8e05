"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a group, in the order of their ids, form a tree of runs of two, and the groups' roots, in the order of the groups,
form another one. A node's label is its level and its place in the level. A sweep in the order of labels takes from a priority queue all digests sent
to a node, and sends the node's own digest to its parent; a reversed sweep sends to each child the part of a proof that its parent has
received, with the child's sibling in front, until the leaves hold whole proofs.

Labels are dealt in blocks of ``2 ** HEIGHT`` neighbouring places. A queue in memory holds the messages inside a block; those that
leave it (one digest up, one partial proof down, for each block) go through Spark's sorted shuffle to the block above or below, which is the queue's external
part. So a task holds one block's messages whatever the size of a group, and a sweep takes one shuffle for each ``HEIGHT`` levels.

Defined cases: null fields are written ``-``; a null id comes before all others, rows of equal ids are ordered by leaf digest, and equal rows are equal
leaves, one after another; a null group is a group, before all others; an empty text is a value; a lone leaf is its group's root, a lone group's root
the root; an empty table gives an empty table; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches
from skytable.operators.ranking import renumber
from skytable.session import cut_lineage

# Levels of one block.
HEIGHT = 10
# A step of a proof: a letter that tells the sibling's side, and the sibling's digest; or the letter alone for a run of one.
RIGHT, LEFT, ALONE = b"R", b"L", b"-"
_STEP = 33


def encoded(value: Column) -> Column:
    """Byte count, colon and value as text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def parent_digest(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def _height(nodes: int, most: int) -> int:
    """Levels above the leaves of a block: ``most``, if its group has other blocks, else as many as its nodes need."""
    return min(most, (nodes - 1).bit_length())


def sweep(digests: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """The top digest of a block and, by level, its digests."""
    queue = [(0, i, i, d) for i, d in enumerate(digests)]
    levels: list[list[bytes]] = [[] for _ in range(height + 1)]
    while queue:
        level, place = queue[0][:2]
        sent = []
        while queue and queue[0][:2] == (level, place):
            sent.append(heapq.heappop(queue)[3])
        own = sent[0] if level == 0 else parent_digest(sent)
        levels[level].append(own)
        if level < height:
            heapq.heappush(queue, (level + 1, place >> 1, place, own))
    return levels[height][0], levels


def sweep_back(levels: list[list[bytes]], top_proof: bytes) -> list[bytes]:
    """The proofs of a block's leaves, from its digests and the proof of its top."""
    queue = [(-(len(levels) - 1), 0, top_proof)]
    proofs: list[bytes] = []
    while queue:
        level, place, proof = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            proofs.append(proof)
            continue
        below, first = levels[level - 1], 2 * place
        if first + 1 < len(below):
            heapq.heappush(queue, (-(level - 1), -first, RIGHT + below[first + 1] + proof))
            heapq.heappush(queue, (-(level - 1), -(first + 1), LEFT + below[first] + proof))
        else:
            heapq.heappush(queue, (-(level - 1), -first, ALONE + proof))
    proofs.reverse()
    return proofs


def steps(proof: bytes) -> list[tuple[bytes, bytes]]:
    """The steps of a proof from the leaf up: side and sibling (empty in a run of one)."""
    found, at = [], 0
    while at < len(proof):
        side = proof[at : at + 1]
        to = at + (1 if side == ALONE else _STEP)
        found.append((side, proof[at + 1 : to]))
        at = to
    return found


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    own = leaf
    for side, sibling in steps(proof):
        own = parent_digest([own, sibling] if side == RIGHT else [sibling, own] if side == LEFT else [own])
    return own


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """One level of blocks up: ``g``, ``i``, ``d`` and ``n`` (nodes of the group on this level) of every block's top."""

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n = table["n"][0].as_py()
        top, _ = sweep(table["d"].to_pylist(), _height(n, height))
        above = {"i": table["i"][0].as_py() >> height, "n": -(-n // (1 << height))}
        return pa.table({"g": table["g"][:1], "d": pa.array([top], pa.binary())} | {c: pa.array([v], pa.int64()) for c, v in above.items()}).select(["g", "i", "d", "n"])

    return nodes.select("g", "i", "d", "n").groupBy("g", F.shiftright("i", height).alias("b")).applyInArrow(up, "g bigint, i bigint, d binary, n bigint")


def _proofs(nodes: DataFrame, above: DataFrame, keep: list[str], height: int) -> DataFrame:
    """The nodes with their ``proof``; ``above`` has the proofs of their blocks' tops (``g``, ``i``, ``proof``)."""
    kinds = dict(nodes.dtypes)
    names = ["g", "i", "d", *keep]

    def down(table: pa.Table, top: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n = table["n"][0].as_py() if table.num_rows else 0
        if not n:
            return pa.table({c: table[c] for c in names} | {"proof": pa.array([], pa.binary())})
        _, levels = sweep(table["d"].to_pylist(), _height(n, height))
        proofs = sweep_back(levels, top["proof"][0].as_py())
        return pa.table({c: table[c] for c in names} | {"proof": pa.array(proofs, pa.binary())})

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in names], "proof binary"])
    upper = above.select("g", F.col("i").alias("b"), "proof")
    return nodes.groupBy("g", F.shiftright("i", height).alias("b")).cogroup(upper.groupBy("g", "b")).applyInArrow(down, schema)


def trees(nodes: DataFrame, keep: list[str] | None = None, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Roots (``g``, ``d``) and nodes with proofs up to them, of the trees over nodes (``g``, ``i`` from 0 on without gaps, ``d``, and ``n`` to the group).

    Starts jobs while the plan is built: one for each ``height`` levels of the largest group.
    """
    layers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        layers.append(cut_lineage(_tops(layers[-1], height)))
        most = -(-most // (1 << height))
    roots = layers[-1].select("g", "d")
    proven = layers[-1].withColumn("proof", F.lit(b""))
    for layer in reversed(layers[:-1]):
        own = layer is nodes
        proven = _proofs(layer, proven.select("g", "i", "proof"), (keep or []) if own else [], height)
    return roots, proven


def manifest(
    docs: DataFrame, fields: list[str], group: str, id_col: str, tampered: Callable[[DataFrame], tuple[Column, list[Column]]] | None = None, height: int = HEIGHT
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``claimed`` of every row, digests as bytes.

    ``fields`` are a leaf's columns. ``tampered`` gives the rows whose fields somebody has changed and their changed fields; their leaf is ``claimed``, which
    is null for other rows. Starts jobs while the plan is built.
    """
    leaf = F.unhex(leaf_digest([docs[f] for f in fields]))
    claimed = F.lit(None).cast("binary")
    if tampered is not None:
        where, changed = tampered(docs)
        claimed = F.when(F.coalesce(where, F.lit(False)), F.unhex(leaf_digest(changed)))
    leaves = cut_lineage(docs.select(docs[id_col].alias("doc_id"), docs[group].alias("lang"), leaf.alias("d"), claimed.alias("claimed")))
    placed = cut_lineage(renumber(leaves, [F.col("lang"), F.col("doc_id"), F.col("d")], "at"))
    groups = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = cut_lineage(renumber(groups, [F.col("lang")], "g"))
    own = groups.withColumnRenamed("lang", "_lang")
    nodes = placed.join(own, placed["lang"].eqNullSafe(own["_lang"])).select("g", (F.col("at") - F.col("first")).alias("i"), "d", "n", "doc_id", "claimed")
    roots, proven = trees(cut_lineage(nodes), ["doc_id", "claimed"], height)
    n_groups = groups.count()
    top = cut_lineage(roots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), "d", F.lit(n_groups).cast("bigint").alias("n")))
    root, above = trees(top, height=height)
    only = root.first()
    above = above.select(F.col("i").alias("g"), F.col("d").alias("subroot"), F.col("proof").alias("_above"), F.lit(bytes(only["d"]) if only else None).cast("binary").alias("root"))
    whole = proven.join(above, "g")
    return whole.select("doc_id", F.col("d").alias("leaf"), "subroot", "root", F.concat("proof", "_above").alias("proof"), "claimed")


def verified(proven: DataFrame) -> DataFrame:
    """Hex digests of what :func:`manifest` returns, a digest of the proof's siblings, and the root that the claimed leaf (else the leaf) folds to."""

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            leaf, claimed, proofs, root = (batch.column(c).to_pylist() for c in ("leaf", "claimed", "proof", "root"))
            siblings = [sha256("".join(s.hex() for _, s in steps(p)).encode()).hexdigest() for p in proofs]
            folded = [fold(a if c is None else c, p) for a, c, p in zip(leaf, claimed, proofs, strict=True)]
            same = [f == r for f, r in zip(folded, root, strict=True)]
            digests = [pa.array([x.hex() for x in v], pa.string()) for v in (leaf, batch.column("subroot").to_pylist(), root)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *digests, pa.array(siblings, pa.string()), pa.array([f.hex() for f in folded], pa.string()), pa.array(same, pa.bool_())], names)

        return step

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = dict(proven.dtypes)["doc_id"]
    return map_batches(proven, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", process)
