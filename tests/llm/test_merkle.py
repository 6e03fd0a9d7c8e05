"""Merkle manifest against a plain tree, and its SQL."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from skytable.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(*parts: str) -> str:  # noqa: N802
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    i, text, lang, source, n = row
    fields = [i, source, lang, None if n is None else n + more, text]
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and, for each leaf, (side, sibling) by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]
    nodes, under = leaves, [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, above = [], []
        for k in range(0, len(nodes), 2):
            run = nodes[k : k + 2]
            for at in range(k, k + len(run)):
                for i in under[at]:
                    paths[i].append(("L", nodes[k]) if at > k else ("R", nodes[k + 1]) if len(run) > 1 else ("-", ""))
            up.append(H(*run))
            above.append(sum(under[k : k + 2], []))
        nodes, under = up, above
    return nodes[0], paths


def by_hand(rows: list[tuple]) -> Counter:
    order = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted(((order(r[0]), leaf(r), r) for r in rows if r[2] == v), key=lambda x: x[:2]) for v in langs]
    made = [tree([x[1] for x in g]) for g in groups]
    root, above = tree([m[0] for m in made])
    out: Counter = Counter()
    for g, (subroot, paths), up in zip(groups, made, above, strict=True):
        for (_, own, r), path in zip(g, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1) if tampered else own
            for side, s in [*path, *up]:
                folded = H(folded, s) if side == "R" else H(s, folded) if side == "L" else H(folded)
            out[r[0], own, subroot, root, H(*[s for _, s in [*path, *up]]), folded, folded == root] += 1
    return out


def sample(n: int) -> list[tuple]:
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(-5, 400)]), rng.choice([None, "", "aé\n" * rng.randrange(9)]), rng.choices([None, "", "de", "en", "é"], [1, 1, 5, 20, 1])[0], rng.choice([None, "s"]), rng.choice([None, 0, 9, 2**63 - 1])) for _ in range(n)]
    return rows + rows[: n // 5] + ([(7, "x" * 300_000, "en", "s", 1)] if n else [])


@pytest.mark.parametrize(("n", "height"), [(0, 10), (40, 2), (300, 3)])
def test_manifest(spark, tmp_path, monkeypatch, n: int, height: int) -> None:
    rows = sample(n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("at", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: plain(*a, height=height))
    got = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == (by_hand(rows) if rows else Counter())
    if 0 < n < 300:
        con = duckdb.connect()
        con.execute(f"create view documents as select doc_id, text, lang, source, case when n_chars > 99 then 99 else n_chars end as n_chars from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = by_hand([(*r[:4], r[4] if r[4] is None else min(r[4], 99)) for r in rows])
        assert Counter(con.execute(queries.SQL["op12_merkle_manifest"]).fetchall()) == want


def test_group_over_many_blocks(spark) -> None:
    digests = [sha256(str(i).encode()).digest() for i in range(700)]
    nodes = spark.createDataFrame([(0, i, d, len(digests)) for i, d in enumerate(digests)], "g bigint, i bigint, d binary, n bigint").repartition(8)
    roots, proven = merkle.trees(nodes, height=4)
    root = tree([d.hex() for d in digests])[0]
    assert [r["d"].hex() for r in roots.collect()] == [root]
    assert all(merkle.fold(r["d"], r["proof"]).hex() == root for r in proven.collect())
    assert proven.count() == 700
