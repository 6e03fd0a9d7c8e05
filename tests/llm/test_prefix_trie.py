"""The trie of conversations against all prefixes by hand, and its SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from skytable.llm import prefix_trie, queries


def by_hand(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
        ends[s].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        gain = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += gain
    digest = lambda p: sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def sample(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    if kind == "empty":
        return []
    words = [None, "", "a b", "a  b c d"] if kind == "mixed" else ["a", "b b"]
    rows = []
    for c in [*range(120 if kind == "mixed" else 60), 10**12, 10**12 + 7]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 12] if kind == "mixed" else [9, 17, 40])):
            # Long common paths that leave a spine of equal turns now and then.
            text = rng.choice(words) if kind == "mixed" or rng.random() < 0.06 else "spine"
            rows.append((c, rng.choice([t, t, None]) if kind == "mixed" else t, rng.choice(["user", None]) if kind == "mixed" else "user", text))
    return [*rows, (None, 1, "user", "x"), *rows[:5], (77, 0, "user", "word " * 50_000)]


@pytest.mark.parametrize("kind", ["empty", "mixed", "spine"])
def test_prefixes(spark, tmp_path, kind: str) -> None:
    rows = sample(kind)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("x", F.lit(1)).withColumn("Depth", F.lit("clash"))
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = Counter(tuple(r) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect())
    assert got == (by_hand(rows) if rows else Counter())
    if rows:
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        assert Counter(con.execute(queries.SQL["op13_prefix_trie"]).fetchall()) == got


def test_fattest(spark) -> None:
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2**40 - 1, 2**40), (5, 2**62)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", prefix_trie.fattest("a", "b").alias("f")).collect()
    for a, b, f in got:
        low = f & -f
        assert a < f <= b and a // (2 * low) == b // (2 * low)
