"""Repeated byte strings against all windows by hand, and the sorted collections against their windows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from skytable.llm import queries, suffix_dedup

LENGTH = suffix_dedup.LENGTH


def tie_of(spark, rows: list[tuple]) -> list[int]:
    return [r[0] for r in spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]


def by_hand(rows: list[tuple], ties: list[int]) -> Counter:
    keys = [(i is not None, i or 0, tie) for (i, _), tie in zip(rows, ties, strict=True)]
    first: dict[bytes, tuple] = {}
    for key, (_, text) in sorted(zip(keys, rows, strict=True), key=lambda x: x[0]):
        data = (text or "").encode()
        for s in range(len(data) - LENGTH + 1):
            first.setdefault(data[s : s + LENGTH], (key, s))
    out: Counter = Counter()
    for key, (i, text) in zip(keys, rows, strict=True):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - LENGTH + 1):
            if first[data[s : s + LENGTH]] != (key, s):
                gone[s : s + LENGTH] = b"\1" * LENGTH
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i, len(data), sum(gone), runs, sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def sample() -> list[tuple]:
    rng = random.Random(5)
    prose = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    passage, long = prose(260), prose(3000)
    rows = [(i, prose(rng.randrange(0, 500))) for i in range(40)]
    rows += [(100 + i, prose(rng.randrange(90)) + passage[rng.randrange(60) :] + prose(rng.randrange(90))) for i in range(60)]
    rows += [(200 + i, long[: rng.randrange(3000)] + rng.choice(["", "é", "x"]) + long[rng.randrange(3000) :]) for i in range(25)]
    # Periods of every kind, which repeat inside a document and between documents.
    rows += [(300 + p, prose(p, "abcdxyz") * (700 // p)) for p in (1, 2, 7, 33, 63, 64, 65, 68, 69, 99, 100, 101, 170)]
    rows += [(320, "a" * 5000), (321, "a" * 101), (322, "a" * 100), (323, prose(40) + "ab" * 70 + prose(30)), (324, passage[:100]), (325, passage[:99])]
    rows += [(None, passage), (None, None), (None, passage), (400, ""), (400, long), (400, passage + long), (7, long), (-3, passage), (401, long), (401, long)]
    return rows


@pytest.mark.parametrize(("bucket_bytes", "block_pieces", "split_pieces"), [(2 << 20, 4000, 4000), (4000, 50, 20)])
def test_remove_repeats(spark, tmp_path, monkeypatch, bucket_bytes: int, block_pieces: int, split_pieces: int) -> None:
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Bucket", F.lit(1)).withColumn("tie", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = suffix_dedup.remove_repeats
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda d: plain(d, bucket_bytes=bucket_bytes, block_pieces=block_pieces, split_pieces=split_pieces))
    got = Counter(tuple(r) for r in queries.op11_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == by_hand(rows, tie_of(spark, rows))


def test_empty_table(spark) -> None:
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_column_wise() -> None:
    rng = random.Random(3)
    for trial in range(60):
        base = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(260))
        pieces = []
        for _ in range(rng.randrange(1, 30)):
            a, n = rng.randrange(92), rng.randrange(LENGTH, LENGTH + suffix_dedup.GRAMS)
            piece = bytearray(base[a : a + n])
            if rng.random() < 0.5:
                piece[rng.randrange(n)] = rng.choice(b"ab")
            pieces.append(bytes(piece))
        want, got = defaultdict(set), defaultdict(set)
        for i, p in enumerate(pieces):
            for o in range(len(p) - LENGTH + 1):
                want[p[o : o + LENGTH]].add((i, o))
        piece, offset, classes = suffix_dedup.column_wise(pieces)
        for i, o, c in zip(piece.tolist(), offset.tolist(), classes.tolist(), strict=True):
            got[c].add((i, o))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        # Classes follow the order of the strings.
        firsts = [pieces[i][o : o + LENGTH] for i, o in zip(piece.tolist(), offset.tolist(), strict=True)]
        assert firsts == sorted(firsts)
