"""Neighbour search, URL filters, components and the registry against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.llm import components, nearest, url_filter

RULES = [url_filter.Rule("net/", True), url_filter.Rule("example.net/en/", False), url_filter.Rule("example.com/de/", True), url_filter.Rule("org/fr/", False)]


def judged_by_hand(url: str | None) -> tuple[str, str, str | None]:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r.text for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=len) if fits else None


def test_url_filter(spark) -> None:
    rng = random.Random(1)
    hosts = ["example.net", "a.Example.NET", "badexample.net", "example.com", "m.example.com", "x.org", "org", "casino-win.biz", "library.edu", "ÉCOLE.fr"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', '://', ':', '://a://'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/7', '/fr/x.html', '?q=/en/', '#/de/', '/en?x#y'])}" for _ in range(400)]
    rows = list(enumerate([*urls, None, "", "://", "no scheme", "http://x.net/" + "a" * 100_000, "multi\nline://h.net/p\nq?x"]))
    pages = spark.createDataFrame([*rows, (None, "http://example.net/en/1"), rows[0]], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    labelled = spark.createDataFrame([(f"http://casino-{i}.biz/win/{i}", True) for i in range(40)] + [(f"http://library{i}.edu/book/{i}", False) for i in range(40)] + [(None, True), ("http://q.x/", None)], "url string, block boolean")
    weights = url_filter.train(labelled)
    got = url_filter.judge(pages, RULES, weights).collect()
    want = Counter((i, *judged_by_hand(u)) for i, u in [*rows, (None, "http://example.net/en/1"), rows[0]])
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    blocks = {r.text: r.block for r in RULES}
    for r in got:
        assert r["verdict"] == ("block" if (blocks[r["rule"]] if r["rule"] else r["p_block"] >= 0.5) else "allow")
    assert url_filter.probability(weights, "casino-777.biz", "/win/777") > 0.8 > 0.2 > url_filter.probability(weights, "library777.edu", "/book/777")
    assert url_filter.judge(pages.limit(0), RULES, weights).count() == 0
    assert url_filter.probability(url_filter.train(labelled.limit(0)), "", "") == pytest.approx(0.5)


def cosines(rows: list[tuple], query: int) -> list[tuple[float, int]]:
    vectors = dict(rows)
    q = np.array(vectors[query], float)
    found = []
    for i, v in rows:
        if i in (query, None) or v is None or len(v) != len(q) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        x = np.array(v, float)
        found.append((-float(q @ x / np.sqrt((q @ q) * (x @ x))), i))
    return sorted((round(s, 12), i) for s, i in found)


def test_nearest(spark, monkeypatch) -> None:
    monkeypatch.setattr(nearest, "CHUNK", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 24))
    rows = [(i, [float(c) for c in base[i % 30] + 0.25 * rng.normal(size=24)]) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] + [1.0] * 23), (2004, [float("nan")] * 24), (2005, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (2050, [1.0, 2.0]), (2051, [2.0, 1.0]), (2100, None)]
    vectors = spark.createDataFrame([*rows, rows[3]], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = nearest.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    usable = {i for i, v in rows if i is not None and i % 50 == 0 and v and any(v)}
    assert {r["query_id"] for r in got} == usable
    hit = total = 0
    for q in usable:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        exact = cosines(rows, q)
        score = {i: -s for s, i in exact}
        assert [r for r, _, _ in mine] == list(range(1, min(5, len(exact)) + 1))
        assert all(score[v] == pytest.approx(s, abs=1e-9) for _, v, s in mine)
        assert [(-round(s, 12), v) for _, v, s in mine] == sorted((-round(s, 12), v) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & {i for _, i in exact[:5]})
        total += min(5, len(exact))
    assert hit / total >= 0.9
    # Copies of one vector: the least ids.
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 1050), key=lambda r: r["rank"])] == [0, 1000, 1001, 1002, 1003]
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    assert nearest.nearest(few, few).count() == 6


def test_probe_order() -> None:
    """Moves come in the order of the squared distances to the walls they cross."""
    place = np.array([[0.2, 3.9]])
    order = nearest.probe_order(place, 9)[0]
    assert order[0].tolist() == [0, 3] and order[1].tolist() == [0, 4] and order[2].tolist() == [-1, 3]
    assert len({tuple(o) for o in order.tolist()}) == 9


def test_components(spark) -> None:
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(x, root(x)) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_registry() -> None:
    from skytable.llm.queries import QUERIES

    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
