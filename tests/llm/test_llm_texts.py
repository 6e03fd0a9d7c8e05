"""Operators on texts against brute force, round trips and public tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skytable.llm import byte_bpe, chunk_dedup, jaccard_join, mixing, quality, sanitise, token_counts, toxicity

ALPHABET = "aeinrst 'dmlv  \n\t.,#1290é½²\x1c\x85\xa0 ßñЖ字😀"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def random_text(rng: random.Random, most: int, special: float = 0.0) -> str:
    return "".join("<|endoftext|>" if rng.random() < special else rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def frame(spark, rows: list[tuple]):
    """Documents from (id, text) or whole rows."""
    full = [r if len(r) == 5 else (*r, "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    """Null ids and texts, an empty text, a very long one, repeated rows."""
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (None, "a null id"), (3, long), (4, "same row twice here"), (4, "same row twice here"), (None, None), (5, "x" * 100_000)]


@pytest.fixture(scope="module")
def entries() -> list[bytes]:
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_library(entries) -> None:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = byte_bpe.ByteBpe(entries, public_tokenizers.PATTERN), random.Random(1)
    texts = [random_text(rng, 60, 0.02) for _ in range(3000)] + [e.decode("utf-8", "ignore") for e in entries[::37]]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_bpe_frames(spark, entries) -> None:
    docs = frame(spark, odd_rows()).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(7))
    encoded = byte_bpe.encode(docs, entries, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, entries).collect()
    want = Counter((r[0], (r[1] or "").encode()) for r in odd_rows())
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == want
    digests = byte_bpe.digests(docs, entries, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in digests.collect()) == Counter((i, hashlib.sha256(t).hexdigest()) for (i, t), n in want.items() for _ in range(n))
    assert byte_bpe.digests(docs.limit(0), entries, public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_library(spark) -> None:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    counter, rng = token_counts.Counter(vocabulary), random.Random(2)
    for _ in range(3000):
        text = random_text(rng, 50, 0.03)
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids)
    for _ in range(1500):
        text, size = random_text(rng, 60), rng.randint(1, 7)
        maps = [counter.state_map(text[i : i + size]) for i in range(0, max(1, len(text)), size)]
        assert counter.total(counter.scan(maps)) == len(library.encode(text, add_special_tokens=False).ids)
        # Composition is associative.
        if len(maps) >= 3:
            a, b, c = maps[:3]
            assert counter.total(counter.compose(counter.compose(a, b), c)) == counter.total(counter.compose(a, counter.compose(b, c)))
    rows = [*odd_rows(), (9, "cut <|endoftext|> here " * 3000)]
    docs = frame(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("row", F.lit(1))
    for chunk in (64, 1 << 16):
        got = token_counts.count_tokens(docs, vocabulary, chunk).collect()
        want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0), vocabulary).count() == 0


def base_by_hand(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base(spark) -> None:
    rng = random.Random(3)
    rows = [*odd_rows(), *((100 + i, " ".join(rng.choice("abcdefg#") for _ in range(rng.randint(0, 90))) + "\n" * rng.randint(0, 2) + "a b c\na b c\x0b\x1c d") for i in range(150))]
    docs = frame(spark, rows).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(0))
    got = quality.judge(docs).collect()
    assert Counter((r["doc_id"], *[r[c] for c in quality.BASE], r["base_failed"]) for r in got) == Counter((i, *base_by_hand(t)) for i, t in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_estimates(spark) -> None:
    """Against the same concentration steps in numpy, and with planted outliers."""
    rng = np.random.default_rng(4)
    names = list(quality.FLOORS)
    x = rng.normal(size=(400, 5)) @ np.diag([0.6, 0.4, 0.05, 0.02, 0.1]) + [5, 5, 0.1, 0, 0.2]
    x[:40, 2] += 5
    rows = [(None if i % 2 else "en", *map(float, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in names))
    got = {r["g"]: r for r in quality.robust_estimates(stats, ["g"]).collect()}
    floors = np.array(list(quality.FLOORS.values()))
    for group, part in ((None, x[1::2]), ("en", x[::2])):
        cells = np.floor(part / (floors / 20))
        at = lambda q: np.sort(cells, 0)[int(np.ceil(q * len(part))) - 1] + 0.5
        centre, spread = at(0.5) * floors / 20, (at(0.75) - at(0.25)) * floors / 20 / 1.349
        cov = np.diag(spread**2 + floors**2)
        for share, factor in [(0.75, quality.FACTOR)] * quality.STEPS + [(None, quality.NEAR_FACTOR)]:
            d = part - centre
            d2 = (d * np.linalg.solve(cov, d.T).T).sum(1)
            bins = np.floor(16 * np.log2(1 + d2))
            chosen = bins <= np.sort(bins)[int(np.ceil(share * len(part))) - 1] if share else d2 <= quality.NEAR
            centre, cov = part[chosen].mean(0), np.cov(part[chosen].T, bias=True) * factor + np.diag(floors**2)
        factor_l = np.linalg.cholesky(cov)
        assert np.allclose([got[group][f"m_{i}"] for i in range(5)], centre)
        assert np.allclose([got[group][f"l_{i}_{j}"] for i in range(5) for j in range(i + 1)], factor_l[np.tril_indices(5)])
        d = part - centre
        out = (d * np.linalg.solve(cov, d.T).T).sum(1) > quality.CUTOFF
        assert out.sum() == (part[:, 2] > 3).sum() and (part[out][:, 2] > 3).all()


BASE_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def spans_by_hand(text: str) -> list[tuple[int, int, int]]:
    found = []
    for kind, pattern in enumerate(BASE_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans() -> None:
    rng = random.Random(5)
    for _ in range(40_000):
        text = "".join(rng.choice("a1.@-+ ()_%9x5\né") for _ in range(rng.randint(0, 30)))
        assert sanitise.base_spans(text) == spans_by_hand(text)
    for run in ("a" * 300_000, "1" * 300_000, "+1 " * 100_000, "a@" * 100_000):
        sanitise.base_spans(run)


def test_disclosing_terms(spark) -> None:
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{noise(20)} Zanzibar clerk writes to boss@acme.com about {noise(20)}") for i in range(6)]
    rows += [(50 + i, f"{noise(15)} about clerk writes {noise(15)}") for i in range(200)]
    rows += [(900, f"{noise(10)} unique near other@acme.com {noise(10)}"), (901, None), (902, "")]
    docs = frame(spark, rows).withColumn("spans", F.lit("clash"))
    found = {r["doc_id"]: r for r in sanitise.find(docs).collect()}
    text = dict(rows)
    words = lambda i: [text[i][s["start"] : s["end"]] for s in found[i]["spans"] if s["kind"] >= sanitise.TERM]
    assert all(words(i) == ["Zanzibar"] for i in range(6)) and not any(words(i) for i in (50, 900))
    assert all(sanitise.KINDS[s["kind"]] == "email" for i in range(6) for s in found[i]["base"])
    clean = {r["doc_id"]: r for r in sanitise.sanitise(docs).collect()}
    assert sanitise.sanitise(docs).columns == docs.columns
    assert "boss@" not in clean[0]["text"] and "Zanzibar" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"]
    assert clean[901]["text"] is None and clean[902]["text"] == "" and clean[60]["text"] == text[60]
    assert sanitise.find(docs.limit(0)).count() == 0 and sanitise.sanitise(docs.limit(0)).count() == 0
    assert sanitise.find(frame(spark, odd_rows())).count() == len(odd_rows())


def test_repeated_passages(spark) -> None:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(70), prose(6)
    rows = [(i, f"{prose(rng.randint(5, 90))} {passage} {prose(rng.randint(5, 90))}") for i in range(25)]
    rows += [(100 + i, f"{prose(60)} {short} {prose(60)}") for i in range(40)]
    rows += [(200, " ".join(["same words in one text again and again"] * 50)), (None, f"x {passage}"), (300, None), (301, "")]
    docs = frame(spark, rows).withColumn("start", F.lit("clash"))
    got = chunk_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {*range(25), None}
    text = dict(rows)
    for r in got:
        assert text[r["doc_id"]][r["start"] : r["end"]].strip() in passage and r["first_doc_id"] == 0 and r["kept"] == (r["doc_id"] in (0, None))
    once = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(docs).collect()}
    assert once[0] == text[0] and len(once[1]) < len(text[1]) - 200 and once[100] == text[100] and once[300] is None
    assert chunk_dedup.repeated_passages(docs.limit(0)).count() == 0
    # Ends follow the bytes: what is inserted before them moves none beyond its surroundings.
    a = prose(400).encode()
    ends = set((chunk_dedup.ends_of(np.frombuffer(a, np.uint8)) + 7).tolist())
    moved = set(chunk_dedup.ends_of(np.frombuffer(b"insert " + a, np.uint8)).tolist())
    assert {e for e in ends if e > 60} == {e for e in moved if e > 60}
    assert np.diff(chunk_dedup.ends_of(np.zeros(5000, np.uint8)), prepend=0).max() <= chunk_dedup.MOST


def groups_by_hand(rows: list[tuple], threshold: float = 0.8) -> tuple[list[list[int]], Counter]:
    """The rows of each connected class, and the links of each row."""
    sets = []
    for i, text in rows:
        w = jaccard_join.words_of(text or "")
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent, links = list(range(len(sets))), Counter()

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for a in range(len(sets)):
        groups[root(a)].append(a)
    return list(groups.values()), links


def classes_by_hand(rows: list[tuple], threshold: float = 0.8) -> Counter:
    groups, links = groups_by_hand(rows, threshold)
    least = lambda g: min((rows[a][0] for a in g if rows[a][0] is not None), default=None)
    return Counter((rows[a][0], least(g), links[a]) for g in groups for a in g)


def n_classes(rows: list[tuple]) -> int:
    return len(groups_by_hand(rows)[0])


def near_rows() -> list[tuple]:
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return [*rows, *odd_rows()]


def test_near_copies(spark, monkeypatch) -> None:
    rows = near_rows()
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash")).withColumn("digest", F.lit(0))
    want = classes_by_hand(rows)
    got = lambda: Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(docs).collect())
    assert got() == want
    # Many small blocks, and components compared bucket by bucket.
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 7)
    assert got() == want
    assert jaccard_join.near_copies(docs.limit(0)).count() == 0
    left = jaccard_join.representatives(docs)
    assert left.columns == docs.columns and left.count() == n_classes(rows)


def test_pruning_bound() -> None:
    from fractions import Fraction
    from math import comb

    for n in (16, 64):
        m = jaccard_join.least_matches(n, 0.8, 1e-9)
        tail = lambda k: sum(comb(n + 1, j) * Fraction(4, 5) ** j * Fraction(1, 5) ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= Fraction(1, 10**9) and (m == 0 or tail(m - 1) < Fraction(1, 10**9))


def test_mixing(spark) -> None:
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["sun", "sea", "ore", "fir", "elm"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(600)]
    rows += [(None, None, None, None, None), (7, "", "en", "a", 0), *rows[:3]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).withColumn("__p", F.lit(1))
    sources, langs, topics = {"a": 0.4, "b": 0.3}, {"en": 0.5, "de": 0.3}, mixing.TOPIC_TARGETS
    got = mixing.mix(docs, sources, langs, topics, 0.3).collect()
    assert len(got) == len(rows) and sum(r["n_tokens"] for r in got) == sum(len((r[1] or "").split()) for r in rows)
    total = sum(r["n_tokens"] * r["probability"] for r in got)
    assert total == pytest.approx(0.3 * sum(r["n_tokens"] for r in got), rel=1e-6)
    for column, wanted in (("source", sources), ("lang", langs)):
        for value, share in wanted.items():
            assert sum(r["n_tokens"] * r["probability"] for r in got if r[column] == value) / total == pytest.approx(share, abs=1e-4)
    kept = mixing.sample(docs, sources, langs, topics, 0.3)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert abs(sum(r["n_tokens"] for r in got if r["kept"]) / total - 1) < 0.2
    assert mixing.mix(docs.limit(0), sources, langs, topics, 0.3).count() == 0 and mixing.sample(docs.limit(0), sources, langs, topics, 0.3).count() == 0
    p = mixing.rake(np.array([[10.0, 0.0], [5.0, 5.0]]), [np.array([0.9, 0.1]), np.array([0.5, 0.5])], 0.9)
    assert ((p >= 0) & (p <= 1)).all()


def toxic_rows(n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(10)
    syllables = ["ran", "tel", "mo", "sha", "ki", "lor", "ve", "un", "di", "par"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        if bad := i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grumpfool", "zokwit" + rng.choice(syllables), "grumpfool"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark) -> None:
    rows, labels = toxic_rows(600)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = frame(spark, [*rows, *((i + 10_000 if i else None, t) for i, t in odd_rows())]).withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*[x for x in labels if x[0] not in held], (None, 1), (0, None), (1, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(*toxicity.sample(docs, known))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels if i in held]) > 0.95
    # Gaps and inserted characters keep most of a score; a spaced-out word is whole again.
    plain, *bent = toxicity.word_scores(model, ["grumpfool", "grumxpfool", "gruumpfoool", "ranmotel"])
    assert plain > 0.5 and min(bent[:2]) > bent[2]
    assert "grumpfool" in toxicity.words_of("say g r u m p f o o l now") and "grumpfool" in toxicity.words_of("g.r.u.m.p-f_o.o.l!")
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.train(*toxicity.sample(docs, known.limit(0)))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_toxicity_table_is_the_kernel_sum() -> None:
    """The table of subsequences scores as the sum over landmarks does."""
    landmarks, words = ["grumpfool", "zokwit", "ran", "telmo"], ["grumpfol", "zok-wit", "x", "shakilor"]
    machine = toxicity._Machine(landmarks)
    model = machine.model(landmarks[:2], np.ones(2), landmarks[2:], Counter())
    k = toxicity.kernel(words, landmarks)
    for i, w in enumerate(words):
        for j, v in enumerate(landmarks):
            by_hand = sum(a * b for u, a in _features(w).items() for x, b in _features(v).items() if u == x)
            assert k[i, j] == pytest.approx(by_hand / toxicity._norm(len(w)) / toxicity._norm(len(v)), rel=1e-4, abs=1e-6)
    x = np.vstack([machine.vectors(landmarks[:2]), machine.vectors(landmarks[2:])])
    beta, intercept = toxicity._svm(x, np.array([1.0, 1, -1, -1]), np.array([0.5, 0.5, 0.5, 0.5]) * toxicity.COST)
    assert np.allclose(toxicity.word_scores(model, words), np.clip(machine.vectors(words) @ beta + intercept, -2, 3), atol=1e-3)


def _features(word: str) -> dict[str, float]:
    marked, out = f"\x01{word}\x02", defaultdict(float)
    for places, weight in toxicity._PATTERNS:
        for at in range(len(marked) - places[-1]):
            out["".join(marked[at + p] for p in places)] += weight
    return out


def disclosures_by_hand(rows: list[tuple], support: int = sanitise.SUPPORT) -> dict[tuple, float]:
    """Disclosure of all (entity, term) pairs with support, from sets of texts."""
    from math import log

    texts = {t or "" for _, t in rows}
    named, windows, held, both = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in texts:
        spans = spans_by_hand(text)
        for w in re.findall(r"[^\W\d_]{3,}", text.lower()):
            held[w].add(text)
        words = [m for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(s < m.end() and m.start() < e for s, _, e in spans)]
        for start, kind, end in spans:
            value = text[start:end].lower() if kind == 0 else text[start:end] if kind == 1 else re.sub("[^0-9]", "", text[start:end])
            left, right = [m[0].lower() for m in words if m.end() <= start], [m[0].lower() for m in words if m.start() >= end]
            around = (*left[-sanitise.REACH :], *right[: sanitise.REACH])
            named[kind, value].add(text)
            for w in set(around):
                windows[(kind, value), w].add(around)
                both[(kind, value), w].add(text)
    out = {}
    for (e, w), seen in windows.items():
        if len(seen) >= support:
            given, share = min(1, len(both[e, w]) / len(held[w])), min(0.5, len(named[e]) / len(texts))
            out[e, w] = 1 - log(given) / log(share)
    return out


def test_disclosure_by_hand(spark) -> None:
    rng = random.Random(16)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(3)) for _ in range(n))
    rows = [(i, f"{noise(30)} {rng.choice(['a1@x.com', 'A1@x.com, b2@y.org', '10.0.0.7', '+1 555 010 9999'])} {rng.choice(['Kappa', 'sigma', 'tau mu nu'])} {noise(30)}") for i in range(60)]
    rows += [(100 + i, noise(20) + rng.choice(["", " kappa"])) for i in range(200)] + [(None, None), (300, "")] + rows[:9]
    docs = frame(spark, rows)
    marked = sanitise._marked(docs, "doc_id", "text", [])
    entity = {sanitise._entity(k, v): (k, v) for k, v in [(0, "a1@x.com"), (0, "b2@y.org"), (1, "10.0.0.7"), (3, "15550109999")]}
    got = {(entity[bytes(r["entity"])], r["term"]): r["disclosure"] for r in sanitise.disclosures(marked, docs, "text").collect()}
    assert got == pytest.approx(disclosures_by_hand(rows)) and len(got) > 3
    # Pairs left out early are those that would not reach the bound.
    for least in (0.2, 0.5, sorted(got.values())[len(got) // 2], 0.95):
        some = {(entity[bytes(r["entity"])], r["term"]): r["disclosure"] for r in sanitise.disclosures(marked, docs, "text", least=least).collect()}
        assert some == pytest.approx({k: v for k, v in got.items() if v >= least})


def test_terms_far_from_their_entity(spark) -> None:
    rng = random.Random(26)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{noise(9)} Zanzibar clerk mail boss@acme.com {noise(20)}") for i in range(6)]
    # Learnt near the entity; replaced 200 words away from it, and without it.
    rows += [(10, f"Zanzibar {noise(200)} mail boss@acme.com {noise(20)}")] + [(20, f"{noise(30)} zanzibar {noise(30)}")] + [(50 + i, f"{noise(15)} mail {noise(15)}") for i in range(200)]
    # Copies with the same surroundings of the entity teach nothing.
    rows += [(400 + i, f"{noise(3)} Madrid {' '.join(['same words here'] * 9)} chief@corp.org {' '.join(['and the same'] * 9)}") for i in range(6)]
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(frame(spark, rows)).collect()}
    text = dict(rows)
    assert all("Zanzibar" not in clean[i] and "mail [EMAIL]" in clean[i] for i in (*range(6), 10))
    assert "zanzibar" not in clean[20] and all(clean[50 + i] == text[50 + i] for i in range(200))
    assert all("Madrid" in clean[400 + i] and "chief@" not in clean[400 + i] for i in range(6))


def test_many_spans_in_linear_time() -> None:
    import time

    for sentence in ("Write to a.person@some-place.com today. ", "a1@b1.c1 "):
        text = sentence * (2_000_000 // len(sentence))
        start = time.process_time()
        spans = sanitise.base_spans(text)
        words = sanitise.words_of(text, spans)
        assert len(sanitise.windows(text, spans, words)) == len(spans) == text.count("@")
        assert time.process_time() - start < 4
    text = "one a@b.c two three d@e.f four"
    spans = sanitise.base_spans(text)
    assert [text[a:b] for a, b in sanitise.words_of(text, spans)] == ["one", "two", "three", "four"]


def test_repeated_and_null_ids(spark) -> None:
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(7, words), (3, words), (None, words), (3, "other " + " ".join(f"v{i}" for i in range(40))), (9, "x")]
    for order in (rows, rows[::-1]):
        docs = frame(spark, order)
        got = jaccard_join.near_copies(docs).collect()
        classes = defaultdict(Counter)
        for r in got:
            classes[r["class_digest"]][r["doc_id"], r["class_id"], r["n_links"]] += 1
        found = {frozenset(c.items()) for c in classes.values()}
        assert found == {frozenset({((7, 3, 2), 1), ((3, 3, 2), 1), ((None, 3, 2), 1)}), frozenset({((3, 3, 0), 1)}), frozenset({((9, 9, 0), 1)})}
        kept = Counter(tuple(r)[:2] for r in jaccard_join.representatives(docs).select("doc_id", "text").collect())
        assert kept == Counter([(3, words), rows[3], rows[4]])
