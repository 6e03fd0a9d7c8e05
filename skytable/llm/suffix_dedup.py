"""Removal of byte strings that are repeated, by suffix arrays of collections of text pieces, built column by column.

A collection of pieces is sorted without sorting suffixes: every round puts one more symbol of each piece, from the last to the first, in front of its suffix.
The Burrows-Wheeler transform so far tells where the new suffix belongs (as many places behind the start of its symbol as that symbol stands earlier in the
transform), and the least common prefix between two equal symbols of the transform, plus one, is the common prefix of the new neighbours. Each round reads
the transform and the prefixes once in order and writes both anew. Neighbours with a common prefix of ``LENGTH`` bytes
hold the same string, of which the earliest stays.

To be spread over a cluster, texts are cut into pieces so that equal strings of ``LENGTH`` bytes always fall into one collection: all windows in a row whose
least gram hash is the same make a piece, and a collection holds all pieces of a number of hashes. A hash that only one piece of the corpus has cannot
hold a repeated string; such pieces are never sent. Hashes are counted in slices, so no table of all hashes exists anywhere. Equal pieces
are sent once from each bucket of texts and are one document of their collection. Where too many pieces
share a hash, they are cut into short runs of windows, which are dealt by a hash of the bytes that these share. The rounds' files are arrays in memory: a collection is
at most some thousand pieces of at most 168 bytes, whatever the corpus.

Defined cases: a null text counts as empty; a null id comes before all others; rows of equal ids are ordered by a hash of their texts, and rows
equal in both are the same document, which does not repeat itself; texts of any length are read whole; texts shorter than ``LENGTH`` bytes lose nothing;
an empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 100
GRAM = 32
# Grams in a window, and windows in a piece at most.
GRAMS = LENGTH - GRAM + 1
# Bytes of text in a bucket, hashes in a slice, pieces in a block and in one collection, on average; pieces of a hash that are cut into windows.
BUCKET_BYTES = 2 << 20
SLICE_HASHES = 200_000
BLOCK_PIECES = 4000
COLLECTION_PIECES = 1500
SPLIT_PIECES = 4000
# Windows that stay together when a hot hash is split, and the number of pieces from which on each goes alone.
TOGETHER, _ALONE_FROM = 8, 64 * SPLIT_PIECES
_STRIDE = 1 << 16

_END = 255
_SPAN = np.dtype([("doc", "<u4"), ("a", "<u4"), ("b", "<u4")])
_ANSWER = np.dtype([("hash", "<u8"), ("block", "<i8"), ("parts", "<u4"), ("step", "<u4")])
_rng = np.random.default_rng(20_011)
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
_ODD = _rng.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[14]
    return (h ^ (h >> np.uint64(29))) * _ODD[15]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` bytes in a row, by doubling."""
    h, n, k = _BYTES[data], 1, 0
    while n < GRAM:
        h = h[:-n] * _ODD[k] + h[n:]
        n, k = 2 * n, k + 1
    return _mixed(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


class Pieces:
    """Pieces of a bucket's texts: document, first window and one behind the last (places in the bucket), least gram hash, and a hash of the whole."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        found = [p for at in range(0, len(data), _STRIDE) if (p := self._stretch(data, offsets, at)) is not None]
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        self.doc, self.a, self.b, self.least, self.whole, self.periodic = (np.concatenate(c) for c in zip(*found, strict=True)) if found else empty

    @staticmethod
    def _stretch(data: np.ndarray, offsets: np.ndarray, at: int) -> tuple | None:
        part = data[at : at + _STRIDE + LENGTH - 1]
        if len(part) < LENGTH:
            return None
        grams = gram_hashes(part)
        least = _least(grams, GRAMS)
        cut = np.empty(len(least), bool)
        cut[0] = True
        np.not_equal(least[1:], least[:-1], out=cut[1:])
        low, high = np.searchsorted(offsets, [at, at + len(least)])
        inner = offsets[low:high] - at
        cut[inner[inner < len(least)]] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(least))
        if (long := b - a > GRAMS).any():
            # A gram that comes again and again, as in periodic text: pieces of the greatest length.
            times = np.where(long, -(-(b - a) // GRAMS), 1)
            first = np.repeat(np.cumsum(times) - times, times)
            a, b = np.repeat(a, times) + (np.arange(len(first)) - first) * GRAMS, np.repeat(b, times)
            b = np.minimum(b, a + GRAMS)
        doc = np.searchsorted(offsets, a + at, "right") - 1
        b = np.minimum(b, offsets[doc + 1] - at - LENGTH + 1)
        some = b > a
        doc, a, b = doc[some], a[some], b[some]
        end = b + LENGTH - 1
        whole = grams[a]
        for k, place in enumerate((a + GRAM, a + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM)):
            whole = _mixed(whole * _ODD[k] + grams[place])
        return doc, a + at, b + at, least[a], whole + (b - a).astype(np.uint64), Pieces._periodic(grams, a, end)

    @staticmethod
    def _periodic(grams: np.ndarray, a: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces that may hold a window twice: then 69 grams in a row come again at one distance below 69, so every 64th gram shows it."""
        found = np.zeros(len(a), bool)
        if len(grams) > GRAMS:
            rows = np.lib.stride_tricks.sliding_window_view(grams, GRAMS)[::64]
            for x in np.flatnonzero((rows[:, 1:] == rows[:, :1]).any(1)) * 64:
                found[np.searchsorted(end, x, "right") : np.searchsorted(a, x, "right")] = True
        # Distances reach over the last grams too.
        if len(a):
            found[np.searchsorted(end, len(grams) - 2 * GRAMS, "right") :] |= len(np.unique(grams[-2 * GRAMS :])) < min(len(grams), 2 * GRAMS)
        return found


def column_wise(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``LENGTH`` bytes in order: their piece, their offset, and the number of their class (equal first ``LENGTH`` bytes)."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(lengths)

    def symbols(which: np.ndarray, j: int) -> np.ndarray:
        """The symbol before a suffix of j bytes; ``_END``, which no UTF-8 text holds, before a whole piece."""
        return np.where(lengths[which] > j, data[np.maximum(ends[which] - 1 - j, 0)], _END).astype(np.uint8)

    # The transform in order of suffixes, the common prefixes with the suffix before, and the places of all symbols, by symbol and place.
    newest = np.arange(n)  # pieces of the newest suffixes
    transform = symbols(newest, 0)
    common = np.zeros(n + 1, np.uint8)
    owner = np.full(n, -1, np.int32)
    places = np.argsort(transform, kind="stable").astype(np.int32)
    newest, entering = newest[places], np.arange(n)
    begin = np.append(0, np.cumsum(np.bincount(transform, minlength=256)))
    for j in range(1, int(lengths.max()) + 1):
        count = int(begin[_END])
        alive = entering < count
        newest, entering = newest[alive], entering[alive]
        own = n + entering
        # Common prefixes change for what enters and for what comes right behind it, if that does not begin with another symbol.
        behind = entering + 1
        behind = behind[(np.append(entering[1:], count) != behind) & (behind < count)]
        touched = np.sort(np.concatenate([entering, behind]))
        heads = np.zeros(count + 1, bool)
        heads[begin[:_END]] = True
        same = touched[~heads[touched]]
        prefixes = np.zeros(n + count + 1, np.uint8)
        stays = np.ones(n + count, bool)
        stays[own] = False
        prefixes[:-1][stays] = common[:-1]
        prefixes[n + touched] = 0
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[::2], bounds[1::2] = places[same - 1], places[same]
            bounds += 1
            prefixes[n + same] = np.minimum.reduceat(common, bounds)[::2] + np.uint8(1)
        added = symbols(newest, j)
        wider = np.empty(n + count, np.uint8)
        wider[stays] = transform
        wider[own] = added
        transform, common = wider, prefixes
        if j >= LENGTH:
            owners = np.full(n + count, -1, np.int32)
            if j > LENGTH:
                owners[stays] = owner
            owners[own] = newest * 256 + lengths[newest] - j
            owner = owners
        # As many places further as there are new suffixes before.
        number = np.arange(len(own) + 1, dtype=np.int32)
        places += np.repeat(number, np.diff(own - number[:-1], prepend=0, append=len(places)))[places]
        order = np.argsort(added, kind="stable")
        fresh, newest = own[order].astype(np.int32), newest[order]
        number = np.bincount(added, minlength=256)
        entering, first = np.arange(len(fresh)), 0
        for c in np.flatnonzero(number):
            last = first + number[c]
            entering[first:last] += begin[c] + np.searchsorted(places[begin[c] : begin[c + 1]], fresh[first:last])
            first = last
        stays = np.ones(len(places) + len(fresh), bool)
        stays[entering] = False
        longer = np.empty(len(stays), np.int32)
        longer[stays], longer[entering] = places, fresh
        places = longer
        begin[1:] += np.cumsum(number)
    common = common[:-1]
    windows = owner >= 0
    classes = np.cumsum(common < LENGTH)[windows]
    return owner[windows] >> 8, owner[windows] & 255, classes


def _repeats_itself(piece: bytes) -> bool:
    """Whether a window may come twice in the piece: then its middle, which both cover, comes again further on."""
    n = len(piece)
    return n > LENGTH and piece.find(piece[n - LENGTH - 1 : LENGTH], n - LENGTH) >= 0


def _joined(spans: np.ndarray) -> np.ndarray:
    """Ranges of one kind merged where they touch, by document."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans["a"], spans["doc"]))]
    # Documents lie apart, so that one running maximum serves all.
    base = spans["doc"].astype(np.int64) << 32
    start, reach = base + spans["a"], np.maximum.accumulate(base + spans["b"])
    first = np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)
    merged = spans[first]
    merged["b"] = (reach[last] - base[last]).astype(np.uint32)
    return merged


def _bucket(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's documents in their order (rows equal in id and text once), their bytes, where each text begins, and the rows of each document."""
    rows = pa.table({"null": table["doc_id"].is_valid()} | {c: table[c] for c in ("doc_id", "tie", "text")})
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("null", "ascending"), ("doc_id", "ascending"), ("tie", "ascending")])).combine_chunks()
    null, ids, tie = np.asarray(rows["null"]), np.asarray(rows["doc_id"].fill_null(0)), np.asarray(rows["tie"])
    fresh = np.append(True, (null[1:] != null[:-1]) | (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]))[: len(ids)]
    copies = np.bincount(np.cumsum(fresh) - 1) if len(ids) else np.zeros(0, np.int64)
    rows = rows.filter(pa.array(fresh)).combine_chunks()
    text = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    text = text.cast(pa.large_binary())
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return rows, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets, copies


def _counted(slices: int):
    """Every hash of a bucket, with the number of different pieces that have it; the top bit: a piece comes twice, or may hold a window twice."""

    def run(table: pa.Table) -> pa.Table:
        _, data, offsets, _ = _bucket(table)
        p = Pieces(data, offsets)
        order = np.lexsort((p.whole, p.least))
        least, whole = p.least[order], p.whole[order]
        fresh = np.append(True, least[1:] != least[:-1])[: len(least)]
        other = fresh | np.append(True, whole[1:] != whole[:-1])[: len(least)]
        first = np.flatnonzero(fresh)
        hashes = least[first]
        number = np.add.reduceat(other.astype(np.uint32), first) if len(first) else np.zeros(0, np.uint32)
        many = np.logical_or.reduceat(~other | p.periodic[order], first) if len(first) else np.zeros(0, bool)
        weight = number.astype(np.uint32) | (many.astype(np.uint32) << np.uint32(31))
        to = (hashes % np.uint64(slices)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])[: len(to)])
        groups = [order[a:b] for a, b in zip(at, np.append(at[1:], len(to)), strict=True)] if len(at) else []
        return pa.table(
            {
                "slice": pa.array([int(to[g[0]]) for g in groups], pa.int64()),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(groups), pa.int64()),
                "hashes": pa.array([hashes[g].tobytes() for g in groups], pa.binary()),
                "weights": pa.array([weight[g].tobytes() for g in groups], pa.binary()),
            }
        )

    return run


def _answered(block_pieces: int, split_pieces: int):
    """The hashes of a slice that more than one piece has, told to the buckets that have them, with the block that compares their pieces."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table["hashes"].to_pylist()
        hashes = np.frombuffer(b"".join(blobs), np.uint64)
        weights = np.frombuffer(b"".join(table["weights"].to_pylist()), np.uint32)
        bucket = np.repeat(np.array(table["bucket"].to_pylist(), np.int64), [len(b) // 8 for b in blobs])
        order = np.argsort(hashes, kind="stable")
        first = np.append(True, hashes[order][1:] != hashes[order][:-1])
        group = np.cumsum(first) - 1
        number = np.bincount(group, weights[order] & np.uint32(0x7FFFFFFF)).astype(np.int64)
        known = (number > 1) | (np.bincount(group, weights[order] >> np.uint32(31)) > 0)
        hot = known & (number > split_pieces)
        step = np.where(number < _ALONE_FROM, TOGETHER, 1)
        parts = np.where(hot, 1 + number * (1 + GRAMS // 2 // step) // block_pieces, 0)
        block = np.cumsum(np.where(known & ~hot, number, 0)) // block_pieces
        own = np.where(hot, parts, 0)
        block = np.where(hot, block.max() + 1 + np.cumsum(own) - own, block) + (table["slice"][0].as_py() << 32)
        sent = known[group]
        answer = np.zeros(int(sent.sum()), _ANSWER)
        answer["hash"], answer["block"], answer["parts"], answer["step"] = hashes[order][sent], block[group][sent], parts[group][sent], step[group][sent]
        to = bucket[order][sent]
        by = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])[: len(to)])
        groups = [by[a:b] for a, b in zip(at, np.append(at[1:], len(to)), strict=True)] if len(at) else []
        return pa.table({"bucket": pa.array([int(to[g[0]]) for g in groups], pa.int64()), "answer": pa.array([answer[g].tobytes() for g in groups], pa.binary())})

    return run


def _least_grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least gram hash of each piece, where it first stands, and how often it does."""
    lengths = np.array([len(p) for p in pieces])
    starts = np.cumsum(lengths) - lengths
    grams = gram_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    number = lengths - GRAM + 1
    first = np.cumsum(number) - number
    grams = grams[np.repeat(starts - first, number) + np.arange(int(number.sum()))]
    least = np.minimum.reduceat(grams, first)
    same = grams == np.repeat(least, number)
    times = np.add.reduceat(same.astype(np.int64), first)
    at = np.flatnonzero(same)
    return least, at[np.cumsum(times) - times] - first, times


def _split(text: bytes, a: list[int], b: list[int], block: list[int], parts: list[int], step: list[int]) -> list[tuple[int, int, int, int]]:
    """Hot pieces cut into runs of windows (number of the piece, first window, one behind the last, block).

    A window is told by where its least gram first stands in it. Windows in which that place lies within the same ``step`` places
    share all but ``step - 1`` of their bytes, by whose hash they are dealt, so that equal windows meet.
    """
    pieces = [text[x : y + LENGTH - 1] for x, y in zip(a, b, strict=True)]
    found = []
    for k, (piece, at) in enumerate(zip(pieces, _least_grams(pieces)[1].tolist(), strict=True)):
        gram, low, count = piece[at : at + GRAM], 0, b[k] - a[k]
        while at >= 0 and low < count:
            # Windows low .. last have the gram at this place first.
            last = min(at, count - 1)
            while low <= last:
                top = at - (at - low) // step[k] * step[k]
                high = min(last, top)
                core = piece[top : top - step[k] + 1 + LENGTH]
                found.append((k, a[k] + low, a[k] + high + 1, block[k] + xxhash.xxh3_64_intdigest(core) % parts[k]))
                low = high + 1
            at = piece.find(gram, at + 1)
    return found


def _sent(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The pieces of a bucket that may hold a repeated string, equal ones once, with the ranges of the others."""
    rows, data, offsets, _ = _bucket(docs)
    p = Pieces(data, offsets)
    known = np.frombuffer(b"".join(answers["answer"].to_pylist()), _ANSWER)
    known = known[np.argsort(known["hash"])]
    at = np.minimum(np.searchsorted(known["hash"], p.least), max(len(known) - 1, 0))
    hit = np.flatnonzero(known["hash"][at] == p.least) if len(known) else np.zeros(0, np.int64)
    doc, a, b, block, parts, step = p.doc[hit], p.a[hit], p.b[hit], known["block"][at[hit]], known["parts"][at[hit]], known["step"][at[hit]]
    text, seen = data.tobytes(), {}
    hot = np.flatnonzero(parts)
    if len(hot):
        cut = _split(text, a[hot].tolist(), b[hot].tolist(), block[hot].tolist(), parts[hot].tolist(), step[hot].tolist())
        rest = np.flatnonzero(parts == 0)
        doc = np.concatenate([doc[rest], doc[hot][[c[0] for c in cut]]])
        a, b, block = (np.concatenate([column[rest], [c[i] for c in cut]]) for i, column in ((1, a), (2, b), (3, block)))
        by = np.lexsort((a, doc))
        doc, a, b, block = doc[by], a[by], b[by], block[by]
    starts = offsets[doc]
    copied, of = [], []
    for k, (x, y, u) in enumerate(zip(a.tolist(), (b + LENGTH - 1).tolist(), block.tolist(), strict=True)):
        kept = seen.setdefault((u, text[x:y]), k)
        if kept != k:
            copied.append(k)
            of.append(kept)
    sent = list(seen.values())
    contents = [c for _, c in seen]
    by = np.argsort(of, kind="stable")
    copied, of = np.array(copied, np.int64)[by], np.array(of, np.int64)[by]
    spans = np.zeros(len(copied), _SPAN)
    spans["doc"], spans["a"], spans["b"] = doc[copied], a[copied] - starts[copied], b[copied] - starts[copied]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    others = {int(of[x]): (_joined(spans[x:y]) if y - x > 8 else spans[x:y]).tobytes() for x, y in zip(at.tolist(), np.append(at[1:], len(of)).tolist(), strict=True)} if len(at) else {}
    keys = rows.select(["doc_id", "tie"]).take(pa.array(doc[sent], pa.int64()))
    return pa.table(
        {
            "block": pa.array(block[sent], pa.int64()),
            "bucket": pa.array([docs["bucket"][0].as_py()] * len(sent), pa.int64()),
            "doc": pa.array(doc[sent], pa.int64()),
            "doc_id": keys["doc_id"],
            "tie": keys["tie"],
            "start": pa.array((a - starts)[sent], pa.int64()),
            "content": pa.array(contents, pa.binary()),
            "others": pa.array([others.get(k, b"") for k in sent], pa.binary()),
        }
    )


def _collections(pieces: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Collections of whole groups (pieces with one least gram hash): places in the list, first bytes, and what is compared of each piece.

    A window of the group holds the gram, and beside it half of its other bytes on one side at least. So a piece shares no window if no other has the same
    half beside the gram, on neither side; such pieces are left out, and where only one side is shared, the windows that need the other one are.
    """
    half = (LENGTH - GRAM) // 2
    least, at, times = (x.tolist() for x in _least_grams(pieces))
    sides: dict[tuple, int] = {}
    keys: list[tuple] = []
    for k, piece in enumerate(pieces):
        p = at[k]
        left = (least[k], 0, piece[p - half : p]) if p >= half else None
        right = (least[k], 1, piece[p + GRAM : p + GRAM + half]) if p + GRAM + half <= len(piece) else None
        keys.append((left, right))
        for key in (left, right):
            if key:
                sides[key] = sides.get(key, 0) + 1
    # Pieces that hold their gram more than once are compared whole, and so are all that share it.
    whole = {least[k] for k, n in enumerate(times) if n > 1}
    number: dict[int, int] = {}
    for v in least:
        number[v] = number.get(v, 0) + 1
    order = sorted(range(len(pieces)), key=least.__getitem__)
    current: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    before = None
    for k in order:
        piece, p = pieces[k], at[k]
        if number[least[k]] == 1:
            low, high = 0, len(piece) if _repeats_itself(piece) else 0
        elif least[k] in whole:
            low, high = 0, len(piece)
        else:
            left, right = (key is not None and sides[key] > 1 for key in keys[k])
            low, high = 0 if left else max(0, p - half), len(piece) if right else p + GRAM + half
            if not (left or right):
                high = low
        if high - low < LENGTH:
            continue
        if least[k] != before and len(current[0]) >= COLLECTION_PIECES:
            yield current
            current = ([], [], [])
        before = least[k]
        for column, value in zip(current, (k, low, piece[low:high]), strict=True):
            column.append(value)
    if current[0]:
        yield current


def _compared(table: pa.Table) -> pa.Table:
    """For the pieces of a block, the ranges of windows that come earlier somewhere, told to the buckets that hold them."""
    null = np.asarray(table["doc_id"].is_null())
    ids = np.asarray(table["doc_id"].fill_null(0))
    tie, start, bucket, doc = (np.asarray(table[c]) for c in ("tie", "start", "bucket", "doc"))
    order = np.lexsort((tie, ids, ~null))
    new = (ids[order][1:] != ids[order][:-1]) | (tie[order][1:] != tie[order][:-1]) | (null[order][1:] != null[order][:-1])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.append(0, np.cumsum(new))
    key = (rank << 32) + start
    contents, others = table["content"].to_pylist(), table["others"].to_pylist()
    holders: dict[bytes, list[int]] = {}
    for k in np.argsort(key, kind="stable").tolist():
        holders.setdefault(contents[k], []).append(k)
    pieces, held = list(holders), list(holders.values())
    first = np.array([rows[0] for rows in held])
    later = np.array([k for rows in held for k in rows[1:]], np.int64)
    ends = np.array([len(c) for c in contents]) - LENGTH + 1
    found = [(later, np.zeros(len(later), np.int64), ends[later])]
    for members, low, compared in _collections(pieces):
        piece, offset, classes = column_wise(compared)
        offset = offset + np.array(low)[piece]
        own = first[members][piece]
        by = np.lexsort((key[own] + offset, classes))
        after = np.append(False, classes[by][1:] == classes[by][:-1])
        own, offset = own[by][after], offset[by][after]
        by = np.lexsort((offset, own))
        own, offset = own[by], offset[by]
        cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(own)])
        found.append((own[cut], offset[cut], offset[np.append(cut[1:], len(own))[: len(cut)] - 1] + 1))
    row, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
    spans = np.zeros(len(row), _SPAN)
    spans["doc"], spans["a"], spans["b"] = doc[row], start[row] + low, start[row] + high
    # The ranges of equal pieces in the same buckets.
    sizes = np.array([len(o) // _SPAN.itemsize for o in others])
    spans = np.concatenate([spans, np.frombuffer(b"".join(others), _SPAN)])
    to = np.concatenate([bucket[row], np.repeat(bucket, sizes)])
    by = np.argsort(to, kind="stable")
    at = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])[: len(to)])
    groups = [by[x:y] for x, y in zip(at, np.append(at[1:], len(to)), strict=True)] if len(at) else []
    return pa.table({"bucket": pa.array([int(to[g[0]]) for g in groups], pa.int64()), "spans": pa.array([_joined(spans[g]).tobytes() for g in groups], pa.binary())})


def _cleaned(docs: pa.Table, told: pa.Table) -> pa.Table:
    """The texts of a bucket without the bytes of repeated windows, and the removed runs."""
    rows, data, offsets, copies = _bucket(docs)
    spans = np.frombuffer(b"".join(told["spans"].to_pylist()), _SPAN).copy()
    spans["b"] += LENGTH - 1
    spans = _joined(spans)
    bounds = np.searchsorted(spans["doc"], np.arange(len(offsets)))
    kept, runs = [], []
    for k in range(len(offsets) - 1):
        own = spans[bounds[k] : bounds[k + 1]]
        text = data[offsets[k] : offsets[k + 1]]
        runs.append([{"start": x, "end": y} for x, y in zip(own["a"].tolist(), own["b"].tolist(), strict=True)])
        if len(own):
            edges = np.append(0, np.stack([own["a"], own["b"]], 1).ravel().astype(np.int64))
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], np.append(edges[1::2], len(text)), strict=True)))
        else:
            kept.append(text.tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "spans": pa.array(runs, kind), "kept": pa.array(kept, pa.binary())})
    return out if (copies == 1).all() else out.take(pa.array(np.repeat(np.arange(len(copies)), copies)))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, block_pieces: int = BLOCK_PIECES, split_pieces: int = SPLIT_PIECES
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed runs, bytes from ``start`` up to ``end``) and ``kept`` (the other bytes) of every document.

    Starts one job while the plan is built, which sums the bytes of all texts.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).cast("bigint")).first()[0] or 0
    buckets = max(16, size // bucket_bytes)
    slices = max(16, size // ((GRAMS // 2) * SLICE_HASHES))
    given = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    given = given.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    counted = given.groupBy("bucket").applyInArrow(_counted(slices), "slice bigint, bucket bigint, hashes binary, weights binary")
    answers = counted.groupBy("slice").applyInArrow(_answered(block_pieces, split_pieces), "bucket bigint, answer binary")
    sent = given.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        _sent, "block bigint, bucket bigint, doc bigint, doc_id bigint, tie bigint, start bigint, content binary, others binary"
    )
    told = sent.groupBy("block").applyInArrow(_compared, "bucket bigint, spans binary")
    return given.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_cleaned, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
