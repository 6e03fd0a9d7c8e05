"""Token counts by a tokenizer compiled to a deterministic transducer.

The byte-pair vocabulary with its merges becomes a machine over bytes. A sequence of tokens is what the merges produce
exactly when each adjacent pair is, so a machine that has read the last token ``t`` may read a token ``u`` next if no merge crosses the
border of ``t`` and ``u``. Its choices (where the current token began, and which token ended there) are determinised:
a state is the set of choices still open, each with the tokens it has over the least of them, and each transition is annotated with the number of
tokens that all choices have emitted by then. States and transitions are compiled when first met and shared by all words; at the end of a
pre-token exactly one choice is at a token's border, and what it has over the least is emitted too.

The pattern that cuts pre-tokens always begins a new one at white space after other text. There the machine is in its start state whatever
came before, so the state map of a chunk is constant from its first such place on: it is kept as the text before that place, the tokens
emitted up to the last such place, and the text since, from which the state is reached (:class:`StateMap`). Maps of adjacent chunks compose
associatively, so a long text is cut into chunks that different tasks read, and an ordered tree of compositions (a parallel
prefix scan of which only the total is wanted) gives its count.

Defined cases: a null text counts as empty, with no bytes and no tokens; texts longer than a chunk are cut, others are read whole;
repeated rows are counted each; an empty table gives an empty table; only the id and text columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches, texts_of
from skytable.llm.pretokens import splitter

# States and words that one task remembers; beyond them the memory is emptied and compiled anew, which changes no result.
MOST_STATES = 200_000
MOST_WORDS = 400_000
# Characters of a chunk; longer texts are cut.
CHUNK = 1 << 16
_START_NODE = 0
_NODES = (1 << 24) - 1
_NONE = -1
_NEVER = 1 << 60


def _byte_of_character() -> dict[str, int]:
    """Inverse of the byte alphabet of ``.json`` vocabularies: printable bytes stand for themselves, the others for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary(NamedTuple):
    """Tokens as bytes, merges (left, right, result) in order of rank, and the added tokens that are matched inside texts."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    added: list[str]
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a byte-level BPE ``.json`` file."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    ids, byte_of = said["model"]["vocab"], _byte_of_character()
    tokens = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        tokens[i] = bytes(byte_of[c] for c in text)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    return Vocabulary(tokens, merges, [a["content"] for a in said["added_tokens"]], pattern)


class Transducer:
    """The machine of one vocabulary, compiled as it is used."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocabulary.merges)}
        self.parts = {c: (a, b, r) for r, (a, b, c) in enumerate(vocabulary.merges)}
        # Trie of the tokens: child of (node, byte), token that ends at a node, whether a node has children.
        self.child: dict[int, int] = {}
        self.token_at = [_NONE]
        self.inner = [False]
        for i, token in enumerate(vocabulary.tokens):
            node = _START_NODE
            for b in token:
                below = self.child.get(node << 8 | b)
                if below is None:
                    below = len(self.token_at)
                    self.child[node << 8 | b] = below
                    self.inner[node] = True
                    self.token_at.append(_NONE)
                    self.inner.append(False)
                node = below
            if token:
                self.token_at[node] = i
        self.allowed: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all compiled states but the start state."""
        # A state is its open choices in order, each packed into one number: last token plus one, trie node, tokens over the least.
        self.open: list[tuple[int, ...]] = [(0,)]
        self.number = {self.open[0]: 0}
        self.over = [0]
        # By state and byte: next state and tokens emitted, packed alike.
        self.to: dict[int, int] = {}
        self.allowed.clear()

    def _border(self, token: int, last: bool) -> list[tuple[int, int]]:
        """The tokens at one border of a token while merges build it, each with the rank of the merge that ends it."""
        found, until = [], _NEVER
        while True:
            found.append((token, until))
            parts = self.parts.get(token)
            if parts is None:
                return found[::-1]
            token, until = parts[1 if last else 0], parts[2]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens, in the order in which merges happen: least rank first, then leftmost."""
        known = self.allowed.get((left, right))
        if known is None:
            a, b = self._border(left, True), self._border(right, False)
            i = j = 0
            while True:
                (x, until_x), (y, until_y) = a[i], b[j]
                crossing = self.rank.get((x, y), _NEVER)
                if crossing < until_x and crossing <= until_y and crossing != _NEVER:
                    known = False
                    break
                if until_x == _NEVER and until_y == _NEVER:
                    known = True
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.allowed[left, right] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte."""
        found = []
        child, token_at, inner, allowed = self.child, self.token_at, self.inner, self.allowed
        least, ended = 255, 0
        for choice in self.open[state]:
            over, node, last = choice & 255, choice >> 8 & _NODES, (choice >> 32) - 1
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            if inner[below]:
                found.append(last + 1 << 32 | below << 8 | over)
                if over < least:
                    least = over
            token = token_at[below]
            if token != _NONE and (last == _NONE or (allowed.get((last, token)) if (last, token) in allowed else self.may_follow(last, token))):
                ended = over + 1
                found.append(token + 1 << 32 | ended)
                if ended < least:
                    least = ended
        if least:
            found = [choice - least for choice in found]
        found.sort()
        key = tuple(found)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.open)
            self.open.append(key)
            self.over.append(ended - least)
        step = self.to[state << 8 | byte] = number << 8 | least
        return step

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.open) > MOST_STATES:
            self.forget()
        state, emitted, to = 0, 0, self.to
        for b in word:
            step = to.get(state << 8 | b)
            if step is None:
                step = self._compile(state, b)
            state = step >> 8
            emitted += step & 255
        return emitted + self.over[state]


class StateMap(NamedTuple):
    """What a chunk does from any state: ``head`` before its first certain border, tokens between, ``tail`` from its last one on.

    Without a certain border ``closed`` is false and the whole chunk is ``head``.
    """

    closed: bool
    head: str
    count: int
    tail: str


# Text before white space; narrower than the pattern's classes on both sides, so that every place found is a border.
_BORDER = re.compile(r"(?<=\S)(?=[ \t\n\r])")


class Counter(dict):
    """Tokens of texts; as a mapping, tokens of the pre-tokens met so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.machine = Transducer(vocabulary)
        self.split = splitter(vocabulary.pattern)
        self.added = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        n = self[word] = self.machine.count(word.encode())
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        return sum(map(self.__getitem__, self.split(text)))

    def text(self, text: str) -> int:
        """Tokens of a text; an added token's string inside it is one token, and the text around it is cut there."""
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def state_map(self, chunk: str) -> StateMap:
        """Map of a chunk that holds no added token."""
        borders = [m.start() for m in _BORDER.finditer(chunk)]
        if not borders:
            return StateMap(False, chunk, 0, "")
        first, last = borders[0], borders[-1]
        return StateMap(True, chunk[:first], self.plain(chunk[first:last]), chunk[last:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """Map of two adjacent chunks. Between them a border may lie where one ends in text and the other begins with white space."""
        if a.closed and b.closed:
            return StateMap(True, a.head, a.count + self.plain(a.tail + b.head) + b.count, b.tail)
        inner = self.state_map((a.tail if a.closed else a.head) + b.head)
        if not a.closed and not b.closed:
            return inner
        if a.closed:
            # The text since the last border of the first chunk begins at a border.
            return StateMap(True, a.head, a.count + self.plain(inner.head) + inner.count, inner.tail) if inner.closed else StateMap(True, a.head, a.count, inner.head)
        # The text up to the first border of the second chunk ends at a border.
        return StateMap(True, inner.head, inner.count + self.plain(inner.tail) + b.count, b.tail) if inner.closed else StateMap(True, inner.head, b.count, b.tail)

    def total(self, whole: StateMap) -> int:
        """Tokens of a text whose map is known; the text begins in the start state."""
        return self.plain(whole.head) + whole.count + self.plain(whole.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Composition of adjacent maps, in a balanced tree."""
        while len(maps) > 1:
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0] if maps else StateMap(False, "", 0, "")


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    Texts of up to ``chunk`` characters are counted where they are read. Longer ones are cut into chunks (at added tokens
    too), the chunks are dealt to all tasks, and one row per chunk comes back to be composed in order: only long texts
    are shuffled, and what meets in one task is a few dozen characters for each chunk of one text. The vocabulary is broadcast; its
    size is that of its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.char_length("text"), F.lit(0))

    def whole():
        counter = Counter(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array(map(counter.text, texts_of(batch)), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), found], ["doc_id", "n_bytes", "n_tokens"])

        return step

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    short = map_batches(rows.where(size <= chunk).select("doc_id", n_bytes, "text"), f"doc_id {kind}, n_bytes bigint, n_tokens bigint", whole)

    def cut():
        added = Counter(shared.value).added

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, part, place, piece = [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                for p, between in enumerate(added.split(text) if added else [text]):
                    for k, at in enumerate(range(0, max(len(between), 1), chunk)):
                        row.append(i)
                        part.append(p)
                        place.append(k)
                        piece.append(between[at : at + chunk])
            columns = [batch.column(c).take(pa.array(row, pa.int32())) for c in ("row", "doc_id", "n_bytes")]
            columns += [pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(piece, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "part", "place", "piece"])

        return step

    def mapped():
        counter = Counter(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            maps = [counter.state_map(t) for t in batch.column("piece").to_pylist()]
            columns = [batch.column(c) for c in ("row", "doc_id", "n_bytes", "part", "place")]
            kinds = (pa.bool_(), pa.string(), pa.int64(), pa.string())
            columns += [pa.array([m[i] for m in maps], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "part", "place", "closed", "head", "count", "tail"])

        return step

    def composed():
        counter = Counter(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for maps in batch.column("maps").to_pylist():
                parts: dict[int, list[StateMap]] = {}
                for m in maps:
                    parts.setdefault(m["part"], []).append(StateMap(m["closed"], m["head"], m["count"], m["tail"]))
                found.append(len(parts) - 1 + sum(counter.total(counter.scan(p)) for p in parts.values()))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

        return step

    # The row number keeps repeated and null ids apart; it is fixed by the input's partitions and order.
    long = rows.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", n_bytes, "text")
    keys = f"row bigint, doc_id {kind}, n_bytes bigint, part int, place int"
    chunks = map_batches(long, f"{keys}, piece string", cut).repartition("row", "part", "place")
    maps = map_batches(chunks, f"{keys}, closed boolean, head string, count bigint, tail string", mapped)
    ordered = F.sort_array(F.collect_list(F.struct("part", "place", "closed", "head", "count", "tail"))).alias("maps")
    grouped = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), ordered)
    counted = map_batches(grouped.select("doc_id", "n_bytes", "maps"), f"doc_id {kind}, n_bytes bigint, n_tokens bigint", composed)
    return short.unionByName(counted)
