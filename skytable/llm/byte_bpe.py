"""Byte-level BPE encoding and decoding with a sentencepiece model written directly from a rank vocabulary.

Each byte is one character of the model (its value plus an offset), each vocabulary entry one piece with the negative
rank as score, and the normalizer leaves text as it is. Sentencepiece then merges the adjacent pair of best score, which is the pair of lowest rank, leftmost
first: byte-level BPE. Every pre-token is encoded by itself; ids map back to bytes through the inverse of the vocabulary.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole; repeated rows are
encoded each; an empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from skytable.llm.common import map_batches, texts_of
from skytable.llm.pretokens import splitter

_OFFSET = 0x100
# Pre-tokens whose ids one task remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 bytes and a rank on each line), in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    entries: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        entries[int(rank)] = base64.b64decode(token)
    return entries


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def as_characters(data: bytes) -> str:
    """Bytes as characters of the model."""
    return "".join(map(_CHARACTER.__getitem__, data))


_CHARACTER = [chr(_OFFSET + b) for b in range(256)]


def serialise_model(entries: list[bytes]) -> bytes:
    """Sentencepiece BPE model whose ids are the ranks; the unknown piece comes after them.

    The field numbers are those of the public sentencepiece model format (fixed values): model = pieces 1, trainer 2,
    normalizer 3; piece = text 1, score 2, kind 3; trainer = model type 3, size 4, unknown 40, begin 41, end 42, pad 43; normalizer = name 1,
    dummy prefix 3, remove white space 4, escape white space 5.
    """
    parts = []
    for rank, entry in enumerate([*entries, None]):
        text, kind = ("<unk>", 2) if entry is None else (as_characters(entry), 1)
        body = _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, kind)
        parts.append(_block(1, body))
    trainer = _number(3, 2) + _number(4, len(entries) + 1) + _number(40, len(entries))
    trainer += _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(parts) + _block(2, trainer) + _block(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one task."""

    def __init__(self, entries: list[bytes], pattern: str) -> None:
        import sentencepiece

        self.split = splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(entries))
        self.bytes_of = entries
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        known = self.known
        for text in texts:
            tokens = self.split(text)
            new = list(set(tokens).difference(known))
            if new:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = list(set(tokens))
                pieces = self.model.encode([as_characters(t.encode()) for t in new], num_threads=1)
                known.update(zip(new, map(tuple, pieces), strict=True))
            yield list(chain.from_iterable(map(known.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, entries: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (the bytes that the ids give back) of every whole text.

    The vocabulary (:func:`read_ranks`) goes to the tasks as a broadcast: its size is that of the rank file, whatever
    the input. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def process():
        bpe = ByteBpe(shared.value, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = list(bpe.encode(texts_of(batch)))
            columns = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

        return step

    return map_batches(rows, f"doc_id {kind}, ids array<int>, decoded binary", process)


def decode(encoded: DataFrame, entries: list[bytes], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` bytes of an array of ids; a null array gives null."""
    shared = encoded.sparkSession.sparkContext.broadcast(entries)
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def process():
        table = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "decoded"])

        return step

    return map_batches(rows, f"doc_id {kind}, decoded binary", process)


def digests(docs: DataFrame, entries: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens`` and the SHA-256 of the ids (decimal, joined by one space) and of the decoded bytes of every text.

    Encodes and decodes as :func:`encode` does and digests in the same pass, so that ids and bytes of a 100 TB corpus
    do not travel back to the JVM only to be hashed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def process():
        bpe = ByteBpe(shared.value, pattern)
        decimal = [str(i) for i in range(len(shared.value))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_bytes = [], [], []
            for ids in bpe.encode(texts_of(batch)):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(rows, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", process)
