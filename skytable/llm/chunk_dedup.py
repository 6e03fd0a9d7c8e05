"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text: each step doubles it and adds a number drawn for the byte; only the last 16 bytes count. A chunk ends where
the hash is least among the ``REACH`` places on either side. That depends on the bytes near the place only, so it ends wherever the same bytes
stand, whatever was inserted before them; and two ends are more than ``REACH`` bytes apart, so that no chunk is so short that it repeats by chance.
Chunks are compared by digest over all documents. A maximal run of chunks that each occur in two or more documents is a repeated passage if it
has enough words; single chunks that agree by chance do not make one. What a passage loses at its two ends is less than a chunk each.

Digests have 64 bits. That two different chunks share one is rare, and a passage needs several in a row.

Two passes over the texts. The first counts, for each digest, the documents that hold it; a bitmap of fixed size made from the repeated digests then
keeps the second from sending chunks that are not repeated, and a join makes it exact. A chunk that very many documents share is one row after
map-side combine, and Spark may split its join.

Defined cases: a null or empty text has no chunks; texts are chunked whole, and without a natural end within ``MOST`` bytes a chunk ends there; repeated rows are
different documents, unless they share their id: a passage counts as kept in every row of the least id that holds it, and in rows without an id; a run
that is partly first held here and partly elsewhere is one row for each such part, so that no chunk is cut from its first holder; an empty table gives an empty table; only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import fresh_name, map_batches, texts_of
from skytable.session import cut_lineage

# Places on either side that an end of a chunk is compared with (a power of two; chunks have about twice as many bytes), and bytes of a chunk at most.
REACH, MOST = 16, 256
# Words that a run of repeated chunks must have.
LEAST_WORDS = 25
_FILTER_BITS = 1 << 24
_GEAR = np.random.default_rng(1618).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the last 16 bytes after each byte; by doubling the window, which gives what one step per byte gives."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        if len(h) > shift:
            h = h + np.concatenate([np.zeros(shift, np.uint32), h[:-shift] << np.uint32(shift)])
    return h


def ends_of(data: np.ndarray, reach: int = REACH, most: int = MOST) -> np.ndarray:
    """Where the chunks of a text end, the end of the text included."""
    if not len(data):
        return np.empty(0, np.int64)
    # Least hash of ``reach`` places from each one on, by doubling; what lies outside the text is greater than any hash.
    outside = np.full(reach, np.iinfo(np.uint64).max, np.uint64)
    h = np.concatenate([outside, gear(data).astype(np.uint64), outside])
    least, size = h, 1
    while size < reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    own = h[reach:-reach]
    ends = np.flatnonzero((own < least[: len(own)]) & (own <= least[reach + 1 : reach + 1 + len(own)])) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > most:
        # A long chunk is cut at every MOST bytes from its start.
        starts = ends - sizes
        ends = np.concatenate([np.append(np.arange(s + most, e, most), e) for s, e in zip(starts, ends, strict=True)])
    return ends


def digests_of(data: bytes, ends: np.ndarray) -> np.ndarray:
    digest, at, out = xxhash.xxh3_64_intdigest, 0, []
    for end in ends.tolist():
        out.append(digest(data[at:end]))
        at = end
    return np.array(out, np.uint64).view(np.int64)


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``digest`` of every chunk that two or more documents hold."""

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in texts_of(batch, "__text"):
                data = text.encode()
                found.append(np.unique(digests_of(data, ends_of(np.frombuffer(data, np.uint8)))))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["digest"])

        return step

    chunks = map_batches(docs.select(docs[text_col].alias("__text")), "digest bigint", process)
    return chunks.groupBy("digest").count().where("count > 1").select("digest")


def _bitmap(digests: DataFrame) -> bytes:
    def run(batches):
        found = np.zeros(_FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column("digest").to_numpy() & (_FILTER_BITS - 1)
            np.bitwise_or.at(found, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["bits"])

    # At most 16 bitmaps of two megabytes.
    whole = np.zeros(_FILTER_BITS // 8, np.uint8)
    for row in digests.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row[0], np.uint8)
    return whole.tobytes()



def _instances(docs: DataFrame, bits: bytes, id_col: str, text_col: str) -> DataFrame:
    """Chunks that may be repeated: row number, ``doc_id``, text hash, digest, place among the text's chunks, code points, words before its end and start."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    taken = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = taken.schema["doc_id"].dataType.simpleString()
    names = ["digest", "place", "start", "end", "words_before", "words_upto"]

    def process():
        known = np.frombuffer(shared.value, np.uint8)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, columns = [], [[] for _ in names]
            for i, text in enumerate(texts_of(batch)):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                ends = ends_of(data)
                if not len(ends):
                    continue
                digests = digests_of(raw, ends)
                at = digests & (_FILTER_BITS - 1)
                hit = np.flatnonzero(known[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                starts = np.concatenate([[0], ends[:-1]])
                rows.append(np.full(len(hit), i, np.int32))
                for out, values in zip(columns, (digests, np.arange(len(ends)), points[starts], points[ends], begins[starts], begins[ends]), strict=True):
                    out.append(values[hit])
            taken_rows = pa.array(np.concatenate(rows) if rows else [], pa.int32())
            kinds = [pa.int64()] + [pa.int32()] * 5
            made = [pa.array(np.concatenate(c) if c else [], k, safe=False) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("row").take(taken_rows), batch.column("doc_id").take(taken_rows), *made], ["row", "doc_id", *names])

        return step

    return map_batches(taken, f"row bigint, doc_id {kind}, digest bigint, place int, start int, end int, words_before int, words_upto int", process)


def _parts(run: list[dict], own: object, least_words: int) -> list[tuple[list[dict], bool]]:
    """A run of repeated chunks in pieces that are kept or not. Chunks first held by this document are always kept. Of the others those
    are not that follow each other over enough words to be a passage, or that are the whole run."""
    pieces: list[tuple[list[dict], bool]] = []
    for c in run:
        mine = own is None or c["first_doc_id"] == own
        if pieces and pieces[-1][1] == mine:
            pieces[-1][0].append(c)
        else:
            pieces.append(([c], mine))
    out: list[tuple[list[dict], bool]] = []
    for chunks, mine in pieces:
        kept = mine or (len(pieces) > 1 and chunks[-1]["words_upto"] - chunks[0]["words_before"] < least_words)
        if out and out[-1][1] == kept:
            out[-1][0].extend(chunks)
        else:
            out.append((chunks, kept))
    return out


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated passage of each document: ``doc_id``, ``start`` and ``end`` (code points, end exclusive), ``n_words``,
    ``first_doc_id`` (least id that holds a chunk of it), ``n_places`` (chunks in the corpus that equal its most frequent one) and ``kept`` (whether it stays in this document: false if all of it is first held elsewhere).

    Where the first holder of a run's chunks changes between this document and others, another row begins; a kept part with too few words for a passage has no row.
    Documents without repeated passages have no row. Starts jobs while the plan is built.
    """
    repeated = cut_lineage(_counted(docs, text_col))
    found = cut_lineage(_instances(docs, _bitmap(repeated), id_col, text_col).join(repeated, "digest", "left_semi"))
    holders = found.select("digest", "doc_id", "row").groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_places"))
    # Runs: neighbours in place share the difference of place and rank.
    chunk = F.struct("place", "start", "end", "words_before", "words_upto", "first_doc_id", "n_places")
    by_row = found.join(holders, "digest").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(chunk)).alias("chunks"))
    kind = docs.select(docs[id_col].alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, out = [], []
            for i, chunks in enumerate(batch.column("chunks").to_pylist()):
                own = batch.column("doc_id")[i].as_py()
                lo = 0
                while lo < len(chunks):
                    hi = lo + 1
                    while hi < len(chunks) and chunks[hi]["place"] == chunks[hi - 1]["place"] + 1:
                        hi += 1
                    run, lo = chunks[lo:hi], hi
                    if run[-1]["words_upto"] - run[0]["words_before"] < least_words:
                        continue
                    for part, kept in _parts(run, own, least_words):
                        words = part[-1]["words_upto"] - part[0]["words_before"]
                        if words >= least_words:
                            firsts = [c["first_doc_id"] for c in part if c["first_doc_id"] is not None]
                            at.append(i)
                            out.append((part[0]["start"], part[-1]["end"], words, min(firsts, default=None), max(c["n_places"] for c in part), kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.int32(), pa.int64(), batch.column("doc_id").type, pa.int64(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), *columns], ["doc_id", "start", "end", "n_words", "first_doc_id", "n_places", "kept"])

        return step

    return map_batches(by_row.select("doc_id", "chunks"), f"doc_id {kind}, start int, end int, n_words bigint, first_doc_id {kind}, n_places bigint, kept boolean", process)


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the repeated passages whose first holder is another document. Ids must be unique; other columns stay as they are."""
    spans = repeated_passages(docs, least_words, id_col, text_col).where(~F.col("kept"))
    own, cut = fresh_name(docs.columns, "__own"), fresh_name(docs.columns, "__cut")
    gone = spans.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    joined = docs.join(gone, docs[id_col] == gone[own], "left").drop(own)
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def process():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(cut).to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or ():
                    parts.append(text[at : s["start"]])
                    at = s["end"]
                out.append("".join([*parts, text[at:]]) if spans else text)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in columns], columns)

        return step

    touched = map_batches(joined.where(F.col(cut).isNotNull()), schema, process)
    return joined.where(F.col(cut).isNull()).select(*columns).unionByName(touched)
