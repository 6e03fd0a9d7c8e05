"""FITS headers and pixels from file bytes.

All functions take (path, content) rows as the ``binaryFile`` source gives them. A header is a run of 80-byte cards in
2880-byte blocks; ``END`` closes it and the data follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the file format.
CARD, BLOCK, HEADER_LIMIT = 80, 2880, 28800
PIXEL_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def read_bytes(spark, root: str) -> DataFrame:
    # The name filter keeps other files from being read at all.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[fF][iI][tT][sS]")
    return reader.load(root).filter(F.lower("path").rlike(r"\.fits$")).select("path", "content")


def card_value(card: Column) -> Column:
    """Quoted text without its quotes, else the text before the slash comment."""
    body = F.substring(card, 11, 70)
    quoted = F.regexp_extract(body, r"'([^']*)'", 1)
    return F.when(body.contains("'"), F.trim(quoted)).otherwise(F.trim(F.regexp_extract(body, r"^([^/]*)", 1)))


def card_comment(card: Column) -> Column:
    body = F.substring(card, 11, 70)
    after = F.when(body.contains("'"), F.regexp_replace(body, r"^[^']*'[^']*'", "")).otherwise(body)
    return F.trim(F.regexp_extract(after, r"/(.*)$", 1))


def first_header_cards(files: DataFrame) -> DataFrame:
    """(path, position, keyword, value, comment) of the first header, from at most 28,800 bytes, up to END."""
    text = F.decode(F.substring(F.col("content"), 1, HEADER_LIMIT), "ISO-8859-1")
    cards = files.select("path", text.alias("t")).filter(F.length("t") >= CARD)
    spots = F.sequence(F.lit(0), F.floor(F.length("t") / CARD).cast("int") - 1)
    listed = cards.select("path", F.transform(spots, lambda i: F.substring(F.col("t"), i * CARD + 1, F.lit(CARD))).alias("cards"))
    end = F.array_position(F.transform("cards", lambda c: F.rtrim(F.substring(c, 1, 8))), "END")
    kept = F.when(end > 0, F.slice("cards", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("cards"))
    rows = listed.select("path", F.posexplode(kept).alias("position", "card"))
    keyword = F.rtrim(F.substring("card", 1, 8))
    return rows.select("path", "position", keyword.alias("keyword"), card_value(F.col("card")).alias("value"), card_comment(F.col("card")).alias("comment"))


def instrument_of(files: DataFrame) -> DataFrame:
    """Instrument per file, null when its header has none."""
    found = F.when(F.col("keyword") == "INSTRUME", F.struct("position", "value"))
    return first_header_cards(files).groupBy("path").agg(F.min(found).alias("m")).select("path", F.col("m.value").alias("instrument"))


def merge_headers(cards: DataFrame) -> DataFrame:
    """One value per (path, keyword): the SCI header wins over PRIMARY.

    ``cards``: (path, hdu, keyword, value, comment).
    """
    rank = F.when(F.col("hdu") == "SCI", 1).when(F.col("hdu") == "PRIMARY", 0)
    picked = F.max_by(F.struct("value", "comment"), rank)
    return cards.filter(rank.isNotNull()).groupBy("path", "keyword").agg(picked.alias("m")).select("path", "keyword", "m.*")


def _headers(raw: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(cards, data offset, data size) of each unit in a file."""
    at = 0
    while at + BLOCK <= len(raw):
        cards: dict[str, str] = {}
        done = False
        while not done and at + BLOCK <= len(raw):
            block = raw[at : at + BLOCK].decode("latin-1")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD]
                key = card[:8].rstrip()
                if key == "END":
                    done = True
                    break
                body = card[10:]
                cards.setdefault(key, body.split("'")[1].strip() if "'" in body else body.split("/")[0].strip())
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", "0")) + 1)]
        size = abs(int(cards.get("BITPIX", "8"))) // 8 * int(np.prod(axes)) if axes else 0
        yield cards, at, size
        at += -(-size // BLOCK) * BLOCK


def decode_image(raw: bytes) -> tuple[int, int, np.ndarray] | None:
    """Pixels of the SCI unit, else of the first one, scaled and in native byte order."""
    units = list(_headers(raw))
    if not units:
        return None
    cards, at, size = next((u for u in units if u[0].get("EXTNAME", "").upper() == "SCI"), units[0])
    if size == 0 or int(cards.get("NAXIS", "0")) < 2:
        return None
    w, h = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    flat = np.frombuffer(raw, dtype=PIXEL_TYPES[int(cards["BITPIX"])], count=w * h, offset=at).astype("f8")
    return h, w, flat * float(cards.get("BSCALE", "1")) + float(cards.get("BZERO", "0"))


def load_pixels(files: DataFrame) -> DataFrame:
    """(path, h, w, pixels) per readable file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(p, decode_image(c)) for p, c in zip(batch["path"], batch["content"])]
            rows = [(p, d[0], d[1], d[2]) for p, d in done if d is not None]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "pixels"])

    return files.select("path", "content").mapInPandas(decode, "path string, h int, w int, pixels array<double>")


def pixel_rows(images: DataFrame, image_id: str) -> DataFrame:
    """(image_id, h, w, y, x, v) per pixel."""
    wide = images.select(F.col(image_id).alias("image_id"), "h", "w", F.posexplode("pixels").alias("pos", "v"))
    return wide.select(
        "image_id", "h", "w", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v"
    )


def text_card(keyword: str, value: Column) -> Column:
    """One 80-character card, for writers."""
    return F.rpad(F.concat(F.rpad(F.lit(keyword), 8, " "), F.lit("= "), value), CARD, " ")


def encode_image(keywords: list[tuple[str, Column]], pixels: Column) -> Column:
    """Bytes of a one-unit file with 32-bit integer pixels."""
    text = F.concat(*[text_card(k, v) for k, v in keywords], F.rpad(F.lit("END"), CARD, " "))
    blocks = F.ceil(F.length(text) / BLOCK).cast("int") * BLOCK
    header = F.encode(F.rpad(text, blocks, " "), "ISO-8859-1")
    digits = F.array_join(F.transform(pixels, lambda p: F.lpad(F.right(F.hex(p.cast("bigint")), F.lit(8)), 8, "0")), "")
    body = F.unhex(digits)
    pad = F.pmod(-F.length(body), F.lit(BLOCK))
    return F.concat(header, body, F.unhex(F.repeat(F.lit("00"), pad)))
