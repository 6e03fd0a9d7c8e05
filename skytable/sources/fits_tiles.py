"""Image files as tile rows: a data source that reads byte ranges of FITS files, so that no image is one row and no file one task.

A tile row is (``h``, ``w`` of the image, ``y0``, ``x0``, ``rows``, ``cols``, ``values`` row by row). A partition is a range of a file's bytes; it
reads the header and the bands of ``tile`` image rows that begin in its range. The driver lists names and sizes only.
A file that cannot be read gives one row with a ``reason`` and no tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skytable.sources.fits import BLOCK, CARD, PIXEL_TYPES

TILE = 256
# Bytes of a file that one partition reads at most; small files share one, each counted with this much for opening it.
RANGE_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
SCHEMA = "path string, h int, w int, y0 int, x0 int, rows int, cols int, values array<double>, reason string"


class Damaged(Exception):
    """Why a file has no tiles."""


def _cards(file, at: int, size: int) -> tuple[dict[str, str], int]:
    """The cards of a unit that begins at a byte, and where its data begin."""
    cards: dict[str, str] = {}
    while True:
        if at + BLOCK > size:
            raise Damaged("header without end")
        file.seek(at)
        block = file.read(BLOCK).decode("latin-1")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD]
            key = card[:8].rstrip()
            if key == "END":
                return cards, at
            body = card[10:]
            cards.setdefault(key, body.split("'")[1].strip() if "'" in body else body.split("/")[0].strip())


def _number(cards: dict[str, str], key: str, default: str | None = None) -> int:
    text = cards.get(key, default)
    try:
        return int(text)
    except (TypeError, ValueError):
        raise Damaged(f"card {key} is {'absent' if text is None else repr(text)}") from None


def _scale(cards: dict[str, str], key: str, default: float) -> float:
    try:
        return float(cards.get(key, default))
    except ValueError:
        raise Damaged(f"card {key} is {cards[key]!r}") from None


def locate_image(file, size: int) -> tuple[int, int, str, int, float, float]:
    """(h, w, pixel type, first data byte, scale, zero) of the SCI unit, else of the first unit with an image."""
    at, first = 0, None
    while at + BLOCK <= size:
        cards, data_at = _cards(file, at, size)
        axes = [_number(cards, f"NAXIS{i}") for i in range(1, _number(cards, "NAXIS", "0") + 1)]
        bits = _number(cards, "BITPIX", "8")
        if bits not in PIXEL_TYPES or any(a < 0 for a in axes):
            raise Damaged(f"pixels of {bits} bits, axes {axes}")
        length = abs(bits) // 8 * int(np.prod(axes, dtype=object)) if axes else 0
        found = (axes[1], axes[0], PIXEL_TYPES[bits], data_at, _scale(cards, "BSCALE", 1.0), _scale(cards, "BZERO", 0.0)) if len(axes) > 1 and length else None
        science = cards.get("EXTNAME", "").upper() == "SCI"
        if found and (science or first is None):
            if data_at + axes[0] * axes[1] * abs(bits) // 8 > size:
                raise Damaged("data end early")
            first = found
        if found and science:
            return found
        at = data_at + -(-length // BLOCK) * BLOCK
    if first is None:
        raise Damaged("no image")
    return first


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class ByteRanges(InputPartition):
    """Ranges of files: (path, size of the file, first byte, one behind the last)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        self.ranges = ranges


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.tile = int(options.get("tile", TILE))
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[ByteRanges]:
        system, root = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        images = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".fits"))
        found: list[ByteRanges] = []
        room = 0
        for path, size in images:
            for low in range(0, max(size, 1), self.range):
                high = low + self.range
                need = min(size, high) - low + OPEN_BYTES
                if need > room:
                    found.append(ByteRanges([]))
                    room = self.range
                found[-1].ranges.append((path, size, low, high))
                room -= need
        # Spark asks for one partition at least.
        return found or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[tuple]:
        system, _ = _opened(self.root)
        for path, size, low, high in partition.ranges:
            with system.open_input_file(path) as file:
                yield from self._tiles(file, path, size, low, high)

    def _tiles(self, file, path: str, size: int, low: int, high: int) -> Iterator[tuple]:
        try:
            h, w, kind, at, scale, zero = locate_image(file, size)
        except Damaged as e:
            if low == 0:
                yield (path, None, None, None, None, None, None, None, str(e))
            return
        line = w * np.dtype(kind).itemsize
        for y0 in range(0, h, self.tile):
            begin = at + y0 * line
            if not low <= begin < high:
                continue
            rows = min(self.tile, h - y0)
            file.seek(begin)
            band = np.frombuffer(file.read(rows * line), kind).reshape(rows, w).astype("f8") * scale + zero
            for x0 in range(0, w, self.tile):
                part = band[:, x0 : x0 + self.tile]
                yield (path, h, w, y0, x0, rows, part.shape[1], part.ravel().tolist(), None)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def read_tiles(spark: SparkSession, root: str, tile: int = TILE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Tile rows of all FITS files below a folder, with ``path`` and, for files without readable image, ``reason``."""
    spark.dataSource.register(TileSource)
    return spark.read.format("fits_tiles").option("tile", tile).option("rangeBytes", range_bytes).load(root)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write every row of (``path``, ``content``) as a file below the folder, from the tasks; a repeated task writes the same files. Returns their names.

    The result must be used for the files to be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(root)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
            yield batch.select(["path"])

    return files.select("path", "content").mapInArrow(run, "path string")
