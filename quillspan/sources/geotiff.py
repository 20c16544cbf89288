"""GeoTIFF with one band: whole files, and windows of which only the blocks that they touch are read.

A file is a grid of blocks (tiles or strips), each compressed on its own. Where
they lie stands in a directory, so a window takes the directory and the byte
ranges of its blocks, wherever the file is stored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format: bytes of each field type, its code for struct, and the tags read here.
SIZES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)

Fetch = Callable[[int, int], bytes]


def directories(fetch: Fetch) -> tuple[str, list[dict[int, tuple]]]:
    """Byte order, and the fields of every directory: the image itself, then its smaller overviews. fetch(at, n) gives n bytes of the file, or fewer at its end."""
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # Files over 4 GB have counts and places of eight bytes.
    word, entry, count_code, base = ("Q", 20, "Q", 8) if version == 43 else ("I", 12, "H", 4)
    at, size, out = struct.unpack_from(f"{order}{word}", head, base)[0], struct.calcsize(word), []
    while at:
        skip = struct.calcsize(count_code)
        (n,) = struct.unpack(f"{order}{count_code}", fetch(at, skip))
        body = fetch(at + skip, n * entry + size)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", body, entry * k)
            (count,) = struct.unpack_from(f"{order}{word}", body, entry * k + 4)
            if kind in SIZES:
                each, code = SIZES[kind]
                place = entry * k + 4 + size
                raw = body[place : place + size]
                if each * count > size:
                    raw = fetch(struct.unpack(f"{order}{word}", raw)[0], each * count)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw)
        out.append(tags)
        (at,) = struct.unpack_from(f"{order}{word}", body, n * entry)
    return order, out


@dataclass
class Layout:
    """Size and place of an image, and its grid of blocks."""

    order: str
    tags: dict[int, tuple]
    width: int
    height: int
    block_width: int
    block_height: int
    west: float
    north: float
    step_x: float
    step_y: float

    @classmethod
    def of(cls, fetch: Fetch, level: int = 0) -> "Layout":
        """The image of a level: 0 is the whole, higher ones are overviews, which share its place."""
        order, all_tags = directories(fetch)
        if level >= len(all_tags):
            raise ValueError(f"no overview {level}: the file has {len(all_tags)} images")
        first, tags = all_tags[0], all_tags[level]
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        tiled = TILES in tags
        block = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(STRIP_ROWS, (height,))[0], height))
        corner, scale = first[TIE_POINT], first[PIXEL_SCALE]
        return cls(order, tags, width, height, *block, corner[3], corner[4], scale[0] * first[WIDTH][0] / width, scale[1] * first[HEIGHT][0] / height)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{KINDS[self.tags.get(FORMAT, (1,))[0]]}{self.tags[BITS][0] // 8}")

    def place(self, block: int) -> tuple[int, int]:
        """Offset and bytes of a block; no bytes if the file leaves it out."""
        tiled = TILES in self.tags
        return self.tags[TILES if tiled else STRIPS][block], self.tags[TILE_BYTES if tiled else STRIP_BYTES][block]

    def blocks(self, window: tuple[int, int, int, int]) -> list[int]:
        """Numbers of the blocks that a window (first and last row, first and last column) touches."""
        r0, r1, c0, c1 = window
        if r0 > r1 or c0 > c1:
            return []
        return [b * self.across + a for b in range(r0 // self.block_height, r1 // self.block_height + 1) for a in range(c0 // self.block_width, c1 // self.block_width + 1)]

    def values(self, block: int, raw: bytes) -> tuple[int, int, np.ndarray]:
        """First row and column of a block, and its values inside the image."""
        row, col = block // self.across * self.block_height, block % self.across * self.block_width
        rows = self.block_height if TILES in self.tags else min(self.block_height, self.height - row)
        out = np.zeros((rows, self.block_width), self.dtype)
        if raw:
            flat = unpacked(raw, self.tags.get(COMPRESSION, (PLAIN,))[0], out.nbytes)
            out = undo_prediction(np.frombuffer(flat, np.uint8, out.nbytes), self.tags.get(PREDICTOR, (1,))[0], out.shape, self.dtype)
        return row, col, out[: self.height - row, : self.width - col]


def unpacked(raw: bytes, way: int, size: int) -> bytes:
    if way == PLAIN:
        return raw
    if way in DEFLATE:
        return zlib.decompress(raw)
    if way == LZW:
        return lzw(raw, size)
    raise ValueError(f"GeoTIFF with compression {way}")


def lzw(raw: bytes, size: int) -> bytes:
    """The format's LZW: codes of 9 to 12 bits from the high end, 256 clears the table, 257 ends; codes grow one entry early."""
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out, done, width, held, bits, before = [], 0, 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code == 257 or done >= size:
            break
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("damaged LZW data")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out.append(entry)
        done, before = done + len(entry), entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def undo_prediction(flat: np.ndarray, predictor: int, shape: tuple[int, int], dtype: np.dtype) -> np.ndarray:
    """Values from a block's bytes: 2 stores differences along a row, 3 the bytes of floats plane by plane, as differences."""
    if predictor == 1:
        return flat.view(dtype).reshape(shape)
    if predictor == 2:
        whole = np.dtype(f"{dtype.str[0]}u{dtype.itemsize}")  # differences wrap around
        return np.cumsum(flat.view(whole).reshape(shape).astype(whole.newbyteorder("=")), axis=1, dtype=whole.newbyteorder("=")).astype(whole).view(dtype)
    if predictor == 3:
        rows = np.cumsum(flat.reshape(shape[0], -1), axis=1, dtype=np.uint8).reshape(shape[0], dtype.itemsize, shape[1])
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(shape)
    raise ValueError(f"GeoTIFF with predictor {predictor}")


def decode(content: bytes, level: int = 0) -> tuple[np.ndarray, Layout]:
    """All values of an image by row and column, and its layout."""
    fetch = lambda at, n: content[at : at + n]
    layout = Layout.of(fetch, level)
    out = np.zeros((layout.height, layout.width), float)
    for block in layout.blocks((0, layout.height - 1, 0, layout.width - 1)):
        row, col, values = layout.values(block, fetch(*layout.place(block)))
        out[row : row + values.shape[0], col : col + values.shape[1]] = values
    return out, layout


def _batch(path: str, layout: Layout, row: int, col: int, values: np.ndarray) -> pa.RecordBatch:
    rows, cols = np.repeat(np.arange(row, row + values.shape[0]), values.shape[1]), np.tile(np.arange(col, col + values.shape[1]), values.shape[0])
    columns = [rows, cols, layout.north - (rows + 0.5) * layout.step_y, layout.west + (cols + 0.5) * layout.step_x, np.maximum(values.ravel().astype(float), 0.0)]
    return pa.record_batch([pa.array([path]).take(pa.array(np.zeros(values.size, np.int64))), *map(pa.array, columns)], names=["path", "row", "col", "lat", "lon", "value"])


def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of whole files, a batch for each row."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            values, layout = decode(content)
            for row in range(layout.height):
                yield _batch(path, layout, row, 0, values[row : row + 1])


def opened(path: str) -> Fetch:
    """fetch() for a file on any store that pyarrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    file = store.open_input_file(at)
    size = file.size()
    return lambda at, n: file.read_at(max(0, min(n, size - at)), at)


class _Blocks(InputPartition):
    def __init__(self, blocks: list[int], window: tuple[int, int, int, int]):
        self.blocks, self.window = blocks, window


class RasterWindow(DataSource):
    """Pixels (path, row, col, lat, lon, value; middles of pixels, negative values as 0) of one GeoTIFF file.

    Options: path (local, or a URI that pyarrow opens on every executor);
    row_min, row_max, col_min, col_max, both ends included; level (0, or an
    overview); blocks, how many a task reads (64 by default); filters: if true,
    for sessions with spark.sql.python.filterPushdown.enabled, comparisons of
    row, col, lat and lon with values narrow the window too. Only blocks that
    the window touches are read.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_window"

    def schema(self) -> str:
        return "path string, row long, col long, lat double, lon double, value double"

    def reader(self, schema):
        options = dict(self.options)
        return (_FilteringReader if options.get("filters") == "true" else _WindowReader)(options)


class _WindowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.level, self.each = options["path"], int(options.get("level", 0)), int(options.get("blocks", 64))
        bound = lambda name, none: float(options.get(name, none))
        #: What is known of each column: lowest and highest value that is wanted.
        self.range = {c: [bound(f"{c}_min", -math.inf), bound(f"{c}_max", math.inf)] for c in ("row", "col", "lat", "lon")}

    def window(self, layout: Layout) -> tuple[int, int, int, int]:
        """Rows and columns that may hold what is wanted, inside the image. Latitudes and longitudes get a pixel more on either side."""
        def inside(low: float, high: float, size: int) -> tuple[int, int]:
            return int(max(0, math.ceil(max(low, 0)))), int(min(size - 1, math.floor(min(high, size))))

        (south, north), (west, east) = self.range["lat"], self.range["lon"]
        rows = [max(self.range["row"][0], (layout.north - north) / layout.step_y - 1.5), min(self.range["row"][1], (layout.north - south) / layout.step_y + 0.5)]
        cols = [max(self.range["col"][0], (west - layout.west) / layout.step_x - 1.5), min(self.range["col"][1], (east - layout.west) / layout.step_x + 0.5)]
        return *inside(*rows, layout.height), *inside(*cols, layout.width)

    def partitions(self):
        layout = Layout.of(opened(self.path), self.level)
        window = self.window(layout)
        blocks = layout.blocks(window)
        return [_Blocks(blocks[k : k + self.each], window) for k in range(0, len(blocks), self.each)] or [_Blocks([], window)]

    def read(self, partition):
        fetch = opened(self.path)
        layout = Layout.of(fetch, self.level)
        r0, r1, c0, c1 = partition.window
        for block in partition.blocks:
            row, col, values = layout.values(block, fetch(*layout.place(block)))
            top, left = max(row, r0), max(col, c0)
            yield _batch(self.path, layout, top, left, values[top - row : r1 + 1 - row, left - col : c1 + 1 - col])


class _FilteringReader(_WindowReader):
    """Filters can only be given to a reader in sessions that switch this on; in others Spark refuses such readers."""

    def pushFilters(self, filters):
        """Narrows the window; Spark looks at every filter again."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in self.range and isinstance(getattr(f, "value", None), int | float):
                low, high = self.range[column]
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    low = max(low, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    high = min(high, f.value)
                self.range[column] = [low, high]
            yield f
