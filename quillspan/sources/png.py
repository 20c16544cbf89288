"""PNG images of 8 or 16 bits a channel, read with zlib and numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the format: its first bytes, and channels by kind of colour (grey, RGB, palette, grey and alpha, RGB and alpha).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def unfiltered(raw: bytes, height: int, stride: int, pixel: int) -> np.ndarray:
    """Bytes by row, each of which stores differences to the pixel at its left, above, to both, or to the likeliest of its neighbours."""
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for row, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        if kind == 0:
            now = line
        elif kind == 1:  # sums along the row, channel by channel
            now = np.cumsum(line.reshape(-1, pixel), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = _along(kind, line.tolist(), above.tolist(), pixel)
        else:
            raise ValueError(f"PNG with filter {kind}")
        out[row] = above = now
    return out


def _along(kind: int, line: list[int], above: list[int], pixel: int) -> np.ndarray:
    """Filters that need the byte before: 3 adds the mean of left and above, 4 whichever of left, above and above left is nearest to left + above - above left."""
    now = [0] * pixel + line
    up = [0] * pixel + above
    for i in range(pixel, len(now)):
        a, b = now[i - pixel], up[i]
        if kind == 3:
            now[i] = (now[i] + (a + b) // 2) & 255
            continue
        c = up[i - pixel]
        p = a + b - c
        now[i] = (now[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
    return np.array(now[pixel:], np.uint8)


def decode(content: bytes) -> np.ndarray:
    """Red, green and blue by row and column; the high byte of 16 bits. Grey counts for all three, alpha is left out."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in chunks(content):
        parts.setdefault(kind, []).append(body)
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if bits not in (8, 16) or interlaced:
        raise ValueError(f"PNG with {bits} bits a channel" if not interlaced else "interlaced PNG")
    pixel = CHANNELS[colour] * bits // 8
    rows = unfiltered(zlib.decompress(b"".join(parts[b"IDAT"])), height, width * pixel, pixel)
    values = rows.reshape(height, width, CHANNELS[colour], bits // 8)[..., 0]
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)[values[..., 0]]
    return np.repeat(values[..., :1], 3, axis=2) if colour in (0, 4) else values[..., :3]


def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, r, c, red, green, blue: a batch for each image."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            image = decode(content).astype(np.int32)
            r, c = np.indices(image.shape[:2], dtype=np.int32)
            columns = [pa.array([path]).take(pa.array(np.zeros(r.size, np.int64))), *(pa.array(np.ascontiguousarray(x).ravel()) for x in (r, c, image[..., 0], image[..., 1], image[..., 2]))]
            yield pa.record_batch(columns, names=["path", "r", "c", "red", "green", "blue"])
