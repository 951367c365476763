"""Media columns: payloads as PNG images in binary columns, read back and hashed by their low frequencies.

Method: the payload's bytes become the samples of an 8-bit RGB image 64 pixels wide. The writer chooses a
filter for each row, deflates the filtered rows into IDAT chunks and closes every chunk with its CRC-32. The
reader tests the signature and each chunk's checksum, inflates, and undoes the row filters with numpy: None, Sub
and Up as whole-array sums modulo 256, Average and Paeth byte by byte. The feature is a perceptual hash:
the grey image, averaged down to 32 x 32, goes through a two-dimensional DCT-II, and each of the 64 lowest
frequencies gives one bit, set where the coefficient exceeds their lower median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIDE, LOW = 32, 8
CHUNK = 1 << 20

SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, media binary"
)


def payload(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with spaces up to a positive multiple of a row, and its length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: bytes, level: int = 1) -> bytes:
    """An RGB PNG of the samples; each row takes the filter of None, Sub, Up with the least sum of magnitudes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, sub, up)]
    best = np.argmin(cost, axis=0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = rows
    for kind, other in ((1, sub), (2, up)):
        out[best == kind, 1:] = other[best == kind]
    body = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    idat = b"".join(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + idat + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """The samples behind filtered rows; ``kinds`` holds each row's filter type."""
    if kinds.size and int(kinds.max()) > 4:
        raise ValueError("unknown PNG filter")
    out = rows.copy()
    sub = kinds == 1
    if sub.any():
        pixels = out[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(pixels.shape[0], -1)
    if not (kinds >= 2).any():
        return out
    y = 0
    while y < len(out):
        kind = kinds[y]
        if kind == 2:
            end = y
            while end < len(out) and kinds[end] == 2:
                end += 1
            if y:
                out[y] += out[y - 1]
            out[y:end] = np.cumsum(out[y:end], axis=0, dtype=np.uint8)
            y = end
            continue
        if kind >= 3:
            line, above = out[y].tolist(), out[y - 1].tolist() if y else [0] * out.shape[1]
            for x, value in enumerate(line):
                a, b = line[x - bpp] if x >= bpp else 0, above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - bpp] if x >= bpp else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (value + guess) & 255
            out[y] = line
        y += 1
    return out


def read_png(media: bytes) -> np.ndarray:
    """Height x width x channels samples of an 8-bit, non-interlaced, non-palette PNG.

    Raises ValueError on a wrong signature, a chunk whose checksum fails, or a form it does not read.
    """
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut-off chunk")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media):
            raise ValueError("cut-off chunk")
        (crc,) = struct.unpack(">I", media[at + 8 + size : at + 12 + size])
        if zlib.crc32(body, zlib.crc32(kind)) != crc:
            raise ValueError(f"checksum of chunk {kind!r} fails")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("PNG without IHDR or IEND")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit, non-interlaced, non-palette images")
    data = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    rows = data.reshape(height, width * channels + 1)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)


def _basis(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


_DCT = _basis(SIDE, LOW)


@lru_cache(4096)
def _shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each of SIDE bands over n rows, and the bands' heights; short images repeat rows."""
    lo = np.arange(SIDE) * n // SIDE
    return lo, np.maximum(np.append(lo[1:], n) - lo, 1)


def dct_hash(image: np.ndarray) -> str:
    """64 bits in hex of the lowest DCT frequencies of the grey, 32 x 32 averaged image."""
    grey = image.astype(np.int64).sum(2)
    for axis in (0, 1):
        lo, size = _shrink(grey.shape[axis])
        grey = np.add.reduceat(grey, lo, axis=axis) / size.reshape((-1, 1) if axis == 0 else (1, -1))
    low = np.round((_DCT @ grey @ _DCT.T).ravel(), 6)
    return np.packbits(low > np.sort(low)[LOW * LOW // 2 - 1]).tobytes().hex()


def digest(text: str | None, level: int = 1) -> tuple:
    """Write, read back and describe one text, in the order of SCHEMA."""
    raw, n = payload(text)
    media = write_png(raw, level)
    image = read_png(media)
    back = image.tobytes()
    return (
        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), dct_hash(image), media,
    )


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """``key`` and the columns of SCHEMA for every row of ``df``.

    Null and empty texts become one row of 192 spaces. Rows repeat as they do in ``df``; a null key stays null;
    an empty table gives an empty table; other columns of ``df``, whatever their names, are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_rows(rows, lambda: lambda i, t: (i, *digest(t, level)), f"doc_id long, {SCHEMA}")
