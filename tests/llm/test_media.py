import hashlib
import random
import zlib

import numpy as np
import pytest

from tessella.llm import media


@pytest.mark.parametrize("text", [None, "", "a", "ä" * 97, "x" * 192, "line\n" * 5000, "\x00￿\U0001f600"])
def test_round_trip(text):
    raw, n = media.payload(text)
    got = media.digest(text)
    assert len(raw) % 192 == 0 and len(raw) >= 192 and raw[:n] == (text or "").encode()
    assert got[0] == n and got[1] == len(raw) and got[2] == hashlib.sha256(raw).hexdigest()
    assert got[3] == zlib.crc32(raw[-16:]) and media.read_png(got[7]).tobytes() == raw


def _filter(rows, kinds, bpp):
    """Brute-force PNG filtering, byte by byte."""
    out = rows.copy()
    for y in range(len(rows)):
        for x in range(rows.shape[1]):
            a = int(rows[y, x - bpp]) if x >= bpp else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    return out


def test_all_filters():
    rng = np.random.default_rng(1)
    for bpp in (1, 3, 4):
        rows = rng.integers(0, 256, (12, 5 * bpp), dtype=np.uint8)
        kinds = rng.integers(0, 5, 12).astype(np.uint8)
        assert (media.unfilter(kinds, _filter(rows, kinds, bpp), bpp) == rows).all()


def test_damage_is_found():
    png = bytearray(media.write_png(b"some text " * 96))
    random.seed(3)
    for at in random.sample(range(8, len(png) - 4), 20):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bytes(bad))


def test_table_edges(spark):
    df = spark.createDataFrame(
        [(1, "abc", "x"), (1, "abc", "x"), (None, None, None), (2, "", "y"), (3, "z" * 300_000, "q")],
        "doc_id long, text string, media string",
    )
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    assert len(got) == 4 and got[None].n_bytes == 0 and got[None].media_sha256 == got[2].media_sha256
    assert got[3].n_bytes == 300_000
    assert media.media_columns(df.limit(0)).count() == 0
    near = media.dct_hash(media.read_png(media.write_png(b"a" * 19200)))
    assert len(near) == 16


def _slow_hash(image):
    """The hash from its definition: band means, then every cosine sum by itself."""
    import math

    grey = [[int(sum(p)) for p in row] for row in image.tolist()]

    def band(n, i):
        lo = i * n // 32
        return range(lo, max(lo + 1, (i + 1) * n // 32))

    h, w = len(grey), len(grey[0])
    mean = [[sum(grey[y][x] for y in band(h, i) for x in band(w, j)) / len(band(h, i)) / len(band(w, j)) for j in range(32)] for i in range(32)]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    wave = [[scale(k) * math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(mean[y][x] * wave[a][y] * wave[b][x] for y in range(32) for x in range(32)), 6) for a in range(8) for b in range(8)]
    middle = sorted(low)[31]
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


@pytest.mark.parametrize("rows", [1, 7, 40])
def test_dct_hash_against_its_definition(rows):
    rng = np.random.default_rng(rows)
    image = rng.integers(0, 256, (rows, 64, 3), dtype=np.uint8)
    assert media.dct_hash(image) == _slow_hash(image)
