import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import pixels as px


def filtered(p, kinds):
    """PNG bytes whose rows carry the given filters."""
    h, w, c = p.shape
    flat, body = p.reshape(h, -1).astype(int), b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        row = []
        for x in range(w * c):
            left = flat[y, x - c] if x >= c else 0
            up = flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - c] if y and x >= c else 0
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            row.append((flat[y, x] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        body += bytes([kind, *row])
    packed = zlib.compress(body)
    head = struct.pack(">IIBBBBB", w, h, 8, px.COLOUR_TYPES[c], 0, 0, 0)
    return px.SIGNATURE + b"".join(px._chunk(k, d) for k, d in ((b"IHDR", head), (b"tEXt", b"a"), (b"IDAT", packed[:9]), (b"IDAT", packed[9:]), (b"IEND", b"")))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_every_filter_is_undone(channels):
    p = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (px.unpacked(filtered(p, kinds)) == p).all()


def test_pictures_round_trip_in_columns(spark):
    rng = random.Random(1)
    rows = [(i, w, h, c, rng.randbytes(w * h * c)) for i, (w, h, c) in enumerate([(1, 1, 1), (5, 3, 3), (2, 9, 4)])]
    rows += [(7, 2, 2, 3, b"short"), (8, None, None, None, None), (9, 0, 0, 3, b"")]
    df = spark.createDataFrame(rows, "k int, w int, h int, c int, p binary")
    png = df.withColumn("png", px.to_png(*[F.col(x) for x in "whcp"])).withColumn("back", px.from_png(F.col("png")))
    got = {r.k: r for r in png.withColumn("size", by.png_size(F.col("png"))).collect()}
    for k in range(3):
        assert tuple(got[k].back) == rows[k][1:] and (got[k].size.width, got[k].size.height) == rows[k][1:3]
    assert all(got[k].png is None and got[k].back.pixels is None for k in (7, 8, 9))


def test_broken_pictures_are_nulls():
    good = px.packed(np.zeros((2, 2, 3), dtype=np.uint8))
    assert px.unpacked(b"") is None is px.unpacked(None) is px.unpacked(good[:40]) is px.unpacked(good.replace(b"IDAT", b"IDOT"))
    deep = bytearray(good)
    deep[24] = 16
    assert px.unpacked(bytes(deep)) is None


def test_local_threshold_against_loops():
    g = np.random.default_rng(5).integers(0, 256, (13, 17), dtype=np.uint8)
    got = px.local_threshold(g, radius=2, offset=20)
    for y in range(13):
        for x in range(17):
            around = [int(g[min(max(y + a, 0), 12), min(max(x + b, 0), 16)]) for a in range(-2, 3) for b in range(-2, 3)]
            assert got[y, x] == (255 if int(g[y, x]) - sum(around) // 25 > -20 else 0)


def test_contrast_and_size():
    g = np.tile(np.arange(100, 150, dtype=np.uint8), (50, 1))
    c = px.contrasted(g, 0.0)
    assert (c.min(), c.max()) == (0, 255) and (px.contrasted(np.full((3, 3), 9, dtype=np.uint8)) == 9).all()
    big = px.enlarged(g, 2.0)
    assert big.shape == (100, 100) and abs(float(big.mean()) - float(g.mean())) < 0.6


def test_pages_are_prepared_by_profile(spark):
    page = np.full((20, 40, 3), 230, dtype=np.uint8)
    page[8:12, 5:35] = 40
    df = spark.createDataFrame([(1, px.packed(page)), (2, b"no picture"), (3, None)], "k long, b binary")
    got = {r.k: r for r in px.prepared_pages(df, "k", "b", "handwriting").collect()}
    out = px.unpacked(bytes(got[1].image))
    assert out.shape == (20 * 4 + 64, 40 * 4 + 64, 1) and set(np.unique(out)) == {0, 255} and (got[1].scale, got[1].border) == (4.0, 32)
    assert got[1].steps == ["grayscale", "upscale x4.00 (LANCZOS)", "local-mean binarisation (offset 35)", "white border 32px"]
    assert got[2].image is None is got[3].image
    assert px.prepared_pages(df, "k", "b", "none").where("k = 1").first().steps == ["grayscale"]
    assert px.backends(lambda _: None) == [] and px.backends(lambda p: p) == ["tesseract"]
