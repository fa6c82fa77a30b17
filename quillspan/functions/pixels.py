"""Pictures as bytes: PNG read and written, and what is done to a page before it is read. Arrow batches and arrays.

A picture is a row: width, height, channels (1 grey, 3 colour, 4 colour and opacity) and pixels, row by row. Broken,
interlaced or deeper pictures give nulls, not errors; null gives null.
"""

from __future__ import annotations

import shutil
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signature, and the colour types of 8-bit pictures by number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPES = {1: 0, 3: 2, 4: 6}
PICTURE = "width int, height int, channels int, pixels binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def packed(pixels: np.ndarray) -> bytes:
    """PNG of an array (height, width, channels): one IDAT, filter 0, so that equal pictures are equal bytes."""
    height, width, channels = pixels.shape
    rows = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    return min((left, up, corner), key=lambda v: abs(guess - v))


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows led by their filter (0 none, 1 left, 2 up, 3 mean, 4 Paeth), undone."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), dtype=np.uint8)
    for y, row in enumerate(rows, 1):
        kind, line, up = row[0], row[1:], out[y - 1]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            out[y] = line + up
        elif kind in (3, 4):
            now, above = [0] * step + line.tolist(), [0] * step + up.tolist()
            for x in range(step, len(now)):
                left, over = now[x - step], above[x]
                now[x] = (now[x] + ((left + over) // 2 if kind == 3 else _paeth(left, over, above[x - step]))) & 255
            out[y] = now[step:]
        else:
            raise ValueError("unknown filter")
    return out[1:]


def unpacked(data: bytes) -> np.ndarray | None:
    """The pixels of an 8-bit picture without interlace, (height, width, channels); None where it is none."""
    if data is None or data[:8] != SIGNATURE:
        return None
    try:
        head, body = None, b""
        for kind, part in _chunks(data):
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body += part
        width, height, depth, colour, _, _, laced = head
        channels = {v: k for k, v in COLOUR_TYPES.items()}[colour]
        if depth != 8 or laced:
            return None
        rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * channels)
        return _unfiltered(rows, channels).reshape(height, width, channels)
    except (struct.error, zlib.error, ValueError, KeyError, TypeError):
        return None


def _row(p: np.ndarray | None) -> tuple:
    return (None, None, None, None) if p is None else (p.shape[1], p.shape[0], p.shape[2], p.tobytes())


def _frame(pictures: list[np.ndarray | None]) -> pd.DataFrame:
    f = pd.DataFrame([_row(p) for p in pictures], columns=["width", "height", "channels", "pixels"])
    return f.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})


def from_png(data: Column) -> Column:
    """struct of a picture from PNG bytes."""

    @F.pandas_udf(f"struct<{PICTURE.replace(' ', ':').replace(',:', ',')}>")
    def read(batch: pd.Series) -> pd.DataFrame:
        return _frame([unpacked(None if d is None else bytes(d)) for d in batch])

    return read(data)


def to_png(width: Column, height: Column, channels: Column, pixels: Column) -> Column:
    """PNG bytes of a picture; null where the sizes do not fit."""

    @F.pandas_udf("binary")
    def write(w: pd.Series, h: pd.Series, c: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for x, y, n, data in zip(w, h, c, p, strict=True):
            fits = data is not None and n in COLOUR_TYPES and x > 0 and y > 0 and len(data) == x * y * n
            out.append(packed(np.frombuffer(data, dtype=np.uint8).reshape(int(y), int(x), int(n))) if fits else None)
        return pd.Series(out, dtype=object)

    return write(width, height, channels, pixels)


# ---- before a page is read -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """How a page is prepared. ``psm`` and ``oem`` are for the engine."""

    psm: int = 3
    oem: int | None = None
    binarize: bool = False
    autocontrast: bool = True
    min_width: int = 2000
    border: int = 24
    binarize_offset: int = 35
    max_scale: float = 4.0


#: Print, handwriting, and pictures that are ready.
PROFILES = {
    "print": Profile(),
    "handwriting": Profile(psm=6, oem=1, binarize=True, min_width=2600, border=32),
    "none": Profile(autocontrast=False, min_width=0, border=0),
}
#: Engines by the program or module that shows they are there.
BACKENDS = {"tesseract": "tesseract"}


def backends(which: Callable[[str], str | None] = shutil.which) -> list[str]:
    """The engines found on this machine; none is an ordinary answer, transcripts may come from elsewhere."""
    return [name for name, program in BACKENDS.items() if which(program)]


def grey(p: np.ndarray) -> np.ndarray:
    """Luma of a colour picture, (height, width)."""
    if p.shape[2] == 1:
        return p[:, :, 0]
    r, g, b = (p[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def contrasted(g: np.ndarray, cutoff: float = 0.01) -> np.ndarray:
    """Stretched to the full range, ``cutoff`` of the pixels left out at either end."""
    n = np.bincount(g.ravel(), minlength=256)
    drop = int(g.size * cutoff)
    lo = int(np.searchsorted(np.cumsum(n), drop, side="right"))
    hi = 255 - int(np.searchsorted(np.cumsum(n[::-1]), drop, side="right"))
    if hi <= lo:
        return g
    scale = 255.0 / (hi - lo)
    return np.clip((np.arange(256) - lo) * scale, 0, 255).astype(np.uint8)[g]


def _lanczos(n: int, m: int, reach: int = 3) -> np.ndarray:
    """(m x n) weights that resample a row of n pixels to m > n."""
    at = (np.arange(m) + 0.5) * n / m
    off = np.arange(n)[None, :] + 0.5 - at[:, None]
    w = np.where(np.abs(off) < reach, np.sinc(off) * np.sinc(off / reach), 0.0)
    return w / w.sum(1, keepdims=True)


def enlarged(g: np.ndarray, scale: float) -> np.ndarray:
    h, w = round(g.shape[0] * scale), round(g.shape[1] * scale)
    out = _lanczos(g.shape[0], h) @ g.astype(float) @ _lanczos(g.shape[1], w).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def local_threshold(g: np.ndarray, radius: int = 25, offset: int = 35) -> np.ndarray:
    """Black where a pixel is darker by ``offset`` than the mean around it, else white; edges go on outwards."""
    side = 2 * radius + 1
    wide = np.pad(g.astype(np.int64), radius + 1, mode="edge")[:-1, :-1]
    total = wide.cumsum(0).cumsum(1)
    mean = (total[side:, side:] - total[:-side, side:] - total[side:, :-side] + total[:-side, :-side]) // (side * side)
    return np.where(g.astype(np.int64) - mean > -offset, 255, 0).astype(np.uint8)


def prepared(p: np.ndarray, o: Profile) -> tuple[np.ndarray, dict]:
    """The picture to be read, and the transform that leads back: scale, border, steps."""
    g, steps, scale = grey(p), ["grayscale"], 1.0
    if o.autocontrast and not o.binarize:  # the local threshold does not depend on contrast
        g = contrasted(g)
        steps.append("autocontrast(cutoff=1)")
    if o.min_width and g.shape[1] < o.min_width and min(o.max_scale, o.min_width / g.shape[1]) > 1.01:
        scale = min(o.max_scale, o.min_width / g.shape[1])
        g = enlarged(g, scale)
        steps.append(f"upscale x{scale:.2f} (LANCZOS)")
    if o.binarize:
        g = local_threshold(g, offset=o.binarize_offset)
        steps.append(f"local-mean binarisation (offset {o.binarize_offset})")
    if o.border:
        g = np.pad(g, o.border, constant_values=255)
        steps.append(f"white border {o.border}px")
    return g[:, :, None], {"scale": round(scale, 4), "border": o.border, "steps": steps}


def prepared_pages(pages: DataFrame, key: str, image: str, profile: str = "print") -> DataFrame:
    """(key, image, scale, border, steps) of PNG pages; what is no picture has nulls."""
    o = PROFILES[profile]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, data in zip(f[key], f[image], strict=True):
                p = unpacked(None if data is None else bytes(data))
                if p is None:
                    rows.append((k, None, None, None, None))
                else:
                    q, t = prepared(p, o)
                    rows.append((k, packed(q), t["scale"], t["border"], t["steps"]))
            yield pd.DataFrame(rows, columns=[key, "image", "scale", "border", "steps"]).astype({"border": "Int32"})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, image).mapInPandas(run, f"{key} {kind}, image binary, scale double, border int, steps array<string>")
