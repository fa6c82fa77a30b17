"""Byte strings: ciphers, checksums, shared secrets, headers and packed texts, in Catalyst where the semantics allow.

The Arrow functions at the end (sequential scans, dynamic types) work on whole batches.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the end mark, which no transform touches.
END_MARK = 0x24


def octets(data: Column) -> Column:
    """The bytes as array<int>."""
    figures = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.transform(figures, lambda h: F.conv(h, 16, 10).cast("int"))


def from_octets(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def xored(data: Column, key: int) -> Column:
    """Bytes xor a key, the end mark untouched before and, by its cipher, after: the transform is its own inverse
    except on bytes that become the end mark."""
    return from_octets(F.transform(octets(data), lambda b: F.when(b == END_MARK, b).otherwise(b.bitwiseXOR(F.lit(key)))))


def crc16(data: Column) -> Column:
    """CRC-16 with initial 0xFFFF, reflected polynomial 0xA001, no final xor."""

    def byte(crc: Column, b: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(8)),
            crc.bitwiseXOR(b),
            lambda c, _: F.when(
                c.bitwiseAND(F.lit(1)) == 1, F.shiftright(c, 1).bitwiseXOR(F.lit(0xA001))
            ).otherwise(F.shiftright(c, 1)),
        )

    return F.aggregate(octets(data), F.lit(0xFFFF), byte)


def wrapped_base64(data: Column) -> Column:
    """Base64 in lines of 76 characters with line feeds."""
    flat = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return F.regexp_replace(flat, "(.{76})(?=.)", "$1\n")


def intact(encoded: Column, sha256: Column) -> Column:
    """Whether an encoded payload has the checksum it should have."""
    return F.coalesce(F.sha2(F.unbase64(F.regexp_replace(encoded, r"\s", "")), 256) == F.lower(sha256), F.lit(False))


# ---- arithmetic of 256 elements: polynomial 0x11b, generator 3 --------------------------------------------------------


def _tables() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 510, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    return exp, log


_EXP, _LOG = _tables()


def _lookup(table: list[int], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in table]), i + 1)


def field_product(a: Column, b: Column) -> Column:
    both = _lookup(_EXP, _lookup(_LOG, a) + _lookup(_LOG, b))
    return F.when((a == 0) | (b == 0), 0).otherwise(both)


def times(a: Column, by: int) -> Column:
    """The product with a constant: one look into its table."""
    return _lookup([0 if not v or not by else _EXP[_LOG[v] + _LOG[by]] for v in range(256)], a)


def field_quotient(a: Column, b: Column) -> Column:
    return F.when(a == 0, 0).otherwise(_lookup(_EXP, _lookup(_LOG, a) + 255 - _lookup(_LOG, b)))


def share_of(secret: Column, coefficients: Column, x: int) -> Column:
    """The share at ``x``: per secret byte the polynomial with that constant and the given coefficients.

    ``coefficients``: array (one entry per byte) of arrays of the higher coefficients, lowest first.
    """
    return F.zip_with(
        secret,
        coefficients,
        lambda s, c: F.aggregate(F.reverse(c), F.lit(0), lambda acc, k: times(acc.bitwiseXOR(k), x)).bitwiseXOR(s),
    )


def combined(shares: list[tuple[int, Column]]) -> Column:
    """The secret from shares at different x, by interpolation at 0."""
    out = None
    for xi, y in shares:
        num = den = 1
        for xj, _ in shares:
            if xj != xi:
                num = _EXP[(_LOG[num] + _LOG[xj]) % 255]
                den = _EXP[(_LOG[den] + _LOG[xi ^ xj]) % 255]
        w = _EXP[(_LOG[num] - _LOG[den]) % 255]
        term = _scaled(y, w)
        out = term if out is None else F.zip_with(out, term, lambda a, b: a.bitwiseXOR(b))
    return out


def _scaled(values: Column, by: int) -> Column:
    return F.transform(values, lambda b: times(b, by))


def share_text(x: int, y: Column) -> Column:
    """Hexadecimal: the index byte, then the share."""
    return F.concat(F.lit(f"{x:02x}"), F.array_join(F.transform(y, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), ""))


def parsed_share(text: Column) -> Column:
    all_bytes = octets(F.unhex(text))
    return F.struct(F.element_at(all_bytes, 1).alias("x"), F.slice(all_bytes, F.lit(2), F.size(all_bytes) - 1).alias("y"))


# ---- headers ---------------------------------------------------------------------------------------------------------


def octets_text(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _figure(data: Column, at: int | Column, size: int, little: bool) -> Column:
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    h = F.hex(F.substring(data, start, F.lit(size)))
    if little:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(h, 16, 10).cast("bigint")


#: The fields of the executable's header, two bytes each, in order.
MZ_FIELDS = "magic cblp_lastpage cp_pages crlc_reloc cparhdr minalloc maxalloc ss sp csum ip cs lfarlc ovno".split()
#: Signatures of newer executables.
NEW_SIGNATURES = ["NE", "LE", "LX", "PE", "W3"]


def mz_header(data: Column) -> Column:
    """The header's figures and the size of the load module; null where the file is shorter than a header."""
    f = {k: _figure(data, 2 * i, 2, True) for i, k in enumerate(MZ_FIELDS) if i}
    full = F.when(f["cblp_lastpage"] == 0, f["cp_pages"] * 512).otherwise((f["cp_pages"] - 1) * 512 + f["cblp_lastpage"])
    return F.when(
        F.length(data) >= 0x40, F.struct(*[v.alias(k) for k, v in f.items()], full.alias("load_size"))
    )


def executable_kind(data: Column) -> Column:
    """raw, MZ, or the signature of a newer header; with ? where it was found by searching the stub."""
    at = _figure(data, 0x3C, 4, True)
    named = octets_text(F.substring(data, (at + 1).cast("int"), F.lit(2)))
    probes = F.sequence(F.lit(0x40), F.greatest(F.lit(0x40), F.least(F.length(data), F.lit(0x400)) - 2), F.lit(0x10))
    hits = F.filter(
        F.transform(probes, lambda p: octets_text(F.substring(data, p + 1, F.lit(2)))), lambda s: s.isin(NEW_SIGNATURES)
    )
    mz = octets_text(F.substring(data, 1, 2)) == "MZ"
    return (
        F.when((F.length(data) < 0x40) | ~mz, "raw")
        .when((at > 0) & (at + 2 <= F.length(data)) & named.isin(NEW_SIGNATURES), named)
        .when(F.size(hits) > 0, F.concat(F.element_at(hits, 1), F.lit("?")))
        .otherwise("MZ")
    )


def png_size(data: Column) -> Column:
    ok = (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (octets_text(F.substring(data, 13, 4)) == "IHDR")
    size = F.struct(_figure(data, 16, 4, False).alias("width"), _figure(data, 20, 4, False).alias("height"))
    return F.when((F.length(data) >= 24) & ok, size)


def ascii_runs(data: Column, least: int) -> Column:
    """Runs of printable characters."""
    return F.regexp_extract_all(octets_text(data), F.lit(f"([ -~]{{{least},}})"), F.lit(1))


# ---- sequential scans: Arrow batches ---------------------------------------------------------------------------------


def _runs(data: bytes, least: int) -> list[dict]:
    out, start = [], None
    for i, b in enumerate(data + b"\x00"):
        if 32 <= b < 127:
            start = i if start is None else start
        elif start is not None:
            if i - start >= least:
                out.append({"at": start, "text": data[start:i].decode("latin1")})
            start = None
    return out


def ascii_strings(least: int):
    """Printable runs with their offsets."""

    @F.pandas_udf("array<struct<at:int,text:string>>")
    def scan(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else _runs(bytes(d), least))

    return scan


def _prefixed(data: bytes, least: int) -> list[dict]:
    out, i = [], 0
    while i < len(data) - 1:
        n = data[i]
        text = data[i + 1 : i + 1 + n]
        if least <= n and 1 <= n <= 100 and len(text) == n and all(32 <= b < 127 or b == 9 for b in text):
            out.append({"at": i, "text": text.decode("latin1")})
            i += n
        i += 1
    return out


def length_prefixed_strings(least: int):
    """Texts led by their length (1 to 100), each consumed once found."""

    @F.pandas_udf("array<struct<at:int,text:string>>")
    def scan(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else _prefixed(bytes(d), least))

    return scan


def packed_names(data: Column) -> Column:
    """Names packed with the top bit of their last letter set; other bytes end a name too. Catalyst: the top bits
    are cleared by marking, and names are what lies between marks."""
    marked = F.aggregate(
        octets(data),
        F.lit(""),
        lambda acc, b: F.concat(
            acc,
            F.when(b >= 128, F.concat(F.when(F.chr(b - 128).rlike("[A-Za-z]"), F.chr(b - 128)).otherwise(""), F.lit(" ")))
            .when(F.chr(b).rlike("[A-Za-z]"), F.chr(b))
            .otherwise(" "),
        ),
    )
    return F.filter(F.split(marked, " "), lambda w: w != "")


def _jpeg(data: bytes) -> dict | None:
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0x01, 0xD8) or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return {"width": width, "height": height}
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def jpeg_size(data: Column) -> Column:
    """struct(width, height) of a picture, both null where it is none."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(batch: pd.Series) -> pd.DataFrame:
        found = [(_jpeg(bytes(d)) if d is not None else None) or {"width": None, "height": None} for d in batch]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return size(data)


def _bdecode(data: bytes, at: int = 0):
    lead = data[at : at + 1]
    if lead == b"i":
        end = data.index(b"e", at)
        return int(data[at + 1 : end]), end + 1
    if lead in (b"l", b"d"):
        items, at = [], at + 1
        while data[at : at + 1] != b"e":
            v, at = _bdecode(data, at)
            items.append(v)
        return (items if lead == b"l" else dict(zip(items[::2], items[1::2], strict=True))), at + 1
    colon = data.index(b":", at)
    n = int(data[at:colon])
    text = data[colon + 1 : colon + 1 + n]
    if len(text) < n:
        raise ValueError("truncated")
    return text.decode("latin1"), colon + 1 + n


def _bencode_json(d: bytes | None) -> str | None:
    try:
        return None if d is None else json.dumps(_bdecode(bytes(d))[0], sort_keys=True)
    except (ValueError, IndexError, TypeError):
        return None


def bencode_json(data: Column) -> Column:
    """Bencoded bytes as JSON text; null where they are broken."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(_bencode_json)

    return decode(data)


def json_safe(data: Column, limit: int = 4096) -> Column:
    """Bytes for a JSON document: ASCII as text, else base64; long ones by their size."""
    text = F.regexp_replace(octets_text(data), "\\x00+$", "")
    return (
        F.when(F.length(data) > limit, F.concat(F.lit("<"), F.length(data).cast("string"), F.lit(" bytes>")))
        .when(text.rlike(r"^[\x00-\x7f]*$"), text)
        .otherwise(F.concat(F.lit("base64:"), F.regexp_replace(F.base64(data), r"[\r\n]", "")))
    )
