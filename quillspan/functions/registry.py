"""Named column functions, for pipelines that are described by names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import ciphers as cp
from quillspan.functions import text as tx

RECIPES: dict[str, Callable[..., Column]] = {}


def recipe(name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in RECIPES:
            raise ValueError(f"{name} exists")
        RECIPES[name] = f
        return f

    return add


recipe("rot13")(lambda c: tx.rotated(c, 13))
recipe("caesar")(lambda c, by=3: tx.rotated(c, by))
recipe("atbash")(lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA"))
recipe("rot5")(lambda c: F.translate(c, "0123456789", "5678901234"))
recipe("rot18")(lambda c: F.translate(tx.rotated(c, 13), "0123456789", "5678901234"))
recipe("reverse")(F.reverse)
recipe("base64")(lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", ""))
recipe("hex")(lambda c: F.lower(F.hex(F.encode(c, "UTF-8"))))
recipe("crc16")(lambda c: by.crc16(F.encode(c, "UTF-8")).cast("string"))
recipe("sha256")(lambda c: F.sha2(c, 256))
recipe("slug")(lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"))
for _name in ("vigenere", "beaufort", "variant_beaufort", "gronsfeld", "autokey", "affine", "keyed_caesar", "rot47", "a1z26", "from_a1z26",
              "baconian", "polybius", "pig_latin", "rail_fence", "columnar", "double_transposition", "rotated_by"):
    recipe(_name)(getattr(cp, _name))
for _name in ("base85", "base32", "as_integer"):
    recipe(_name)(lambda c, f=getattr(cp, _name): f(F.encode(c, "UTF-8")))
recipe("base58")(lambda c: cp.based(F.encode(c, "UTF-8")))
recipe("base62")(lambda c: cp.based(F.encode(c, "UTF-8"), cp.BASE62))


def cooked(c: Column, steps: list[tuple]) -> Column:
    """``c`` through the named steps: (name, *arguments)."""
    for name, *args in steps:
        c = RECIPES[name](c, *args)
    return c
