"""Classical ciphers and encodings as columns. Text ciphers change the letters A to Z in either case and keep all else in
place; the key goes on with letters only. Null gives null, '' gives ''."""

from __future__ import annotations

import base64
from collections.abc import Callable
from string import ascii_lowercase as LOWER
from string import ascii_uppercase as UPPER

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import let

#: Alphabets of the number encodings.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789" + UPPER + LOWER


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z])"), F.lit(1))


def _code(letter: Column) -> Column:
    """0 for a or A."""
    return F.ascii(F.lower(letter)) - 97


def _letter(code: Column, like: Column) -> Column:
    """The letter of a code, in the case of ``like``."""
    c = F.pmod(code, F.lit(26))
    return F.chr((c + F.when(F.ascii(like) < 97, 65).otherwise(97)).cast("bigint"))


def _put_back(text: Column, letters: Column) -> Column:
    """``text`` with its letters replaced, in order: what lies between them stays."""
    between = F.split(text, "[A-Za-z]", -1)
    return F.array_join(F.zip_with(between, F.array_append(letters, F.lit("")), lambda a, b: F.concat(a, b)), "")


def _shifted(text: Column, code: Callable[[Column, Column], Column]) -> Column:
    """Every letter by ``code`` of its own code and its number among the letters."""
    return let(text, lambda t: _put_back(t, F.transform(_letters(t), lambda c, i: _letter(code(_code(c), i), c))))


def _keyed(key: list[int], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in key]), F.pmod(i, F.lit(len(key))) + 1)


def _codes(key: str) -> list[int]:
    out = [ord(c) - 97 for c in key.lower() if c in LOWER]
    if not out:
        raise ValueError("the key has no letters")
    return out


def vigenere(text: Column, key: str, back: bool = False) -> Column:
    k = _codes(key)
    return _shifted(text, lambda c, i: c - _keyed(k, i) if back else c + _keyed(k, i))


def beaufort(text: Column, key: str) -> Column:
    """Key minus text: its own inverse."""
    return _shifted(text, lambda c, i: _keyed(_codes(key), i) - c)


def variant_beaufort(text: Column, key: str, back: bool = False) -> Column:
    return vigenere(text, key, not back)


def gronsfeld(text: Column, key: str, back: bool = False) -> Column:
    return vigenere(text, "".join(LOWER[int(d)] for d in key), back)


def autokey(text: Column, key: str, back: bool = False) -> Column:
    """The key, then the plain text itself."""
    k = _codes(key)
    n, first = len(k), F.array(*[F.lit(v) for v in k])

    def spoken(letters: Column, codes: Column) -> Column:
        return F.transform(letters, lambda c, i: _letter(F.element_at(codes, i + 1), c))

    def there(letters: Column) -> Column:
        stream = F.concat(first, F.transform(letters, _code))
        return let(F.zip_with(F.transform(letters, _code), F.slice(stream, F.lit(1), F.size(letters)), lambda c, s: c + s), lambda x: spoken(letters, x))

    def home(letters: Column) -> Column:
        plain = F.aggregate(
            F.transform(letters, _code), first, lambda a, c: F.array_append(a, F.pmod(c - F.element_at(a, F.size(a) - n + 1), F.lit(26)))
        )
        return let(F.slice(plain, F.lit(n + 1), F.size(letters)), lambda x: spoken(letters, x))

    return let(text, lambda t: _put_back(t, let(_letters(t), home if back else there)))


def affine(text: Column, a: int, b: int, back: bool = False) -> Column:
    """a x + b; ``a`` must have no factor in common with 26."""
    inverse = pow(a, -1, 26)
    return _shifted(text, lambda c, _: (c - b + 26) * inverse if back else c * a + b)


def rotated_by(text: Column, n: int, digits: bool = False) -> Column:
    out = _shifted(text, lambda c, _: c + n)
    turned = "".join(str((d + n) % 10) for d in range(10))
    return F.translate(out, "0123456789", turned) if digits else out


def keyword_alphabet(keyword: str) -> str:
    return "".join(dict.fromkeys([c for c in keyword.lower() if c in LOWER] + list(LOWER)))


def keyed_caesar(text: Column, keyword: str, shift: int = 0, back: bool = False) -> Column:
    """By an alphabet that begins with the keyword, turned by ``shift``."""
    alphabet = keyword_alphabet(keyword)
    turned = alphabet[shift % 26 :] + alphabet[: shift % 26]
    plain, secret = LOWER + UPPER, turned + turned.upper()
    return F.translate(text, secret, plain) if back else F.translate(text, plain, secret)


def rot47(text: Column) -> Column:
    plain = "".join(map(chr, range(33, 127)))
    return F.translate(text, plain, plain[47:] + plain[:47])


def a1z26(text: Column) -> Column:
    return F.array_join(F.transform(_letters(text), lambda c: (_code(c) + 1).cast("string")), "-")


def from_a1z26(text: Column) -> Column:
    figures = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.array_join(F.transform(figures, lambda d: F.chr((d.cast("int") + 96).cast("bigint"))), "")


def baconian(text: Column) -> Column:
    """Five letters a or b for each letter."""
    return F.array_join(F.transform(_letters(text), lambda c: F.translate(F.lpad(F.bin(_code(c).cast("bigint")), 5, "0"), "01", "ab")), " ")


def polybius(text: Column) -> Column:
    """Row and column in the square of 25 letters; j is i."""
    square = LOWER.replace("j", "")
    at = lambda c: F.instr(F.lit(square), F.translate(F.lower(c), "j", "i")) - 1
    place = lambda c: F.concat((F.floor(at(c) / 5) + 1).cast("string"), (at(c) % 5 + 1).cast("string"))
    return F.array_join(F.transform(_letters(text), place), " ")


def pig_latin(text: Column) -> Column:
    """Leading consonants to the end and ay; yay after a vowel."""
    words = F.split(text, r"(?<=[^A-Za-z])|(?=[^A-Za-z])", -1)

    def word(w: Column) -> Column:
        return (
            F.when(w.rlike("(?i)^[aeiou][a-z]*$"), F.concat(w, F.lit("yay")))
            .when(w.rlike("(?i)^[a-z]+$"), F.concat(F.regexp_replace(w, "(?i)^([^aeiou]+)(.*)$", "$2$1"), F.lit("ay")))
            .otherwise(w)
        )

    return F.array_join(F.transform(words, word), "")


# ---- transpositions --------------------------------------------------------------------------------------------------


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _by(text: Column, place: Callable[[Column], Column], back: bool) -> Column:
    """Characters in the order of ``place`` of their number (ties: as they stand), or the way back."""

    def moved(chars: Column) -> Column:
        keyed = F.transform(chars, lambda c, i: F.struct(place(i).alias("p"), i.alias("i"), c.alias("c")))
        if not back:
            return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "")
        home = F.zip_with(F.array_sort(keyed), chars, lambda s, c: F.struct(s["i"].alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(home), lambda s: s["c"]), "")

    return let(_chars(text), moved)


def rail_fence(text: Column, rails: int, back: bool = False) -> Column:
    if rails < 2:
        return text
    turn = 2 * rails - 2
    return _by(text, lambda i: F.least(i % turn, turn - i % turn), back)


def columnar(text: Column, key: str, back: bool = False) -> Column:
    """Written in rows under the key, read in columns in the order of its letters; the last row may be short."""
    rank = [sorted(range(len(key)), key=lambda j: (key.lower()[j], j)).index(j) for j in range(len(key))]
    return _by(text, lambda i: _keyed(rank, i), back)


def double_transposition(text: Column, first: str, second: str, back: bool = False) -> Column:
    a, b = (second, first) if back else (first, second)
    return columnar(columnar(text, a, back), b, back)


# ---- numbers: Arrow batches ------------------------------------------------------------------------------------------


def _mapped(f: Callable[[bytes], str], data: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda d: None if d is None else f(bytes(d)))

    return run(data)


def _in_base(alphabet: str) -> Callable[[bytes], str]:
    def encode(d: bytes) -> str:
        n, out = int.from_bytes(d), ""
        while n:
            n, r = divmod(n, len(alphabet))
            out = alphabet[r] + out
        return alphabet[0] * (len(d) - len(d.lstrip(b"\x00"))) + out

    return encode


def _of_base(alphabet: str) -> Callable[[str], bytes | None]:
    at = {c: i for i, c in enumerate(alphabet)}

    def decode(t: str) -> bytes | None:
        n = 0
        for c in t:
            if c not in at:
                return None
            n = n * len(alphabet) + at[c]
        zeros = len(t) - len(t.lstrip(alphabet[0]))
        return bytes(zeros) + n.to_bytes((n.bit_length() + 7) // 8)

    return decode


def based(data: Column, alphabet: str = BASE58) -> Column:
    """Bytes as a number in the base of the alphabet; leading zero bytes are its first letter."""
    return _mapped(_in_base(alphabet), data)


def unbased(text: Column, alphabet: str = BASE58) -> Column:
    """The bytes back; null for other characters."""
    decode = _of_base(alphabet)

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else decode(t))

    return run(text)


def base85(data: Column) -> Column:
    return _mapped(lambda d: base64.a85encode(d).decode(), data)


def base32(data: Column) -> Column:
    return _mapped(lambda d: base64.b32encode(d).decode(), data)


def as_integer(data: Column) -> Column:
    """The bytes as one decimal number."""
    return _mapped(lambda d: str(int.from_bytes(d)), data)
