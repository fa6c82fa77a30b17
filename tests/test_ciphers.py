import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import ciphers as cp
from quillspan.functions.registry import RECIPES, cooked

TEXTS = ["Attack at Dawn!", "", "a", "The 3 old herons, by the marsh.", "ÄöZz-9 xY", "AbCdEfGhIjKlMnOpQrStUvWxYz" * 40, None]


def run(spark, f, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    return [r.x for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "there,back",
    [
        (lambda c: cp.vigenere(c, "Lemon"), lambda c: cp.vigenere(c, "lemon", True)),
        (lambda c: cp.beaufort(c, "fort"), lambda c: cp.beaufort(c, "fort")),
        (lambda c: cp.variant_beaufort(c, "fort"), lambda c: cp.vigenere(c, "fort")),
        (lambda c: cp.gronsfeld(c, "31415"), lambda c: cp.gronsfeld(c, "31415", True)),
        (lambda c: cp.autokey(c, "queen"), lambda c: cp.autokey(c, "queen", True)),
        (lambda c: cp.affine(c, 5, 8), lambda c: cp.affine(c, 5, 8, True)),
        (lambda c: cp.keyed_caesar(c, "zebra", 3), lambda c: cp.keyed_caesar(c, "zebra", 3, True)),
        (cp.rot47, cp.rot47),
        (lambda c: cp.rotated_by(c, 7, True), lambda c: cp.rotated_by(c, -7, True)),
        (lambda c: cp.rail_fence(c, 3), lambda c: cp.rail_fence(c, 3, True)),
        (lambda c: cp.columnar(c, "zebra"), lambda c: cp.columnar(c, "zebra", True)),
        (lambda c: cp.double_transposition(c, "zebra", "stripe"), lambda c: cp.double_transposition(c, "zebra", "stripe", True)),
        (lambda c: cp.based(F.encode(c, "UTF-8")), lambda c: F.decode(cp.unbased(c), "UTF-8")),
    ],
)
def test_there_and_back(spark, there, back):
    assert run(spark, lambda c: back(there(c))) == TEXTS


def test_known_answers(spark):
    one = lambda f, t: run(spark, f, [t])[0]
    assert one(lambda c: cp.vigenere(c, "lemon"), "attackatdawn") == "lxfopvefrnhr"
    assert one(lambda c: cp.autokey(c, "queenly"), "attackatdawn") == "qnxepvytwtwp"
    assert one(lambda c: cp.affine(c, 5, 8), "affine cipher") == "ihhwvc swfrcp"
    assert one(lambda c: cp.rail_fence(c, 3), "wearediscoveredfleeatonce") == "wecrlteerdsoeefeaocaivden"
    assert one(lambda c: cp.columnar(c, "zebra"), "abcdefghijkl") == "ejchbgldiafk"
    assert one(cp.a1z26, "Hi, Zed") == "8-9-26-5-4" and one(cp.from_a1z26, "8-9 26") == "hiz"
    assert one(cp.baconian, "Ab z") == "aaaaa aaaab bbaab" and one(cp.polybius, "jam") == "24 11 32"
    assert one(cp.pig_latin, "The old string, by 2 apples") == "eThay oldyay ingstray, byay 2 applesyay"
    assert one(lambda c: cp.based(F.unhex(c)), "0000287FB4CD") == "11233QC4"
    assert one(lambda c: cp.base85(F.encode(c, "UTF-8")), "Man is") == base64.a85encode(b"Man is").decode()
    assert one(lambda c: cp.as_integer(F.encode(c, "UTF-8")), "ab") == "24930" and one(lambda c: cp.unbased(c), "0OIl") is None


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40))
def test_bases_round_trip(data):
    for alphabet in (cp.BASE58, cp.BASE62):
        assert cp._of_base(alphabet)(cp._in_base(alphabet)(data)) == data


def test_recipes_by_name(spark):
    assert run(spark, lambda c: cooked(c, [("vigenere", "key"), ("vigenere", "key", True)])) == TEXTS
    assert {"base58", "base62", "base85", "a1z26", "rail_fence", "double_transposition", "pig_latin", "keyed_caesar"} <= set(RECIPES)
    with pytest.raises(ValueError):
        cp.vigenere(F.lit("x"), "123")
