import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import numbers as nm
from quillspan.functions import syllables as sy
from quillspan.functions import text as tx
from quillspan.functions.registry import RECIPES, cooked, recipe

#: Expected syllables, by what they show.
WORDS = {
    # vowel groups, silent and sounded e
    "lantern": 2, "harbour": 2, "stone": 1, "grove": 1, "candle": 2, "timbre": 2, "degree": 2, "yellow": 2, "rhyme": 1, "hymn": 1, "nth": 1,
    # -ed and -es
    "climbed": 1, "painted": 2, "guided": 2, "rattled": 2, "rolled": 1, "roses": 2, "bridges": 2, "matches": 2, "pebbles": 2, "stones": 1,
    # silent e inside
    "homely": 2, "careless": 2, "statement": 2, "moonlight": 2, "firelight": 2, "lakeside": 2, "homesick": 2, "lifelong": 2, "lifer": 2,
    # two vowels that are two syllables, and such that are one
    "violin": 3, "dial-up": (2, 3), "mania": 3, "social": 2, "curio": 3, "mission": 2, "neon": 2, "surgeon": 2, "gradual": 3, "iguana": 3,
    "cruelty": 3, "druid": 2, "suit": 1, "stadium": 3, "arduous": 3, "stoically": 4, "variety": 4, "cloudier": 3, "cashier": 2, "drying": 2,
    "spasm": 2, "logarithm": 4, "saviour": 2, "peculiar": 3,
    # exceptions, their stems, contractions, figures, marks
    "fire": (1, 2), "fire's": (1, 2), "create": 2, "poetry": 3, "naked": 2, "someone": 2, "eye": 1, "flower": 2, "aren't": (1, 2), "mustn't": 2,
    "heron's": 2, "they'll": 1, "22nd": 3, "80s": 2, "40-page": 3, "thirty-one": 3, "-": 0, "?!": 0,
}


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_kind(v)}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0], names


def _kind(v):
    return {str: "string", bytes: "binary", int: "long", float: "double", type(None): "string"}[type(v)]


def test_words(spark):
    got = {r.word: (r.lo, r.hi) for r in sy.word_syllables(spark.createDataFrame([(w,) for w in WORDS], "word string")).collect()}
    assert {w: r for w, r in got.items() if r != (WORDS[w] if isinstance(WORDS[w], tuple) else (WORDS[w],) * 2)} == {}


def test_words_take_a_table_of_exceptions_and_a_dictionary(spark, monkeypatch):
    mine = spark.createDataFrame([("pond", 9, 9)], "word string, lo int, hi int")
    dic = spark.createDataFrame([("pond", 5, 5), ("frog", 4, 5)], "word string, lo int, hi int")
    w = spark.createDataFrame([("pond",), ("frog",), ("frog's",)], "word string")
    want = {"pond": (9, 9), "frog": (4, 5), "frog's": (4, 5)}
    assert {r.word: (r.lo, r.hi) for r in sy.word_syllables(w, mine, dic).collect()} == want
    monkeypatch.setattr(sy, "MOST_IN_ROW", 0)
    assert {r.word: (r.lo, r.hi) for r in sy.word_syllables(w, mine, dic).collect()} == want


def test_words_joined_to_a_table_are_counted_like_words_in_rows(spark):
    w = spark.createDataFrame([(w,) for w in WORDS], "word string")
    a, b = sy.word_syllables(w), sy.joined_syllables(w, None, None)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("text,want", [("14", (2, 2)), ("7", (2, 2)), ("1999", (5, 5)), ("2005", (4, 4)), ("2023", (5, 6)), ("12345", (5, 5)), ("", (1, 1))])
def test_numerals(spark, text, want):
    r, _ = one(spark, sy.of_number(F.col("t")), t=text)
    assert (r["lo"], r["hi"]) == want


def test_lines_and_their_explanation(spark):
    df = spark.createDataFrame([(1, "An old silent pond"), (2, "Splash! Silence again."), (3, ""), (4, None)], "k int, text string")
    out = {r.k: r for r in sy.line_syllables(df, ["k"]).withColumn("e", sy.explained(F.col("breakdown"))).collect()}
    assert out[1].e == "An(1) old(1) silent(2) pond(1) = 5" and (out[2].syl_lo, out[2].syl_hi) == (5, 5)
    assert [(out[k].syl_lo, out[k].word_count) for k in (3, 4)] == [(0, 0), (0, 0)]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="frost—late spring; ‘kettle’ don't -x-")[0] == ["frost", "late", "spring", "kettle", "don't", "x"]


@pytest.mark.parametrize(
    "text,dated",
    [(t, True) for t in ("sat by the stove", "8 Aug.", "the 21st of september", "Oct 1987", "1.2.34", "2041/6/30", "(2010)", "at 16:20 h")]
    + [(t, False) for t in ("august and old", "march on, heron", "1066 and all that", "12:30 the ferry left the quay again")],
)
def test_dates(spark, text, dated):
    assert one(spark, tx.is_date_like(F.col("t")), t=text)[0] is dated


@pytest.mark.parametrize(
    "words,text,dropped",
    [
        ([("|", 71), ("gulls", 88), ("over", 93), ("slate", 95), ("¬", 40), ("rf", 12)], "gulls over slate", ["|", "rf", "¬"]),
        ([("Go", 8), ("we", 15), ("*", 2), ("must", 91), ("by", 4)], "Go we * must by", []),
        ([("==", 3), ("+", 0)], None, None),
        ([], None, None),
        ([("ok", None)], "ok", []),
    ],
)
def test_junk_edges(spark, words, text, dropped):
    df = spark.createDataFrame([([(a, None if b is None else float(b)) for a, b in words],)], "w array<struct<text:string,conf:double>>")
    r = df.select(tx.trimmed_words(F.col("w")).alias("x")).first().x
    assert (r and r["text"], r and r["dropped"]) == (text, dropped)


def test_families(spark):
    paths = {
        "a/Radar Scope (3).html": "radar-scope",
        "radar_scope-1700000000000.html": "radar-scope",
        "radar-scope-2024-05-01T10-20.htm": "radar-scope",
        "radar-scope-v12.html": "radar-scope",
        "radar-scope-final-fixed.html": "radar-scope",
        "copy.html": "untitled",
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", tx.family(F.col("p"))).collect()} == paths


def test_titles(spark):
    assert one(spark, tx.title(F.col("t")), t="<html><TITLE lang=en>\n A  b\tc </TITLE><title>no</title>")[0] == "A b c"
    assert one(spark, tx.title(F.col("t")), t=None)[0] == ""


def test_property_bags(spark):
    bag, _ = one(spark, tx.property_bag(F.col("t")), t="bbox 1 2.9 3 4; x_wconf 91;; bbox 5 6 7 8")
    assert bag == {"x_wconf": ["91"], "bbox": ["5", "6", "7", "8"]}
    assert one(spark, tx.bbox_of(tx.property_bag(F.col("t"))), t="bbox 1 2.9 x 4")[0] is None
    assert tuple(one(spark, tx.bbox_of(tx.property_bag(F.col("t"))), t="bbox 1 2.9 3 4")[0]) == (1, 2, 3, 4)


def test_replies(spark):
    for t in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} there'):
        assert one(spark, F.get_json_object(tx.unfenced_json(F.col("t")), "$.a"), t=t)[0] == "1"
    assert one(spark, tx.unfenced_json(F.col("t")), t="no object [1]")[0] is None
    assert one(spark, tx.reply_text(F.col("t")), t='{"choices":[{"message":{"content":"hi"}}]}')[0] == "hi"
    assert one(spark, tx.reply_text(F.col("t")), t='{"content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}]}')[0] == "ab"


def test_hygiene(spark):
    assert one(spark, tx.safe_color(F.col("t")), t=" #a1b2c3 ")[0] == "#a1b2c3"
    assert one(spark, tx.safe_color(F.col("t")), t="rgba(1, 2, 3, .5)")[0] and one(spark, tx.safe_color(F.col("t")), t="red;x")[0] is None
    assert one(spark, tx.safe_id(F.col("t")), t="__proto__")[0] is None and one(spark, tx.safe_text(F.col("t"), 3), t="<a>bcd")[0] == "abc"
    assert one(spark, tx.plain_text(F.col("t"), 0x5A), t="a$b~cé")[0] == "abc?"


def test_crc_and_xor(spark):
    assert one(spark, by.crc16(F.col("b")), b=b"123456789")[0] == 0x4B37
    assert one(spark, by.xored(F.col("b"), 0x5A), b=b"a$b")[0] == bytes([ord("a") ^ 0x5A, 0x24, ord("b") ^ 0x5A])


def test_base64_lines_and_fixity(spark):
    data = bytes(range(256)) * 2
    text, _ = one(spark, by.wrapped_base64(F.col("b")), b=data)
    assert max(map(len, text.split("\n"))) == 76 and not text.endswith("\n")
    assert one(spark, by.intact(by.wrapped_base64(F.col("b")), F.lit(hashlib.sha256(data).hexdigest())), b=data)[0] is True
    assert one(spark, by.intact(by.wrapped_base64(F.col("b")), F.lit("0" * 64)), b=data)[0] is False


def test_shared_secret_from_any_three(spark):
    rng = random.Random(3)
    secret = [rng.randrange(256) for _ in range(20)]
    coeff = [[rng.randrange(256) for _ in range(2)] for _ in secret]
    df = spark.createDataFrame([(secret, coeff)], "s array<int>, c array<array<int>>")
    xs = [1, 2, 77, 255]
    df = df.select("s", *[by.share_of(F.col("s"), F.col("c"), x).alias(f"y{x}") for x in xs])
    for three in ((1, 2, 77), (255, 77, 2), (1, 255, 2)):
        assert df.select(by.combined([(x, F.col(f"y{x}")) for x in three])).first()[0] == secret


def test_headers(spark):
    mz = bytearray(0x100)
    mz[:28] = struct.pack("<2s13H", b"MZ", 0, 3, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)
    mz[0x3C:0x40] = struct.pack("<I", 0x80)
    mz[0x80:0x82] = b"NE"
    r, _ = one(spark, by.mz_header(F.col("b")), b=bytes(mz))
    assert (r["cp_pages"], r["load_size"], r["ovno"]) == (3, 1536, 13)
    assert one(spark, by.executable_kind(F.col("b")), b=bytes(mz))[0] == "NE"
    mz[0x3C:0x40] = b"\0" * 4
    assert one(spark, by.executable_kind(F.col("b")), b=bytes(mz))[0] == "NE?"
    mz[0x80:0x82] = b"\0\0"
    assert one(spark, by.executable_kind(F.col("b")), b=bytes(mz))[0] == "MZ"
    assert one(spark, by.executable_kind(F.col("b")), b=b"MZ")[0] == "raw" and one(spark, by.mz_header(F.col("b")), b=b"MZ")[0] is None
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 300, 200)
    assert tuple(one(spark, by.png_size(F.col("b")), b=png)[0]) == (300, 200)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx\xff\xc0" + struct.pack(">HBHH", 17, 8, 50, 60) + b"\0" * 9
    assert tuple(one(spark, by.jpeg_size(F.col("b")), b=jpg)[0]) == (60, 50)


def test_scans(spark):
    data = b"\x05hello\x00abc\x7fworld!\x03one"
    assert [(r["at"], r["text"]) for r in one(spark, by.length_prefixed_strings(3)(F.col("b")), b=data)[0]] == [(0, "hello"), (17, "one")]
    assert [(r["at"], r["text"]) for r in one(spark, by.ascii_strings(4)(F.col("b")), b=data)[0]] == [(1, "hello"), (11, "world!")]
    assert one(spark, by.packed_names(F.col("b")), b=b"ca" + bytes([ord("t") | 0x80]) + b"dog1fo" + bytes([0xFF]) + b"x")[0] == ["cat", "dog", "fo", "x"]


def test_bencode(spark):
    assert one(spark, by.bencode_json(F.col("b")), b=b"d1:ali-3e2:hie1:b4:spame")[0] == '{"a": [-3, "hi"], "b": "spam"}'
    assert one(spark, by.bencode_json(F.col("b")), b=b"d1:a")[0] is None


def test_hexdump(spark):
    got, _ = one(spark, tx.hexdump(F.col("b")), b=b"0123456789abcdef\x00z")
    assert got.split("\n")[0] == "00000  30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66  |0123456789abcdef|"
    assert got.split("\n")[1].startswith("00010  00 7a ") and got.endswith("|.z|")
    assert one(spark, tx.hexdump(F.col("b"), most=16), b=b"x" * 20)[0].endswith("... truncated (20 bytes total)")


def test_band_rms(spark):
    wave = [8.3 * math.sin(2 * math.pi * 10 * i / 256) for i in range(300)]
    df = spark.createDataFrame([(wave,), (wave[:10],)], "s array<double>")
    full, short = [r[0] for r in df.select(nm.band_rms(F.col("s"), 256, 8, 12)).collect()]
    assert short is None and abs(full - 8.3 / math.sqrt(2 * 5)) < 1e-6


def test_small_rules(spark):
    assert one(spark, nm.clock_usable(F.lit(True), F.col("u"), 80), u=80)[0] is True
    assert one(spark, nm.clock_usable(F.lit(True), F.col("u"), 79), u=80)[0] is False
    assert one(spark, nm.clock_usable(F.lit(None).cast("boolean"), F.col("u"), 80), u=1)[0] is False
    assert one(spark, nm.pitch_hz(F.col("n")), n=69)[0] == 440.0
    assert one(spark, nm.record_payload(F.col("n"), F.lit(100)), n=21 + 250)[0] == 250 - 17 * 3


def test_recipes(spark):
    assert one(spark, cooked(F.col("t"), [("rot13",), ("rot13",), ("caesar", 2)]), t="abz")[0] == "cdb"
    with pytest.raises(ValueError):
        recipe("rot13")(lambda c: c)
    assert set(RECIPES) >= {"rot18", "atbash", "hex"}


def test_bytes_for_json(spark):
    assert one(spark, by.json_safe(F.col("b")), b=b"plain\x00\x00")[0] == "plain"
    assert one(spark, by.json_safe(F.col("b")), b=b"\xff\x00")[0] == "base64:/wA="
    assert one(spark, by.json_safe(F.col("b"), 3), b=b"12345")[0] == "<5 bytes>"


def test_word_syllables_reads_documents_of_any_lang(spark, tmp_path):
    from quillspan.plans import text

    docs = [(1, "en", "heron"), (2, "en-GB", "colour"), (3, None, "marsh"), (4, "und", "willow"), (5, "fr", "orage")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.word for r in text.QUERIES["word_syllables"](spark, str(tmp_path)).collect()} == {"heron", "colour", "marsh", "willow", "orage"}
