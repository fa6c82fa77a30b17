import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import page_repair as pr

SCHEMA = "packet_id long, notebook_id long, page_no int, n int, par_size int, gap_before double, text string, received_at timestamp, label int"
NOTEBOOKS = [(1, "The Marsh Book", ["Winter Pages", "Second Part"]), (2, None, None)]
FILLER = "the heron watched the marsh and the willow near the orchard while everyone learned that the morning was cold and different"


def page(packet, no, lines, notebook=1):
    out = []
    for i, (text, size, gap) in enumerate(lines, 1):
        out.append((packet, notebook, no, i, size, None if i == 1 else gap, text, None, 9))
    return out


def body(*texts):
    return [(t, len(texts), 1.5 if i == 0 else 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def defects(spark):
    rows = []
    for k in range(60):  # enough pages for counts and for the layout
        no = k + 1
        rows += page(100, no, [("THE MARSH BOOK" if k % 2 else "Winter Pages", 1, None), *body(FILLER, FILLER, FILLER), *body(FILLER, FILLER), (f"— {40 + no} —", 1, 1.5)])
    rows += page(1, 1, [("the rnarsh 600k", 1, None), *body("the heron watched the mar-", "sh and the willow, said the salt-", "worn heron", "everyone leamed thc rnorning")])
    rows += page(2, 1, [*body("the heron watched the mea¬")]) + page(2, 2, [("winter pages", 1, None), ("[41]", 1, 1.5), *body("dow near the orchard")])
    rows += page(2, 3, [*body("Total so far:", "35")])
    rows += page(3, 1, body("the salt-worn heron", "salt-worn the marsh", "salt-worn and cold", "the quarryspool of Thalstead", "R14 and C7, the 3rd of 14a", "th^e orch;ard wa's c0ld"))
    rows += page(4, 1, [("", 1, None), (None, None, None), ("x" * 100_000, 1, 1.5)], notebook=99)
    rows += page(5, None, [("alone", None, None)], notebook=None) + [(5, 1, 1, None, None, None, "the heron", None, 9)]
    rows += page(1, 1, [("the rnarsh 600k", 1, None)])  # delivered again
    rows += page(6, 1, body("it ended with a cross-"))
    df = spark.createDataFrame(rows, SCHEMA)
    nb = spark.createDataFrame(NOTEBOOKS, "notebook_id long, title string, sections array<string>")
    return df, nb, {(r.packet_id, r.page_no, r.n, r.defect) for r in pr.found(df, nb).collect()}


def test_heads_and_numbers(defects):
    _, _, d = defects
    assert {x for x in d if x[0] == 100} == {(100, no, 1, "header") for no in range(1, 61)} | {(100, no, 7, "page_number") for no in range(1, 61)}
    assert (2, 2, 1, "header") in d and (2, 2, 2, "page_number") in d
    assert not {x for x in d if x[:2] == (2, 3)}


def test_broken_words(defects):
    _, _, d = defects
    assert {x[:3] for x in d if x[3] == "hyphen"} == {(1, 1, 2), (2, 1, 1)}


def test_misread_words(defects):
    _, _, d = defects
    got = {x[:3] for x in d if x[3] == "misread"}
    assert (1, 1, 5) in got and (3, 1, 6) in got
    assert not {(3, 1, i) for i in range(1, 6)} & got and not {x for x in got if x[0] in (4, 5, 6, 100)}


def test_paragraphs_read_on(defects):
    df, nb, _ = defects
    got = [r.text for r in pr.paragraphs(df.where("packet_id = 2 or packet_id = 100"), nb).where("packet_id = 2").orderBy("first_page", "first_n").collect()]
    assert got[0].startswith("the heron watched the meadow") and "winter" not in " ".join(got).lower()


def test_empty_tables(spark, defects):
    df, nb, _ = defects
    assert pr.found(df.limit(0), nb).count() == 0
    assert pr.found(df.where("packet_id = 3"), nb.limit(0)).where("defect = 'header'").count() == 0


def test_blocks_read_on_across_their_borders(spark):
    nb = spark.createDataFrame(NOTEBOOKS, "notebook_id long, title string, sections array<string>")
    rows = page(1, 63, body(FILLER, "the heron watched the wil=")) + page(1, 64, body("low near the orchard", FILLER))
    rows += [r for k in range(20) for r in page(2, k, body(FILLER, FILLER))]
    got = {(r.packet_id, r.page_no, r.n, r.defect) for r in pr.found(spark.createDataFrame(rows, SCHEMA), nb).collect()}
    assert got == {(1, 63, 2, "hyphen")}


def test_hash_is_the_engines(spark):
    for t in ("w:naïve", "p:abc", "s:" + "x" * 60):
        h = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
        assert h & (2**64 - 1) == xxhash.xxh64_intdigest(t.encode(), 42)


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(1)
    model = pr._prior()
    symbols = rng.integers(0, pr.SYMBOLS, 9)
    first = np.array([0, 4, 5])
    got = pr.decode(model, symbols, first)
    import itertools

    s, a, e = (np.log(x) for x in model)
    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        best = max(itertools.product(range(4), repeat=hi - lo), key=lambda p: s[p[0]] + e[p[0], symbols[lo]] + sum(a[p[i - 1], p[i]] + e[p[i], symbols[lo + i]] for i in range(1, hi - lo)))
        assert list(got[lo:hi]) == list(best)


def test_page_values():
    assert [pr._value(t, False) for t in ("— l2 —", "[49]", "xlvi", "36 / 180", ".1O.", "p. 7")] == [12, 49, 46, 36, 10, 7]
    assert pr._value("151 OF TRIBUNAL AND VISIT", True) == 151 and pr._value("Winter Pages", True) is None


def test_packets_read_on_across_every_border(spark, monkeypatch):
    """A long packet gives the same words and paragraphs in small blocks and slices as in one."""
    nb = spark.createDataFrame(NOTEBOOKS, "notebook_id long, title string, sections array<string>")
    tail = "everyone learned that the orch-"
    rows = []
    for k in range(60):
        rows += page(2, k, body(FILLER, FILLER))
    for no in (62, 63, 64, 66, 127, 130):  # a page is missing at 65 and at 128
        rows += page(1, no, [("Winter Pages", 1, None), *body("ard was cold and the wil-", "low near the marsh", FILLER, tail)])
    rows += page(1, 129, [("Winter Pages", 1, None)])  # a page without text
    rows += page(1, 192, body("ard was cold and the mar-")) + page(1, 256, body("sh was diffe-")) + page(1, 257, body("rcnt and cold.", FILLER))
    df = spark.createDataFrame(rows, SCHEMA)

    def run():
        d = sorted(tuple(r) for r in pr.found(df, nb).where("packet_id = 1").collect())
        p = sorted(tuple(r) for r in pr.paragraphs(df, nb).where("packet_id = 1").collect())
        return d, p

    small = run()
    monkeypatch.setattr(pr, "BLOCK_PAGES", 1000)
    whole = run()
    assert small == whole
    assert len(small[1]) == 1 and "orch-" not in small[1][0][4] and small[1][0][4].count("learned that the orchard was cold") == 6
    assert "cold and the marsh was different and cold." in small[1][0][4]
    assert (1, 63, 5, "hyphen") in small[0] and (1, 66, 5, "hyphen") in small[0] and (1, 257, 1, "misread") in small[0]
    monkeypatch.setattr(pr, "SLICE_LINES", 3)
    monkeypatch.setattr(pr, "HALO_LINES", 1)
    sliced = run()
    assert {x for x in sliced[0] if x[3] == "hyphen"} == {x for x in whole[0] if x[3] == "hyphen"}
    assert " ".join(x[4] for x in sliced[1]) == " ".join(x[4] for x in whole[1])
