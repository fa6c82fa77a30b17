from pyspark.sql import functions as F

from quillspan.operators import transcript as tr
from quillspan.operators import verse as vs
from quillspan.sources.synthetic import planted_pages

PAGE = [
    [("Tuesday, 14 March", 280, 300)],
    [("We walked along the shore for an hour and talked about the boats", 150, 1400),
     ("and the weather, which had been fine for most of the long week,", 150, 1400),
     ("until the rain came in from the west and we went back inside.", 150, 1300)],
    [("Rain on the harbour", 280, 420), ("the gulls fight over old scraps", 280, 560), ("none of them are cold", 280, 430)],
    [("Then supper, and the long talk about the roof once again.", 150, 1400)],
    [("An old silent pond", 280, 400), ("A frog jumps into the pond", 280, 560), ("Splash! Silence again.", 280, 440)],
    [("- 12 -", 700, 100)],
]


def detected(spark, page=PAGE, options=vs.Options()):
    a = vs.analysed(planted_pages(spark, page), options)
    return a, vs.selected(vs.candidates(a, tr.text_widths(a), options), options)


def test_planted_verse_is_found(spark):
    a, s = detected(spark)
    rows = {tuple(r.line_ids): r for r in s.where("accepted").collect()}
    assert set(rows) == {("line_1_5", "line_1_6", "line_1_7"), ("line_1_9", "line_1_10", "line_1_11")}
    r = rows["line_1_9", "line_1_10", "line_1_11"]
    assert (r.syllables, r.validation, r.confidence, r.score) == ([5, 7, 5], "exact", "high", 1.0)
    why = {r.line_id: r.excluded for r in a.collect()}
    assert why["line_1_1"] == ["date/time"] and why["line_1_12"][-3:] != [] and "page number" in why["line_1_12"]
    assert why["line_1_2"][0].endswith("words (prose)")


def test_statistics_add_up(spark):
    a, s = detected(spark)
    r = vs.statistics(a, s).first()
    assert r.lines == 12 and r.accepted == 2 and r.candidates == r.accepted + r.rejected


def test_approximate_and_strict(spark):
    page = [[("Rain on the harbour now", 280, 420), ("the gulls fight over old scraps", 280, 560), ("none of them are cold", 280, 430)]]
    _, s = detected(spark, page)
    r = s.where("accepted").first()
    assert r.validation.startswith("approximate (off by 1") or r.form == "free-form 3-line"
    _, s = detected(spark, page, vs.Options(tolerance_per_line=0, tolerance_total=0, include_free_form=False))
    assert s.count() == 0


def test_free_form_only_alone(spark):
    lines = [("late bus tonight", 280, 300), ("only the driver hums", 280, 300), ("frost again", 280, 300)]
    _, s = detected(spark, [lines])
    assert [r.form for r in s.collect()] == ["free-form 3-line"]
    _, s = detected(spark, [[*lines, ("more of the same", 280, 300)]])
    assert s.count() == 0


def test_no_overlap_and_order_of_input_does_not_matter(spark):
    page = [[("An old silent pond", 280, 400), ("A frog jumps into the pond", 280, 560), ("Splash! Silence again.", 280, 440), ("A frog jumps into the pond", 280, 560), ("An old silent pond", 280, 400)]]
    lines = planted_pages(spark, page)
    got = []
    for df in (lines, lines.orderBy(F.rand(1))):
        a = vs.analysed(df)
        got.append(sorted((r.n, r.accepted, r.milli) for r in vs.selected(vs.candidates(a, tr.text_widths(a))).collect()))
    assert got[0] == got[1] and sum(ok for _, ok, _ in got[0]) == 1


def test_model_findings_recounted(spark):
    schema = "reply_id int, packet_id long, page_no int, lines array<string>, ocr_lines array<string>, syllables array<int>, source_line_ids array<string>"
    pond = ["An old silent pond", "A frog jumps into the pond", "Splash! Silence again."]
    rows = [
        (1, 1, 1, pond, ["An old silenf pond", *pond[1:]], [5, 7, 5], ["line_1_9", "nope", "line_1_10"]),
        (2, 1, 1, pond, None, [5, 9, 5], []),
        (3, 1, 1, pond[:2], None, None, None),
    ]
    out = {r.reply_id: r for r in vs.revalidated(spark.createDataFrame(rows, schema), planted_pages(spark, PAGE)).collect()}
    assert (out[1].validation, out[1].agree, out[1].unresolved) == ("exact", True, ["nope"])
    assert [tuple(c) for c in out[1].corrections] == [("An old silenf pond", "An old silent pond")]
    assert (out[2].agree, out[3].validation, out[3].agree) == (False, "not 3 lines (2)", None)


def test_plain_pages(spark):
    df = spark.createDataFrame([(1, "Date\n\nline one\nline two\n\n\f\n \f\nnext page\r\n"), (2, None), (3, " \n\f")], "doc_id int, text string")
    got = [(r.doc_id, r.page_no, r.par_no, r.n, r.text) for r in tr.parsed_text(df).collect()]
    assert got == [(1, 1, 1, 1, "Date"), (1, 1, 2, 2, "line one"), (1, 1, 2, 3, "line two"), (1, 2, 1, 1, "next page")]


def test_totals(spark):
    _, s = detected(spark)
    assert tuple(vs.digest_totals(s).first()) == (1, 2)
    checked = spark.createDataFrame([("exact", True), ("exact", None), ("not 5-7-5", False)], "validation string, agree boolean")
    assert tuple(vs.reply_statistics(checked).first()) == (3, 2, 1)
