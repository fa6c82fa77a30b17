import datetime as dt

import pytest

from quillspan.llm import text_quality as tq

DOCS = "doc_id long, text string, n_words long, kind string"
LINES = "doc_id long, line_no int, letter_ratio double, word_count int, excluded array<string>, run_at timestamp, text string"
PROSE = "The heron watched the marsh near the evening. I think the willow was cold, and nobody expected it.\n" * 3
ITEMS = ["bug for the number", "thread (5)", "stack", "cache and function", "runtime for the idea", "7 packages", "plain loader, old"]
NOUNS = "frost marsh willow heron otter dune branch lichen field gull".split()

CASES = {
    "prose": (PROSE, None),
    "figures": ("At 3:15 the epoch stood at 1.8, then 61.1, then 90.1 again. The trace (No. 8708, 53.4 x 91.6) was 81.6 below the stimulus of 2016.\n" * 3, None),
    "verse": ("nothing but orchard\nafter lunch a marsh\nno one saw the blossom\n\nhow windblown the gull is\nmy month has gone out\nthe shoreline waits twice", None),
    "wrapped": ("They checked it finally, as before. The useful watermark\nscanned the backup near the moment. I will come back to\nthis around seven. Most of the dune comes from a meadow.", None),
    "bulleted sentences": ("- They missed it together, as before.\n- He returned the function because the cache had been watched.\n- I will come back to this.", None),
    "dialogue": ("A: She missed the evening, then kept it.\nB: Could the stock have roasted the thyme?\nA: It is hard to say why.", None),
    "short list inside": (PROSE + "- signature\n- crib\n- salt\n" + PROSE, None),
    "german": ("Die Frage nach Chiffre ist noch offen. Danach sind wir nach Hause gegangen. Das war nicht so einfach, wie wir gedacht hatten. " * 40, None),
    "bullets": ("\n".join("• " + x for x in ITEMS), "list"),
    "numbered": ("\n".join(f"{i}) {x}" for i, x in enumerate(ITEMS)), "list"),
    "checkboxes": ("They left it early.\n" + "\n".join("[x] " + x for x in ITEMS * 2), "list"),
    "bare items": ("Still missing:\n" + "\n".join(ITEMS), "list"),
    "items in a row": ("; ".join(ITEMS * 3), "list"),
    "pipes": ("| name | qty | state |\n|---|---|---|\n" + "".join(f"| {w} | {i} | ok |\n" for i, w in enumerate(NOUNS)), "table"),
    "tabs": ("name\tqty\tstate\n" + "".join(f"{w}\t{i}\tok\n" for i, w in enumerate(NOUNS)), "table"),
    "commas": ("name,qty,value,state\n" + "".join(f"{w},{i},3.{i},\n" for i, w in enumerate(NOUNS)), "table"),
    "quoted": ('"name";"qty";"state"\n' + "".join(f'"{w}";"{i}";""\n' for i, w in enumerate(NOUNS)), "table"),
    "aligned": ("name              qty     value     state\n" + "".join(f"{w:18}{i:<8}89.1{i}     ok\n" for i, w in enumerate(NOUNS)), "table"),
    "one row over and over": ("frost,12,3.4,\n" * 9, "junk"),
    "base64": ("QXjdqujWdbobWHOxayGBBHV0fnS29qliNCssVJQYqMh4py0VtfeoB0tX4y2zVJjjnq7NF3bO\n" * 8, "junk"),
    "bytes": ("00000010  70 e3 07 17 c7 f3 01 97 a6 8d 9d 29 c4 0a fc 9c  !?Y?.09a?0.bb.bc\n" * 5, "junk"),
    "charset": ("sr™r sÃ râ€oe er©noÃ™s tÂa Ãno€™se €eo€€Ã™\n" * 5, "junk"),
    "navigation": ("Home > Menu > Help > Login\nBack > Next > Top > Share\n" * 4, "junk"),
    "repetition": ("click here\n" * 20, "junk"),
    "consonants": ("hkfkxpdg vdk jvtth cjngvf\nwrrzph xrswzwt fqq kc\ntgb rqwwckg wchsqhnff", "junk"),
    "symbols": ("_}_%~-:*i:ji<[/'<j%I<^\nJ1.:_:[-.\\I_,%*J'<#;11*#=^\n" * 4, "junk"),
    "blanks": (" .\n\n--\n...\n ?\n", "junk"),
    "empty": ("", "junk"),
    "null": (None, "junk"),
    "very long line": ("word\t" * 200_000 + ".", "junk"),
    "very long prose": ("".join(f"On day {i} the heron watched the marsh. I think the {NOUNS[i % 10]} was cold.\n" for i in range(9000)), None),
}


def lines(spark, rows=()):
    return spark.createDataFrame(list(rows), LINES)


@pytest.fixture(scope="module")
def judged(spark):
    names = list(CASES)
    docs = spark.createDataFrame([(i, CASES[n][0], 1, "clash") for i, n in enumerate(names)], DOCS)
    out = tq.judged(tq.statistics(docs, lines(spark))).collect()
    return {names[r.doc_id]: r for r in out}


@pytest.mark.parametrize("name", CASES)
def test_kinds(judged, name):
    r = judged[name]
    assert r.kind == CASES[name][1], list(r.reasons)
    assert bool(r.reasons) is (r.kind is not None) and all(": " in x for x in r.reasons)


def test_statistics(judged):
    r = judged["bullets"]
    assert (r.n_lines, r.n_bullets, r.n_ended_lines, r.n_sentences) == (7, 7, 0, 0)
    assert judged["null"].n_chars == 0 and judged["very long prose"].n_lines == 9000


def test_latest_run_of_a_line_counts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, 0.2, 3, ["a"], None, ""),
        (1, 1, 0.9, 5, [], t, ""),
        (1, 1, 0.9, 5, [], t, ""),
        (1, 3, None, None, None, t, ""),
        (1, 4, 0.5, 1, ["x", "y"], t, ""),
    ]
    r = tq.line_statistics(lines(spark, rows)).first()
    assert (r.analysed_lines, r.low_letter_lines, r.excluded_lines, r.mean_words) == (3, 1, 1, 3.0) and abs(r.mean_letter_ratio - 0.7) < 1e-9


def test_empty_and_repeated(spark):
    assert tq.found(spark.createDataFrame([], DOCS), lines(spark)).count() == 0
    two = spark.createDataFrame([(1, "click here\n" * 9, 0, ""), (2, "click here\n" * 9, 0, "")], DOCS)
    assert sorted(r.doc_id for r in tq.found(two, lines(spark)).collect()) == [1, 2]


def test_published_rules_have_their_reasons(spark):
    words = "the heron watched the marsh and the willow was old".split()
    prose = " ".join(words * 2) + ". " + " ".join(words * 2) + ". " + " ".join(words * 2) + "."
    texts = [prose, "\n".join(f"- {w} and so" for w in words * 8), " ".join("internationalisation" for _ in range(60)), prose.replace(".", " ..."), "cold\n" * 60]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOCS)
    t = dt.datetime(2024, 1, 1)
    analysed = lines(spark, [(0, 1, 0.5, 2, ["letters 50% (numbers/punctuation)", None], t, "")])
    got = {r.doc_id: set(r.failures) for r in tq.judged(tq.statistics(docs, analysed)).collect()}
    assert got[0] == {"lines: letter ratio under 0.8", "lines: fewer than 5 words a line", "lines: over 0.2 excluded as wordless"}
    assert "gopher: bullets on over 0.9 of lines" in got[1] and "fineweb: punctuation ends at most 0.12 of lines" in got[1]
    assert {"gopher: mean word length not within 3 and 10", "gopher: fewer than 2 stop words"} <= got[2]
    assert "gopher: ellipses end over 0.3 of lines" in got[3]
    assert {"gopher: over 0.3 of lines are repetitions", "fineweb: at least 0.67 of lines under 30 characters"} <= got[4]


def test_a_text_that_fails_no_published_rule_is_natural(spark):
    stats = tq.statistics(spark.createDataFrame([(1, "click here\n" * 9, 0, "")], DOCS), lines(spark))
    assert tq.judged(stats).first().kind == "junk"
    passing = {"n_words": 100, "n_tokens": 100, "n_ink": 500, "n_bullets": 0, "n_stop_words": 3, "n_sentences": 5, "n_ended_lines": 9, "n_short_lines": 0}
    clean = stats.withColumns({k: tq.F.lit(v) for k, v in passing.items()}).withColumn("n_distinct_lines", tq.F.col("n_lines"))
    assert tq.judged(clean).first().kind is None and tq.judged(clean).first().failures == []
