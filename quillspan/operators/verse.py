"""Three-line verse in lines of transcripts: analysis, scoring of windows, greedy selection.

Windows are per page. Scores are kept in thousandths as whole numbers, so that sums of weights are exact; all weights are
multiples of 0.05. Selection is a fold over the page's candidates in order of score: a page is one group, and a page's
candidates are at most its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import numbers, syllables
from quillspan.functions import text as tx

#: Syllables of the three lines.
TARGET = (5, 7, 5)
_PAGE = ["packet_id", "page_no"]
_KEY = [*_PAGE, "n"]


@dataclass(frozen=True)
class Options:
    """Fixed values as defaults; every call may bring its own."""

    tolerance_per_line: int = 1
    tolerance_total: int = 2
    min_score: float = 0.5
    min_confidence: float = 20.0
    max_words_per_line: int = 10
    include_free_form: bool = True


def exclusions(text: Column, words: Column, lo: Column, hi: Column, conf: Column, kind: Column, o: Options) -> Column:
    """array<string>: every reason why a line is no verse line, in order; empty for a usable line."""
    ratio = tx.letter_ratio(text)
    return F.array_compact(
        F.array(
            F.when((text == "") | (words == 0), "empty"),
            F.when(words > o.max_words_per_line, F.concat(words.cast("string"), F.lit(" words (prose)"))),
            F.when(tx.is_date_like(text), "date/time"),
            F.when(
                (text != "") & (ratio < 0.6),
                F.concat(F.lit("letters "), F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("% (numbers/punctuation)")),
            ),
            F.when(tx.is_page_number(text) & (text != ""), "page number"),
            F.when(conf < o.min_confidence, F.concat(F.lit("ocr confidence "), F.bround(conf, 0).cast("int").cast("string"))),
            F.when(kind == "ocr_header", "header"),
            F.when(hi == 0, "no syllables"),
            F.when(lo > 12, F.concat(lo.cast("string"), F.lit("+ syllables"))),
        )
    )


def analysed(lines: DataFrame, options: Options = Options(), exceptions: DataFrame | None = None) -> DataFrame:
    """``lines`` with clean ``verse_text``, syl_lo, syl_hi, word_count, breakdown, letter_ratio, excluded."""
    marked = lines.withColumn("verse_text", tx.without_marks(F.coalesce("text", F.lit(""))))
    out = syllables.with_syllables(marked, "verse_text", exceptions).withColumn("letter_ratio", F.bround(tx.letter_ratio(F.col("verse_text")), 2))
    why = exclusions(*[F.col(c) for c in ("verse_text", "word_count", "syl_lo", "syl_hi", "conf", "kind")], options)
    return out.withColumn("excluded", why)


def structure(w: str = "") -> tuple[Column, Column]:
    """(thousandths, notes): how a window of lines a, b, c sits on its page. Columns as :func:`windows` makes them."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    same = (a["par_id"] == b["par_id"]) & (b["par_id"] == c["par_id"])
    size = a["par_size"].cast("string")
    singles = (a["par_size"] == 1) & (b["par_size"] == 1) & (c["par_size"] == 1)
    widest = F.greatest(*[(x["bbox"]["x1"] - x["bbox"]["x0"]) / F.col("text_width") for x in (a, b, c)])
    boxed = a["bbox"].isNotNull() & b["bbox"].isNotNull() & c["bbox"].isNotNull() & (F.col("text_width") > 0)
    words = F.greatest(a["word_count"], b["word_count"], c["word_count"])
    breaks = sum((tx.sentence_breaks(x["verse_text"]) for x in (b, c)), tx.sentence_breaks(a["verse_text"]))
    confs = F.filter(F.array(a["conf"], b["conf"], c["conf"]), lambda v: v.isNotNull())
    mean = F.aggregate(confs, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(confs), F.lit(0))
    percent = F.concat(F.bround(widest * 100, 0).cast("int").cast("string"), F.lit("%"))
    after, ended = F.col("after_gap"), F.col("ended")
    rules = [
        (same & (a["par_size"] == 3), 200, F.lit("isolated 3-line stanza")),
        (same & (a["par_size"] != 3) & F.col("short_par"), -50, F.concat(F.lit("inside a "), size, F.lit("-line block of short lines"))),
        (same & (a["par_size"] != 3) & ~F.col("short_par"), -300, F.concat(F.lit("embedded in a "), size, F.lit("-line paragraph"))),
        (~same & singles, 100, F.lit("three consecutive single-line paragraphs")),
        (~same & ~singles, -250, F.lit("crosses a paragraph boundary")),
        (boxed & (widest < 0.65), 150, F.concat(F.lit("narrow lines (max "), percent, F.lit(" of page text width)"))),
        (boxed & (widest > 0.9), -200, F.concat(F.lit("full-width line ("), percent, F.lit(" of page text width) reads like wrapped prose"))),
        (words >= 9, -100, F.lit("a line has 9+ words")),
        (words <= 6, 50, None),
        (breaks == 1, -100, F.lit("sentence breaks inside lines")),
        (breaks > 1, -200, F.lit("sentence breaks inside lines")),
        (a["gap_before"] >= 0.9, 50, F.lit("blank space before")),
        (~ended & (after >= 0.9), 50, F.lit("blank space after")),
        (ended, 50, F.lit("end of page")),
        (mean < 50, -100, F.concat(F.lit("low OCR confidence ("), F.bround(mean, 0).cast("int").cast("string"), F.lit(")"))),
    ]
    score = sum((F.when(F.coalesce(k, F.lit(False)), v).otherwise(0) for k, v, _ in rules[1:]), F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1]).otherwise(0))
    notes = F.array_compact(F.array(*[F.when(k, n) for k, _, n in rules if n is not None]))
    return score, notes


def windows(analysed_lines: DataFrame, widths: DataFrame) -> DataFrame:
    """Three consecutive lines of a page as structs a, b, c, with what follows them and the page's text width."""
    fields = ["n", "line_id", "par_id", "par_size", "bbox", "conf", "gap_before", "verse_text", "text", "raw", "syl_lo", "syl_hi",
              "word_count", "excluded", "breakdown"]
    row = F.struct(*fields)
    page = Window.partitionBy(*_PAGE).orderBy("n")
    # blanks in the text count where the engine gave no number of words
    own_words = F.coalesce(F.nullif(F.col("words"), F.lit(0)), F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")))
    short = F.min((own_words <= 7).cast("int")).over(Window.partitionBy(*_PAGE, "par_id")) == 1
    return (
        analysed_lines.withColumn("short_par", short)
        .select(
            *_PAGE,
            row.alias("a"),
            F.lead(row, 1).over(page).alias("b"),
            F.lead(row, 2).over(page).alias("c"),
            F.lead("gap_before", 3).over(page).alias("after_gap"),
            F.lead("n", 3).over(page).isNull().alias("ended"),
            F.coalesce("short_par", F.lit(False)).alias("short_par"),
        )
        .where("c is not null")
        .join(widths, _PAGE, "left")
    )


def candidates(analysed_lines: DataFrame, widths: DataFrame, options: Options = Options()) -> DataFrame:
    """Scored windows: (packet_id, page_no, n, line_ids, deviations, deviation, milli, score, form, validation, notes ...)."""
    o = options
    w = windows(analysed_lines, widths).where(
        (F.size("a.excluded") == 0) & (F.size("b.excluded") == 0) & (F.size("c.excluded") == 0)
    )
    trio = [F.col(k) for k in "abc"]
    devs = [numbers.deviation(x["syl_lo"], x["syl_hi"], t) for x, t in zip(trio, TARGET, strict=True)]
    said = [numbers.chosen(x["syl_lo"], x["syl_hi"], t) for x, t in zip(trio, TARGET, strict=True)]
    place, notes = structure()
    w = w.withColumns(
        {
            "deviations": F.array(*devs),
            "deviation": devs[0] + devs[1] + devs[2],
            "syllables": F.array(*said),
            "_place": place,
            "notes": notes,
        }
    )
    total = F.col("deviation")
    match = (F.array_max("deviations") <= o.tolerance_per_line) & (total <= o.tolerance_total)
    alone = (F.col("a.par_id") == F.col("c.par_id")) & (F.col("a.par_size") == 3)
    spoken = F.aggregate("syllables", F.lit(0), lambda s, v: s + v)
    free = (
        alone
        & spoken.between(8, 17)
        & (F.greatest(*[x["syl_hi"] for x in trio]) <= 9)
        & (F.greatest(*[x["word_count"] for x in trio]) <= 6)
        & F.lit(o.include_free_form)
    )
    raw = F.when(match & (total == 0), 1000 + F.col("_place")).when(
        match, F.least(F.lit(950), 1000 - 150 * total + F.col("_place"))
    ).when(free, F.least(F.lit(800), 550 + F.col("_place")))
    scored = w.withColumn("milli", F.greatest(F.lit(0), F.least(F.lit(1000), raw)).cast("int")).where(match | free)
    return scored.select(
        *_PAGE,
        F.col("a.n").alias("n"),
        F.array("a.n", "b.n", "c.n").alias("line_numbers"),
        F.array("a.line_id", "b.line_id", "c.line_id").alias("line_ids"),
        F.array("a.verse_text", "b.verse_text", "c.verse_text").alias("lines"),
        "syllables",
        "deviations",
        "deviation",
        "milli",
        (F.col("milli") / 1000.0).alias("score"),
        F.when(match & (total == 0), "5-7-5").when(match, "5-7-5 (approximate)").otherwise("free-form 3-line").alias("form"),
        F.when(match & (total == 0), "exact")
        .when(match, F.concat(F.lit("approximate (off by "), total.cast("string"), F.lit(")")))
        .otherwise("not 5-7-5 (short modern form)")
        .alias("validation"),
        numbers.confidence(F.col("milli") / 1000.0).alias("confidence"),
        "notes",
    )


def selected(cands: DataFrame, options: Options = Options()) -> DataFrame:
    """``cands`` with ``accepted`` and ``reason``: best first, a window that shares a line with an accepted one is out.

    Order: score down, deviation up, position up. Lines are told apart by their number, which no two lines of a page share.
    """
    least = int(round(options.min_score * 1000))
    groups = cands.groupBy(*_PAGE).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("milli")).alias("s"), "deviation", "n", "line_numbers"))
        ).alias("_all")
    )
    empty = F.expr("cast(array() as array<int>)")
    out = F.expr("cast(array() as array<struct<n:int,accepted:boolean,reason:string>>)")

    def step(acc: Column, c: Column) -> Column:
        low = -c["s"] < least
        clash = F.arrays_overlap(acc["used"], c["line_numbers"])
        ok = ~low & ~clash
        reason = F.when(low, "score below threshold").when(clash, "overlaps a higher-scoring candidate")
        return F.struct(
            F.when(ok, F.concat(acc["used"], c["line_numbers"])).otherwise(acc["used"]).alias("used"),
            F.array_append(acc["out"], F.struct(c["n"].alias("n"), ok.alias("accepted"), reason.alias("reason"))).alias("out"),
        )

    folded = F.aggregate("_all", F.struct(empty.alias("used"), out.alias("out")), step, lambda a: a["out"])
    verdicts = groups.select(*_PAGE, F.inline(folded))
    return cands.join(verdicts, [*_PAGE, "n"])


def statistics(analysed_lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: lines, usable lines, candidates, accepted and rejected ones."""
    a = analysed_lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("excluded") == 0).alias("usable_lines"))
    b = chosen.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
    )
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def revalidated(replies: DataFrame, known_lines: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """A model's three-line findings recounted: (reply_id, validation, agree, unresolved, corrections).

    ``replies``: reply_id, packet_id, page_no, lines, ocr_lines, syllables, source_line_ids. ``known_lines``: packet_id,
    page_no, line_id. ``agree`` is null where the model gave no three counts; corrections pair what was read with what
    the model made of it; unresolved ids keep their order.
    """
    each = replies.select("reply_id", F.posexplode(F.slice(F.coalesce("lines", F.array()), F.lit(1), F.lit(3))).alias("n", "text"))
    count = syllables.line_syllables(each, ["reply_id", "n"], "text", exceptions)
    goal = F.element_at(F.array(*[F.lit(t) for t in TARGET]), F.col("n") + 1)
    off = F.when(F.col("syl_lo") > goal, F.col("syl_lo") - goal).when(F.col("syl_hi") < goal, goal - F.col("syl_hi")).otherwise(0)
    per = count.withColumn("off", off).groupBy("reply_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.sum("off").alias("total"),
        F.max("off").alias("worst"),
        F.array_sort(F.collect_list(F.struct("n", "syl_lo", "syl_hi"))).alias("ranges"),
    )
    ids = replies.select("reply_id", "packet_id", "page_no", F.posexplode("source_line_ids").alias("_i", "line_id"))
    missing = (
        ids.join(known_lines.select("packet_id", "page_no", "line_id").distinct(), ["packet_id", "page_no", "line_id"], "left_anti")
        .groupBy("reply_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "line_id"))), lambda s: s["line_id"]).alias("unresolved"))
    )
    r = replies.join(per, "reply_id", "left").join(missing, "reply_id", "left")
    total = F.col("total")
    read, made = (F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("ocr_lines", "lines"))
    both = F.least(F.size(read), F.size(made))
    pairs = F.filter(
        F.zip_with(F.slice(read, F.lit(1), both), F.slice(made, F.lit(1), both), lambda a, b: F.struct(a.alias("ocr"), b.alias("model"))),
        lambda p: tx.strip(p["ocr"]) != tx.strip(p["model"]),
    )
    return r.select(
        "reply_id",
        F.when(F.coalesce("found", F.lit(0)) != 3, F.concat(F.lit("not 3 lines ("), F.coalesce("found", F.lit(0)).cast("string"), F.lit(")")))
        .when(total == 0, "exact")
        .when((total <= 2) & (F.col("worst") <= 1), F.concat(F.lit("approximate (off by "), total.cast("string"), F.lit(")")))
        .otherwise("not 5-7-5")
        .alias("validation"),
        F.when(
            (F.size("syllables") == 3) & (F.col("found") == 3),
            F.forall(
                F.zip_with("ranges", "syllables", lambda g, m: (m >= g["syl_lo"]) & (m <= g["syl_hi"])), lambda ok: ok
            ),
        ).alias("agree"),
        F.coalesce("unresolved", F.expr("cast(array() as array<string>)")).alias("unresolved"),
        pairs.alias("corrections"),
    )


def reply_statistics(checked: DataFrame) -> DataFrame:
    """One row over :func:`revalidated`: findings, exact ones, and those where model and count agree."""
    return checked.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("validation") == "exact").alias("exact"),
        F.count_if(F.coalesce("agree", F.lit(False))).alias("agreed"),
    )


def digest_totals(chosen: DataFrame) -> DataFrame:
    """One row: pages with accepted verse, and accepted verse in all."""
    per = chosen.where("accepted").groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("verses"))
