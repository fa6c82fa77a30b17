"""Per-document text statistics and the rules that tell natural text from lists, tables and junk.

Method. Length, symbol, punctuation, bullet, separator and common-word statistics are counted over the whole text by
Catalyst expressions, in one pass over ``documents`` without a shuffle; the lines' own figures are reduced to one row per
document and joined. Two sets of fixed thresholds are then applied, each failure with its reason:

* ``failures``: published rules with their published numbers (:data:`PUBLISHED`), from three public corpus filters
  (Gopher, C4, FineWeb), on words, mean word length, symbols, bullets, ellipses, ended, short and repeated lines and stop
  words; the lines' own figures (letter ratio, words, exclusions) are held against the same numbers. A document that
  passes them all is natural text.
* ``reasons``: of the documents that fail any, what they are. The published rules are made for long English web pages and
  also fail verse, notes and other languages; so own thresholds on layout and wording (:func:`kinds`) tell junk, tables
  and lists from natural text that merely is short or wrapped. The kind is that of the first reason, junk before table
  before list.

Defined results
---------------
* Null or blank text: zero counts, kind ``junk``, reason ``blank``. Texts of any length are counted whole; no pattern
  repeats a group without bound, so that very long lines cannot exhaust the stack.
* ``line_analyses``: of several rows for a line the latest run counts (missing run times are oldest, then the larger
  figures); null figures and lines without analysis are left out of the means; documents without any have nulls there.
  An analysis of a line that the text does not have counts like any other.
* Repeated texts under other ids each have their row. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import spread

#: Words that clauses need and bare items do without (and, for, of and articles are left out on purpose).
CLAUSE_WORDS = {
    "en": "is are was were be been has have had did does do not no nothing i we he she they it you my our his her its "
    "this that there what who which how when where why if because then than so but or as at by in on under from with "
    "without to into before after until since during around between could would will can may said says",
    "de": "ist war sind waren nicht ich wir er sie es sich wie wenn weil aber auf mit zu im am nach noch hat haben gab "
    "mir über ohne wäre steht dass dann von bei aus",
    "fr": "est était sont ne pas je nous il elle on que qui ce cette dans sur avec sans à au aux y avait plus rien "
    "sommes avons son se toujours cela",
}
_CLAUSE = sorted({w for v in CLAUSE_WORDS.values() for w in v.split()})
_WORD = r"\p{L}+(?:['’-]\p{L}+)?"
_END = r"[.!?…][\"'”’)\]]?[ \t]*$"
_BULLET = r"^[ \t]*(?:[-*•+‣–·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])[ \t]+"
#: Rows of cells: pipes and rules, tabs, quoted cells, cells without blanks after the comma, aligned columns.
ROW_PATTERNS = [
    r"^[ \t]*[|+][^\n]*[|+][ \t]*$",
    r"^[^\t\n]*\t[^\t\n]*\t[^\n]*$",
    r"^\"[^\"\n]*\"[;,]\"[^\"\n]*\"[;,]\"[^\n]*\"$",
    r"^[^,;\n]{1,30}([,;])[^,;\s][^,;\n]{0,29}\1[^,;\n]{0,30}\1[^\n]{0,90}(?<![.!?])$",
    r"^[^\s][^\n]{0,60}\S {2,}\S[^\n]*\S {2,}\S[^\n]*$",
]
#: What a text must hold for the pattern to find anything.
ROW_MARKS = [("|", "+"), ("\t",), ('";"', '","'), (",", ";"), ("  ",)]
_HEX = r"^[0-9a-fA-F]{4,8}:?[ \t]+[0-9a-fA-F]{2}[ \t][0-9a-fA-F]{2}[ \t][^\n]*$"
_NAV = r"^[ \t]*[^\s>|»\n][^>|»\n]{0,24} [>|»] [^>|»\n]{1,24}[^\n]*$"


#: The stop words of which Gopher's filter wants two.
STOP_WORDS = "the be to of and that have with".split()


#: Reasons of exclusion that speak of a line without words.
WORDLESS = r"\(numbers/punctuation\)|^no syllables|^page number"


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _ink(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", "")).cast("long")


def _without(text: Column, pattern: str, *marks: str) -> Column:
    """``text`` without the lines of a pattern; texts that hold none of ``marks`` are not searched."""
    gone = F.regexp_replace(text, "(?m)" + pattern, "")
    if not marks:
        return gone
    held = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        held = held | F.contains(text, F.lit(m))
    return F.when(held, gone).otherwise(text)


def _among(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(known))).cast("long")


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row per document with the counts that the rules need; everything in whole numbers."""
    t = F.coalesce("text", F.lit(""))
    d = spread(documents.select("doc_id", "text")).select("doc_id", t.alias("_t"), F.lower(t).alias("_l"))
    t, low = F.col("_t"), F.col("_l")
    tabular = t
    for p, marks in zip(ROW_PATTERNS, ROW_MARKS, strict=True):
        tabular = _without(tabular, p, *marks)
    # lines that end a sentence are gone from what may be items
    open_lines = _without(t, r"^[^\n]*[.!?:;…][\"'”’)\]]?[ \t]*$")
    short_open = F.regexp_replace(open_lines, r"(?m)^[^\n]{46,}$", "")
    every = F.lit(_WORD)
    d = d.withColumns(
        {
            "_open": F.regexp_extract_all(F.lower(open_lines), every, F.lit(0)),
            "_short": short_open,
            "_rows": tabular,
            "_words": F.regexp_extract_all(low, every, F.lit(0)),
        }
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\r\u00a0", "   "))) > 0)
    words = F.col("_words")
    counted = d.select(
        "doc_id",
        F.length(t).cast("long").alias("n_chars"),
        _ink(t).alias("n_ink"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_distinct_lines"),
        F.size(F.filter(lines, lambda x: F.length(x) < 30)).cast("long").alias("n_short_lines"),
        F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in STOP_WORDS]))).cast("long").alias("n_stop_words"),
        # begins with the rare character and looks back
        _n(t, r"[^\s\p{L}](?<!\S[\s\S])[^\s\p{L}]*+(?!\S)").alias("n_letterless_tokens"),
        _n(t, r"#|\.\.\.|…").alias("n_hashes_and_ellipses"),
        F.when(t.rlike(r"\.\.\.|…"), _n(t, r"(?m)(?:\.\.\.|…)[ \t]*$")).otherwise(0).cast("long").alias("n_ellipsis_lines"),
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        _n(t, r"\p{Nd}").alias("n_digits"),
        F.length(F.regexp_replace(low, r"[^aeiouyäöüàâéèêëîïôûœ]+", "")).cast("long").alias("n_vowels"),
        _n(t, r"[#…_~^|\\<>{}\[\]=*/%]").alias("n_symbols"),
        _n(t, r"[ÃÂ€™�¢¬]").alias("n_mojibake"),
        _n(t, r"\S+").alias("n_tokens"),
        F.when(t.rlike(r"\S{25}"), F.length(F.regexp_replace(t, r"(?<!\S)\S{1,24}(?!\S)|\s+", ""))).otherwise(0).cast("long").alias("ink_long_tokens"),
        # each alternative begins with the rare character and looks back
        _n(t, r"[|~^;:](?<=\p{L}.)(?=[\p{L}\d|~^])|[|~^](?<=\p{L}.)(?!\S)|\d(?<=\p{L}\d)|\d(?=\p{L})|'[\dIl|](?!\S)").alias("n_broken_words"),
        _n(t, "(?m)" + _END).alias("n_ended_lines"),
        _n(t, r"[.!?…](?<=\p{L}[\"”’)]?[.!?…])(?=[\"'”’)\]]?(?:\s|$))").alias("n_sentences"),
        _n(t, "(?m)" + _BULLET).alias("n_bullets"),
        _n(t, r"[;,](?= )").alias("n_separators"),
        _among(words, _CLAUSE).alias("n_clause_words"),
        (_ink(t) - _ink(F.col("_rows"))).alias("ink_rows"),
        F.when(t.rlike("(?m)" + _HEX), _ink(t) - _ink(_without(t, _HEX))).otherwise(0).alias("ink_hex"),
        F.when(t.rlike(" [>|»] "), _ink(t) - _ink(_without(t, _NAV))).otherwise(0).alias("ink_nav"),
        F.when(t.rlike("(?m)" + _BULLET), _ink(t) - _ink(_without(t, _BULLET + r"[^\n]*(?<![.!?…\"”])$"))).otherwise(0).alias("ink_bullet_items"),
        _ink(F.col("_short")).alias("ink_short_open"),
        _among(F.col("_open"), _CLAUSE).alias("n_open_clause_words"),
        F.size("_open").cast("long").alias("n_open_words"),
    )
    return counted


def line_statistics(line_analyses: DataFrame) -> DataFrame:
    """(doc_id, analysed_lines, mean_letter_ratio, low_letter_lines, mean_words, excluded_lines, wordless_lines) of the latest runs.

    ``wordless_lines`` were excluded for holding figures and marks instead of words; others are excluded for being prose.
    """
    wordless = F.exists(F.coalesce("excluded", F.array()), lambda r: r.rlike(WORDLESS))
    latest = line_analyses.groupBy("doc_id", "line_no").agg(
        F.max(
            F.struct(
                F.coalesce(F.col("run_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("run"),
                "letter_ratio",
                "word_count",
                F.size(F.coalesce("excluded", F.array())).alias("reasons"),
                F.coalesce(wordless, F.lit(False)).alias("wordless"),
            )
        ).alias("x")
    )
    return latest.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("analysed_lines"),
        F.avg("x.letter_ratio").alias("mean_letter_ratio"),
        F.count_if(F.col("x.letter_ratio") < 0.6).alias("low_letter_lines"),
        F.avg("x.word_count").alias("mean_words"),
        F.count_if(F.col("x.reasons") > 0).alias("excluded_lines"),
        F.count_if("x.wordless").alias("wordless_lines"),
    )


def statistics(documents: DataFrame, line_analyses: DataFrame) -> DataFrame:
    return text_statistics(documents).join(line_statistics(line_analyses), "doc_id", "left")


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


def published() -> dict[str, Column]:
    """The published rules, by reason: Rae et al. 2021 (Gopher, A.1.1), Raffel et al. 2020 (C4, 2.2), Penedo et al. 2024 (FineWeb, 3.6)."""
    words, lines = F.col("n_words"), F.col("n_lines")
    mean_word = _share("n_ink", "n_tokens")
    analysed = F.col("analysed_lines") > 0
    return {
        "gopher: words not within 50 and 100000": ~words.between(50, 100_000),
        "gopher: mean word length not within 3 and 10": ~mean_word.between(3, 10),
        "gopher: hashes and ellipses over 0.1 a word": _share("n_hashes_and_ellipses", "n_tokens") > 0.1,
        "gopher: bullets on over 0.9 of lines": _share("n_bullets", "n_lines") > 0.9,
        "gopher: ellipses end over 0.3 of lines": _share("n_ellipsis_lines", "n_lines") > 0.3,
        "gopher: letters in under 0.8 of words": _share("n_letterless_tokens", "n_tokens") > 0.2,
        "gopher: fewer than 2 stop words": F.col("n_stop_words") < 2,
        "gopher: over 0.3 of lines are repetitions": (lines - F.col("n_distinct_lines")) > 0.3 * lines,
        "c4: fewer than 3 sentences": F.col("n_sentences") < 3,
        "fineweb: punctuation ends at most 0.12 of lines": _share("n_ended_lines", "n_lines") <= 0.12,
        "fineweb: at least 0.67 of lines under 30 characters": _share("n_short_lines", "n_lines") >= 0.67,
        "lines: letter ratio under 0.8": analysed & (F.col("mean_letter_ratio") < 0.8),
        "lines: fewer than 5 words a line": analysed & (F.col("mean_words") < 5),
        "lines: over 0.2 excluded as wordless": analysed & (F.col("wordless_lines") > 0.2 * F.col("analysed_lines")),
    }


def _failed(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with ``failures`` (published rules), ``reasons`` (every rule of a kind that holds) and ``kind``.

    Without failures there are no reasons; without reasons the text is natural and ``kind`` null.
    """
    suspect = F.size("failures") > 0
    return (
        stats.withColumn("failures", _failed(published()))
        .withColumn("reasons", F.when(suspect, _failed(kinds())).otherwise(F.array().cast("array<string>")))
        .withColumn("kind", F.when(F.size("reasons") > 0, F.substring_index(F.element_at("reasons", 1), ":", 1)))
    )


def kinds() -> dict[str, Column]:
    """What shows that a suspect text is junk, a table or a list, in order of precedence."""
    ink, words, lines = F.col("n_ink"), F.col("n_words"), F.col("n_lines")
    rows = _share("ink_rows", "n_ink")
    letters = _share("n_letters", "n_ink")
    clauses = _share("n_clause_words", "n_words")
    open_clauses = _share("n_open_clause_words", "n_open_words")
    is_table = (rows > 0.5) & (letters >= 0.15)
    broken = _share("n_broken_words", "n_tokens")
    hexed = _share("ink_hex", "n_ink") > 0.5
    low_lines = F.coalesce(F.col("low_letter_lines") * 2 > F.col("analysed_lines"), F.lit(False))
    junk = [
        ("blank", (words == 0) | (F.col("n_letters") < 2)),
        ("dump of bytes", hexed),
        ("encoded text", ~is_table & (_share("ink_long_tokens", "n_ink") > 0.5)),
        ("wrong character set", _share("n_mojibake", "n_ink") > 0.08),
        ("few letters", ~is_table & ((letters < 0.5) | ((letters < 0.6) & low_lines)) & (clauses < 0.2)),
        ("symbols", (_share("n_symbols", "n_ink") > 0.25) & (~is_table | (_share("n_letters", "n_words") < 1.8))),
        ("repeated lines", (lines >= 5) & (_share("n_distinct_lines", "n_lines") <= 0.3)),
        ("repeated words", (words >= 16) & (F.col("n_distinct_words") <= 6)),
        ("no vowels", (words >= 3) & (_share("n_vowels", "n_letters") < 0.2)),
        ("navigation", (_share("ink_nav", "n_ink") > 0.5) & ~is_table & (clauses < 0.1)),
        (
            "broken words",
            ((broken > 0.45) & (_share("n_ink", "n_tokens") < 7)) | (~is_table & (broken > 0.3) & (clauses < 0.2)),
        ),
    ]
    table = [("rows of cells", is_table & ~hexed)]
    listed = [
        ("bulleted items", _share("ink_bullet_items", "n_ink") > 0.5),
        (
            "short open lines",
            (lines >= 3) & (_share("ink_short_open", "n_ink") > 0.5) & (open_clauses < 0.06),
        ),
        (
            "items in a row",
            (words >= 6) & (_share("n_separators", "n_words") > 0.2) & (clauses < 0.06) & (F.col("n_sentences") <= 1),
        ),
    ]
    return {f"{kind}: {name}": c for kind, rules in (("junk", junk), ("table", table), ("list", listed)) for name, c in rules}


def found(documents: DataFrame, line_analyses: DataFrame) -> DataFrame:
    return judged(statistics(documents, line_analyses)).where("kind is not null").select("doc_id", "kind")
