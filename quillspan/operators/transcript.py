"""Lines of transcripts with their context: numbering, gaps, widths, page text.

Input of the window functions is flat: one row per line, keyed by ``doc`` and ``page`` columns, so a window never holds
more than a page. Ties in order are settled by all columns named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip

_KEYS = ["packet_id", "page_no"]


def deduplicated(lines: DataFrame, key: list[str] = [*_KEYS, "n"], order: str = "received_at") -> DataFrame:
    """One row per line: the latest delivery; equal times by the whole row. A combining aggregate, no window."""
    rest = [c for c in lines.columns if c not in key]
    plain = [c for c in rest if c != order]
    best = lines.groupBy(*key).agg(F.max(F.struct(order, *plain)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def numbered(lines: DataFrame) -> DataFrame:
    """``line_no`` within the page, ``par_pos`` and ``par_count`` within the paragraph."""
    page = Window.partitionBy(*_KEYS)
    par = Window.partitionBy(*_KEYS, "par_id")
    return (
        lines.withColumn("line_no", F.row_number().over(page.orderBy("n")))
        .withColumn("par_pos", F.row_number().over(par.orderBy("n")) - 1)
        .withColumn("par_count", F.count(F.lit(1)).over(par))
    )


def line_heights(lines: DataFrame) -> DataFrame:
    """(packet_id, page_no, median_height): the interpolated median of the heights above zero."""
    h = F.col("bbox.y1") - F.col("bbox.y0")
    return lines.where(h > 0).groupBy(*_KEYS).agg(F.median(h.cast("double")).alias("median_height"))


def with_gaps(lines: DataFrame) -> DataFrame:
    """``gap``: white space above a line in median line heights; null for a page's first line and missing boxes.

    The line before is the one before on the page, whatever its paragraph.
    """
    before = F.lag("bbox.y1").over(Window.partitionBy(*_KEYS).orderBy("n"))
    top = lines.withColumn("_above", F.col("bbox.y0") - before)
    return (
        top.join(line_heights(lines), _KEYS, "left")
        .withColumn("gap", F.bround(F.col("_above") / F.col("median_height"), 2))
        .drop("_above")
    )


def text_widths(lines: DataFrame) -> DataFrame:
    """(packet_id, page_no, text_width): the width that nine tenths of the lines do not exceed (by rank, not
    interpolated); the widest for up to four lines."""
    w = F.col("bbox.x1") - F.col("bbox.x0")
    sorted_w = F.sort_array(F.collect_list(w))
    n = F.size(sorted_w)
    at = F.when(n > 4, F.floor(n * 0.9).cast("int") + 1).otherwise(n)
    return lines.where(w.isNotNull()).groupBy(*_KEYS).agg(F.element_at(sorted_w, at).alias("text_width"))


def boxes(lines: DataFrame, key: list[str]) -> DataFrame:
    """``key`` + the smallest box around all; missing boxes are left out."""
    return lines.where("bbox is not null").groupBy(*key).agg(
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")
    )


def mean_confidence(lines: DataFrame, key: list[str]) -> DataFrame:
    """``key`` + (conf_sum, conf_n, mean_conf): nulls left out, one decimal, null for none."""
    return lines.groupBy(*key).agg(
        F.sum("conf").alias("conf_sum"), F.count("conf").alias("conf_n"), F.bround(F.avg("conf"), 1).alias("mean_conf")
    )


def page_text(lines: DataFrame) -> DataFrame:
    """(packet_id, page_no, text): lines in order, an empty line between paragraphs."""
    new_par = F.coalesce(
        F.col("par_id") != F.lag("par_id").over(Window.partitionBy(*_KEYS).orderBy("n")), F.lit(False)
    )
    marked = lines.withColumn("_line", F.concat(F.when(new_par, "\n").otherwise(""), F.coalesce("text", F.lit(""))))
    return marked.groupBy(*_KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_line"))), lambda s: s["_line"]), "\n").alias("text")
    )


def parsed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, par_no, n, line_id, par_id, text) of plain transcripts.

    Form feeds part pages, blank lines paragraphs; blank pages take no number. All within the row: no shuffle.
    """
    pages = F.filter(
        F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\f"), lambda p: p.rlike(r"\S")
    )

    def fold(acc: Column, raw: Column) -> Column:
        blank = ~raw.rlike(r"\S")
        par = acc["par"] + F.when(~blank & acc["open"], 0).when(~blank, 1).otherwise(0)
        row = F.struct(par.alias("par_no"), strip(raw).alias("text"))
        return F.struct(
            par.alias("par"), (~blank).alias("open"), F.when(blank, acc["rows"]).otherwise(F.array_append(acc["rows"], row)).alias("rows")
        )

    start = F.struct(
        F.lit(0).alias("par"), F.lit(False).alias("open"), F.expr("cast(array() as array<struct<par_no:int,text:string>>)").alias("rows")
    )
    paged = docs.select(key, F.posexplode(pages).alias("_p", "_text"))
    rows = paged.select(
        key, (F.col("_p") + 1).alias("page_no"), F.posexplode(F.aggregate(F.split("_text", "\n"), start, fold, lambda a: a["rows"])).alias("_n", "_r")
    )
    return rows.select(
        key,
        "page_no",
        F.col("_r.par_no").alias("par_no"),
        (F.col("_n") + 1).alias("n"),
        F.concat_ws("_", F.lit("line"), "page_no", F.col("_n") + 1).alias("line_id"),
        F.concat_ws("_", F.lit("par"), "page_no", F.col("_r.par_no")).alias("par_id"),
        F.col("_r.text").alias("text"),
    )
