"""Writers. Distributed tables stay distributed; small reports and packages are made of bounded collections."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(rows: DataFrame, path: str, columns: list[str], by: Column) -> None:
    """A tab-separated file with a header, sorted, so that equal content gives equal bytes."""
    ordered = rows.orderBy(by, *columns).select(*columns)
    ordered.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, lineSep="\n", quote="", emptyValue="", nullValue="")


def write_results(rows: DataFrame, path: str, fmt: str) -> None:
    """JSON lines or XML by flag."""
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    elif fmt == "xml":
        rows.write.mode("overwrite").format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def as_xml(row: Column, tag: str) -> Column:
    return F.to_xml(row, {"rowTag": tag})


def packet_xml(lines: DataFrame) -> DataFrame:
    """(packet_id, xml): packets put together again from flat lines; attributes without value are left out."""
    def attr(name: str, value: Column) -> Column:
        v = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
        return F.coalesce(F.when(value.cast("string") != "", F.concat(F.lit(f' {name}="'), v, F.lit('"'))), F.lit(""))

    box = F.when(F.col("bbox").isNotNull(), F.concat_ws(" ", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "&", "&amp;"), "<", "&lt;")
    plain = F.when(~F.col("kind").isin("ocr_line", "text"), F.col("kind"))
    line = F.concat(
        F.lit("<line"), attr("id", F.col("line_id")), attr("n", F.col("n")), attr("bbox", box), attr("conf", F.col("conf")), attr("words", F.col("words")),
        attr("gap_before", F.col("gap_before")), attr("kind", plain), attr("raw", F.col("raw")), F.lit(">"), text, F.lit("</line>"),
    )
    def ordered(key: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "\n")

    pars = lines.withColumn("_x", line).groupBy("packet_id", "page_no", "par_id").agg(F.min("n").alias("_at"), ordered("n", "_x").alias("_body"))
    pars = pars.withColumn("_x", F.concat(F.lit("<paragraph"), attr("id", F.col("par_id")), F.lit(">\n"), F.col("_body"), F.lit("\n</paragraph>")))
    pages = pars.groupBy("packet_id", "page_no").agg(ordered("_at", "_x").alias("_body"))
    pages = pages.withColumn("_x", F.concat(F.lit("<page"), attr("n", F.col("page_no")), F.lit(">\n"), F.col("_body"), F.lit("\n</page>")))
    return pages.groupBy("packet_id").agg(
        F.concat(F.lit('<pipeline_packet version="1.0">\n<ocr_transcript>\n'), ordered("page_no", "_x"), F.lit("\n</ocr_transcript>\n</pipeline_packet>\n")).alias("xml")
    )


def digest(found: DataFrame) -> DataFrame:
    """(packet_id, markdown): per packet a heading and its accepted verse, in order."""
    entry = F.concat(
        F.lit("### "), F.col("form"), F.lit(" — "), F.col("validation"), F.lit(" · score "), F.col("score").cast("string"), F.lit("\n\n    "),
        F.array_join("lines", "\n    "), F.lit("\n"),
    )
    return found.where("accepted").withColumn("_e", entry).groupBy("packet_id").agg(
        F.concat(
            F.lit("## "), F.first("packet_id").cast("string"), F.lit("\n\n"), F.count(F.lit(1)).cast("string"), F.lit(" found\n\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "n", "_e"))), lambda s: s["_e"]), "\n"),
        ).alias("markdown")
    )


def write_package(source: str, target: str, leave_out: tuple[str, ...] = (".git", "__pycache__", "node_modules", "test", "dist")) -> int:
    """A ZIP of a small directory whose bytes depend on its content only: sorted entries, fixed time and rights."""
    if not os.path.isfile(os.path.join(source, "index.html")):
        raise FileNotFoundError("index.html")
    if os.path.exists(os.path.join(source, "webxdc.js")):
        raise ValueError("webxdc.js must not be packaged")
    names = sorted(
        os.path.relpath(os.path.join(base, f), source).replace(os.sep, "/")
        for base, _, files in os.walk(source)
        for f in files
        if not set(os.path.relpath(base, source).split(os.sep)) & set(leave_out)
    )
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            entry = zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
            entry.compress_type, entry.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            with open(os.path.join(source, n), "rb") as f:
                z.writestr(entry, f.read())
    return len(names)


def write_history(events: DataFrame, path: str) -> None:
    """A history as CSV with a header, oldest first."""
    cols = ["ts", "event_type", "value"]
    events.orderBy("ts").select(*cols).write.mode("overwrite").csv(path, header=True)
