"""Inputs with known answers: signals and pages with planted verse."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signal(spark: SparkSession, seconds: int, rate: int = 256, per_frame: int = 8, seed: int = 7) -> DataFrame:
    """Frames of a test signal: a drifting 10 Hz wave, weaker ones of 3 and 22 Hz, and noise. Columns as frames have them."""
    t = F.col("id") / rate
    turn = 2 * math.pi
    value = (
        8.3 * (1 + 0.23 * F.sin(turn * 0.08 * t)) * F.sin(turn * 10 * t)
        + 3.2 * F.sin(turn * 3 * t)
        + 1.1 * F.sin(turn * 22 * t)
        + (F.rand(seed) - 0.5) * 2.2
    )
    points = spark.range(seconds * rate).select("id", value.alias("v"), F.floor(F.col("id") / per_frame).alias("frame"))
    return points.groupBy("frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda s: s["v"]).alias("samples_uv")
    ).select(
        F.lit("sig/1").alias("protocol"), F.lit("frame").alias("type"), (F.col("frame") + 1).alias("seq"),
        F.lit(float(rate)).alias("sample_rate_hz"), F.lit("SIM-CH1").alias("channel"), "samples_uv",
        F.lit(None).cast("double").alias("sent_at_unix_ms"),
    )


def planted_pages(spark: SparkSession, paragraphs: list[list[tuple[str, int, int]]], pages: int = 1) -> DataFrame:
    """Lines of pages laid out from paragraphs of (text, left, width): 40 high, 60 apart, 60 more between paragraphs."""
    rows = []
    for page in range(1, pages + 1):
        y, n = 100, 0
        for p, par in enumerate(paragraphs, 1):
            for i, (text, left, width) in enumerate(par):
                n += 1
                gap = None if n == 1 else (1.5 if i == 0 else 0.5)
                rows.append((1, page, n, f"line_{page}_{n}", f"par_{page}_{p}", len(par), i, (left, y, left + width, y + 40), 91.0,
                             len(text.split()), gap, "ocr_line", text, None))
                y += 60
            y += 60
    return spark.createDataFrame(
        rows,
        "packet_id long, page_no int, n int, line_id string, par_id string, par_size int, par_index int, bbox struct<x0:int,y0:int,x1:int,y1:int>, "
        "conf double, words int, gap_before double, kind string, text string, raw string",
    )
