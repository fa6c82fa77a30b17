"""Figures, intervals and geometry as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def deviation(lo: Column, hi: Column, target: int) -> Column:
    """How far an interval is from a target: 0 inside, else to the nearer end."""
    return F.when(lo <= target, F.when(hi >= target, 0).otherwise(target - hi)).otherwise(lo - target)


def chosen(lo: Column, hi: Column, target: int) -> Column:
    """The value of an interval nearest to a target, the lower end where both are alike."""
    inside = (lo <= target) & (hi >= target)
    return F.when(inside, target).when(F.abs(lo - target) <= F.abs(hi - target), lo).otherwise(hi)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def source_box(box: Column, scale: Column, border: Column) -> Column:
    """A box of a scaled, bordered picture in the coordinates of its source; never negative."""
    def back(v: Column) -> Column:
        return F.greatest(F.lit(0), F.bround((v - border) / scale).cast("int"))

    return F.struct(*[back(box[k]).alias(k) for k in ("x0", "y0", "x1", "y1")])


def pitch_hz(note: Column) -> Column:
    """Frequency of a MIDI note, concert pitch."""
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def odds(sides: Column) -> Column:
    return 1.0 / sides


def expected_roll(sides: Column) -> Column:
    return (sides + 1) / 2.0


def next_lcg(state: Column) -> Column:
    """The next state of a linear congruential generator (fixed values: multiplier, increment, modulus 2^31)."""
    return F.pmod(state * F.lit(1103515245).cast("bigint") + 12345, F.lit(1 << 31).cast("bigint"))


def record_payload(encrypted: Column, record: Column, head: int = 21, mark: int = 17) -> Column:
    """Plain bytes of a stream of encrypted records: without the head and each record's tag and delimiter."""
    body = encrypted - head
    return body - mark * F.ceil(body / record).cast("bigint")


def band_rms(samples: Column, rate: int, low: float, high: float) -> Column:
    """Root mean square of a band over the last samples, by projection on whole frequencies; null below 32 samples.

    The window is the rate, at least 32 and at most what there is. Sines and cosines come from one expression per
    frequency, so the whole stays in Catalyst.
    """
    n = F.least(F.size(samples), F.lit(max(32, round(rate))))
    tail = F.slice(samples, -n, n)
    total, kinds = None, 0
    for hz in range(math.ceil(low), math.floor(high) + 1):
        step = 2 * math.pi * hz / rate
        pair = F.aggregate(
            _projected(tail, step),
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, x: F.struct((acc["a"] + x["a"]).alias("a"), (acc["b"] + x["b"]).alias("b")),
        )
        square = F.pow(2.0 / n, F.lit(2)) * (pair["a"] * pair["a"] + pair["b"] * pair["b"])
        total = square if total is None else total + square
        kinds += 1
    return F.when(n >= 32, F.sqrt(total / (2 * kinds))) if kinds else F.lit(None).cast("double")


def _projected(samples: Column, step: float) -> Column:
    return F.transform(samples, lambda v, i: F.struct((v * F.sin(i * step)).alias("a"), (v * F.cos(i * step)).alias("b")))


def cue(rms: Column, threshold: float) -> Column:
    """Three states: waiting without a figure, on from the threshold, else off."""
    return F.when(rms.isNull(), "waiting").when(rms >= threshold, "on").otherwise("off")


def clock_usable(synchronised: Column, uncertainty: Column, limit: int) -> Column:
    return F.coalesce(synchronised & (uncertainty <= limit), F.lit(False))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with seconds and Z."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_or_blank(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))
