"""Event logs: gaps, order, rings, running figures, traces of stages, frames, record budgets.

Figures that run along a key's events are taken in two levels, so that a key with a third of all events is no single task:
events fall into blocks of the order column (bounds from one pass of approximate quantiles, at most :data:`BLOCKS` of them),
windows run within (key, block), and what earlier blocks hand on comes from a small table of one row per key and block.
Results do not depend on the bounds. Where an aggregate serves (first and last values, deduplication) it is used instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64


def _place(c: str, kind: str) -> Column:
    """The order column as a figure."""
    col = F.col(c)
    return F.unix_micros(col.cast("timestamp")).cast("double") if "timestamp" in kind else col.cast("double")


def blocked(events: DataFrame, order: str, blocks: int = BLOCKS) -> DataFrame:
    """``events`` + _blk: the block of the order column; events equal in it share a block, null ones come first."""
    at = _place(order, dict(events.dtypes)[order])
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = events.select(at.alias("_at")).approxQuantile("_at", cuts, 0.5 / blocks) if cuts else []
    listed = sorted(set(bounds))
    below = F.lit(0)
    if listed:
        array = F.array(*[F.lit(x) for x in listed])
        below = F.coalesce(F.size(F.filter(array, lambda x: x < at)), F.lit(0))
    return events.withColumn("_blk", F.when(at.isNull(), -1).otherwise(below))


def _handed_on(blocks: DataFrame, key: str, **figures: tuple) -> DataFrame:
    """Per key and block what all earlier blocks of the key come to. ``figures``: name -> (per block, over blocks)."""
    per = blocks.groupBy(key, "_blk").agg(*[f.alias(n) for n, (f, _) in figures.items()])
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(key, "_blk", *[over(F.col(n)).over(before).alias(n) for n, (_, over) in figures.items()])


def gaps(events: DataFrame, key: str, seq: str) -> DataFrame:
    """``events`` + missing: how many numbers lie between an event and the one before it in its key; 0 for the first."""
    b = blocked(events, seq)
    before = _handed_on(b, key, _last=(F.max(seq), F.max))
    last = F.coalesce(F.lag(seq).over(Window.partitionBy(key, "_blk").orderBy(seq)), F.col("_last"))
    out = b.join(before, [key, "_blk"], "left").withColumn("missing", F.greatest(F.coalesce(F.col(seq) - last - 1, F.lit(0)), F.lit(0)))
    return out.select(*events.columns, "missing")


def monotone(events: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """``events`` + rejected: whether the sequence does not exceed all earlier ones in arrival order."""
    b = blocked(events, order[0])
    before = _handed_on(b, key, _most=(F.max(seq), F.max))
    w = Window.partitionBy(key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    most = F.greatest(F.max(seq).over(w), F.col("_most"))
    out = b.join(before, [key, "_blk"], "left").withColumn("rejected", F.coalesce(F.col(seq) <= most, F.lit(False)))
    return out.select(*events.columns, "rejected")


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """Replayed events once: the first by all columns; exact, without a bounded memory that forgets."""
    rest = [c for c in events.columns if c not in key]
    first = events.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ring(events: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The last ``k`` events of each key with ``age`` 1 for the newest. Spark keeps k rows a key before the shuffle."""
    return events.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("age") <= k)


def running(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``events`` + run_n, run_sum, run_avg up to and with each event."""
    b = blocked(events, order[0])
    before = _handed_on(b, key, _n=(F.count(value), F.sum), _s=(F.sum(value), F.sum))
    w = Window.partitionBy(key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(value).over(w) + F.coalesce("_n", F.lit(0))
    total = F.when(n > 0, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.coalesce("_s", F.lit(0)))
    out = b.join(before, [key, "_blk"], "left").withColumns({"run_n": n, "run_sum": total})
    return out.withColumn("run_avg", F.col("run_sum") / F.nullif(F.col("run_n"), F.lit(0))).select(*events.columns, "run_n", "run_sum", "run_avg")


def streaks(events: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """``events`` + streak: how many hits in a row end with each event; 0 where it is none. In two levels."""
    told = running(events.withColumn("_one", F.lit(1)).withColumn("_hit", F.coalesce(hit, F.lit(False))), key, order, "_one")
    b = blocked(told, order[0]).withColumn("_miss", F.when(~F.col("_hit"), F.col("run_n")))
    before = _handed_on(b, key, _last=(F.max("_miss"), F.max))
    w = Window.partitionBy(key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max("_miss").over(w), F.col("_last"), F.lit(0))
    return b.join(before, [key, "_blk"], "left").withColumn("streak", F.col("run_n") - last).select(*events.columns, "streak")


#: The shape of a frame.
FRAME_RATES, FRAME_SAMPLES, CHANNEL = (32, 2048), 1024, "^[A-Za-z0-9_.-]{1,24}$"


def frame_error(protocol: str) -> Column:
    """The first rule a frame breaks, else null. Columns: protocol, type, seq, sample_rate_hz, channel, samples_uv,
    sent_at_unix_ms (may be null)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rate, seq, samples, sent = F.col("sample_rate_hz"), F.col("seq"), F.col("samples_uv"), F.col("sent_at_unix_ms")
    rules = [
        ((F.col("protocol") == protocol) & (F.col("type") == "frame"), "unsupported frame protocol/type"),
        (seq.between(0, (1 << 53) - 1), "seq must be a non-negative integer"),
        (finite(rate) & rate.between(*FRAME_RATES), "sample_rate_hz must be 32–2048"),
        (F.col("channel").rlike(CHANNEL), "channel must be a short non-identifying label"),
        (F.size(samples).between(1, FRAME_SAMPLES) & F.forall(samples, finite), "samples_uv must contain 1–1024 finite values"),
        (sent.isNull() | (finite(sent) & (sent >= 0)), "sent_at_unix_ms must be a Unix-millisecond number if supplied"),
    ]
    out = F.lit(None).cast("string")
    for ok, message in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)).otherwise(out)
    return out


#: The stages of a trace and the one that must be there before.
STAGES = ["drdy", "spi_done", "process", "event", "observer"]
BEFORE = {"spi_done": "drdy", "process": "spi_done", "event": "process", "observer": "process"}


def mark_codes(marks: DataFrame) -> DataFrame:
    """``marks`` (trace, pos, stage, ts) + code of each mark in turn.

    DUPLICATE_STAGE, then STAGE_ORDER (its predecessor was not accepted yet), then TIME_ORDER (before an accepted one);
    a rejected mark leaves the trace as it was. A fold over the marks of a trace, which are few by their nature.
    """
    empty = F.expr("cast(array() as array<struct<stage:string,ts:bigint>>)")
    out = F.expr("cast(array() as array<struct<pos:int,code:string>>)")
    need = F.create_map(*[F.lit(x) for kv in BEFORE.items() for x in kv])

    def step(acc: Column, m: Column) -> Column:
        have = F.transform(acc["seen"], lambda s: s["stage"])
        before = F.try_element_at(need, m["stage"])
        late = F.exists(acc["seen"], lambda s: m["ts"] < s["ts"])
        code = (
            F.when(~m["stage"].isin(STAGES), "ARGUMENT")
            .when(F.array_contains(have, m["stage"]), "DUPLICATE_STAGE")
            .when(before.isNotNull() & ~F.array_contains(have, before), "STAGE_ORDER")
            .when(late, "TIME_ORDER")
            .otherwise("OK")
        )
        kept = F.struct(m["stage"].alias("stage"), m["ts"].alias("ts"))
        return F.struct(
            F.when(code == "OK", F.array_append(acc["seen"], kept)).otherwise(acc["seen"]).alias("seen"),
            F.array_append(acc["out"], F.struct(m["pos"].alias("pos"), code.alias("code"))).alias("out"),
        )

    folded = F.aggregate("_all", F.struct(empty.alias("seen"), out.alias("out")), step, lambda a: a["out"])
    per = marks.groupBy("trace").agg(
        F.array_sort(F.collect_list(F.struct("pos", "stage", F.col("ts").cast("bigint").alias("ts")))).alias("_all")
    )
    return marks.join(per.select("trace", F.inline(folded)), ["trace", "pos"])


def stage_delta(start: Column, end: Column) -> Column:
    """struct(code, delta): MISSING_STAGE, TIME_ORDER, or OK and the difference."""
    code = F.when(start.isNull() | end.isNull(), "MISSING_STAGE").when(end < start, "TIME_ORDER").otherwise("OK")
    return F.struct(code.alias("code"), F.when(code == "OK", end - start).alias("delta"))


def _starts(rows: DataFrame, scope: str, order: str, size: str) -> DataFrame:
    """``rows`` + _at: what comes before each in its scope."""
    whole = running(rows, scope, [order], size)
    return whole.withColumn("_at", F.coalesce("run_sum", F.lit(0)) - F.coalesce(size, F.lit(0))).drop("run_n", "run_sum", "run_avg")


def record_owner(records: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """Records of a stream assigned to the files whose byte budgets they fill, in order.

    ``records``: scope, pos, size; ``files``: scope, file_no, budget. Running sums on both sides, in two levels; a record
    belongs to the file whose range holds its first byte. The ranges are joined by a union and a forward fill over blocks of
    positions, handed on from block to block, so that a scope with a third of all records is no single task.
    """
    starts, opens = _starts(records, scope, "pos", "size"), _starts(files, scope, "file_no", "budget")
    none = lambda kind: F.lit(None).cast(kind)
    both = opens.select(scope, "_at", F.lit(0).alias("_k"), none("bigint").alias("pos"), none("bigint").alias("size"), F.col("file_no").cast("int").alias("file_no")).unionByName(
        starts.select(scope, "_at", F.lit(1).alias("_k"), F.col("pos").cast("bigint"), F.col("size").cast("bigint"), none("int").alias("file_no"))
    )
    b = blocked(both, "_at")
    # file numbers ascend with the ranges, so the last one so far is the greatest
    before = _handed_on(b, scope, _open=(F.max("file_no"), F.max))
    within = F.max("file_no").over(Window.partitionBy(scope, "_blk").orderBy("_at", "_k", "pos").rowsBetween(Window.unboundedPreceding, 0))
    out = b.join(before, [scope, "_blk"], "left").withColumn("owner", F.coalesce(within, F.col("_open"))).where("_k = 1")
    return out.select(scope, "pos", "size", F.col("owner").alias("file_no"))


def latest_serial(events: DataFrame, key: str, serial: str) -> DataFrame:
    return events.groupBy(key).agg(F.max(serial).alias("max_serial"), F.count(F.lit(1)).alias("replayed"))
