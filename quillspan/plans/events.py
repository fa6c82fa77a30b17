"""Event queries: sequences, rings, running figures, traces, frames, budgets."""

from pyspark.sql import functions as F

from quillspan.functions import numbers as nm
from quillspan.operators import events as ev
from quillspan.session import table
from quillspan.sources.feeds import bounded_tail


def _events(s, d):
    return table(s, d, "events")


def _frames(s, d):
    """Events as signal frames, good and broken ones as they come."""
    v = F.col("value")
    return _events(s, d).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "other").otherwise("sig/1").alias("protocol"),
        F.lit("frame").alias("type"),
        (v * 20).alias("sample_rate_hz"),
        F.concat("event_type", F.when(F.col("user_id") % 5 == 0, F.lit(" !")).otherwise(F.lit(""))).alias("channel"),
        F.when(v > 1, F.array(v, -v)).otherwise(F.array().cast("array<double>")).alias("samples_uv"),
        F.when(F.col("user_id") % 7 == 0, -v).alias("sent_at_unix_ms"),
    )


def _replay(s, d):
    """Delivered lines once: of several deliveries of a line the first."""
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    return ev.deduplicated(table(s, d, "packet_lines").select("packet_id", "page_no", "n", at.alias("at"), "words"), ["packet_id", "page_no", "n"])


def _traces(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    o = table(s, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = ev.stage_delta(us("o_orderdate"), us("first_ship"))
    b = ev.stage_delta(us("first_ship"), us("last_ship"))
    return o.select("o_orderkey", a["code"].alias("to_ship"), a["delta"].alias("to_ship_us"), b["code"].alias("shipping"), b["delta"].alias("shipping_us"))


def _marks(s, d):
    """Dates of an order as marks of a trace, in the order of its lines."""
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("trace"),
        F.col("l_linenumber").alias("pos"),
        F.element_at(F.array(*[F.lit(x) for x in ev.STAGES]), F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("int") + 1).alias("stage"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"),
    )
    return ev.mark_codes(li.dropDuplicates(["trace", "pos"])).select("trace", "pos", "stage", "code")


def _budget(s, d):
    """Order lines as records that fill the customers' orders' budgets, by customer."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    files = o.select(
        F.col("o_custkey").alias("cust"),
        F.row_number().over(_by_cust()).cast("int").alias("file_no"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("budget"),
    )
    recs = o.select(
        F.col("o_custkey").alias("cust"),
        F.row_number().over(_by_cust()).cast("int").alias("pos"),
        F.floor(F.col("o_totalprice") / 150).cast("long").alias("size"),
    )
    return ev.record_owner(recs, files, "cust")


def _by_cust():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


def _tails(s, d):
    tail = bounded_tail(F.col("embedding"), 10)
    return table(s, d, "embeddings").select("vec_id", F.size(tail).alias("n"), F.get(tail, F.lit(0)).cast("double").alias("first"))


QUERIES = {
    "bounded_tails": _tails,
    "sequence_gaps": lambda s, d: ev.gaps(_events(s, d), "user_id", "event_id").select("event_id", "user_id", "missing"),
    "monotone_reject": lambda s, d: ev.monotone(_events(s, d), "user_id", ["ts", "event_id"], "event_id").select("event_id", "rejected"),
    "ring_last_12": lambda s, d: ev.ring(_events(s, d), "user_id", [F.desc("ts"), F.desc("event_id")], 12).select("event_id", "user_id", "age"),
    "running_stats": lambda s, d: ev.running(_events(s, d), "user_id", ["ts", "event_id"], "value").select(
        "event_id", "run_n", F.round("run_sum", 4).alias("run_sum")
    ),
    "echo_dedupe": _replay,
    "latest_serial": lambda s, d: ev.latest_serial(_events(s, d), "user_id", "event_id"),
    "frame_errors": lambda s, d: _frames(s, d).select("seq", ev.frame_error("sig/1").alias("error")),
    "clock_usable": lambda s, d: _events(s, d).select(
        "event_id", nm.clock_usable(F.col("event_type") != "error", F.col("value").cast("int"), 50).alias("usable")
    ),
    "threshold_cue": lambda s, d: _events(s, d).select("event_id", nm.cue(F.when(F.col("event_type") != "view", F.col("value")), 40.0).alias("cue")),
    "stage_trace": _traces,
    "stage_marks": _marks,
    "record_budgets": _budget,
    "record_payload": lambda s, d: table(s, d, "files").where("length > 21").select(
        "file_id", nm.record_payload(F.col("length"), F.lit(65536)).alias("plain_bytes")
    ),
    "band_rms": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(nm.band_rms(F.col("embedding").cast("array<double>"), 64, 8, 12), 6).alias("rms")),
}

ORACLE = {
    "bounded_tails": 'select vec_id, 10 n, cast(embedding[len(embedding) - 9] as double) "first" from embeddings',
    "sequence_gaps": "select event_id, user_id, greatest(coalesce(event_id - lag(event_id) over (partition by user_id order by event_id) - 1, 0), 0) missing from events",
    "monotone_reject": """select event_id, coalesce(event_id <= max(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) rejected from events""",
    "ring_last_12": """select event_id, user_id, cast(a as int) age from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) a from events) where a <= 12""",
    "running_stats": """select event_id, count("value") over w run_n, round(sum("value") over w, 4) run_sum from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "echo_dedupe": """select packet_id, page_no, n, "at", words from (select packet_id, page_no, n, epoch_us(received_at) "at", words,
 row_number() over (partition by packet_id, page_no, n order by received_at nulls first, words nulls first) rn from packet_lines) where rn = 1""",
    "stage_marks": """
with recursive m as (select l_orderkey trace, l_linenumber pos, ['drdy', 'spi_done', 'process', 'event', 'observer'][(l_linenumber - 1) % 5 + 1] stage, epoch_us(l_shipdate) ts,
  row_number() over (partition by l_orderkey order by l_linenumber) k from (select distinct on (l_orderkey, l_linenumber) * from lineitem)),
f as (select trace, 0 k, cast(null as int) pos, cast(null as varchar) stage, cast([] as varchar[]) seen, cast(null as bigint) latest, cast(null as varchar) code from (select distinct trace from m)
 union all select trace, cast(k as int), pos, stage, case when code = 'OK' then list_append(seen, stage) else seen end, case when code = 'OK' then greatest(latest, ts) else latest end, code
 from (select m.trace, m.k, m.pos, m.stage, m.ts, f.seen, f.latest, case when list_contains(f.seen, m.stage) then 'DUPLICATE_STAGE'
  when not list_contains(f.seen, map {'spi_done': 'drdy', 'process': 'spi_done', 'event': 'process', 'observer': 'process'}[m.stage]) and m.stage <> 'drdy' then 'STAGE_ORDER'
  when m.ts < f.latest then 'TIME_ORDER' else 'OK' end code from f join m on m.trace = f.trace and m.k = f.k + 1))
select trace, cast(pos as int) pos, stage, code from f where k > 0""",
    "latest_serial": "select user_id, max(event_id) max_serial, count(*) replayed from events group by 1",
    "frame_errors": """
with f as (select event_id seq, case when event_type = 'error' then 'other' else 'sig/1' end p, "value" * 20 rate,
 event_type || case when user_id % 5 = 0 then ' !' else '' end ch, case when "value" > 1 then ["value", -"value"] else [] end sm,
 case when user_id % 7 = 0 then -"value" end sent from events)
select seq, case when p <> 'sig/1' then 'unsupported frame protocol/type' when not (seq >= 0) then 'seq must be a non-negative integer'
 when not coalesce(rate between 32 and 2048, false) then 'sample_rate_hz must be 32–2048'
 when not regexp_matches(ch, '^[A-Za-z0-9_.-]{1,24}$') then 'channel must be a short non-identifying label'
 when not (len(sm) between 1 and 1024) then 'samples_uv must contain 1–1024 finite values'
 when not (sent is null or sent >= 0) then 'sent_at_unix_ms must be a Unix-millisecond number if supplied' end error from f""",
    "clock_usable": """select event_id, coalesce(event_type <> 'error' and cast(trunc("value") as int) <= 50, false) usable from events""",
    "threshold_cue": """select event_id, case when event_type = 'view' or "value" is null then 'waiting' when "value" >= 40 then 'on' else 'off' end cue from events""",
    "stage_trace": """
with l as (select l_orderkey, min(l_shipdate) a, max(l_shipdate) z from lineitem group by 1),
t as (select o_orderkey, epoch_us(o_orderdate) o, epoch_us(a) a, epoch_us(z) z from orders left join l on o_orderkey = l_orderkey)
select o_orderkey, case when o is null or a is null then 'MISSING_STAGE' when a < o then 'TIME_ORDER' else 'OK' end to_ship,
 case when a >= o then a - o end to_ship_us, case when a is null then 'MISSING_STAGE' when z < a then 'TIME_ORDER' else 'OK' end shipping,
 case when z >= a then z - a end shipping_us from t""",
    "record_payload": """select file_id, length - 21 - 17 * cast(ceil((length - 21) / 65536.0) as bigint) plain_bytes from files where length > 21""",
    "record_budgets": """
with o as (select o_custkey cust, row_number() over (partition by o_custkey order by o_orderkey) k, cast(floor(o_totalprice / 100) as bigint) b, cast(floor(o_totalprice / 150) as bigint) z from orders),
f as (select cust, k file_no, coalesce(sum(b) over (partition by cust order by k rows between unbounded preceding and 1 preceding), 0) lo from o),
r as (select cust, k pos, z size, coalesce(sum(z) over (partition by cust order by k rows between unbounded preceding and 1 preceding), 0) at0 from o)
select r.cust, pos, cast(size as bigint) size, cast(max(file_no) as int) file_no from r join f on r.cust = f.cust and f.lo <= r.at0 group by 1, 2, 3""",
    "band_rms": """
with e as (select vec_id, embedding, len(embedding) n, unnest(range(8, 13)) hz from embeddings),
x as (select vec_id, hz, n, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 i from e),
p as (select vec_id, hz, n, sum(v * sin(2 * pi() * hz * i / 64)) a, sum(v * cos(2 * pi() * hz * i / 64)) b from x group by 1, 2, 3)
select vec_id, round(sqrt(sum(pow(2.0 / n, 2) * (a * a + b * b)) / 10), 6) rms from p group by 1""",
}
