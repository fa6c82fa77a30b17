"""Replies, digests, turns and streaks: what models say recounted, and figures of games in closed form."""

from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import text as tx
from quillspan.operators import events as ev
from quillspan.operators import ledger as lg
from quillspan.operators import verse as vs
from quillspan.plans.syllable_sql import SPOKEN
from quillspan.plans.text_sql import TOKENS
from quillspan.plans.transcript import _candidates
from quillspan.plans.verse_sql import ANALYSED, CANDIDATES, CHOSEN
from quillspan.session import table
from quillspan.sources import sinks, synthetic


def _recounts(s, d):
    """Candidates as a model's findings: each says 5-7-5 of its lines."""
    said = F.array(*[F.lit(n) for n in vs.TARGET])
    c = table(s, d, "candidates").select(
        F.col("candidate_id").alias("reply_id"), "packet_id", "page_no", F.col("line_texts").alias("lines"), F.col("line_texts").alias("ocr_lines"),
        said.alias("syllables"), F.col("line_ids").alias("source_line_ids"),
    )
    got = vs.revalidated(c, table(s, d, "packet_lines"))
    return got.select("reply_id", "validation", "agree", F.array_join("unresolved", "|").alias("unresolved"), F.size("corrections").alias("corrections"))


def _replies(s, d):
    """Texts as two kinds of chat reply, and the text in them."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    other = F.struct(F.lit("note").alias("type"), F.lit("x").alias("text"))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    parts = F.to_json(F.struct(F.array(other, part).alias("content")))
    raw = F.when(F.col("doc_id") % 2 == 0, chat).otherwise(parts)
    return table(s, d, "documents").where("text is not null and text != ''").select("doc_id", F.md5(tx.reply_text(raw)).alias("md5"))


def _turns(s, d):
    """Six seats, alive by the bits of a customer's number."""
    alive = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.floor(F.col("c_custkey") / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return table(s, d, "customer").select("c_custkey", lg.next_alive(alive, F.col("c_custkey") % 6).alias("turn"))


def _streaks(s, d):
    """Orders as throws of two dice: how many doubles in a row a customer has thrown."""
    hit = F.col("o_orderkey") % 4 == F.floor(F.col("o_totalprice")) % 4
    return ev.streaks(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"], hit).select("o_orderkey", "streak")


def _bytes(s, d):
    return table(s, d, "documents").where("title is not null").select("doc_id", by.json_safe(F.encode("title", "UTF-8"), 24).alias("safe"))


def _signal(s, d):
    """Ten seconds of the test signal: its frames, and whether samples stay within what its waves can reach."""
    f = synthetic.signal(s, 10)
    return f.select("seq", "channel", F.size("samples_uv").alias("n"), F.forall("samples_uv", lambda v: F.abs(v) <= 15.61).alias("bounded"))


QUERIES = {
    "reply_recounts": _recounts,
    "reply_texts": _replies,
    "verse_digests": lambda s, d: sinks.digest(vs.selected(_candidates(s, d))),
    "turn_rotation": _turns,
    "double_streaks": _streaks,
    "last_alive": lambda s, d: lg.last_alive(table(s, d, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal") > 9900),
    "json_safe_titles": _bytes,
    "terminal_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(tx.plain_text(F.col("text"), 0x5A)).alias("md5")),
    "signal_frames": _signal,
}

ORACLE = {
    "reply_recounts": f"""
with e as (select candidate_id, unnest(line_texts[1:3]) t, generate_subscripts(line_texts[1:3], 1) i from candidates),
tok as (select candidate_id, i, unnest({TOKENS.format("coalesce(t, '')")}) w from e), words as (select distinct w word from tok), {SPOKEN},
s as (select e.candidate_id, e.i, coalesce(sum(lo), 0) lo, coalesce(sum(hi), 0) hi from e left join tok on tok.candidate_id = e.candidate_id and tok.i = e.i left join spoken on word = w group by 1, 2),
o as (select *, [5, 7, 5][i] g from s), f as (select *, case when lo > g then lo - g when hi < g then g - hi else 0 end off from o),
p as (select candidate_id, count(*) n, sum(off) total, max(off) worst, bool_and(off = 0) agree from f group by 1),
c as (select candidate_id, packet_id, page_no, unnest(line_ids) x, generate_subscripts(line_ids, 1) i from candidates),
k as (select distinct packet_id, page_no, line_id from packet_lines),
u as (select candidate_id, string_agg(x, '|' order by i) ids from c where not exists (select 1 from k where k.packet_id = c.packet_id and k.page_no = c.page_no and k.line_id = c.x) group by 1)
select candidates.candidate_id reply_id, case when coalesce(n, 0) <> 3 then 'not 3 lines (' || coalesce(n, 0) || ')' when total = 0 then 'exact'
 when total <= 2 and worst <= 1 then 'approximate (off by ' || cast(total as int) || ')' else 'not 5-7-5' end validation, case when n = 3 then agree end agree, coalesce(ids, '') unresolved, 0 corrections
from candidates left join p using (candidate_id) left join u using (candidate_id)""",
    "reply_texts": """select doc_id, md5("text") md5 from documents where "text" <> ''""",
    "verse_digests": ANALYSED + CANDIDATES + CHOSEN + """, f as (select c.packet_id, c.page_no, c.n, '### ' || form || ' — ' || validation || ' · score ' || cast(c.milli / 1000.0 as varchar) || chr(10) || chr(10)
 || '    ' || array_to_string(ts, chr(10) || '    ') || chr(10) e from chosen x join cands c on c.packet_id = x.packet_id and c.page_no = x.page_no and c.n = x.n where accepted)
select packet_id, '## ' || packet_id || chr(10) || chr(10) || count(*) || ' found' || chr(10) || chr(10) || string_agg(e, chr(10) order by page_no, n) markdown from f group by packet_id""",
    "turn_rotation": """with c as (select c_custkey, c_custkey % 6 a, list_transform(range(1, 7), lambda k: cast((c_custkey % 6 + k) % 6 as int)) seats from customer)
select c_custkey, cast(coalesce(list_filter(seats, lambda i: (c_custkey >> i) & 1 = 1)[1], a) as int) turn from c""",
    "double_streaks": """with h as (select o_custkey, o_orderkey, o_orderkey % 4 = cast(floor(o_totalprice) as bigint) % 4 hit from orders),
g as (select *, sum(case when hit then 0 else 1 end) over (partition by o_custkey order by o_orderkey) run from h)
select o_orderkey, count(*) filter (hit) over (partition by o_custkey, run order by o_orderkey) streak from g""",
    "last_alive": "select c_nationkey, count(*) filter (c_acctbal > 9900) alive, case when count(*) filter (c_acctbal > 9900) = 1 then min(c_custkey) filter (c_acctbal > 9900) end winner from customer group by 1",
    "json_safe_titles": r"""select doc_id, case when octet_length(encode(title)) > 24 then '<' || octet_length(encode(title)) || ' bytes>' when regexp_matches(title, '^[\x00-\x7f]*$') then title
 else 'base64:' || base64(encode(title)) end safe from documents where title is not null""",
    "terminal_text": r"""select doc_id, md5(translate(regexp_replace("text", '[^\x00-\x7f]', '?', 'g'), '$~', '')) md5 from documents""",
    "signal_frames": "select cast(unnest(range(1, 321)) as bigint) seq, 'SIM-CH1' channel, 8 n, true bounded",
}
