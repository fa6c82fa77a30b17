"""Transcript queries: line context, page figures, verse."""

from pyspark.sql import functions as F

from quillspan.functions import syllables as sy
from quillspan.functions import text as tx
from quillspan.operators import nested
from quillspan.operators import reconcile as rc
from quillspan.operators import transcript as tr
from quillspan.operators import verse as vs
from quillspan.plans import nested as nq
from quillspan.plans.syllable_sql import SPOKEN
from quillspan.plans.text_sql import TOKENS
from quillspan.plans.verse_sql import ANALYSED, CANDIDATES, CHOSEN
from quillspan.session import cut, table

_PAGE = ["packet_id", "page_no"]


def lines(s, d):
    return tr.deduplicated(table(s, d, "packet_lines"))


def _once(s, d, *cols):
    """Lines with only the columns needed: duplicates agree on them, but for what is read here."""
    return tr.deduplicated(table(s, d, "packet_lines").select("packet_id", "page_no", "n", "received_at", *cols))


def _analysed(s, d):
    return vs.analysed(lines(s, d))


def _candidates(s, d):
    a = cut(_analysed(s, d))
    return vs.candidates(a, tr.text_widths(a))


def _verse_stats(s, d):
    a = cut(_analysed(s, d))
    return vs.statistics(a, vs.selected(vs.candidates(a, tr.text_widths(a))))


def _junk_edges(s, d):
    """Edge words of nested deliveries cut where they are specks."""
    ws = nested.words(table(s, d, "packets")).groupBy("delivery_id", "par_pos", "line_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "text", "conf"))), lambda w: F.struct(w["text"].alias("text"), w["conf"].alias("conf"))).alias("ws")
    )
    t = tx.trimmed_words(F.col("ws"))
    return ws.select("delivery_id", "par_pos", "line_pos", t["text"].alias("text"), F.array_join(t["dropped"], "|").alias("dropped"))


def _triples(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*_PAGE).orderBy("n")
    return _once(s, d, "text").select(
        *_PAGE, "n", F.lead("n", 1).over(w).alias("n2"), F.lead("n", 2).over(w).alias("n3")
    ).where("n3 is not null")


def _found_by(s, d):
    """Lines that two detectors call no prose: short ones, and ones of few letters."""
    base = _once(s, d, "text", "words")
    a = base.where("words <= 3").select(*_PAGE, "n", F.col("words").alias("score"))
    b = base.where(tx.letters(F.col("text")) * 10 < tx.ink(F.col("text")) * 6).select(*_PAGE, "n", F.col("words").alias("score"))
    return rc.merged(a, b, [*_PAGE, "n"], ("short", "letters")).select(*_PAGE, "n", "score", F.array_join("found_by", "+").alias("found_by"))


def _cited(s, d):
    ids = F.transform("line_ids", lambda x: F.lower(F.trim(x)))
    c = table(s, d, "candidates").withColumn("ids", ids)
    return rc.unresolved(c, table(s, d, "packet_lines").withColumn("line_id", F.lower(F.trim("line_id"))), "candidate_id", "ids", _PAGE, "line_id").select(
        "candidate_id", F.array_join("unresolved", "|").alias("unresolved")
    )


def _resolved_ids(s, d):
    return table(s, d, "candidates").select("candidate_id", F.array_join(F.array_distinct("line_ids"), "|").alias("ids"))


def _explain(s, d):
    ls = table(s, d, "notebooks").select("notebook_id", F.lit(1).alias("k"), F.col("title").alias("text"))
    return sy.line_syllables(ls, ["notebook_id", "k"]).select("notebook_id", sy.explained(F.col("breakdown")).alias("explained"))


def _parsed(s, d):
    return tr.parsed_text(table(s, d, "documents")).select("doc_id", "page_no", "par_no", "n", "line_id", "text")


QUERIES = {
    "line_context": lambda s, d: tr.numbered(_once(s, d, "par_id")).select(*_PAGE, "n", "line_no", "par_pos", "par_count"),
    "line_heights": lambda s, d: tr.line_heights(_once(s, d, "bbox")),
    "line_gaps": lambda s, d: tr.with_gaps(_once(s, d, "bbox")).select(*_PAGE, "n", F.col("gap").isNull().alias("no_gap")),
    "text_widths": lambda s, d: tr.text_widths(_once(s, d, "bbox")),
    "page_boxes": lambda s, d: tr.boxes(_once(s, d, "bbox"), _PAGE),
    "mean_confidence": lambda s, d: tr.mean_confidence(_once(s, d, "conf"), _PAGE).select(*_PAGE, "conf_n", F.bround(F.col("conf_sum"), 6).alias("conf_sum")),
    "page_text": lambda s, d: tr.page_text(_once(s, d, "text", "par_id")),
    "plain_pages": _parsed,
    "line_triples": _triples,
    "junk_edges": _junk_edges,
    "found_by_merge": _found_by,
    "cited_lines": _cited,
    "ordered_distinct_ids": _resolved_ids,
    "line_exclusions": lambda s, d: _analysed(s, d).select(*_PAGE, "n", "word_count", F.array_join("excluded", "; ").alias("excluded")),
    "verse_candidates": lambda s, d: _candidates(s, d).select(*_PAGE, "n", "deviation", "milli", "form", "validation"),
    "verse_selected": lambda s, d: vs.selected(_candidates(s, d)).select(*_PAGE, "n", "milli", "accepted", "reason"),
    "verse_stats": _verse_stats,
    "verse_totals": lambda s, d: vs.digest_totals(vs.selected(_candidates(s, d))),
    "explained_titles": _explain,
}

_ONCE = """with r as (select *, row_number() over (partition by packet_id, page_no, n order by received_at desc) rn from packet_lines),
l as (select * from r where rn = 1)"""
_TRIM = "lower(trim({0}))"

ORACLE = {
    "line_exclusions": ANALYSED + " select packet_id, page_no, n, word_count, array_to_string(excluded, '; ') excluded from analysed",
    "verse_candidates": ANALYSED + CANDIDATES + " select packet_id, page_no, n, deviation, milli, form, validation from cands",
    "verse_selected": ANALYSED + CANDIDATES + CHOSEN + " select packet_id, page_no, n, milli, accepted, reason from chosen",
    "verse_stats": ANALYSED + CANDIDATES + CHOSEN + """ select (select count(*) from analysed) "lines", (select count(*) from analysed where len(excluded) = 0) usable_lines,
 (select count(*) from chosen) candidates, (select count(*) from chosen where accepted) accepted, (select count(*) from chosen where not accepted) rejected""",
    "verse_totals": ANALYSED + CANDIDATES + CHOSEN + """ select count(*) pages, coalesce(cast(sum(v) as bigint), 0) verses from
 (select packet_id, page_no, count(*) v from chosen where accepted group by 1, 2)""",
    "explained_titles": f"""with tok as (select notebook_id, unnest({TOKENS.format('title')}) w, generate_subscripts({TOKENS.format('title')}, 1) i from notebooks),
words as (select distinct w word from tok), {SPOKEN},
s as (select *, case when lo = hi then '' || lo else lo || '-' || hi end span from tok join spoken on word = w),
e as (select notebook_id, string_agg(w || '(' || span || ')', ' ' order by i) t, sum(lo) lo, sum(hi) hi from s group by 1)
select notebook_id, coalesce(t, '') || ' = ' || case when coalesce(lo, 0) = coalesce(hi, 0) then '' || coalesce(lo, 0) else lo || '-' || hi end explained from notebooks left join e using (notebook_id)""",
    "junk_edges": f"""with w as ({nq.ORACLE["p2_words"]}),
m as (select *, trim("text") t0 from w),
j as (select *, not regexp_matches(t0, '[\\p{{L}}\\p{{N}}]') or (coalesce(conf, 100) < 30 and length(t0) <= 2 and lower(t0) not in ({", ".join(repr(x) for x in tx.SHORT_WORDS)})) junk from m),
g as (select delivery_id, par_pos, line_pos, list("text" order by word_pos) ts, list(not junk order by word_pos) ok from j group by 1, 2, 3),
b as (select *, list_position(ok, true) lo, len(ok) + 1 - list_position(list_reverse(ok), true) hi from g)
select delivery_id, par_pos, line_pos, case when lo > 0 then regexp_replace(regexp_replace(array_to_string(ts[lo:hi], ' '), '[ \t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end "text",
 case when lo > 0 then array_to_string(list_concat(ts[1:lo - 1], list_reverse(ts[hi + 1:])), '|') end dropped from b""",
    "line_context": _ONCE + """ select packet_id, page_no, n, cast(row_number() over (partition by packet_id, page_no order by n) as int) line_no,
 cast(row_number() over (partition by packet_id, page_no, par_id order by n) - 1 as int) par_pos,
 count(*) over (partition by packet_id, page_no, par_id) par_count from l""",
    "line_heights": _ONCE + """ select packet_id, page_no, median(cast(bbox.y1 - bbox.y0 as double)) median_height from l
 where bbox.y1 - bbox.y0 > 0 group by 1, 2""",
    "line_gaps": _ONCE + """, m as (select packet_id, page_no, median(cast(bbox.y1 - bbox.y0 as double)) h from l where bbox.y1 - bbox.y0 > 0 group by 1, 2),
g as (select l.packet_id, l.page_no, l.n, bbox.y0 - lag(bbox.y1) over (partition by l.packet_id, l.page_no order by l.n) up from l)
select packet_id, page_no, n, (up is null or h is null) no_gap from g left join m using (packet_id, page_no)""",
    "text_widths": _ONCE + """, w as (select packet_id, page_no, list_sort(list(bbox.x1 - bbox.x0)) ws from l where bbox is not null group by 1, 2)
select packet_id, page_no, ws[case when len(ws) > 4 then cast(floor(len(ws) * 0.9) as int) + 1 else len(ws) end] text_width from w""",
    "page_boxes": _ONCE + """ select packet_id, page_no, min(bbox.x0) x0, min(bbox.y0) y0, max(bbox.x1) x1, max(bbox.y1) y1 from l
 where bbox is not null group by 1, 2""",
    "mean_confidence": _ONCE + """ select packet_id, page_no, count(conf) conf_n, round(sum(conf), 6) conf_sum from l group by 1, 2""",
    "page_text": _ONCE + """, b as (select packet_id, page_no, n, case when par_id <> lag(par_id) over (partition by packet_id, page_no order by n)
  then chr(10) else '' end || coalesce("text", '') t from l)
select packet_id, page_no, string_agg(t, chr(10) order by n) "text" from b group by 1, 2""",
    "plain_pages": r"""
with p0 as (select doc_id, unnest(list_filter(string_split(replace(coalesce("text", ''), chr(13) || chr(10), chr(10)), chr(12)), lambda x: regexp_matches(x, '\S'))) t,
  generate_subscripts(list_filter(string_split(replace(coalesce("text", ''), chr(13) || chr(10), chr(10)), chr(12)), lambda x: regexp_matches(x, '\S')), 1) page_no from documents),
r as (select doc_id, page_no, unnest(string_split(t, chr(10))) raw, generate_subscripts(string_split(t, chr(10)), 1) i from p0),
f as (select *, regexp_matches(raw, '\S') full_line, coalesce(lag(regexp_matches(raw, '\S')) over (partition by doc_id, page_no order by i), false) before from r),
k as (select doc_id, page_no, i, raw, sum(case when full_line and not before then 1 else 0 end) over (partition by doc_id, page_no order by i) par_no, full_line from f)
select doc_id, cast(page_no as int) page_no, cast(par_no as int) par_no, cast(row_number() over (partition by doc_id, page_no order by i) as int) n,
 'line_' || page_no || '_' || row_number() over (partition by doc_id, page_no order by i) line_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') "text" from k where full_line""",
    "line_triples": _ONCE + """, t as (select packet_id, page_no, n, lead(n, 1) over w n2, lead(n, 2) over w n3 from l window w as (partition by packet_id, page_no order by n))
select * from t where n3 is not null""",
    "found_by_merge": _ONCE + r""", a as (select packet_id, page_no, n, words score from l where words <= 3),
b as (select packet_id, page_no, n, words score from l where length(regexp_replace("text", '[^\p{L}]+', '', 'g')) * 10 < length(regexp_replace("text", '\s+', '', 'g')) * 6)
select coalesce(a.packet_id, b.packet_id) packet_id, coalesce(a.page_no, b.page_no) page_no, coalesce(a.n, b.n) n, coalesce(a.score, b.score) score,
 case when a.n is not null and b.n is not null then 'short+letters' when a.n is not null then 'short' else 'letters' end found_by
from a full join b on a.packet_id = b.packet_id and a.page_no = b.page_no and a.n = b.n""",
    "ordered_distinct_ids": """select candidate_id, array_to_string(list_filter(line_ids, lambda x, i: list_position(line_ids, x) = i), '|') ids from candidates""",
    "cited_lines": """
with c as (select candidate_id, packet_id, page_no, unnest(line_ids) x, generate_subscripts(line_ids, 1) i from candidates),
k as (select distinct packet_id, page_no, lower(trim(line_id)) line_id from packet_lines)
select candidate_id, string_agg(lower(trim(x)), '|' order by i) unresolved from c where not exists
 (select 1 from k where k.packet_id = c.packet_id and k.page_no = c.page_no and k.line_id = lower(trim(c.x))) group by 1""",
}
