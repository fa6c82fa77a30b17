"""Verse in lines once more, as SQL: analysis, windows and scores, greedy selection."""

from quillspan.functions import text as tx
from quillspan.plans.syllable_sql import SPOKEN
from quillspan.plans.text_sql import DATES, TOKENS

_MARKS = tx.TRAILING_MARKS.replace("'", "''")


def bare(x: str) -> str:
    """``x`` without marks at either end."""
    strip = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    return strip.format(f"regexp_replace(regexp_replace({x}, '^[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}]+', ''), '{_MARKS}', '')")


#: CTEs: ``once``, ``analysed`` (lines with t, word_count, lo, hi, excluded) of packet_lines.
ANALYSED = rf"""
with recursive r as (select *, row_number() over (partition by packet_id, page_no, n order by received_at desc) rn from packet_lines),
once as (select * exclude (rn), {bare('coalesce("text", chr(32))')} t from r where rn = 1),
tok as (select packet_id, page_no, n, unnest({TOKENS.format('t')}) w from once),
words as (select distinct w word from tok),
{SPOKEN},
sums as (select packet_id, page_no, n, count(*) wc, sum(lo) lo, sum(hi) hi from tok join spoken on word = w group by 1, 2, 3),
l0 as (select once.*, cast(coalesce(wc, 0) as int) word_count, coalesce(lo, 0) lo, coalesce(hi, 0) hi, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) letters,
 length(regexp_replace(t, '\s+', '', 'g')) ink from once left join sums using (packet_id, page_no, n)),
analysed as (select *, list_filter([
 case when t = '' or word_count = 0 then 'empty' end, case when word_count > 10 then word_count || ' words (prose)' end,
 case when {DATES} then 'date/time' end,
 case when t <> '' and coalesce(letters / nullif(ink, 0), 0) < 0.6 then 'letters ' || cast(round_even(coalesce(letters / nullif(ink, 0), 0) * 100, 0) as int) || '% (numbers/punctuation)' end,
 case when t <> '' and regexp_matches(t, '^\W*\d+\W*$') then 'page number' end, case when conf < 20 then 'ocr confidence ' || cast(round_even(conf, 0) as int) end,
 case when kind = 'ocr_header' then 'header' end, case when hi = 0 then 'no syllables' end, case when lo > 12 then lo || '+ syllables' end], lambda x: x is not null) excluded from l0)
"""

_TRIO = "abc"
_BREAKS = " + ".join(f"len(regexp_extract_all({x}.t, '[.!?]\\s+[A-Z]'))" for x in _TRIO)
_WIDEST = ", ".join(f"({x}.bbox.x1 - {x}.bbox.x0) / tw" for x in _TRIO)
_DEVIATION = [f"case when {x}.lo > {t} then {x}.lo - {t} when {x}.hi < {t} then {t} - {x}.hi else 0 end" for x, t in zip(_TRIO, (5, 7, 5), strict=True)]
_SAID = " + ".join(f"greatest({x}.lo, least({x}.hi, {t}))" for x, t in zip(_TRIO, (5, 7, 5), strict=True))
_ALL = lambda f: " and ".join(f.format(x) for x in _TRIO)
_MOST = lambda f: "greatest(" + ", ".join(f.format(x) for x in _TRIO) + ")"
_PLACE = f"""case when same and a.par_size = 3 then 200 else 0 end + case when same and a.par_size <> 3 then case when short_par then -50 else -300 end else 0 end
 + case when not same then case when singles then 100 when not singles then -250 else 0 end else 0 end
 + case when boxed and widest < 0.65 then 150 when boxed and widest > 0.9 then -200 else 0 end + case when wc >= 9 then -100 when wc <= 6 then 50 else 0 end
 + case when breaks = 1 then -100 when breaks > 1 then -200 else 0 end + case when a.gap_before >= 0.9 then 50 else 0 end
 + case when not ended and after_gap >= 0.9 then 50 else 0 end + case when ended then 50 else 0 end + case when mean < 50 then -100 else 0 end"""

#: CTEs after ANALYSED: ``cands`` (packet_id, page_no, n, deviation, milli, form, validation, ns).
CANDIDATES = f""",
widths as (select packet_id, page_no, ws[case when len(ws) > 4 then cast(floor(len(ws) * 0.9) as int) + 1 else len(ws) end] tw
 from (select packet_id, page_no, list_sort(list(bbox.x1 - bbox.x0)) ws from once where bbox is not null group by 1, 2)),
short as (select *, min(coalesce(nullif(words, 0), len(string_split_regex(trim(coalesce("text", '')), '\\s+'))) <= 7) over (partition by packet_id, page_no, par_id) sp from analysed),
line as (select packet_id, page_no, n, sp, struct_pack(n := n, par_id := par_id, par_size := par_size, bbox := bbox, conf := conf, gap_before := gap_before, t := t, lo := lo, hi := hi,
 wc := word_count, ok := len(excluded) = 0) s from short),
win as (select packet_id, page_no, n, coalesce(sp, false) short_par, s a, lead(s, 1) over w b, lead(s, 2) over w c, lead(s.gap_before, 3) over w after_gap, lead(n, 3) over w is null ended
 from line window w as (partition by packet_id, page_no order by n)),
use as (select win.*, tw, a.par_id = b.par_id and b.par_id = c.par_id same, {_ALL("{0}.par_size = 1")} singles, greatest({_WIDEST}) widest,
 {_ALL("{0}.bbox is not null")} and tw > 0 boxed, {_MOST("{0}.wc")} wc, {_BREAKS} breaks, list_avg(list_filter([a.conf, b.conf, c.conf], lambda x: x is not null)) mean,
 [{", ".join(_DEVIATION)}] devs, {_SAID} said from win left join widths using (packet_id, page_no) where c is not null and a.ok and b.ok and c.ok),
pts as (select *, list_sum(devs) deviation, {_PLACE} place, list_max(devs) <= 1 and list_sum(devs) <= 2 hit,
 a.par_id = c.par_id and a.par_size = 3 and said between 8 and 17 and {_MOST("{0}.hi")} <= 9 and wc <= 6 free from use),
cands as (select packet_id, page_no, n, [a.n, b.n, c.n] ns, [a.t, b.t, c.t] ts, cast(deviation as int) deviation,
 cast(greatest(0, least(1000, case when hit and deviation = 0 then 1000 + place when hit then least(950, 1000 - 150 * deviation + place) else least(800, 550 + place) end)) as int) milli,
 case when hit and deviation = 0 then '5-7-5' when hit then '5-7-5 (approximate)' else 'free-form 3-line' end form,
 case when hit and deviation = 0 then 'exact' when hit then 'approximate (off by ' || cast(deviation as int) || ')' else 'not 5-7-5 (short modern form)' end validation from pts where hit or free)
"""

#: CTEs after CANDIDATES: ``chosen`` (packet_id, page_no, n, milli, accepted, reason).
CHOSEN = """,
queue as (select *, row_number() over (partition by packet_id, page_no order by milli desc, deviation, n) k from cands),
pick as (select packet_id, page_no, 0 k, cast([] as int[]) used, cast(null as int) n, cast(null as int) milli, false accepted, cast(null as varchar) reason from (select distinct packet_id, page_no from queue)
 union all select q.packet_id, q.page_no, cast(q.k as int), case when q.milli >= 500 and not list_has_any(p.used, q.ns) then list_concat(p.used, q.ns) else p.used end, q.n, q.milli,
  q.milli >= 500 and not list_has_any(p.used, q.ns), case when q.milli < 500 then 'score below threshold' when list_has_any(p.used, q.ns) then 'overlaps a higher-scoring candidate' end
  from pick p join queue q on p.packet_id = q.packet_id and p.page_no = q.page_no and q.k = p.k + 1),
chosen as (select * from pick where k > 0)
"""
