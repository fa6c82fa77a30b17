"""Text queries over documents and transcript lines."""

from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import numbers as nm
from quillspan.functions import syllables as sy
from quillspan.functions import text as tx
from quillspan.plans.syllable_sql import SPOKEN
from quillspan.plans.text_sql import DATES, STRIP, TOKENS
from quillspan.session import table


def _docs(s, d):
    return table(s, d, "documents")


def _lines(s, d):
    return table(s, d, "packet_lines").select("packet_id", "page_no", "n", "text", "conf", "kind", "par_size").distinct()


def _tokens(s, d):
    t = tx.tokens(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.slice(t, 1, 5), "|").alias("first_tokens"))


def _words(docs):
    each = docs.select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return each.select(F.lower("word").alias("word")).distinct()


def _numbers(s, d):
    r = sy.of_number(F.col("o_orderkey").cast("string"))
    return table(s, d, "orders").select("o_orderkey", r["lo"].alias("lo"), r["hi"].alias("hi"))


def _intact(s, d):
    enc = by.wrapped_base64(F.encode("text", "UTF-8"))
    return _docs(s, d).select(
        "doc_id",
        F.length(enc).alias("encoded_length"),
        by.intact(enc, F.sha2("text", 256)).alias("intact"),
    )


def _reply(s, d):
    """Replies as a model would wrap them: fences, prose, or bare."""
    obj = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}"))
    kind = F.pmod("user_id", F.lit(3))
    raw = F.when(kind == 0, obj).when(kind == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(
        F.concat(F.lit("Here it is: "), obj, F.lit(" - done"))
    )
    found = tx.unfenced_json(raw)
    return table(s, d, "events").select("event_id", F.get_json_object(found, "$.id").cast("long").alias("id"))


QUERIES = {
    "clean_text": lambda s, d: _docs(s, d).select("doc_id", tx.xml_safe(tx.clean(F.col("text"))).alias("clean")),
    "tokens_per_doc": _tokens,
    "letter_ratio": lambda s, d: _docs(s, d).select(
        "doc_id", tx.letters(F.col("text")).alias("letters"), tx.ink(F.col("text")).alias("ink")
    ),
    "date_like_lines": lambda s, d: _lines(s, d).where(tx.is_date_like(F.col("text"))).select("packet_id", "page_no", "n", "text"),
    "page_number_lines": lambda s, d: _lines(s, d).where(tx.is_page_number(F.col("text"))).select("packet_id", "page_no", "n"),
    "sentence_breaks": lambda s, d: _docs(s, d).select("doc_id", tx.sentence_breaks(F.col("text")).cast("long").alias("breaks")),
    "plain_names": lambda s, d: table(s, d, "candidates").select("engine").distinct().where(tx.looks_like_name(F.col("engine"))),
    "slugs": lambda s, d: table(s, d, "files").select("file_id", tx.slug(F.col("path"), F.col("file_id").cast("string")).alias("slug")),
    "unsafe_paths": lambda s, d: table(s, d, "files").where(tx.is_unsafe_path(F.col("path"))).select("file_id", "path"),
    "safe_fields": lambda s, d: table(s, d, "documents").select(
        "doc_id", tx.safe_text(F.col("title"), 18).alias("title"), tx.safe_id(F.col("source")).alias("source"), tx.safe_color(F.col("lang")).alias("color")
    ),
    "forbidden_terms": lambda s, d: _docs(s, d).select(
        "doc_id", F.array_join(tx.contained_terms(F.col("text"), ["Orchard", "voltage", "key", "verdict"]), ",").alias("terms")
    ),
    "rot13": lambda s, d: _docs(s, d).select("doc_id", tx.rotated(F.col("text"), 13).alias("rot13"), tx.rotated(F.col("text"), 3).alias("caesar3")),
    "sniffed_formats": lambda s, d: table(s, d, "files").select("file_id", tx.sniffed_format(F.col("path"), F.col("head")).alias("format")),
    "number_syllables": _numbers,
    "vowel_groups": lambda s, d: _words(_docs(s, d)).select("word", sy.vowel_groups(F.col("word")).cast("long").alias("groups")),
    "word_syllables": lambda s, d: sy.word_syllables(_words(_docs(s, d))),
    "base64_fixity": _intact,
    "fenced_json": _reply,
    "letter_frequency": lambda s, d: _docs(s, d)
    .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z])"), F.lit(1))).alias("letter"))
    .groupBy("letter").agg(F.count(F.lit(1)).alias("n")),
    "confidence_buckets": lambda s, d: table(s, d, "candidates").where("score between 0 and 1").select("candidate_id", nm.confidence(F.col("score")).alias("bucket")),
    "captured_day": lambda s, d: _docs(s, d).select("doc_id", nm.day_or_blank(F.col("created_at")).alias("day"), nm.iso_utc(F.col("received_at")).alias("received")),
}

_LINES = "with lines as (select distinct packet_id, page_no, n, \"text\", conf, kind, par_size from packet_lines)"
_TWO = """(case when {0} < 20 then list_extract([2,1,1,1,1,1,1,2,1,1,1,3,1,2,2,2,2,3,2,2], cast({0} as int) + 1)
 else list_extract([0,0,2,2,2,2,2,3,2,2], cast({0} // 10 as int) + 1) + case when {0} % 10 > 0 then
 list_extract([2,1,1,1,1,1,1,2,1,1], cast({0} % 10 as int) + 1) else 0 end end)"""

ORACLE = {
    "clean_text": r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce("text", ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'),
 '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') clean from documents""",
    "tokens_per_doc": f"""select doc_id, cast(len({TOKENS.format('"text"')}) as int) n_tokens,
 array_to_string(list_slice({TOKENS.format('"text"')}, 1, 5), '|') first_tokens from documents""",
    "letter_ratio": r"""select doc_id, cast(length(regexp_replace("text", '[^\p{L}]+', '', 'g')) as int) letters,
 cast(length(regexp_replace("text", '\s+', '', 'g')) as int) ink from documents""",
    "date_like_lines": f"""{_LINES}, t as (select *, {STRIP.format('"text"')} t from lines)
select packet_id, page_no, n, "text" from t where {DATES}""",
    "page_number_lines": _LINES + r""" select packet_id, page_no, n from lines where regexp_matches(coalesce("text", ''), '^\W*\d+\W*$')""",
    "sentence_breaks": r"""select doc_id, len(regexp_extract_all("text", '[.!?]\s+[A-Z]')) breaks from documents""",
    "plain_names": "select distinct engine from candidates where regexp_matches(engine, '^[A-Za-z]+$') and length(engine) >= 3",
    "slugs": r"""select file_id, left(regexp_replace(path, '[^A-Za-z0-9_.\-]+', '_', 'g'), 120) || '__' || file_id slug from files""",
    "unsafe_paths": """select file_id, path from files where path like '/%' or contains(path, chr(92)) or list_contains(string_split(path, '/'), '..')""",
    "safe_fields": r"""select doc_id, left(regexp_replace(coalesce(title, ''), '[\x00-\x1f<>]', '', 'g'), 18) title,
 case when length(source) between 1 and 64 and source not in ('__proto__', 'constructor', 'prototype') then source end source,
 case when regexp_matches(regexp_replace(coalesce(lang, ''), '^\s+|\s+$', '', 'g'), '^(#[0-9a-fA-F]{3,8}|[a-zA-Z]{3,20})$')
  then regexp_replace(lang, '^\s+|\s+$', '', 'g') end color from documents""",
    "forbidden_terms": """select doc_id, array_to_string(list_filter(['Orchard', 'voltage', 'key', 'verdict'],
 lambda t: contains(lower("text"), lower(t))), ',') terms from documents""",
    "rot13": """select doc_id, translate("text", 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') rot13, translate("text", 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'defghijklmnopqrstuvwxyzabcDEFGHIJKLMNOPQRSTUVWXYZABC') caesar3 from documents""",
    "sniffed_formats": r"""with f as (select file_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) x, lower(left(coalesce(head, ''), 4000)) h from files)
select file_id, case when x in ('.hocr', '.html', '.htm', '.xhtml') or contains(h, 'ocr_page') or contains(h, 'ocrx_word') then 'hocr'
 when x = '.xml' or starts_with(ltrim(h), '<?xml') then case when contains(h, '<alto') or contains(left(h, 600), 'alto') then 'alto'
  when contains(h, 'pcgts') then 'unsupported' else 'alto' end else 'text' end format from f""",
    "number_syllables": f"""
with k as (select o_orderkey, cast(o_orderkey as varchar) d, o_orderkey n from orders),
v as (select *, {_TWO.format('(n // 100)')} + case when n % 100 > 0 then {_TWO.format('(n % 100)')} else 2 end yr,
 {_TWO.format('(n // 1000)')} + 2 + case when n % 1000 = 0 then 0 else
  case when (n % 1000) // 100 > 0 then {_TWO.format('((n % 1000) // 100)')} + 2 else 0 end
  + case when n % 100 > 0 then {_TWO.format('(n % 100)')} else 0 end end lg from k where length(d) = 4),
x as (select o_orderkey, case when length(d) <= 2 then {_TWO.format('n')} when length(d) = 3 then {_TWO.format('(n // 100)')} + 2 +
  case when n % 100 > 0 then {_TWO.format('(n % 100)')} else 0 end
 else list_sum(list_transform(string_split(d, ''), lambda c: list_extract([2,1,1,1,1,1,1,2,1,1], cast(c as int) + 1))) end c
 from k where length(d) <> 4)
select o_orderkey, cast(case when n < 2000 then yr when n < 2010 then lg else least(yr, lg) end as int) lo,
 cast(case when n < 2000 then yr when n < 2010 then lg else greatest(yr, lg) end as int) hi from v
union all select o_orderkey, cast(c as int), cast(c as int) from x""",
    "vowel_groups": f"""
with w as (select distinct lower(t) word from (select unnest({TOKENS.format('"text"')}) t from documents))
select word, len(regexp_extract_all(regexp_replace(regexp_replace(word, 'y([aeiou])', '#\\1', 'g'), 'y#', 'y#', 'g'), '[aeiouy]+')) groups from w""",
    "word_syllables": f"""with words as (select distinct lower(t) word from (select unnest({TOKENS.format('"text"')}) t from documents)), {SPOKEN}
select word, lo, hi from spoken""",
    "base64_fixity": """select doc_id, cast(length(base64(encode("text"))) + (length(base64(encode("text"))) - 1) // 76 as int) encoded_length,
 true intact from documents""",
    "fenced_json": "select event_id, event_id id from events",
    "letter_frequency": """select letter, count(*) n from (select unnest(regexp_extract_all(lower("text"), '[a-z]')) letter from documents) group by 1""",
    "confidence_buckets": """select candidate_id, case when score >= 0.85 then 'high' when score >= 0.65 then 'medium' else 'low' end bucket
 from candidates where score between 0 and 1""",
    "captured_day": """select doc_id, coalesce(strftime(created_at, '%Y-%m-%d'), '') "day", strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') received from documents""",
}
