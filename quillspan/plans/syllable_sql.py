"""The syllable rules once more, as SQL without look-behind: what is counted less what a letter before rules out."""

from quillspan.functions import syllables as sy

_STEMS = sy.COMPOUND_STEM.split("(?:", 1)[1].split(")(?=", 1)[0]
_INFLECTION = sy.INFLECTION
#: (pattern, the same with what must not stand before, or null), each match adds one.
_PAIRS = [
    ("ia", "[ctsg]ia"), ("io", "[cgstxhnl]io"), ("eo", "[gp]eo"), ("ua", "[gq]ua"), ("ue[lnt]", "[gq]ue[lnt]"), ("ui(?:[dn]|ty|tion)", "[qg]ui(?:[dn]|ty|tion)"),
    ("iu", None), ("uou", None), ("eum", None), ("oic", "oice"), ("iety?$", None), ("[^aeiou]ie(?:r|st)$", None), ("[^aeiouy]ying$", None), ("(?:sm|thm)$", None),
]
_TWO = """(case when ({0}) < 20 then list_extract([2,1,1,1,1,1,1,2,1,1,1,3,1,2,2,2,2,3,2,2], cast({0} as int) + 1)
 else list_extract([0,0,2,2,2,2,2,3,2,2], cast(({0}) // 10 as int) % 10 + 1) + case when ({0}) % 10 > 0 then list_extract([2,1,1,1,1,1,1,2,1,1], cast(({0}) % 10 as int) + 1) else 0 end end)"""


def _two(x: str) -> str:
    return _TWO.format(x)


def _three(x: str) -> str:
    return f"(case when ({x}) // 100 > 0 then {_two(f'({x}) // 100')} + 2 else 0 end + case when ({x}) % 100 > 0 then {_two(f'(({x}) % 100)')} else 0 end)"


def _count(w: str, pattern: str) -> str:
    return f"len(regexp_extract_all({w}, '{pattern}'))"


def rules(w: str) -> str:
    """The count of a word by its letters."""
    out = [_count(f"regexp_replace({w}, 'y([aeiou])', '#\\1', 'g')", "[aeiouy]+")]
    for pattern, unless, change in sy.ENDINGS:
        also = f" and not regexp_matches({w}, '{unless}')" if unless else ""
        out.append(f"case when regexp_matches({w}, '{pattern}'){also} then {change} else 0 end")
    rest = f"regexp_extract({w}, '^(?:{_STEMS})([^aeiouy][a-z]{{2,}})$', 1)"
    compound = f"({rest} <> '' and not regexp_matches({rest}, '{_INFLECTION}'))"
    out.append(f"case when regexp_matches({w}, '{sy.SILENT_SUFFIX}') or {compound} then -1 else 0 end")
    out.append(f"case when {w} in ({', '.join(repr(x) for x in sy.IER_WORDS)}) then -1 else 0 end")
    out += [_count(w, p) + (f" - {_count(w, n)}" if n else "") for p, n in _PAIRS]
    out += [f"- {_count(w, p)}" for p in ("viou?r$", "liar$")]
    return f"case when regexp_matches({w}, '[aeiouy]') then greatest(1, {' + '.join(out)}) else 1 end".replace("+ -", "-")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(w)}, {a}, {b})" for w, (a, b) in sy.EXCEPTIONS.items())

#: CTEs after ``words(word)``, distinct tokens: ``spoken(word, lo, hi)``.
SPOKEN = rf"""
known(k, klo, khi) as (values {_KNOWN}),
plain as (select word, trim(translate(lower(trim(word)), '’‘ʼ', ''''''''), {_quoted(sy._EDGES)}) w from words),
part as (select word, unnest(string_split(w, '-')) p from plain),
part1 as (select *, regexp_matches(p, '[0-9]') fig, regexp_replace(p, '[0-9,.'']', '', 'g') letters, regexp_replace(p, '[^0-9]', '', 'g') d from part),
part2 as (select *, case when not fig then p when letters not in ('st', 'nd', 'rd', 'th', 's', '') then letters end t, try_cast(case when length(d) <= 4 then d end as int) n from part1),
part3 as (select *, coalesce(suffix(t, 'n''t') and length(t) > 3, false) neg from part2),
part4 as (select *, replace(case when neg then left(t, length(t) - 3) else regexp_replace(t, '^(.{{2,}}?)(?:''s|s''|''ll|''ve|''re|''d|''m)$', '\1') end, '''', '') stem from part3),
part5 as (select part4.*, a.klo wlo, a.khi whi, b.klo blo, b.khi bhi, neg::int x from part4 left join known a on a.k = t left join known b on b.k = stem),
part6 as (select *, case when t is null or t = '' then 0 when wlo is not null then wlo when stem = '' then 1 when blo is not null then blo + x else ({rules('stem')}) + x end slo,
 case when t is null or t = '' then 0 when whi is not null then whi when stem = '' then 1 when bhi is not null then bhi + x else ({rules('stem')}) + x end shi,
 {_two('(n // 100)')} + case when n % 100 > 0 then {_two('(n % 100)')} else 2 end yr, {_two('(n // 1000)')} + 2 + case when n % 1000 > 0 then {_three('(n % 1000)')} else 0 end lg from part5),
part7 as (select *, case when not fig then 0 when length(d) <= 2 then {_two('n')} when length(d) = 3 then {_three('n')} when length(d) > 4 then
 list_sum(list_transform(string_split(d, ''), lambda c: list_extract([2,1,1,1,1,1,1,2,1,1], cast(c as int) + 1))) when n between 1000 and 1999 then yr when n between 2000 and 2009 then lg else least(yr, lg) end nlo,
 case when fig and length(d) = 4 then case when n between 1000 and 1999 then yr when n between 2000 and 2009 then lg else greatest(yr, lg) end end nhi from part6),
spoken as (select word, cast(greatest(sum(nlo + slo), case when count(*) > 1 then 1 else 0 end) as int) lo, cast(greatest(sum(coalesce(nhi, nlo) + shi), case when count(*) > 1 then 1 else 0 end) as int) hi from part7 group by word)
"""
