"""p2: nested packet deliveries as flat tables."""

from quillspan.operators import nested
from quillspan.session import table


def _p2_found(spark, sf):
    return nested.words(table(spark, sf, "packets")).select("delivery_id", "par_pos", "line_pos", "word_pos")


QUERIES = {
    "p2_found": _p2_found,
    "p2_words": lambda s, d: nested.words(table(s, d, "packets")).select(
        "delivery_id", "par_pos", "line_pos", "word_pos", "word_id", "text", "conf"
    ),
    "p2_lines": lambda s, d: nested.lines(table(s, d, "packets")).select(
        "delivery_id", "par_pos", "line_pos", "page", "line_id", "n", "text", "kind", "n_words"
    ),
    "p2_paragraphs": lambda s, d: nested.paragraphs(table(s, d, "packets")).select(
        "delivery_id", "par_pos", "page", "par_id", "n_lines"
    ),
}

# A member may be a list, or one element standing alone; DuckDB sees either through JSON.
_LIST = """case json_type({0}) when 'ARRAY' then cast({0} as json[]) when 'NULL' then cast([] as json[])
 else case when {0} is null then cast([] as json[]) else [{0}] end end"""
_TREE = f"""
with typed as (select delivery_id, to_json(paragraphs) pars from packets where paragraphs is not null),
outer_body as (select delivery_id, case when json_valid(body) then cast(body as json) end j from packets where paragraphs is null),
inner_body as (select delivery_id, case when json_type(j) = 'VARCHAR'
   then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end else j end j from outer_body),
paged as (select delivery_id, case when json_extract(j, '$.paragraphs') is not null then {_LIST.format("json_extract(j, '$.paragraphs')")}
   else flatten(list_transform({_LIST.format("json_extract(j, '$.pages')")},
     lambda pg: list_transform({_LIST.format("json_extract(pg, '$.paragraphs')")}, lambda par: case when json_type(par) = 'OBJECT'
      and par ->> '$.page' is null then json_merge_patch(par, json_object('page', json_extract(pg, '$.n'))) else par end))) end pars from inner_body),
tree as (select delivery_id, cast(pars as json[]) pars from typed union all select delivery_id, pars from paged),
p as (select delivery_id, unnest(pars) par, generate_subscripts(pars, 1) - 1 par_pos from tree),
l0 as (select delivery_id, par_pos, {_LIST.format("json_extract(par, '$.lines')")} ls from p),
l as (select delivery_id, par_pos, unnest(ls) line, generate_subscripts(ls, 1) - 1 line_pos from l0),
w0 as (select delivery_id, par_pos, line_pos, {_LIST.format("json_extract(line, '$.words')")} ws from l),
w as (select delivery_id, par_pos, line_pos, unnest(ws) word, generate_subscripts(ws, 1) - 1 word_pos from w0),
t as (select *, case json_type(word) when 'OBJECT' then word ->> '$.text' else word ->> '$' end "text" from w)
"""
_HERE = "where regexp_matches(\"text\", '\\S')"

ORACLE = {
    "p2_found": _TREE
    + f"""select delivery_id, cast(par_pos as int) par_pos, cast(line_pos as int) line_pos,
 cast(word_pos as int) word_pos from t {_HERE}""",
    "p2_words": _TREE
    + f"""select delivery_id, cast(par_pos as int) par_pos, cast(line_pos as int) line_pos, cast(word_pos as int) word_pos,
 case json_type(word) when 'OBJECT' then word ->> '$.id' end word_id, "text",
 case json_type(word) when 'OBJECT' then cast(word ->> '$.conf' as double) end conf from t {_HERE}""",
    "p2_lines": _TREE
    + f"""select l.delivery_id, cast(l.par_pos as int) par_pos, cast(line_pos as int) line_pos, cast(par ->> '$.page' as int) page, line ->> '$.id' line_id,
 cast(line ->> '$.n' as int) n, line ->> '$.text' "text", line ->> '$.kind' kind,
 cast(len(list_filter({_LIST.format("json_extract(line, '$.words')")}, lambda x: x is not null and json_type(x) <> 'NULL')) as int) n_words
 from l join p on l.delivery_id = p.delivery_id and l.par_pos = p.par_pos where line is not null and json_type(line) <> 'NULL'""",
    "p2_paragraphs": _TREE
    + f"""select delivery_id, cast(par_pos as int) par_pos, cast(par ->> '$.page' as int) page, par ->> '$.id' par_id,
 cast(len(list_filter({_LIST.format("json_extract(par, '$.lines')")}, lambda x: x is not null and json_type(x) <> 'NULL')) as int) n_lines
 from p where par is not null and json_type(par) <> 'NULL'""",
}
