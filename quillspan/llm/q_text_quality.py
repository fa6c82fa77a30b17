"""p5: per-document text quality statistics."""

from pyspark.sql import functions as F

from quillspan.llm import text_quality as tq
from quillspan.session import table

QUERIES = {
    "p5_found": lambda s, d: tq.found(table(s, d, "documents"), table(s, d, "line_analyses")),
    "p5_reasons": lambda s, d: tq.judged(tq.statistics(table(s, d, "documents"), table(s, d, "line_analyses"))).select(
        "doc_id", "kind", F.array_join("reasons", "; ").alias("reasons"), F.array_join("failures", "; ").alias("failures")
    ),
    "p5_counts": lambda s, d: tq.text_statistics(table(s, d, "documents")).select(
        "doc_id", "n_chars", "n_ink", "n_lines", "n_letters", "n_digits"
    ),
    "p5_lines": lambda s, d: tq.line_statistics(table(s, d, "line_analyses")).select(
        "doc_id", "analysed_lines", "low_letter_lines", "excluded_lines"
    ),
}

ORACLE = {
    "p5_counts": r"""
select doc_id, cast(length(t) as bigint) n_chars, cast(length(regexp_replace(t, '\s+', '', 'g')) as bigint) n_ink,
 cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S'))) as bigint) n_lines,
 cast(length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as bigint) n_letters,
 cast(length(regexp_replace(t, '[^\p{Nd}]+', '', 'g')) as bigint) n_digits
from (select doc_id, coalesce("text", '') t from documents)""",
    "p5_lines": """
with r as (select doc_id, letter_ratio, len(coalesce(excluded, [])) reasons, row_number() over (partition by doc_id, line_no
   order by run_at desc nulls last, letter_ratio desc nulls last, word_count desc nulls last, len(coalesce(excluded, [])) desc) rn
   from line_analyses)
select doc_id, count(*) analysed_lines, count(*) filter (letter_ratio < 0.6) low_letter_lines,
 count(*) filter (reasons > 0) excluded_lines from r where rn = 1 group by doc_id""",
}
