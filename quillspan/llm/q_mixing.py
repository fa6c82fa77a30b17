"""p7: mixing sources to target weights."""

from pyspark.sql import functions as F

from quillspan.llm import mixing as mx
from quillspan.session import table


def _mix(s, d, **kw):
    return mx.mixed(table(s, d, "documents"), table(s, d, "mix_targets"), total=mx.WHOLE, **kw)


def _report(s, d):
    return mx.report(table(s, d, "documents"), table(s, d, "mix_targets"), _mix(s, d))


def _invariants(s, d):
    """Per source with a share: its different texts, all of which the mix uses, and whether any is used too often."""
    r = _report(s, d).where("target_share > 0 and max_repeats >= 1")
    return r.select("source", "texts_used", (F.col("most_uses") > F.col("max_repeats")).alias("used_too_often"))


QUERIES = {"p7_mixed": _mix, "p7_report": _report, "p7_invariants": _invariants}

ORACLE = {
    "p7_invariants": """
with t as (select lower(trim(source)) source, sum(target_share) share, max(max_repeats) r from mix_targets group by 1),
d as (select lower(trim(source)) source, count(distinct "text") n from documents where "text" <> '' group by 1)
select t.source, coalesce(n, 0) texts_used, false used_too_often from t left join d on d.source = t.source where t.source <> '' and share > 0 and r >= 1""",
}
