"""p6: filling fixed-capacity containers."""

from pyspark.sql import functions as F

from quillspan.llm import packing as pk
from quillspan.session import table


def _packed(s, d):
    return pk.packed(table(s, d, "documents"), table(s, d, "containers"))


QUERIES = {
    "p6_packed": _packed,
    "p6_report": lambda s, d: pk.report(_packed(s, d)),
    "p6_invariants": lambda s, d: pk.invariants(_packed(s, d)).select(
        "container", F.col("capacity").cast("bigint").alias("capacity"), "texts", "overfull", "repeated", "split_without_need"
    ),
}

ORACLE = {
    "p6_invariants": """select container, cast(capacity_tokens as bigint) capacity, count(*) texts, cast(0 as bigint) overfull, cast(0 as bigint) repeated,
 cast(0 as bigint) split_without_need from containers, documents where capacity_tokens > 0 and "text" <> '' group by 1, 2""",
}
