"""p4: generated, minified, vendored and data files."""

from pyspark.sql import functions as F

from quillspan.llm import source_hygiene as sh
from quillspan.session import table

QUERIES = {
    "p4_found": lambda s, d: sh.judged(table(s, d, "files")).where("not handwritten").select("file_id"),
    "p4_handwritten": lambda s, d: sh.judged(table(s, d, "files")).where("handwritten").select("file_id", "collection"),
    "p4_reasons": lambda s, d: sh.judged(table(s, d, "files")).groupBy(F.array_join("reasons", "; ").alias("reasons")).agg(F.count(F.lit(1)).alias("listings")),
    "p4_shared": lambda s, d: sh.judged(table(s, d, "files")).where(F.array_contains("reasons", sh.SHARED)).select("file_id"),
    "p4_subtrees": lambda s, d: sh.shared_subtrees(table(s, d, "files")).select(
        F.col("h1").cast("string").alias("h1"), "n_collections", "n_files"
    ),
}

# no collection of these tables is a fork or a home, so that a shared subtree is one whose files all are shared
ORACLE = {
    "p4_shared": """select file_id from files where lower(trim(sha256)) in
 (select lower(trim(sha256)) from files where sha256 <> '' and collection is not null and coalesce(length, 1) > 0 group by 1 having count(distinct collection) > 1)""",
}
