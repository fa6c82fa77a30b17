"""Catalogue queries over documents and file listings."""

from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators import catalog as cg
from quillspan.session import table


def _docs(s, d):
    return table(s, d, "documents").select(
        "doc_id",
        F.lower(F.trim("source")).alias("source"),
        cg.fingerprint(F.col("text")).alias("sha256"),
        F.length("text").cast("long").alias("bytes"),
    )


def _files(s, d):
    return table(s, d, "files")


def _twin_sides(s, d, twin):
    """Files of the largest collection whose content others hold too, and those of which none does."""
    own = _files(s, d).select("file_id", "collection", "sha256", "length")
    first, rest = own.where("collection = 'room-0001'"), own.where("collection != 'room-0001'")
    if twin:
        return cg.twins(first, rest, payload="file_id", size="length").select("file_id", "sha256", "held_as")
    return cg.without_twin(first, rest, size="length").select("file_id", "sha256")


def _drift(s, d):
    f = _files(s, d)
    return cg.drift(cg.listings(f, False), cg.listings(f, True), ["collection", "path"], ["sha256", "length"])


def _title_stats(s, d):
    t = tx.title(F.col("head"))
    return _files(s, d).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(t != "").alias("titled"),
        F.count_if(t == "").alias("untitled"),
        F.count_if(F.col("length") == 0).alias("empty_files"),
    )


def _rows(s, d):
    return (
        _files(s, d)
        .select(
            "file_id",
            "sha256",
            F.col("length").alias("bytes"),
            F.coalesce("mtime", F.lit("")).alias("mtime"),
            F.translate("path", "\\", "/").alias("path"),
            tx.title(F.col("head")).alias("title"),
        )
        .orderBy(F.lower("path"), "file_id")
    )


def _priority(s, d):
    order = F.array_position(F.array(*[F.lit(x) for x in ("readme", "manual", "memo", "notes", "journal")]), F.col("source"))
    docs = _docs(s, d).withColumn("rank", F.when(order > 0, order).otherwise(99).cast("int"))
    return cg.by_priority(docs, "sha256", F.col("rank"), "doc_id").select("sha256", "doc_id", "source", "rank")


def _labels(s, d):
    nations = table(s, d, "nation").select(F.col("n_nationkey").alias("address"), F.col("n_name").alias("label"))
    owners = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("address"))
    return cg.labelled(owners, nations, "address", "label").select("c_custkey", "label")


QUERIES = {
    "code_labels": _labels,
    "catalog_redundancy": lambda s, d: cg.redundancy(_docs(s, d)),
    "catalog_summary": lambda s, d: cg.summary(_docs(s, d)),
    "catalog_rows": _rows,
    "title_stats": _title_stats,
    "path_families": lambda s, d: cg.families(_files(s, d).select(F.translate("path", "\\", "/").alias("path"))),
    "top_families": lambda s, d: cg.top_families(_files(s, d).select(F.translate("path", "\\", "/").alias("path"))),
    "twin_semi": lambda s, d: _twin_sides(s, d, True),
    "twin_anti": lambda s, d: _twin_sides(s, d, False),
    "drift_listings": _drift,
    "mtime_span": lambda s, d: cg.span(_files(s, d)),
    "priority_source": _priority,
    "natural_order": lambda s, d: table(s, d, "files").select("file_id", tx.natural_key(F.col("path")).alias("sort_key")),
    "distinct_titles": lambda s, d: table(s, d, "documents").select("title").where("title is not null").distinct().orderBy("title"),
}

_DOCS = """with docs as (select doc_id, lower(trim(source)) source, sha256("text") sha256, length("text") bytes from documents)"""
_FAMILY = """
with f as (select replace(path, chr(92), '/') path from files),
a as (select path, regexp_extract(path, '([^/]*)$', 1) s from f),
b as (select path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\.(html?|htm)$', '', 'i'),
 '\\s*\\(\\d+\\)', '', 'g'), '[-_]\\d{13}', '', 'g'), '[-_]\\d{4}-\\d{2}-\\d{2}([T_]\\d\\d-\\d\\d(-\\d\\d)?)?', '', 'g'),
 '[-_]v?\\d+$', '') s from a),
w as (select path, regexp_replace(s,
 '([-_.]?)(final|fixed|optimized|repaired|standalone|offline|working|latest|copy\\d*|new|old|v\\d+)([-_.]|$)', '\\3', 'gi') s from b),
c as (select path, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') fam from w),
r as (select case when fam = '' then 'untitled' else fam end family, count(*) builds, min(path) sample from c group by 1)
"""

ORACLE = {
    "code_labels": "select c_custkey, coalesce(n_name, '') label from customer left join nation on n_nationkey = c_nationkey + 3",
    "catalog_redundancy": _DOCS + """
select sha256, count(*) copies, min(doc_id) first_id, max(bytes) bytes from docs group by sha256 having count(*) > 1""",
    "catalog_summary": _DOCS + """, per as (select sha256, count(*) n, sum(bytes) b from docs group by sha256)
select cast(sum(n) as bigint) entries, cast(sum(b) as bigint) bytes, count(*) distinct_contents,
 cast(sum(n - 1) as bigint) redundant_copies from per""",
    "catalog_rows": r"""select file_id, sha256, length bytes, coalesce(mtime, '') mtime, replace(path, chr(92), '/') path,
 trim(regexp_replace(regexp_extract(coalesce(head, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) title from files""",
    "title_stats": r"""with t as (select length, trim(regexp_replace(regexp_extract(coalesce(head, ''),
 '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) title from files)
select count(*) entries, count(*) filter (title <> '') titled, count(*) filter (title = '') untitled,
 count(*) filter (length = 0) empty_files from t""",
    "twin_semi": """with held as (select sha256, min(file_id) held_as from files where collection <> 'room-0001' and length > 0 group by 1)
select file_id, sha256, held_as from files join held using (sha256) where collection = 'room-0001'""",
    "twin_anti": """select file_id, sha256 from files where collection = 'room-0001' and sha256 not in
 (select sha256 from files where collection <> 'room-0001' and length > 0 and sha256 is not null)""",
    "drift_listings": """
with r as (select collection, path, sha256, length,
 row_number() over (partition by collection, path order by listed_at, file_id) a,
 row_number() over (partition by collection, path order by listed_at desc, file_id desc) z from files)
select x.collection, x.path, case when x.sha256 is not distinct from y.sha256 and x.length is not distinct from y.length
 then 'OK' else 'DRIFT' end status from r x join r y on x.collection = y.collection and x.path = y.path where x.a = 1 and y.z = 1""",
    "mtime_span": """select min(nullif(mtime, '')) "first", max(nullif(mtime, '')) "last", count(nullif(mtime, '')) dated from files""",
    "priority_source": _DOCS + """, r as (select *, coalesce(nullif(list_position(['readme','manual','memo','notes','journal'], source), 0), 99) rk from docs),
o as (select *, row_number() over (partition by sha256 order by rk, doc_id) n from r)
select sha256, doc_id, source, cast(rk as int) "rank" from o where n = 1""",
    "natural_order": r"""select file_id, array_to_string(list_transform(regexp_extract_all(lower(path), '\d+|\D+'), lambda r:
 case when regexp_matches(r, '^\d') then lpad(r, 20, '0') else r end), chr(1)) sort_key from files""",
    "path_families": _FAMILY + "select family, builds, sample from r",
    "top_families": _FAMILY + "select family, builds, sample from r where builds > 1 order by builds desc, family limit 22",
    "distinct_titles": "select distinct title from documents where title is not null",
}
