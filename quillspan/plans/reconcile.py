"""Reconciliation queries."""

from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators import reconcile as rc
from quillspan.session import table


def _orders(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("orderkey"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return o, li


def _missing_priorities(s, d):
    """Customer-priority pairs that every ordering customer should hold, without the ones that orders have."""
    have = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    every = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    need = have.select("custkey").distinct().select("custkey", F.explode(every).alias("priority"))
    return rc.difference(need, have, ["custkey", "priority"])


def _keys(s, d):
    keys = F.json_object_keys("props")
    return table(s, d, "events").select("event_id", F.array_join(rc.unknown_keys(keys, ["source", "page"]), ",").alias("unknown"))


def _document_verdicts(s, d):
    t, title = F.coalesce("text", F.lit("")), F.col("title")
    v = rc.verdict(
        [
            ("error", "no text", t == ""),
            ("error", "stale length", F.col("n_chars") != F.length("text")),
            ("warning", "no title", title.isNull()),
            ("warning", "no language", F.coalesce(F.trim("lang"), F.lit("")) == ""),
            ("info", "no date", F.col("created_at").isNull()),
            ("info", "mentions a key", F.contains(t, F.lit("key"))),
        ]
    )
    return table(s, d, "documents").select("doc_id", v.alias("v")).select(
        "doc_id", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"),
        F.array_join("v.infos", ",").alias("infos"), "v.verdict",
    )


def _paths(s, d):
    v = rc.verdict(
        [
            ("error", "unsafe path", tx.is_unsafe_path(F.col("path"))),
            ("warning", "no length", F.col("length").isNull()),
            ("warning", "no date", F.coalesce("mtime", F.lit("")) == ""),
        ]
    )
    return rc.rollup(table(s, d, "files").select(v["verdict"].alias("verdict")))


def _enriched(s, d):
    f = table(s, d, "packets").groupBy("packet_id").agg(F.count(F.lit(1)).alias("deliveries"))
    ocr = table(s, d, "packets").groupBy("packet_id").agg(F.max("ocr.mean_word_confidence").alias("conf"))
    kept = table(s, d, "packets").groupBy("packet_id").agg(F.max("preservation.sha256").alias("sha256"))
    return rc.enriched(f, "packet_id", [ocr, kept])


def _metadata(s, d):
    m = F.create_map(F.lit("master"), F.col("preservation.master_file"), F.lit("captured"), F.col("preservation.captured"),
                     F.lit("engine"), F.col("ocr.engine"))
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    return table(s, d, "packets").select("delivery_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


QUERIES = {
    "orders_without_lines": lambda s, d: rc.difference(*_orders(s, d), ["orderkey"]),
    "orders_symmetric": lambda s, d: rc.symmetric_difference(*_orders(s, d), ["orderkey"]),
    "expected_subset": _missing_priorities,
    "unknown_json_keys": _keys,
    "document_verdicts": _document_verdicts,
    "path_rollup": _paths,
    "packet_enrichment": _enriched,
    "metadata_keys": _metadata,
}

ORACLE = {
    "orders_without_lines": "select distinct o_orderkey orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "orders_symmetric": """select coalesce(a.k, b.k) orderkey, case when b.k is null then 'left' else 'right' end side
from (select distinct o_orderkey k from orders) a full join (select distinct l_orderkey k from lineitem) b on a.k = b.k where a.k is null or b.k is null""",
    "expected_subset": """select custkey, priority from (select distinct o_custkey custkey from orders), (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) priority)
except select o_custkey, o_orderpriority from orders""",
    "unknown_json_keys": """select event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k not in ('source', 'page'))), ',') "unknown" from events""",
    "document_verdicts": """
with c as (select doc_id,
 list_filter([case when coalesce("text", '') = '' then 'no text' end, case when n_chars <> length("text") then 'stale length' end], lambda x: x is not null) e,
 list_filter([case when title is null then 'no title' end, case when coalesce(trim(lang), '') = '' then 'no language' end], lambda x: x is not null) w,
 list_filter([case when created_at is null then 'no date' end, case when contains(coalesce("text", ''), 'key') then 'mentions a key' end], lambda x: x is not null) i
 from documents)
select doc_id, array_to_string(e, ',') errors, array_to_string(w, ',') warnings, array_to_string(i, ',') infos,
 case when len(e) > 0 then 'FAIL' when len(w) > 0 then 'WARN' else 'OK' end verdict from c""",
    "path_rollup": """
with c as (select case when path like '/%' or contains(path, chr(92)) or list_contains(string_split(path, '/'), '..') then 'FAIL'
 when length is null or coalesce(mtime, '') = '' then 'WARN' else 'OK' end v from files)
select count(*) checked, count(*) filter (v = 'FAIL') failed, count(*) filter (v = 'WARN') warned, count(*) filter (v <> 'FAIL') passed from c""",
    "packet_enrichment": """select packet_id, count(*) deliveries, max(ocr.mean_word_confidence) conf, max(preservation.sha256) sha256 from packets group by 1""",
    "metadata_keys": """select delivery_id, array_to_string(list_sort(list_filter([
 case when coalesce(preservation.master_file, '') <> '' then 'master' end, case when coalesce(preservation.captured, '') <> '' then 'captured' end,
 case when coalesce(ocr.engine, '') <> '' then 'engine' end], lambda x: x is not null)), ',') keys from packets""",
}
