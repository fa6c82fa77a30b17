"""Byte and arithmetic queries."""

from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import numbers as nm
from quillspan.functions import text as tx
from quillspan.session import table


def _titles(s, d, plain=False):
    """Titles of documents as bytes; ``plain``: their printable ASCII only."""
    title = F.regexp_replace("title", "[^ -~]", "") if plain else F.col("title")
    return table(s, d, "documents").where("title is not null").select("doc_id", F.encode(title, "UTF-8").alias("b"), title.alias("title"))


def _xor(s, d):
    return _titles(s, d).select(
        "doc_id", F.lower(F.hex(by.xored(F.col("b"), 0x5A))).alias("cipher"),
        F.decode(by.xored(by.xored(F.col("b"), 0x5A), 0x5A), "UTF-8").alias("back"),
    )


def _shares(s, d):
    """Titles split among five, any three of which give them back; the coefficients follow from the bytes."""
    t = _titles(s, d).withColumn("secret", by.octets(F.col("b")))
    coeff = F.transform("secret", lambda v, i: F.array(F.pmod(v * 7 + i, F.lit(256)), F.pmod(v * 31 + i * 3 + 1, F.lit(256))))
    t = t.withColumn("c", coeff)
    xs = [3, 7, 11, 200, 255]
    t = t.withColumns({f"y{x}": by.share_of(F.col("secret"), F.col("c"), x) for x in xs})
    back = by.combined([(7, F.col("y7")), (200, F.col("y200")), (255, F.col("y255"))])
    parsed = by.parsed_share(by.share_text(11, F.col("y11")))
    return t.select(
        "doc_id",
        by.share_text(3, F.col("y3")).alias("share"),
        (parsed["y"] == F.col("y11")).alias("parsed_alike"),
        F.decode(by.from_octets(back), "UTF-8").alias("title"),
    )


def _boxes(s, d):
    b = nm.source_box(F.col("bbox"), F.lit(2), F.lit(20))
    base = table(s, d, "packet_lines").where("bbox is not null").select("packet_id", "page_no", "n", "bbox").distinct()
    return base.select("packet_id", "page_no", "n", b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))


def _property_boxes(s, d):
    bag = F.format_string("bbox %d %d %d %d; x_wconf %.1f", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", F.coalesce("conf", F.lit(0.0)))
    base = table(s, d, "packet_lines").where("bbox is not null").select("packet_id", "page_no", "n", tx.property_bag(bag).alias("p")).dropDuplicates(["packet_id", "page_no", "n"])
    box = tx.bbox_of(F.col("p"))
    return base.select("packet_id", "page_no", "n", box["x0"].alias("x0"), box["y1"].alias("y1"))


QUERIES = {
    "xor_roundtrip": _xor,
    "crc16": lambda s, d: _titles(s, d).select("doc_id", by.crc16(F.col("b")).alias("crc")),
    "shared_secrets": _shares,
    "hexdumps": lambda s, d: _titles(s, d, True).select("doc_id", tx.hexdump(F.col("b")).alias("dump")),
    "packed_names": lambda s, d: _titles(s, d, True).select("doc_id", F.array_join(by.packed_names(F.col("b")), "|").alias("names")),
    "ascii_runs": lambda s, d: table(s, d, "documents").select("doc_id", F.size(by.ascii_runs(F.encode("text", "UTF-8"), 8)).alias("runs")),
    "sha256": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")),
    "source_boxes": _boxes,
    "property_boxes": _property_boxes,
    "pitches": lambda s, d: table(s, d, "part").select("p_partkey", F.round(nm.pitch_hz(F.col("p_size")), 6).alias("hz")),
    "dice_odds": lambda s, d: table(s, d, "part").select(
        "p_partkey", F.round(nm.odds(F.col("p_size")), 9).alias("odds"), nm.expected_roll(F.col("p_size")).alias("expected")
    ),
    "lcg_steps": lambda s, d: table(s, d, "orders").select("o_orderkey", nm.next_lcg(F.col("o_orderkey")).alias("next")),
}

ORACLE = {
    "crc16": """
with recursive titles as (select doc_id, title from documents where title is not null), b as (select doc_id, encode(title) v from titles),
s as (select doc_id, v, 0 i, 65535 crc from b
 union all select doc_id, v, i + 1, list_reduce(list_prepend(cast(xor(crc, ('0x' || substr(hex(v), 2 * i + 1, 2))::int) as int), range(8)),
  lambda c, _: case when c & 1 = 1 then xor(c >> 1, 40961) else c >> 1 end)::int from s where i < octet_length(v))
select doc_id, crc from s where i = octet_length(v)""",
    "hexdumps": r"""
with titles as (select doc_id, regexp_replace(title, '[^ -~]', '', 'g') title from documents where title is not null), b as (select doc_id, encode(title) v, hex(encode(title)) h, octet_length(encode(title)) n, title from titles),
r as (select doc_id, o, lower(substr(h, 2 * o + 1, 32)) hx, substr(title, o + 1, 16) a from b, range(0, 2048, 16) t(o) where o < n)
select doc_id, string_agg(lpad(lower(to_hex(o)), 5, '0') || '  ' || rpad(regexp_replace(hx, '(..)', '\1 ', 'g'), 48, ' ') || ' |' || a || '|', chr(10) order by o) dump from r group by 1""",
    "sha256": 'select doc_id, sha256("text") sha256 from documents',
    "source_boxes": """select distinct packet_id, page_no, n, cast(greatest(0, round_even((bbox.x0 - 20) / 2, 0)) as int) x0, cast(greatest(0, round_even((bbox.y0 - 20) / 2, 0)) as int) y0,
 cast(greatest(0, round_even((bbox.x1 - 20) / 2, 0)) as int) x1, cast(greatest(0, round_even((bbox.y1 - 20) / 2, 0)) as int) y1 from packet_lines where bbox is not null""",
    "property_boxes": "select distinct packet_id, page_no, n, bbox.x0 x0, bbox.y1 y1 from packet_lines where bbox is not null",
    "shared_secrets": """
with recursive titles as (select doc_id, title from documents where title is not null), seed as (select doc_id, title, octet_length(encode(title)) n, hex(encode(title)) h from titles),
e as (select 0 i, 1 x union all select i + 1, (xor(x, (case when x & 128 > 0 then xor((x << 1) & 255, 27) else x << 1 end))) & 255 from e where i < 254),
ex as (select list(x order by i) ex from e),
lg as (select map_from_entries(list((x, i))) lg from e),
b as (select doc_id, title, n, i, ('0x' || substr(h, 2 * i + 1, 2))::int v from seed, range(0, 200) t(i) where i < n),
c as (select *, (v * 7 + i) % 256 c1, (v * 31 + i * 3 + 1) % 256 c2 from b),
m as (select c.*, xor(case when c2 = 0 then c1 else xor(c1, ex[(lg[c2] + lg[3]) % 255 + 1]) end, 0) t from c, ex, lg),
s as (select m.*, xor(v, case when t = 0 then 0 else ex[(lg[t] + lg[3]) % 255 + 1] end) y from m, ex, lg)
select doc_id, '03' || string_agg(lpad(lower(to_hex(y)), 2, '0'), '' order by i) share, true parsed_alike, any_value(title) title from s group by 1""",
    "pitches": "select p_partkey, round(440 * pow(2, (p_size - 69) / 12.0), 6) hz from part",
    "dice_odds": "select p_partkey, round(1.0 / p_size, 9) odds, (p_size + 1) / 2.0 expected from part",
    "lcg_steps": "select o_orderkey, (o_orderkey * 1103515245 + 12345) % 2147483648 \"next\" from orders",
    "packed_names": "with titles as (select doc_id, regexp_replace(title, '[^ -~]', '', 'g') title from documents where title is not null) select doc_id, array_to_string(regexp_extract_all(title, '[A-Za-z]+'), '|') names from titles",
    "ascii_runs": r"""select doc_id, cast(len(regexp_extract_all("text", '[ -~]{8,}')) as int) runs from documents""",
    "xor_roundtrip": """
with titles as (select doc_id, title from documents where title is not null), x as (select doc_id, title, list_transform(range(1, octet_length(encode(title)) + 1), lambda i: ('0x' || substr(hex(encode(title)), 2 * i - 1, 2))::int) b from titles)
select doc_id, array_to_string(list_transform(b, lambda v: lpad(lower(to_hex(case when v = 36 then v else xor(v, 90) end)), 2, '0')), '') cipher, replace(title, '~', '$') back from x""",
}
