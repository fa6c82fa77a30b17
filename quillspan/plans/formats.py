"""Formats written from tables and read back: pages, packets, envelopes, manifests, containers, pictures, sealed streams.

Each query makes a format of whole tables and takes it apart again with the reader, so that its SQL is the table itself.
"""

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quillspan.functions import bytes as by
from quillspan.functions import ciphers as cp
from quillspan.functions import pixels as px
from quillspan.functions import text as tx
from quillspan.operators import reconcile as rc
from quillspan.operators import sealed as sl
from quillspan.session import table
from quillspan.sources import feeds, files, sinks
from quillspan.sources import transcripts as ts

_PAGE = ["packet_id", "page_no"]


def _escaped(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def _lines(s, d):
    """Each line once, by its latest delivery; text of words with one blank between them."""
    rows = table(s, d, "packet_lines").where("packet_id is not null and page_no is not null and n is not null")
    last = rows.groupBy(*_PAGE, "n").agg(F.max_by(F.struct("text", "bbox", "par_size"), F.struct("received_at", "line_id")).alias("r"))
    return last.select(*_PAGE, "n", tx.clean(F.regexp_replace("r.text", r"[^\x20-\x7e]", "")).alias("text"), "r.bbox").where("text != ''")


def _pages(s, d, line, head, tail):
    """Page per row: its lines in order, as markup."""
    own = _lines(s, d).select(*_PAGE, F.struct("n", line.alias("x")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["x"]), "")
    key = F.concat_ws("/", "packet_id", "page_no").alias("page")
    return own.groupBy(*_PAGE).agg(body.alias("b")).select(key, F.concat(F.lit(head), "b", F.lit(tail)).alias("markup"))


def _back(parsed):
    page = F.split("page", "/")
    return parsed.select(
        page[0].cast("long").alias("packet_id"), page[1].cast("int").alias("page_no"), F.col("n").alias("line_no"), "text", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1")
    )


def _marked(s, d):
    """Lines as class-marked HTML, a word per element, and read again."""
    box = F.when(F.col("bbox").isNotNull(), F.concat(F.lit(" title='bbox "), F.concat_ws(" ", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"), F.lit("'")))
    words = F.array_join(F.transform(F.split("text", " +"), lambda w: F.concat(F.lit("<span class='ocrx_word'>"), _escaped(w), F.lit("</span>"))), " ")
    line = F.concat(F.lit("<span class='ocr_line'"), F.coalesce(box, F.lit("")), F.lit(">"), words, F.lit("</span>"))
    return _back(ts.parsed_marked(_pages(s, d, line, "<body><div class='ocr_page'><p class='ocr_par'>", "</p></div></body>"), "page", "markup"))


def _alto(s, d):
    """Lines as ALTO, and read again."""
    edge = lambda name, c: F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))
    b = F.col("bbox")
    box = F.concat(edge("HPOS", b["x0"]), edge("VPOS", b["y0"]), edge("WIDTH", b["x1"] - b["x0"]), edge("HEIGHT", b["y1"] - b["y0"]))
    words = F.array_join(F.transform(F.split("text", " +"), lambda w: F.concat(F.lit('<String CONTENT="'), _escaped(w), F.lit('"/>'))), "<SP/>")
    line = F.concat(F.lit("<TextLine"), F.coalesce(box, F.lit("")), F.lit(">"), words, F.lit("</TextLine>"))
    head, tail = '<alto xmlns="urn:x"><Layout><Page><PrintSpace><TextBlock ID="b">', "</TextBlock></PrintSpace></Page></Layout></alto>"
    return _back(ts.parsed_alto(_pages(s, d, line, head, tail), "page", "markup"))


def _packets(s, d):
    """Lines as packet XML, and read again."""
    none = lambda kind: F.lit(None).cast(kind)
    own = _lines(s, d).select(
        *_PAGE, "n", F.concat_ws("_", F.lit("line"), "page_no", "n").alias("line_id"), F.concat_ws("_", F.lit("par"), "page_no").alias("par_id"), "text", "bbox",
        none("double").alias("conf"), none("int").alias("words"), none("double").alias("gap_before"), F.lit("ocr_line").alias("kind"), none("string").alias("raw"),
    )
    read = ts.packet_lines(ts.read_packets(sinks.packet_xml(own), "packet_id", "xml"), "packet_id")
    return read.select("packet_id", "page_no", F.col("n").cast("int").alias("n"), "line_id", "par_id", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))


def _envelopes(s, d):
    """Texts in envelopes: what the head says without the payload, and the payload."""
    e = table(s, d, "documents").where("text is not null and text != ''").select(
        "doc_id", ts.envelope(F.encode("text", "UTF-8"), F.concat(F.lit("file:///a&b/"), F.col("doc_id").cast("string")), "n/1").alias("x")
    )
    m = ts.envelope_meta(F.col("x"))
    return e.select("doc_id", m["source_uri"].alias("uri"), m["normaliser"].alias("normaliser"), m["payload_element"].alias("element"), F.sha2(ts.unwrapped(F.col("x")), 256).alias("sha256"))


def _schematic(s, d):
    """Orders and their lines as a schematic of parts and nets, and the edges read again."""
    li = table(s, d, "lineitem").select("l_orderkey", F.format_string('<pinref part="U%d" gate="G" pin="%d"/>', "l_suppkey", "l_linenumber").alias("x"))
    nets = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))
    xml = nets.select(
        "l_orderkey",
        F.concat(F.lit('<eagle><drawing><schematic><sheets><sheet><nets><net name="N'), F.col("l_orderkey").cast("string"), F.lit('"><segment>'), "x",
                 F.lit("</segment></net></nets></sheet></sheets></schematic></drawing></eagle>")).alias("m"),
    )
    _, pins = ts.schematic(xml, "l_orderkey", "m")
    return pins.groupBy("net").agg(F.count(F.lit(1)).alias("pins"), F.countDistinct("part").alias("parts"))


def _sidecars(s, d):
    """Provenance of documents as JSON, read with its schema: day and camera by precedence."""
    exif = F.struct(
        F.date_format("received_at", "yyyy:MM:dd HH:mm:ss").alias("DateTime"), F.initcap(F.trim("source")).alias("Make"),
        F.struct(F.date_format("created_at", "yyyy:MM:dd HH:mm:ss").alias("DateTimeOriginal")).alias("Exif"),
    )
    read = table(s, d, "documents").select("doc_id", F.from_json(F.to_json(F.struct(exif.alias("exif"))), feeds.PROVENANCE).alias("p"))
    return read.select("doc_id", feeds.captured(F.col("p.exif")).alias("captured"), feeds.camera(F.col("p.exif")).alias("camera"))


def _manifests(s, d):
    """Keys and values as TOML, and read again; what is no TOML says so."""
    line = F.concat(F.lit('name = "n'), F.col("file_id").cast("string"), F.lit('"\nsize = '), F.coalesce(F.col("length").cast("string"), F.lit("= broken")), F.lit("\n[inner]\nx = 1\n"))
    got = table(s, d, "files").select("file_id", "length", line.alias("t")).withColumn("m", files.manifest("t"))
    return got.select("file_id", F.col("m.values")["name"].alias("name"), F.col("m.values")["size"].cast("long").alias("size"), F.col("m.error").isNotNull().alias("broken"))


def _zipped(batch: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("a/text.txt", (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
            z.writestr(zipfile.ZipInfo("empty", (1980, 1, 1, 0, 0, 0)), b"")
        return out.getvalue()

    return batch.map(one)


def _archives(s, d):
    """Texts as archives of two entries, and their entries."""
    made = F.pandas_udf(_zipped, "binary")
    a = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), made("text").alias("content"))
    e = files.zip_entries(a)
    return e.select(F.col("archive").cast("long").alias("doc_id"), "entry", "size", "mtime", F.sha2("content", 256).alias("sha256"))


def _bencoded(s, d):
    """Documents as bencoded dictionaries, and read again."""
    size = lambda c: F.octet_length(c).cast("string")
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\x20-\x7e]", "")
    t = F.concat(F.lit("d4:langl"), F.when(F.col("lang").isNotNull(), F.concat(size("lang"), F.lit(":"), "lang")).otherwise(""), F.lit("e4:sizei"),
                 F.col("n").cast("string"), F.lit("e5:title"), size(title), F.lit(":"), title, F.lit("e"))
    docs = table(s, d, "documents").select("doc_id", "title", F.regexp_replace("lang", r"[^\x20-\x7e]", "").alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    got = docs.select("doc_id", F.from_json(by.bencode_json(F.encode(t, "UTF-8")), "lang array<string>, size long, title string").alias("x"))
    return got.select("doc_id", F.get("x.lang", F.lit(0)).alias("lang"), "x.size", "x.title")


def _executables(s, d):
    """Listings as executables: the header's figures, the size to load, the kind."""
    word = lambda c: F.lpad(F.hex(c.cast("bigint")), 4, "0")
    little = lambda c: F.concat(F.substring(word(c), 3, 2), F.substring(word(c), 1, 2))
    n = F.coalesce("length", F.lit(0))
    pages, last = F.floor(n / 512) % 60000 + 1, n % 512
    new = F.col("file_id") % 3 == 0
    body = F.concat(F.lit("4D5A"), little(last), little(pages), F.repeat(F.lit("0000"), 27), F.when(new, F.lit("40000000")).otherwise("00000000"), F.when(new, F.lit("4E450000")).otherwise("00000000"))
    e = table(s, d, "files").select("file_id", F.unhex(body).alias("b"))
    h = by.mz_header(F.col("b"))
    return e.select("file_id", h["cblp_lastpage"].alias("last_page"), h["cp_pages"].alias("pages"), h["load_size"].alias("load_size"), by.executable_kind(F.col("b")).alias("kind"))


def _pascal(s, d):
    """Titles as length-prefixed strings between zeros."""
    title = F.substring(F.regexp_replace("title", r"[^\x20-\x7e]", ""), 1, 60)
    b = F.concat(F.unhex(F.lit("0000")), F.unhex(F.lpad(F.hex(F.length("t")), 2, "0")), F.encode("t", "UTF-8"), F.unhex(F.lit("00")))
    rows = table(s, d, "documents").select("doc_id", title.alias("t")).where("length(t) >= 4")
    got = rows.select("doc_id", by.length_prefixed_strings(4)(b).alias("x"))
    return got.select("doc_id", F.get("x", F.lit(0))["at"].alias("at"), F.get("x", F.lit(0))["text"].alias("text"))


def _pictures(s, d):
    """The checksum of a text as a picture of 4 x 2 pixels with opacity, through PNG and back; sizes read from its head."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("p"))
    png = docs.withColumn("png", px.to_png(F.lit(4), F.lit(2), F.lit(4), F.col("p"))).withColumn("back", px.from_png(F.col("png")))
    size = by.png_size(F.col("png"))
    return png.select("doc_id", size["width"].alias("width"), size["height"].alias("height"), F.col("back.channels").alias("channels"), F.lower(F.hex("back.pixels")).alias("pixels"))


def _thresholds(s, d):
    """Embeddings as grey pictures, made black and white around their local mean."""

    @F.pandas_udf("int")
    def black(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: int((px.local_threshold((255 * (v - v.min()) / max(1e-9, v.max() - v.min())).astype("uint8").reshape(8, -1), radius=100, offset=1) == 0).sum())).astype("int32")

    return table(s, d, "embeddings").select("vec_id", black("embedding").alias("black"))


def _jpegs(batch: pd.Series) -> pd.Series:
    """The first bytes of pictures whose height is the number given."""
    return batch.map(lambda n: b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", int(n) % 60_000 + 1, 77) + bytes(12))


def _jpeg_sizes(s, d):
    made = F.pandas_udf(_jpegs, "binary")
    return table(s, d, "part").select("p_partkey", by.jpeg_size(made("p_partkey")).alias("z")).select("p_partkey", "z.width", "z.height")


def _sealed(s, d):
    """Texts sealed under a key each, sent in pieces of 1,000 bytes, opened piece by piece."""
    docs = table(s, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("transfer"), F.lit(0).alias("file_no"), F.encode("text", "UTF-8").alias("data"),
        F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("secret"), F.unhex(F.md5("text")).alias("salt"),
    )
    made = sl.sealed(docs, record_size=4096).select("transfer", "file_no", "secret", "stream", F.length("stream").alias("length"))
    cut = F.sequence(F.lit(0), F.col("length") - 1, F.lit(1000))
    pieces = made.select("transfer", "stream", F.explode(cut).alias("at")).select("transfer", F.col("at").cast("long").alias("at"), F.expr("substring(stream, at + 1, 1000)").alias("content"))
    whole = sl.contents(sl.opened(pieces, made, made))
    return whole.select(F.col("transfer").alias("doc_id"), "records", F.sha2("data", 256).alias("sha256"), "error")


def _headers(s, d):
    """Listings as lines of a table with a header contract: which headers keep it."""
    head = F.when(F.col("file_id") % 2 == 0, F.lit("sha256,bytes,mtime,path,title")).otherwise("sha256,bytes,path,mtime,title")
    want = ",".join(files.CATALOGUE)
    same = rc.same_columns(s.createDataFrame([], ", ".join(f"{c} string" for c in files.CATALOGUE)), files.CATALOGUE)
    return table(s, d, "files").select("file_id", (head == want).alias("kept"), F.lit(same).alias("same"))


def _ciphered(s, d):
    c = F.col("text")
    return table(s, d, "documents").select(
        "doc_id", cp.vigenere(F.substring(c, 1, 1 << 20), "abc").alias("vigenere"), cp.rot47(c).alias("rot47"),
        F.md5(cp.columnar(cp.columnar(c, "zebra"), "zebra", True)).alias("columnar_back"), cp.a1z26(F.col("title")).alias("numbers"),
    )


QUERIES = {
    "marked_roundtrip": _marked,
    "alto_roundtrip": _alto,
    "packet_roundtrip": _packets,
    "envelopes": _envelopes,
    "schematic_nets": _schematic,
    "sidecar_fields": _sidecars,
    "toml_manifests": _manifests,
    "zip_listing": _archives,
    "bencoded": _bencoded,
    "executable_headers": _executables,
    "pascal_strings": _pascal,
    "png_roundtrip": _pictures,
    "jpeg_sizes": _jpeg_sizes,
    "local_thresholds": _thresholds,
    "sealed_streams": _sealed,
    "header_contract": _headers,
    "ciphered": _ciphered,
}

_LINES_SQL = r"""
with r as (select *, row_number() over (partition by packet_id, page_no, n order by received_at desc, line_id desc) rn from packet_lines
  where packet_id is not null and page_no is not null and n is not null),
l as (select packet_id, page_no, n, bbox, regexp_replace(regexp_replace(regexp_replace(coalesce("text", ''), '[^\x20-\x7e]', '', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') "text" from r where rn = 1)
"""

ORACLE = {
    "marked_roundtrip": _LINES_SQL + """select packet_id, page_no, cast(row_number() over (partition by packet_id, page_no order by n) as int) line_no, "text", bbox.x0 x0, bbox.y1 y1 from l where "text" <> ''""",
    "packet_roundtrip": _LINES_SQL + """select packet_id, page_no, n, 'line_' || page_no || '_' || n line_id, 'par_' || page_no par_id, "text", bbox.x0 x0, bbox.y1 y1 from l where "text" <> ''""",
    "envelopes": """select doc_id, 'file:///a&b/' || doc_id uri, 'n/1' normaliser, 'payload' element, sha256("text") sha256 from documents where "text" <> ''""",
    "schematic_nets": """select 'N' || l_orderkey net, count(*) pins, count(distinct l_suppkey) parts from lineitem group by 1""",
    "sidecar_fields": r"""select doc_id, coalesce(strftime(created_at, '%Y:%m:%d %H:%M:%S'), strftime(received_at, '%Y:%m:%d %H:%M:%S')) captured,
 nullif(upper(left(trim(source), 1)) || lower(substr(trim(source), 2)), '') camera from documents""",
    "toml_manifests": """select file_id, case when length is not null then 'n' || file_id end "name", length size, length is null broken from files""",
    "zip_listing": """select doc_id, 'a/text.txt' entry, cast(octet_length(encode("text")) as bigint) size, '1980-01-01' mtime, sha256("text") sha256 from documents where "text" is not null
 union all select doc_id, 'empty', 0, '1980-01-01', sha256('') from documents where "text" is not null""",
    "bencoded": r"""select doc_id, regexp_replace(lang, '[^\x20-\x7e]', '', 'g') lang, cast(length(coalesce("text", '')) as bigint) size, regexp_replace(coalesce(title, ''), '[^\x20-\x7e]', '', 'g') title from documents""",
    "executable_headers": """with f as (select file_id, coalesce(length, 0) n from files), h as (select file_id, n % 512 l, (n // 512) % 60000 + 1 p from f)
select file_id, cast(l as bigint) last_page, cast(p as bigint) pages, cast(case when l = 0 then p * 512 else (p - 1) * 512 + l end as bigint) load_size, case when file_id % 3 = 0 then 'NE' else 'MZ' end kind from h""",
    "pascal_strings": r"""select doc_id, cast(2 as int) "at", t "text" from (select doc_id, left(regexp_replace(title, '[^\x20-\x7e]', '', 'g'), 60) t from documents) where length(t) >= 4""",
    "png_roundtrip": """select doc_id, cast(4 as bigint) width, cast(2 as bigint) height, cast(4 as int) channels, sha256("text") pixels from documents where "text" is not null""",
    "jpeg_sizes": """select p_partkey, cast(77 as int) width, cast(p_partkey % 60000 + 1 as int) height from part""",
    "sealed_streams": """select doc_id, greatest(1, cast(ceil(octet_length(encode("text")) / 4079.0) as bigint)) records, sha256("text") sha256, cast(null as varchar) error from documents where "text" is not null""",
    "header_contract": "select file_id, file_id % 2 = 0 kept, true same from files",
    "ciphered": r"""
with d as (select doc_id, "text" t, title, string_split("text", '') c from documents),
k as (select doc_id, t, title, c, list_transform(c, lambda x: regexp_matches(x, '^[A-Za-z]$')) a from d),
p as (select doc_id, unnest(c) x, unnest(a) l, generate_subscripts(c, 1) i from k where t <> ''),
n as (select *, sum(l::int) over (partition by doc_id order by i) - 1 m from p),
v as (select doc_id, string_agg(case when l then chr(cast((ascii(x) - case when ascii(x) < 97 then 65 else 97 end + m % 3) % 26 + case when ascii(x) < 97 then 65 else 97 end as int)) else x end, '' order by i) vigenere,
 string_agg(case when ascii(x) between 33 and 126 then chr(cast((ascii(x) - 33 + 47) % 94 + 33 as int)) else x end, '' order by i) rot47 from n group by 1)
select d.doc_id, case when t = '' then '' else vigenere end vigenere, case when t = '' then '' else rot47 end rot47, md5(t) columnar_back,
 array_to_string(list_transform(regexp_extract_all(lower(title), '[a-z]'), lambda x: ascii(x) - 96), '-') "numbers" from d left join v using (doc_id)""",
}
ORACLE["alto_roundtrip"] = ORACLE["marked_roundtrip"]
