"""Transcript formats: marked-up OCR output, ALTO, packets, envelopes. Plain text is in operators.transcript."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from quillspan.functions.text import clean, strip

#: The classes that OCR engines write, by what they hold.
AREAS, LINES = ("ocr_carea", "ocrx_block", "ocr_column"), ("ocr_line", "ocr_textfloat", "ocr_header", "ocr_caption")
VOID = "br meta img link hr input base area col wbr".split()
LINE_SCHEMA = (
    "array<struct<page_no:int,par_id:string,line_id:string,kind:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>,text:string,"
    "words:array<struct<id:string,text:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>,conf:double>>>>"
)


def _properties(title: str | None) -> dict[str, list[str]]:
    parts = (p.split() for p in (title or "").split(";"))
    return {p[0]: p[1:] for p in parts if p}


def _box(p: dict) -> dict | None:
    try:
        return dict(zip(("x0", "y0", "x1", "y1"), (int(float(v)) for v in p["bbox"][:4]), strict=True))
    except (KeyError, ValueError):
        return None


class _Events(HTMLParser):
    """Flat list of (tag, attributes) of what opens, (tag, None) of what closes and (None, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str | None, dict | str | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.seen.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.seen.append((tag, None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data):
        self.seen.append((None, data))


def _ends(events: list) -> dict[int, int]:
    """Where each element that opens is over: at the end tag of its name, or of one around it, or at one that matches nothing."""
    end: dict[int, int] = {}
    alive: list[int] = []
    for j, (tag, what) in enumerate(events):
        if tag is None:
            continue
        if what is not None:
            alive.append(j)
            continue
        match = max((k for k, i in enumerate(alive) if events[i][0] == tag), default=0)
        end |= dict.fromkeys(alive[match:], j)
        del alive[match:]
    return end


#: What an element is, outermost first.
_LEVELS = ["page", "area", "par", "line", "word"]


def _level(kinds: list[str]) -> tuple[str | None, str | None]:
    """(level, class) of an element by its classes; the outermost counts."""
    named = {"ocr_page": "page", "ocr_par": "par", "ocrx_word": "word"} | dict.fromkeys(AREAS, "area") | dict.fromkeys(LINES, "line")
    found = [(_LEVELS.index(named[k]), k) for k in kinds if k in named]
    return (_LEVELS[min(found)[0]], min(found, key=lambda f: f[0])[1]) if found else (None, None)


def _number(p: dict, name: str) -> float | None:
    try:
        return float(p[name][0])
    except (KeyError, IndexError, ValueError):
        return None


def _lines(markup: str | None) -> list[dict] | None:
    if markup is None:
        return None
    parser = _Events()
    parser.feed(markup)
    parser.close()
    events = parser.seen
    end, never = _ends(events), len(events)
    lines: list[dict] = []
    within: dict[str, tuple[int, object]] = {}  # by level what was opened last, and until where it holds
    pages = made = 0

    def holds(level: str, j: int):
        until, what = within.get(level, (-1, None))
        return what if j < until else None

    def enter(level: str, j: int, what: object, until: int | None = None) -> object:
        """``what`` holds from here on until its element ends; one that the markup leaves out, as long as what is around it."""
        depth = _LEVELS.index(level)
        around = [within[x][0] for x in _LEVELS[:depth] if holds(x, j) is not None]
        for deeper in _LEVELS[depth:]:
            within.pop(deeper, None)
        within[level] = (min(around, default=never) if until is None else until, what)
        return what

    def name(given: str | None, level: str) -> str:
        nonlocal made
        made += not given
        return given or f"{level}_{made}"

    def line(j: int, ident: str | None, kind: str, box: dict | None, until: int | None = None) -> None:
        nonlocal pages
        pages = pages or 1
        par = holds("par", j) or enter("par", j, name(None, "par"))
        own = {"page_no": pages, "par_id": par, "line_id": name(ident, "line"), "kind": kind, "bbox": box, "text": "", "words": []}
        lines.append(enter("line", j, own, until))

    for j, (tag, what) in enumerate(events):
        if tag is None:
            if (word := holds("word", j)) is not None:
                word["text"] += what
            elif (own := holds("line", j)) is not None and what.strip():
                own["text"] = f"{own['text']} {what.strip()}".strip()
        elif what is not None:
            level, kind = _level((what.get("class") or "").split())
            p, until = _properties(what.get("title")), end.get(j, never)
            if level == "page":
                pages += 1
                enter("page", j, pages, until)
            elif level == "area":
                enter("area", j, j, until)
            elif level == "par":
                enter("par", j, name(what.get("id"), "par"), until)
            elif level == "line":
                line(j, what.get("id"), kind, _box(p), until)
            elif level == "word":
                if holds("line", j) is None:
                    line(j, None, "ocr_line", None)
                word = {"id": name(what.get("id"), "word"), "text": "", "bbox": _box(p), "conf": _number(p, "x_wconf")}
                holds("line", j)["words"].append(enter("word", j, word, until))
    return lines


#: Characters of markup whose lines are handed on at once: as Python values, lines and words take many times their markup.
BATCH_CHARS = 1 << 20


def _handed_on(batches: Iterator[pa.RecordBatch], line: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, markup) to (key, _i, ln): a row per line, in batches that a bounded amount of markup makes."""
    for batch in batches:
        rows, at, lines, held = [], [], [], 0
        for i, markup in enumerate(batch.column(1)):
            own = _lines(markup.as_py()) or []
            rows += [i] * len(own)
            at += range(len(own))
            lines += own
            held += len(markup.as_py() or "")
            if held >= BATCH_CHARS or i == batch.num_rows - 1:
                key = batch.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([key, pa.array(at, pa.int32()), pa.array(lines, line)], [batch.schema.names[0], "_i", "ln"])
                rows, at, lines, held = [], [], [], 0


def marked_lines(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, _i, ln): the lines of pages marked up by class names. HTML is not XML: taken apart by a tolerant parser, batch-wise."""
    pages = docs.select(key, markup)
    line = DataType.fromDDL(LINE_SCHEMA).elementType
    out = StructType([pages.schema[0], StructField("_i", IntegerType()), StructField("ln", line)])
    to = to_arrow_type(line)
    return pages.mapInArrow(lambda batches: _handed_on(batches, to), out)


def parsed_marked(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, page_no, n, par_id, par_pos, par_size, line_id, kind, bbox, text, words, conf): lines without text left out.

    A line's box is its own, else that of its words; its text that of its words, cleaned; conf their mean to one decimal.
    """
    raw = marked_lines(docs, key, markup)
    words = F.transform("ln.words", lambda w: w.withField("text", clean(w["text"])))
    spoken = F.filter(F.transform(words, lambda w: w["text"]), lambda t: t != "")
    text = F.when(F.size("ln.words") > 0, clean(F.array_join(spoken, " "))).otherwise(clean(F.col("ln.text")))
    boxed = F.filter(F.transform(words, lambda w: w["bbox"]), lambda b: b.isNotNull())
    union = F.when(
        F.size(boxed) > 0,
        F.struct(
            F.array_min(F.transform(boxed, lambda b: b["x0"])).alias("x0"),
            F.array_min(F.transform(boxed, lambda b: b["y0"])).alias("y0"),
            F.array_max(F.transform(boxed, lambda b: b["x1"])).alias("x1"),
            F.array_max(F.transform(boxed, lambda b: b["y1"])).alias("y1"),
        ),
    )
    confs = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c.isNotNull())
    mean = F.aggregate(confs, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(confs), F.lit(0))
    return _placed(
        raw.select(
            key,
            "_i",
            F.col("ln.page_no").alias("page_no"),
            F.col("ln.par_id").alias("par_id"),
            F.col("ln.line_id").alias("line_id"),
            F.col("ln.kind").alias("kind"),
            F.coalesce("ln.bbox", union).alias("bbox"),
            text.alias("text"),
            words.alias("words"),
            F.bround(mean, 1).alias("conf"),
        ).where("text != ''"),
        key,
    )


def _placed(lines: DataFrame, key: str) -> DataFrame:
    from pyspark.sql import Window

    page = Window.partitionBy(key, "page_no").orderBy("_i")
    par = Window.partitionBy(key, "page_no", "par_id")
    return (
        lines.withColumn("n", F.row_number().over(page))
        .withColumn("par_pos", F.row_number().over(par.orderBy("_i")) - 1)
        .withColumn("par_size", F.count(F.lit(1)).over(par).cast("int"))
        .drop("_i")
    )


_BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def parsed_alto(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """The same columns from ALTO files, whatever their name space: a paragraph per text block, conf times hundred.

    Catalyst's XML reader takes the tree; prefixes are cut first, attributes keep their names.
    """
    plain = F.regexp_replace(F.regexp_replace(markup, r"<(/?)[A-Za-z0-9]+:", "<$1"), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    string = "struct<_ID:string,_CONTENT:string,_HPOS:double,_VPOS:double,_WIDTH:double,_HEIGHT:double,_WC:double>"
    line = f"struct<_ID:string,_HPOS:double,_VPOS:double,_WIDTH:double,_HEIGHT:double,String:array<{string}>>"
    block = f"struct<_ID:string,TextLine:array<{line}>>"
    page = f"struct<PrintSpace:struct<TextBlock:array<{block}>>,TextBlock:array<{block}>>"
    tree = F.from_xml(plain, f"Layout struct<Page:array<{page}>>", {"attributePrefix": "_"})

    def box(e: Column) -> Column:
        x, y = e["_HPOS"].cast("int"), e["_VPOS"].cast("int")
        ok = x.isNotNull() & y.isNotNull() & e["_WIDTH"].isNotNull() & e["_HEIGHT"].isNotNull()
        return F.when(ok, F.struct(x.alias("x0"), y.alias("y0"), (x + e["_WIDTH"].cast("int")).alias("x1"), (y + e["_HEIGHT"].cast("int")).alias("y1")))

    pages = docs.select(key, F.posexplode(tree["Layout"]["Page"]).alias("_p", "pg"))
    blocks = pages.select(key, (F.col("_p") + 1).alias("page_no"), F.posexplode(F.coalesce("pg.PrintSpace.TextBlock", "pg.TextBlock")).alias("_b", "bl"))
    lines = blocks.select(key, "page_no", "_b", F.concat(F.coalesce("bl._ID", F.concat(F.lit("block_"), F.col("_b") + 1)), F.lit("_par")).alias("par_id"), F.posexplode("bl.TextLine").alias("_l", "ln"))
    words = F.transform(
        "ln.String",
        lambda w: F.struct(w["_ID"].alias("id"), w["_CONTENT"].alias("text"), box(w).alias("bbox"), F.bround(w["_WC"] * 100, 1).alias("conf")),
    )
    confs = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c.isNotNull())
    mean = F.aggregate(confs, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(confs), F.lit(0))
    out = lines.select(
        key, (F.col("_b") * 100_000 + F.col("_l")).alias("_i"), "page_no", "par_id",
        F.coalesce("ln._ID", F.concat_ws("_", F.lit("line"), F.col("_b") + 1, F.col("_l") + 1)).alias("line_id"), F.lit("ocr_line").alias("kind"),
        box(F.col("ln")).alias("bbox"), clean(F.array_join(F.transform(words, lambda w: w["text"]), " ")).alias("text"), words.alias("words"),
        F.bround(mean, 1).alias("conf"),
    )
    return _placed(out.where("text != ''"), key)


# ---- packets as XML ----------------------------------------------------------------------------------------------------

_LINE = "struct<_VALUE:string,_id:string,_n:int,_bbox:string,_conf:double,_words:int,_gap_before:double,_kind:string,_raw:string>"
_PAR = f"struct<_id:string,_bbox:string,line:array<{_LINE}>>"
PACKET = (
    f"_version string, preservation_source struct<master_file:struct<_VALUE:string,_sha256:string>,captured:string>, "
    f"ocr struct<_engine:string,_lang:string,_psm:int,_mean_word_confidence:double>, "
    f"ocr_transcript struct<page:array<struct<_n:int,paragraph:array<{_PAR}>>>>"
)


def read_packets(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """``key`` + the packet's tree from its XML."""
    return docs.select(key, F.from_xml(F.col(markup), PACKET, {"attributePrefix": "_"}).alias("packet"))


def packet_lines(packets: DataFrame, key: str) -> DataFrame:
    """Flat lines of read packets; boxes parsed, paragraph sizes and positions attached by higher-order projection."""
    def box(b: Column) -> Column:
        v = F.transform(F.split(b, r"\s+"), lambda x: x.try_cast("int"))
        return F.when(F.size(v) >= 4, F.struct(*[F.get(v, F.lit(i)).alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))]))

    rows = F.flatten(
        F.flatten(
            F.transform(
                "packet.ocr_transcript.page",
                lambda pg: F.transform(
                    F.coalesce(pg["paragraph"], F.array()),
                    lambda p: F.transform(
                        F.coalesce(p["line"], F.array()),
                        lambda ln, i: F.struct(
                            pg["_n"].alias("page_no"), ln["_n"].alias("n"), ln["_id"].alias("line_id"), p["_id"].alias("par_id"),
                            F.size(p["line"]).alias("par_size"), i.alias("par_index"), box(ln["_bbox"]).alias("bbox"),
                            ln["_conf"].alias("conf"), ln["_words"].alias("words"), ln["_gap_before"].alias("gap_before"),
                            ln["_kind"].alias("kind"), strip(ln["_VALUE"]).alias("text"), ln["_raw"].alias("raw"),
                        ),
                    ),
                ),
            )
        )
    )
    return packets.select(key, F.inline(rows))


# ---- envelopes -----------------------------------------------------------------------------------------------------------


def envelope(payload: Column, source_uri: Column, normaliser: str, tag: str = "payload", attributes: str = "") -> Column:
    """An XML envelope around bytes in base64 lines."""
    from quillspan.functions.bytes import wrapped_base64

    esc = F.regexp_replace(F.regexp_replace(source_uri, "&", "&amp;"), "<", "&lt;")
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<xena>\n<meta_data>\n<normaliser_name>{normaliser}</normaliser_name>\n<input_source_uri>'),
        esc,
        F.lit(f"</input_source_uri>\n</meta_data>\n<content>\n<{tag}{attributes}>\n"),
        wrapped_base64(payload),
        F.lit(f"\n</{tag}>\n</content>\n</xena>\n"),
    )


def envelope_meta(markup: Column) -> Column:
    """struct of the envelope's metadata and the name of its payload element, without decoding the payload."""
    def text(name: str) -> Column:
        return F.xpath_string(markup, F.lit(f"string(//*[local-name()='{name}'])"))

    return F.struct(
        text("meta_data_wrapper_name").alias("wrapper"),
        text("normaliser_name").alias("normaliser"),
        text("input_source_uri").alias("source_uri"),
        F.xpath_string(markup, F.lit("local-name(//*[local-name()='content']/*[1])")).alias("payload_element"),
    )


def unwrapped(markup: Column) -> Column:
    """The payload's bytes."""
    body = F.xpath_string(markup, F.lit("string(//*[local-name()='content']/*[1])"))
    return F.unbase64(F.regexp_replace(body, r"\s", ""))


# ---- schematic trees -----------------------------------------------------------------------------------------------------


def schematic(docs: DataFrame, key: str, markup: str) -> tuple[DataFrame, DataFrame]:
    """(parts, pins): part names, and (net, part, pin) edges of a schematic."""
    schema = (
        "drawing struct<schematic:struct<parts:struct<part:array<struct<_name:string,_value:string>>>,sheets:struct<sheet:array<struct<nets:"
        "struct<net:array<struct<_name:string,segment:array<struct<pinref:array<struct<_part:string,_pin:string>>>>>>>>>>>>"
    )
    tree = docs.select(key, F.from_xml(F.col(markup), schema, {"attributePrefix": "_"}).alias("t"))
    parts = tree.select(key, F.explode("t.drawing.schematic.parts.part").alias("p")).select(key, F.col("p._name").alias("part"), F.col("p._value").alias("value"))
    nets = tree.select(key, F.explode("t.drawing.schematic.sheets.sheet").alias("s")).select(key, F.explode("s.nets.net").alias("n"))
    pins = nets.select(key, F.col("n._name").alias("net"), F.explode("n.segment").alias("g")).select(key, "net", F.explode("g.pinref").alias("r"))
    return parts, pins.select(key, "net", F.col("r._part").alias("part"), F.col("r._pin").alias("pin"))
