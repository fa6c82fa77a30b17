import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quillspan.functions.numbers import band_rms, source_box
from quillspan.operators.reconcile import difference, package_verdict, symmetric_difference
from quillspan.sources import calls, files, sinks, synthetic
from quillspan.sources import transcripts as ts

PAGE = """<html><head><meta name='ocr-system' content='x'></head><body><div class='ocr_page' title='bbox 0 0 1000 1400'>
<div class='ocr_carea' id='b1'><p class='ocr_par' id='p1'>
<span class='ocr_line' id='l1' title='bbox 200 100 600 140'><span class='ocrx_word' title='bbox 200 100 300 140; x_wconf 80'>Monday,</span>
<span class='ocrx_word' title='bbox 310 100 350 140; x_wconf 90'>3</span> <span class='ocrx_word'>June</span></span></p>
<p class='ocr_par' id='p2'><span class='ocr_line' id='l2' title='bbox 200 300 600 340'><span class='ocrx_word' title='x_wconf 90.2'>Frost</span>
<span class='ocrx_word' title='x_wconf oops'>thaw &amp; thaw</span></span>
<span class='ocr_line' id='blank'><span class='ocrx_word'> </span></span>
<span class='ocr_header' id='l3'>no words <b>here</b></span></p></div></div>
<div class='ocr_page'><span class='ocrx_word'>loose</span></div></body>"""

ALTO = """<?xml version="1.0"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Layout><Page WIDTH="1000" HEIGHT="1400"><PrintSpace>
<TextBlock ID="tb"><TextLine ID="a" HPOS="100" VPOS="100" WIDTH="400" HEIGHT="40"><String CONTENT="Snow" WC="0.9" HPOS="100" VPOS="100" WIDTH="90" HEIGHT="40"/>
<SP/><String CONTENT="by" WC="0.81"/></TextLine><TextLine><String CONTENT="a"/><String CONTENT="quay"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""


def test_marked_pages(spark):
    got = ts.parsed_marked(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "k int, m string"), "k", "m").orderBy("page_no", "n").collect()
    assert [(r.page_no, r.n, r.par_id, r.par_pos, r.par_size, r.text) for r in got] == [
        (1, 1, "p1", 0, 1, "Monday, 3 June"), (1, 2, "p2", 0, 2, "Frost thaw & thaw"), (1, 3, "p2", 1, 2, "no words here"), (2, 1, got[3].par_id, 0, 1, "loose")]
    assert (got[0].conf, got[1].conf, got[2].conf, got[2].kind) == (85.0, 90.2, None, "ocr_header")
    assert tuple(got[0].bbox) == (200, 100, 600, 140) and got[3].bbox is None


def test_sloppy_markup():
    """End tags left out, crossed, doubled or without start; words outside lines; text between words."""
    word = lambda t: f"<span class='ocrx_word'>{t}</span>"
    crossed = f"<div class=ocr_page><p class=ocr_par id=a><span class=ocr_line id=x>{word('one')}<b>{word('two')}</p>{word('three')}</b></div>{word('four')}"
    got = ts._lines(crossed)
    assert [([w["text"] for w in x["words"]], x["par_id"], x["page_no"]) for x in got][:2] == [(["one", "two"], "a", 1), (["three"], got[1]["par_id"], 1)]
    assert [w["text"] for w in got[-1]["words"]] == ["four"] and got[-1]["page_no"] == 1 and len({x["par_id"] for x in got}) == 3
    assert [x["text"] for x in ts._lines("<p class=ocr_par><span class=ocr_line>a<br>b <i>c</i></span></i></p><span class=ocr_line>d")] == ["a b c", "d"]
    assert [[w["text"] for w in x["words"]] for x in ts._lines("<span class=ocr_line><span class=ocrx_word>a<span class=ocrx_word>b</span>")] == [["a", "b"]]
    assert ts._lines("") == [] == ts._lines("</p></div>just text") and ts._lines(None) is None


def test_marked_pages_are_handed_on_in_bounded_batches(spark, monkeypatch):
    """Pages of one batch, more than may be held as Python values at once: several batches come out, and every line once."""
    page = "<p class=ocr_par>" + "<span class=ocr_line><span class=ocrx_word>a</span></span>" * 20
    monkeypatch.setattr(ts, "BATCH_CHARS", 3 * len(page))
    line = to_arrow_type(DataType.fromDDL(ts.LINE_SCHEMA).elementType)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([None, "", *[page] * 98])], ["k", "m"])
    got = list(ts._handed_on(iter([batch, batch.slice(0, 2), batch.slice(0, 0)]), line))
    assert max(b.num_rows for b in got) == 60 and len(got) == 34
    assert [(k, i) for b in got for k, i in zip(b["k"].to_pylist(), b["_i"].to_pylist(), strict=True)] == [(k, i) for k in range(2, 100) for i in range(20)]
    rows = ts.parsed_marked(spark.createDataFrame([("x/1", page), (None, page)], "k string, m string"), "k", "m").collect()
    assert sorted((r.k or "", r.n, r.text) for r in rows) == sorted((k, n, "a") for k in ("", "x/1") for n in range(1, 21))


def test_alto(spark):
    got = ts.parsed_alto(spark.createDataFrame([(1, ALTO)], "k int, m string"), "k", "m").orderBy("n").collect()
    assert [(r.text, r.par_id, r.par_size, r.conf) for r in got] == [("Snow by", "tb_par", 2, 85.5), ("a quay", "tb_par", 2, None)]
    assert tuple(got[0].bbox) == (100, 100, 500, 140) and got[1].bbox is None


def test_packets_round_trip_through_xml(spark):
    lines = synthetic.planted_pages(spark, [[("a < b & c", 10, 300)], [("two", 10, 50), ('say "x"', 10, 90)]], pages=2)
    back = ts.packet_lines(ts.read_packets(sinks.packet_xml(lines), "packet_id", "xml"), "packet_id")
    cols = ["packet_id", "page_no", "n", "line_id", "par_id", "par_size", "par_index", "bbox", "conf", "words", "gap_before", "text"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, lines.select(*cols).collect()))


def test_envelopes(spark):
    data = bytes(range(256)) * 3
    df = spark.createDataFrame([(data,)], "b binary").select(ts.envelope(F.col("b"), F.lit("file:///a&b.jpg"), "n/1").alias("x"), "b")
    m = df.select(ts.envelope_meta(F.col("x")).alias("m"), (ts.unwrapped(F.col("x")) == F.col("b")).alias("same")).first()
    assert (m.m.source_uri, m.m.normaliser, m.m.payload_element, m.same) == ("file:///a&b.jpg", "n/1", "payload", True)
    body = df.first().x.split("<payload>\n")[1].split("\n</payload>")[0]
    assert max(map(len, body.split("\n"))) == 76


def test_schematic_reconciles(spark):
    xml = """<eagle><drawing><schematic><parts><part name="U1" value="x"/><part name="R1"/></parts><sheets><sheet><nets><net name="VCC"><segment>
    <pinref part="U1" gate="G" pin="1"/><pinref part="R1" gate="G" pin="2"/></segment></net></nets></sheet></sheets></schematic></drawing></eagle>"""
    parts, pins = ts.schematic(spark.createDataFrame([(1, xml)], "k int, m string"), "k", "m")
    need = spark.createDataFrame([("U1",), ("U2",)], "part string")
    assert [r.part for r in difference(need, parts, ["part"]).collect()] == ["U2"]
    assert sorted(tuple(r) for r in symmetric_difference(need, parts, ["part"]).collect()) == [("R1", "right"), ("U2", "left")]
    assert sorted((r.net, r.part, r.pin) for r in pins.collect()) == [("VCC", "R1", "2"), ("VCC", "U1", "1")]


def test_trees_catalogues_and_tsv(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "b").mkdir(parents=True)
    (root / "skip").mkdir()
    (root / "B.html").write_text("<title>Bee</title>")
    (root / "b" / "a.txt").write_text("x")
    (root / "skip" / "c").write_text("y")
    (root / "p10.png").write_text("1")
    (root / "p9.PNG").write_text("2")
    assert sorted(r.path for r in files.tree(spark, str(root), exclude=["skip"]).collect()) == ["B.html", "b/a.txt", "p10.png", "p9.PNG"]
    c = files.catalogue(spark, str(root))
    assert [(r.path, r.title, r.bytes) for r in c.collect()][:2] == [("B.html", "Bee", 18), ("b/a.txt", "", 1)]
    assert [r.path for r in files.images(spark, str(root)).collect()] == ["p9.PNG", "p10.png"]
    with pytest.raises(FileNotFoundError):
        files.images(spark, str(root / "b"))
    sinks.write_tsv(c, str(tmp_path / "out"), files.CATALOGUE, F.lower("path"))
    part = next((tmp_path / "out").glob("part-*")).read_text()
    assert part.startswith("sha256\tbytes\tmtime\tpath\ttitle\n") and part.count("\n") == 6
    assert sorted(map(tuple, files.tab_separated(spark, str(tmp_path / "out")).select("path", "bytes").collect())) == sorted((r.path, r.bytes) for r in c.collect())


def test_contracted_header(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_text('Item,RefDes\n1,"a,b"\n')
    assert [tuple(r) for r in files.contracted_csv(spark, str(p), ["Item", "RefDes"]).collect()] == [("1", "a,b")]
    with pytest.raises(ValueError):
        files.contracted_csv(spark, str(p), ["Item", "Ref"])


def package(**entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return b.getvalue()


def test_packages(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 256, 256)
    small = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 64, 32)
    toml = 'name = "x"\nsource_code_url = "u"\n'
    cases = {
        "good.xdc": package(index_dot_html="x", manifest_dot_toml=toml, icon_dot_png=png),
        "nested.xdc": package(app__index_dot_html="x"),
        "shim.xdc": package(index_dot_html="x", webxdc_dot_js=""),
        "climb.xdc": package(**{"index_dot_html": "x", "..__y": ""}),
        "icon.xdc": package(index_dot_html="x", icon_dot_png=small, manifest_dot_toml=toml + "extra = 1\n"),
        "broken.xdc": b"no zip",
        "toml.zip": package(index_dot_html="x", manifest_dot_toml="name = "),
    }
    df = spark.createDataFrame([(f"/p/{k}", v) for k, v in cases.items()], "path string, content binary")
    got = {r.file_name: r.v for r in files.packages(df).select("file_name", package_verdict().alias("v")).collect()}
    assert (got["good.xdc"].verdict, got["good.xdc"].errors, got["good.xdc"].warnings) == ("OK", [], [])
    assert got["nested.xdc"].errors == ["index.html is not at the root"] and got["shim.xdc"].errors == ["webxdc.js must not be shipped"]
    assert got["climb.xdc"].errors == ["unsafe entry path"] and got["broken.xdc"].errors == ["not a ZIP file"]
    assert got["icon.xdc"].warnings == ["icon is not square", "icon size is out of range"] and "manifest has unknown keys" in got["icon.xdc"].infos
    assert got["toml.zip"].errors == ["extension is not .xdc", "manifest does not parse"]


def test_written_packages_are_equal_bytes(tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "index.html").write_text("x")
    (src / "a.js").write_text("y")
    for n in ("one.xdc", "two.xdc"):
        assert sinks.write_package(str(src), str(tmp_path / n)) == 2
    assert (tmp_path / "one.xdc").read_bytes() == (tmp_path / "two.xdc").read_bytes()
    (src / "webxdc.js").write_text("")
    with pytest.raises(ValueError):
        sinks.write_package(str(src), str(tmp_path / "three.xdc"))


def test_signal(spark):
    f = synthetic.signal(spark, 2).orderBy("seq").collect()
    assert len(f) == 64 and [r.seq for r in f[:2]] == [1, 2] and len(f[0].samples_uv) == 8
    df = spark.createDataFrame([(sum((r.samples_uv for r in f), []),)], "s array<double>")
    assert 1.5 < df.select(band_rms(F.col("s"), 256, 8, 12)).first()[0] < 4


def test_source_boxes(spark):
    df = spark.createDataFrame([((150, 100, 750, 140),)], "b struct<x0:int,y0:int,x1:int,y1:int>")
    assert tuple(df.select(source_box(F.col("b"), F.lit(2), F.lit(20))).first()[0]) == (65, 40, 365, 60)


def test_calls_retry_and_keep_errors(spark):
    tries = []

    def flaky(url, headers, body, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise calls.Transient("503")
        return body.upper()

    waits = []
    assert calls.with_retries(flaky, pause=waits.append)("u", {}, "x", 1.0) == "X" and waits == [1.0, 2.0]

    def fake(url, headers, body, timeout):
        if body == "bad":
            raise RuntimeError("no")
        return body + "!"

    df = spark.createDataFrame([("a",), ("bad",)], "t string")
    assert sorted(tuple(r) for r in calls.asked(df, F.col("t"), "http://x", fake).select("t", "reply", "error").collect()) == [("a", "a!", None), ("bad", None, "no")]


def test_results_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 3, True, "5-7-5", "exact", 1.0, ["a", "b", "c"])], "packet_id int, page_no int, n int, accepted boolean, form string, validation string, score double, lines array<string>")
    sinks.write_results(df, str(tmp_path / "j"), "json")
    sinks.write_results(df, str(tmp_path / "x"), "xml")
    assert spark.read.json(str(tmp_path / "j")).first().lines == ["a", "b", "c"]
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "x")).first().form == "5-7-5"
    assert "### 5-7-5 — exact · score 1.0\n\n    a\n    b\n    c" in sinks.digest(df).first().markdown
    with pytest.raises(ValueError):
        sinks.write_results(df, str(tmp_path / "y"), "yaml")


def test_sidecars(spark, tmp_path):
    from quillspan.sources import feeds

    (tmp_path / "p1.provenance.json").write_text('{"schema": "x/provenance/1.0", "master": {"path": "m.png", "width": 10}, "exif": {"DateTime": "2020", "Make": "M", "Exif": {"DateTimeOriginal": ""}}}')
    (tmp_path / "p2.provenance.json").write_text('{"exif": {"DateTime": "2020", "Exif": {"DateTimeOriginal": "2019"}}, "unknown": 1}')
    df = feeds.sidecars(spark, str(tmp_path), feeds.PROVENANCE)
    got = {r.stem: (r.t, r.c, r.master and r.master.width) for r in df.select("stem", "master", feeds.captured(F.col("exif")).alias("t"), feeds.camera(F.col("exif")).alias("c")).collect()}
    assert got == {"p1": ("2020", "M", 10), "p2": ("2019", None, None)}


def test_feed_maps_and_tails(spark, tmp_path):
    from quillspan.sources import feeds

    with pytest.raises(ValueError):
        feeds.frame_feed(spark, str(tmp_path), "ws://x")
    assert feeds.frame_feed(spark, str(tmp_path), "wss://x").isStreaming
    df = spark.createDataFrame([({"a": "1"}, [1.0, 2.0, 3.0]), (None, [])], "m map<string,string>, v array<double>")
    got = df.select(feeds.with_defaults(F.col("m"), {"a": "0", "b": "0"}).alias("m"), feeds.bounded_tail(F.col("v"), 2).alias("v")).collect()
    assert [(r.m, r.v) for r in got] == [({"a": "1", "b": "0"}, [2.0, 3.0]), ({"a": "0", "b": "0"}, [])]


def test_history(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", "b", 2.0), ("2024-01-01", "a", 1.0)], "ts string, event_type string, value double")
    sinks.write_history(df, str(tmp_path / "h"))
    lines = [x for p in sorted((tmp_path / "h").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == "ts,event_type,value" and [x.split(",")[1] for x in lines if "event" not in x] == ["a", "b"]


def test_http_transport_tells_what_may_pass():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Server(BaseHTTPRequestHandler):
        def answer(self):
            seen.append((self.command, self.rfile.read(int(self.headers.get("content-length") or 0)).decode()))
            code = {"/busy": 503, "/gone": 404}.get(self.path, 200) if len(seen) < 4 or self.path == "/gone" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(f"{self.path} said".encode())

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, waits = f"http://127.0.0.1:{server.server_port}", []
    try:
        assert calls.http(f"{base}/a", {}, "x", 5) == "/a said" and seen == [("POST", "x")]
        assert calls.with_retries(calls.http, 6, waits.append, calls.linear)(f"{base}/busy", {}, None, 5) == "/busy said"
        assert waits == [2.0, 4.0] and seen[-1] == ("GET", "")
        with pytest.raises(ValueError, match="HTTP 404"):
            calls.http(f"{base}/gone", {}, None, 5)
    finally:
        server.shutdown()
    with pytest.raises(calls.Transient):
        server.server_close()
        calls.http(base, {}, None, 0.5)
