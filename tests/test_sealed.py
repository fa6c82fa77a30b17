import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import sealed as sl


def test_key_derivation_known_answer():
    """RFC 5869, first test case."""
    out = sl.hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert out.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


@pytest.fixture(scope="module")
def transfer(spark):
    rng = random.Random(9)
    rows = [(t, n, rng.randbytes(16), rng.randbytes(16) if n else b"s" * 16, data) for t in (1, 2) for n, data in enumerate([rng.randbytes(1000), b"", b"a\x00\x00", rng.randbytes(83), rng.randbytes(84)])]
    rows = [(t, n, rows[0 if t == 1 else 5][2], salt, data) for t, n, _, salt, data in rows]
    made = sl.sealed(spark.createDataFrame(rows, "transfer long, file_no int, secret binary, salt binary, data binary"), record_size=100)
    return rows, [tuple(r) for r in made.select("transfer", "file_no", "secret", "stream").collect()]


def tables(spark, made, size, drop=(), spoil=lambda t, b: b):
    whole = {}
    for t, _, _, stream in sorted(made):
        whole[t] = whole.get(t, b"") + bytes(stream)
    cut = [(t, i, spoil(t, w)[i : i + size]) for t, w in whole.items() for i in range(0, len(w), size) if (t, i) not in drop]
    return (
        spark.createDataFrame(cut, "transfer long, at long, content binary"),
        spark.createDataFrame([(t, n, len(s)) for t, n, _, s in made], "transfer long, file_no int, length long"),
        spark.createDataFrame([(t, k) for t, k in {(t, bytes(k)) for t, _, k, _ in made}], "transfer long, secret binary"),
    )


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_streams_open_whatever_the_pieces(spark, transfer, size):
    rows, made = transfer
    if size == 1:
        made = [m for m in made if m[0] == 1]
    got = {(r.transfer, r.file_no): r for r in sl.contents(sl.opened(*tables(spark, made, size))).collect()}
    for t, n, _, _, data in rows:
        if (t, n) in got:
            assert (bytes(got[t, n].data), got[t, n].error, got[t, n].records) == (data, None, max(1, -(-len(data) // 83)))
    assert len(got) == len(made)


def test_what_is_lost_or_spoilt_is_said(spark, transfer):
    _, made = transfer
    flip = lambda t, b: b[:130] + bytes([b[130] ^ 1]) + b[131:] if t == 2 else b
    got = {(r.transfer, r.file_no, r.seq): r.error for r in sl.opened(*tables(spark, made, 50, drop={(1, 400)}, spoil=flip)).collect()}
    assert got[1, 0, 3] == "incomplete" == got[1, 0, 4] or got[1, 0, 3] == "incomplete"
    assert got[2, 0, 1] == "wrong key or tag" and got[2, 0, 0] is None and got[1, 0, 0] is None
    pieces, files, _ = tables(spark, made, 50)
    none = spark.createDataFrame([(1, b"x" * 16)], "transfer long, secret binary")
    said = {(r.transfer, r.file_no): r.error for r in sl.opened(pieces, files, none).where("seq is null or seq = 0").collect()}
    assert said[1, 0] == "wrong key or tag" and said[2, 0] == "no secret"
    headless = sl.opened(pieces.limit(0), files, none).collect()
    assert {r.error for r in headless} == {"no head"} and len(headless) == len(made)


def test_files_without_all_records_have_no_data(spark, transfer):
    _, made = transfer
    r = sl.opened(*tables(spark, made, 50)).where(~((F.col("seq") == 2) & (F.col("file_no") == 0)))
    got = {(x.transfer, x.file_no): x for x in sl.contents(r).collect()}
    assert got[1, 0].data is None and got[1, 0].error == "missing records" and got[1, 3].error is None
