import json

import pytest

from quillspan.operators import nested

SCHEMA = (
    "delivery_id long, paragraphs array<struct<id:string,page:int,bbox:struct<x0:int,y0:int,x1:int,y1:int>,lines:array<struct<id:string,"
    "n:int,text:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>,conf:double,gap_before:double,kind:string,raw:string,words:array<struct<"
    "id:string,text:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>,conf:double>>>>>>, body string, par_pos int"
)


def word(t, **kw):
    return {"text": t, **kw}


def tree(*words):
    return {"id": "p", "lines": [{"id": "l", "words": list(words)}]}


@pytest.fixture(scope="module")
def found(spark):
    typed = [("p1", 1, None, [("l1", 1, "a b", None, None, None, None, None, [(None, "a", None, 1.0), None, ("w", " ", None, None), ("w", "b", None, None)]), None]), None]
    bodies = {
        2: json.dumps({"paragraphs": [tree(word("x"), None, "y", word(""), word(None))]}),
        3: json.dumps(json.dumps({"paragraphs": [None, tree(word("twice"))]})),
        4: json.dumps({"pages": [{"n": 1, "paragraphs": [tree(word("a")), tree()]}, None, {"paragraphs": tree("b")}]}),
        5: json.dumps({"paragraphs": {"lines": {"words": {"text": "alone"}}}}),
        6: json.dumps({"paragraphs": [tree(word("cut"))]})[:-5],
        7: "",
        8: None,
        9: json.dumps(["not", "a", "packet"]),
        10: json.dumps({"paragraphs": [{"lines": None}, {"lines": [{"words": "solo"}]}]}),
        11: json.dumps({"paragraphs": [tree(word("long " * 50_000))]}),
        12: json.dumps({"paragraphs": []}),
    }
    rows = [(1, typed, None, 77)] + [(k, None, b, 77) for k, b in bodies.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.delivery_id, r.par_pos, r.line_pos, r.word_pos): r.text for r in nested.words(df).collect()}


def test_positions_and_shapes(found):
    short = {k: v for k, v in found.items() if k[0] != 11}
    assert short == {
        (1, 0, 0, 0): "a",
        (1, 0, 0, 3): "b",
        (2, 0, 0, 0): "x",
        (2, 0, 0, 2): "y",
        (3, 1, 0, 0): "twice",
        (4, 0, 0, 0): "a",
        (4, 2, 0, 0): "b",
        (5, 0, 0, 0): "alone",
        (10, 1, 0, 0): "solo",
    }
    assert len(found[11, 0, 0, 0]) == 250_000


def test_children_point_to_parents(spark):
    body = json.dumps({"paragraphs": [tree(word("a")), None, {"id": "q", "lines": [None, {"id": "m", "words": ["b"]}]}]})
    df = spark.createDataFrame([(1, None, body, 0), (1, None, body, 0)], SCHEMA)
    pars = {(r.delivery_id, r.par_pos): r.par_id for r in nested.paragraphs(df).collect()}
    lines = {(r.delivery_id, r.par_pos, r.line_pos): r.par_id for r in nested.lines(df).collect()}
    words = nested.words(df).collect()
    assert pars == {(1, 0): "p", (1, 2): "q"} and set(lines) == {(1, 0, 0), (1, 2, 1)}
    assert all(pars[k[:2]] == v for k, v in lines.items()) and all((w.delivery_id, w.par_pos, w.line_pos) in lines for w in words)
    assert len(words) == 4  # repeated deliveries give their rows once each


def test_empty_table(spark):
    assert nested.words(spark.createDataFrame([], SCHEMA)).count() == 0
