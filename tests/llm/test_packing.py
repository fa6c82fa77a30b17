import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import packing as pk
from quillspan.llm.tokens import VOCABULARY, counted, encoding

DOCS = "doc_id long, text string, tokens string, bin string"


def words(rng, n):
    return " ".join(rng.choice(["heron", "marsh", "willow", "the", "of", "cold"]) for _ in range(n))


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([3, 20, 60, 110, 200])), "clash", "clash") for i in range(600)]
    rows += [(1000, words(rng, 2000), "", ""), (1001, "", "", ""), (1002, None, "", "")] + [(2000 + i, "the cold marsh", "", "") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    kinds = spark.createDataFrame([("small", 128), ("large", 1024), ("none", 0), ("null", None)], "container string, capacity_tokens int")
    return rows, pk.packed(docs, kinds, shard_rows=150).toPandas()


def test_every_piece_once_and_no_container_too_full(packed):
    rows, got = packed
    enc = encoding(Path(VOCABULARY).read_bytes())
    size = {r[0]: len(enc.encode_ordinary(r[1])) for r in rows if r[1]}
    for (name, cap), g in got.groupby(["container", "capacity"]):
        assert (name, cap) in (("small", 128), ("large", 1024))
        per = g.groupby("doc_id")["tokens"].agg(["sum", "count"])
        assert dict(per["sum"]) == size
        assert all(n == -(-size[d] // cap) for d, n in per["count"].items())
        assert not g.duplicated(["doc_id", "piece"]).any() and g.groupby("bin")["tokens"].sum().max() <= cap


def test_little_room_is_left(packed):
    _, got = packed
    for (_, cap), g in got.groupby(["container", "capacity"]):
        assert g["bin"].nunique() <= 1.06 * -(-g["tokens"].sum() // cap) + 3


def test_empty(spark):
    docs, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "container string, capacity_tokens int")
    kinds = spark.createDataFrame([("a", 10)], none.schema)
    assert pk.packed(docs, kinds).count() == 0
    assert pk.packed(spark.createDataFrame([(1, "x", "", "")], DOCS), none).count() == 0


def test_configurations_serve_all_within_room():
    rng = np.random.default_rng(3)
    for _ in range(5):
        size = np.unique(rng.integers(60, 400, 8))
        need = rng.integers(1, 90, len(size))
        used = pk.configurations(size, need, 512)
        assert all(c @ size <= 512 for c, _ in used)
        assert (sum(c * n for c, n in used) >= need).all()
        rooms = []  # first fit, largest first
        for s in np.repeat(size, need)[::-1]:
            i = next((i for i, r in enumerate(rooms) if r >= s), None)
            if i is None:
                rooms.append(512 - s)
            else:
                rooms[i] -= s
        assert sum(n for _, n in used) <= len(rooms) + len(size)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5000), st.lists(st.tuples(st.floats(0.25, 1.0), st.integers(1, 50)), min_size=1, max_size=30))
def test_any_capacity_has_configurations(capacity, shares):
    """Every large text finds a slot and no container is too full, also for texts one short of the capacity."""
    h = {}
    for share, n in [*shares, (1.0, 3)]:
        t = min(capacity - 1, int(share * capacity) + 1)
        if t * pk.LARGE > capacity:
            h[t] = h.get(t, 0) + n
    sizes = np.array(sorted(h), dtype=np.int64)
    end, used = pk.configured(capacity, sizes, np.array([h[t] for t in sizes], dtype=np.int64))
    need = np.bincount(np.searchsorted(end, sizes), weights=[h[t] for t in sizes], minlength=len(end))
    assert all(c @ end <= capacity for c, _ in used)
    assert (sum((c * n for c, n in used), np.zeros(len(end))) >= need).all()


@pytest.mark.parametrize("capacity", [1, 2, 1538, 2050, 4099])
def test_texts_around_the_capacity(spark, capacity):
    rows = [(i, n) for i, n in enumerate([capacity - 1, capacity, capacity + 1, 2 * capacity - 1, max(1, capacity // 2), 1] * 4)]
    docs = spark.createDataFrame([(i, " a" * n) for i, n in rows], "doc_id long, text string")
    got = pk.packed(docs, spark.createDataFrame([("c", capacity)], "container string, capacity_tokens int")).toPandas()
    assert got.groupby("doc_id")["tokens"].sum().to_dict() == {i: n for i, n in rows if n}
    assert not len(got) or got.groupby("bin")["tokens"].sum().max() <= capacity


def test_pricing_against_brute_force():
    size, value = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.71])
    best = max(a * 0.31 + b * 0.55 + c * 0.71 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    got = pk.price(value, size, 22)
    assert got @ size <= 22 and abs(got @ value - best) < 1e-9


def test_groups_of_equal_cardinality():
    ends = pk.linear_groups(np.arange(1, 101), np.full(100, 10), 10)
    assert list(ends) == list(range(10, 101, 10))
    assert list(pk.linear_groups(np.array([7]), np.array([3]), 10)) == [7] and not len(pk.linear_groups(np.array([]), np.array([])))


def test_best_fit():
    f = pd.DataFrame([("a", 10, -1, -1, 4, "x", 0), ("a", 10, -1, -1, 3, "y", 0), ("a", 10, 1, 0, 3, "", 0), ("a", 10, 2, 0, 4, "", 0), ("a", 10, 3, 0, 2, "", 0)],
                     columns=["container", "capacity", "doc_id", "piece", "tokens", "bin", "shard"])
    assert dict(zip(*[pk.best_fit(f)[c] for c in ("doc_id", "bin")], strict=True)) == {2: "x", 1: "y", 3: "s0-0"}


def test_tokens(spark):
    df = counted(spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "ü" * 5000)], "doc_id int, text string"))
    n = {r.doc_id: r.n_tokens for r in df.collect()}
    assert (n[1], n[2], n[3]) == (2, 0, 0) and n[4] > 1000


def test_invariants_show_what_is_broken(spark):
    rows = [("c", 10, 1, 0, 6, "a"), ("c", 10, 2, 0, 6, "a"), ("c", 10, 3, 0, 4, "b"), ("c", 10, 3, 0, 4, "d"), ("c", 10, 4, 0, 3, "e"), ("c", 10, 4, 1, 3, "f")]
    r = pk.invariants(spark.createDataFrame(rows, pk._OUT)).first()
    assert (r.texts, r.overfull, r.repeated, r.split_without_need) == (4, 1, 1, 1)
