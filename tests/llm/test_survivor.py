import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import survivor as sv

SCHEMA = "candidate_id long, packet_id long, page_no int, line_ids array<string>, engine string, run_at timestamp, score double, form string, validation string"
ENGINES = [("reviewer", 1), (" Big ", 2), ("big", 7), (None, 0), ("", 0)]
T = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
A, B = ["line_1_1", "line_1_2", "line_1_3"], ["LINE-1-03 ", " Line_01_001", "line_1_2"]


@pytest.fixture(scope="module")
def engines(spark):
    return spark.createDataFrame(ENGINES, "engine string, trust_rank int")


def found(spark, engines, rows, strict=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("value", F.lit("clash")).withColumn("field", F.lit(1)).withColumn("trust_rank", F.lit(0))
    return {(r.group_candidate_id, r.field): r.candidate_id for r in sv.survivors(df, engines, strict=strict).collect()}


def test_field_by_field(spark, engines):
    rows = [
        (5, 1, 1, A, "BIG", T[0], 0.5, "5-7-5", None),
        (6, 1, 1, B, "reviewer", T[0], 12.5, " 5-7-5 (Approximate) ", "see notes"),
        (7, 1, 1, A, None, T[2], 0.9, "free-form 3-line", "EXACT"),
        (8, 1, 1, A, "unheard of", None, 0.9, None, "approximate (off by 11)"),
        (9, 1, 2, A, "reviewer", T[0], 0.1, "5-7-5", "exact"),  # alone on its page
        (10, 1, 1, A[:2] + ["line_1_4"], "reviewer", T[0], 0.1, "5-7-5", "exact"),  # other lines
    ]
    assert found(spark, engines, rows) == {(5, "score"): 5, (5, "form"): 6, (5, "validation"): 7}


def test_ties_nulls_and_unusable_values(spark, engines):
    rows = [
        (3, 1, 1, A, "reviewer", None, float("nan"), "", None),
        (2, 1, 1, A, "reviewer", None, -0.1, None, None),
        (4, 1, 1, A, " Reviewer", T[1], 1.0, "  ", "?"),
        (1, 1, 1, A, "reviewer", T[1], 0.0, "n/a", "0.71"),
        (11, 2, 1, None, "reviewer", T[1], 0.5, "5-7-5", "exact"),
        (12, 2, 1, None, "reviewer", T[1], 0.5, "5-7-5", "exact"),
        (13, 2, 1, ["line_1_1", "line_1_1", "line_1_2"], "reviewer", T[1], 0.5, "5-7-5", "exact"),
        (14, None, 1, A, "reviewer", T[1], 0.5, "5-7-5", "exact"),
        (15, None, 1, A, "reviewer", T[1], 0.5, "5-7-5", "exact"),
    ]
    assert found(spark, engines, rows) == {(1, "score"): 1}


def test_empty(spark, engines):
    assert found(spark, engines, []) == {}
    none = spark.createDataFrame([], "engine string, trust_rank int")
    rows = [(1, 1, 1, A, "x", T[0], 0.5, None, None), (2, 1, 1, A, "y", T[1], 0.4, None, None)]
    assert found(spark, none, rows) == {(1, "score"): 2}


def test_hot_group_against_brute_force(spark, engines):
    rng = random.Random(4)
    rows = []
    for i in range(1, 3001):
        hot = rng.random() < 0.5
        rows.append((i, 1 if hot else rng.randrange(2, 400), 1, rng.choice([A, B]), rng.choice(["reviewer", "big", "zzz", None]), rng.choice([*T, None]),
                     rng.choice([None, 5.0, round(rng.random(), 4)]), rng.choice([None, "-", "5-7-5", "free-form 3-line"]), rng.choice(["exact", "tbd", None])))
    trust = {"reviewer": 1, "big": 2}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    want = {}
    for g in groups.values():
        if len(g) < 2:
            continue
        for k, name, ok in ((6, "score", lambda v: v is not None and 0 <= v <= 1), (7, "form", lambda v: v in sv.FORMS), (8, "validation", lambda v: v == "exact")):
            usable = [r for r in g if ok(r[k])]
            if usable:
                best = min(usable, key=lambda r: (trust.get(r[4], 99), -(r[5].timestamp() if r[5] else -1e18), r[0]))
                want[min(r[0] for r in g), name] = best[0]
    assert found(spark, engines, rows) == want


def test_weighted_election_follows_the_many(spark, engines):
    rows = [(i, 1, 1, A, "zzz", T[0], None, "5-7-5", None) for i in range(2, 5)] + [(1, 1, 1, A, "zzz", T[2], None, "free-form 3-line", None)]
    assert found(spark, engines, rows, strict=False)[1, "form"] == 2 and found(spark, engines, rows)[1, "form"] == 1


def test_alignment_decides_where_no_value_has_the_majority(spark, engines):
    """No score is borne by two records; the consensus of the characters is the one in the middle."""
    scores = [0.71, 0.72, 0.42, 0.92, 0.12]
    rows = [(i + 1, 1, 1, A, "zzz", T[0], s, None, "exact") for i, s in enumerate(scores)]
    assert found(spark, engines, rows, strict=False) == {(1, "score"): 2, (1, "validation"): 1}
    base = sv.ranked(spark.createDataFrame(rows, SCHEMA), engines, ["score", "validation"])
    assert {r.field: r._settled for r in sv.votes(base, ["score", "validation"])[1].collect()} == {"score": False, "validation": True}


def test_majority_is_what_alignment_would_elect():
    rng = random.Random(8)
    for _ in range(200):
        values = list({"".join(rng.choice("0123") for _ in range(rng.randrange(1, 6))) for _ in range(4)})
        weights = [rng.random() for _ in values]
        weights[0] = sum(weights[1:]) + 0.01
        p = []
        for k in rng.sample(range(len(values)), len(values)):
            p = sv.align(p, sv.single(list(values[k]), (weights[k], (k, 0, k))))
        assert "".join(sv.consensus(p, strict=False)) == values[0]


def test_alignment():
    v = lambda w, r: (w, (r, 0, r))
    p = sv.align(sv.align(sv.single(list("0.982"), v(1, 3)), sv.single(list("0.92"), v(1, 2))), sv.single(list("0.982"), v(1, 1)))
    assert "".join(sv.consensus(p, strict=False)) == "0.982" and "".join(sv.consensus(p, strict=True)) == "0.982"
    q = sv.align(sv.single("the old pond".split(), v(1, 2)), sv.single("the pond again".split(), v(5, 1)))
    assert sv.consensus(q, strict=True) == "the pond again".split() == sv.consensus(q, strict=False)
    assert sv._unpack(sv._pack(p)) == p


@pytest.mark.parametrize("block", [sv.BLOCK, 2])
def test_every_group_goes_through_alignment_and_consensus(spark, engines, monkeypatch, block):
    """Under precedence too the record is the one the consensus falls on: with another election it is another."""
    rows = [
        (1, 1, 1, A, "zzz", T[0], 0.25, "free-form 3-line", "exact"),
        (2, 1, 1, B, "reviewer", T[0], 0.75, "5-7-5", "exact"),
        (3, 1, 1, A, "big", T[2], 0.5, None, "approximate (off by 2)"),
        (4, 2, 1, A, "big", T[2], 0.5, "5-7-5", "exact"),
    ]
    monkeypatch.setattr(sv, "BLOCK", block)
    assert found(spark, engines, rows) == {(1, "score"): 2, (1, "form"): 2, (1, "validation"): 2}
    monkeypatch.setattr(sv, "consensus", lambda profile, strict: [t for c in profile if (t := max(c, key=lambda t: (c[t][1], t))) != sv._GAP])
    assert found(spark, engines, rows) == {(1, "score"): 1, (1, "form"): 1, (1, "validation"): 3}


def test_large_groups_in_parts_as_in_one_go(spark, engines, monkeypatch):
    rng = random.Random(5)
    rows = [(i, 1 if i % 2 else i % 50, 1, rng.choice([A, B]), rng.choice(["reviewer", "big", None]), rng.choice(T), round(rng.random(), 3), rng.choice(sv.FORMS), "exact") for i in range(600)]
    whole = found(spark, engines, rows)
    monkeypatch.setattr(sv, "BLOCK", 20)
    assert found(spark, engines, rows) == whole and len(whole) == 3 * len({r[1] for r in rows})
