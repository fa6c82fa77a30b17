import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import catalog as cg
from quillspan.operators import events as ev
from quillspan.operators import ledger as lg
from quillspan.operators import reconcile as rc


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_catalogue(spark):
    a = spark.createDataFrame([("h1", "x", 3), ("h1", "y", 3), ("h2", "z", 0)], "sha256 string, path string, bytes long")
    b = spark.createDataFrame([("h1", "q", 3), ("h1", "p", 3), ("h2", "e", 0)], "sha256 string, path string, bytes long")
    assert rows(cg.twins(a, b), "path", "held_as") == [("x", "p"), ("y", "p")]
    assert rows(cg.without_twin(a, b), "path") == [("z",)]
    assert tuple(cg.summary(a).first()) == (3, 6, 2, 1)
    assert rows(cg.redundancy(a, ident="path"), "sha256", "copies", "first_id") == [("h1", 2, "x")]
    d = cg.drift(a.where("path != 'z'"), b.withColumn("path", F.when(F.col("path") == "q", "x").otherwise(F.col("path"))), ["path"], ["sha256"])
    assert rows(d, "path", "status") == [("e", "MISSING"), ("p", "MISSING"), ("x", "OK"), ("y", "GONE")]


def test_merge_keeps_provenance(spark):
    a = spark.createDataFrame([(["1", "2"], 0.5), (["3"], 0.7)], "k array<string>, score double")
    b = spark.createDataFrame([(["1", "2"], 0.9), (["4"], 0.1), (["4"], 0.2)], "k array<string>, score double")
    m = rc.merged(a, b, ["k"], ("rules", "model"))
    got = {tuple(r.k): (r.score, r.model_score, r.found_by) for r in m.collect()}
    assert got == {("1", "2"): (0.5, 0.9, ["rules", "model"]), ("3",): (0.7, None, ["rules"]), ("4",): (0.2, 0.2, ["model"])}


def test_verdicts(spark):
    v = rc.verdict([("error", "neg", F.col("x") < 0), ("warning", "odd", F.col("x") % 2 == 1), ("info", "any", F.col("x").isNotNull())])
    df = spark.createDataFrame([(-1,), (3,), (2,), (None,)], "x int").select("x", v.alias("v")).select("x", "v.*")
    got = {r.x: (r.verdict, r.errors, r.warnings, r.infos) for r in df.collect()}
    assert got == {-1: ("FAIL", ["neg"], [], ["any"]), 3: ("WARN", [], ["odd"], ["any"]), 2: ("OK", [], [], ["any"]), None: ("OK", [], [], [])}
    assert tuple(rc.rollup(df).first()) == (4, 1, 1, 3)


def test_gaps_and_monotone(spark):
    e = spark.createDataFrame([(1, 1, 3), (1, 2, 7), (1, 3, 7), (1, 4, 5), (1, 5, 8), (2, 1, 4)], "k long, at long, seq long")
    assert rows(ev.gaps(e.where("at in (1, 2)"), "k", "seq"), "k", "seq", "missing") == [(1, 3, 0), (1, 7, 3), (2, 4, 0)]
    assert rows(ev.monotone(e, "k", ["at"], "seq"), "k", "at", "rejected") == [
        (1, 1, False), (1, 2, False), (1, 3, True), (1, 4, True), (1, 5, False), (2, 1, False)]


def test_blocks_do_not_change_running_figures(spark, monkeypatch):
    rng = random.Random(8)
    e = [(rng.choice([1, 1, 1, 2, 3]), i // 3, rng.randrange(500), rng.choice([None, 1.5, 2.0])) for i in range(600)]
    df = spark.createDataFrame(e, "k int, at int, seq int, v double").dropDuplicates(["k", "at", "seq"]).withColumn("_n", F.lit("clash"))
    got = []
    for n in (1, 7, 64):
        monkeypatch.setattr(ev.blocked, "__defaults__", (n,))
        got.append([
            rows(ev.gaps(df.dropDuplicates(["k", "seq"]).select("k", "seq"), "k", "seq"), "k", "seq", "missing"),
            rows(ev.monotone(df, "k", ["at", "seq"], "seq"), "k", "at", "seq", "rejected"),
            rows(ev.running(df.drop("_n").fillna(0), "k", ["at", "seq"], "v"), "k", "at", "seq", "run_n", "run_sum"),
        ])
    assert got[0] == got[1] == got[2]


@pytest.mark.parametrize(
    "change,error",
    [
        ({}, None),
        ({"protocol": "x"}, "unsupported"),
        ({"type": "hello"}, "unsupported"),
        ({"seq": -1}, "seq"),
        ({"seq": None}, "seq"),
        ({"sample_rate_hz": 31.0}, "sample_rate"),
        ({"sample_rate_hz": float("nan")}, "sample_rate"),
        ({"channel": "too long a label for a channel"}, "channel"),
        ({"samples_uv": []}, "samples"),
        ({"samples_uv": [1.0, float("inf")]}, "samples"),
        ({"samples_uv": [0.0] * 1025}, "samples"),
        ({"sent_at_unix_ms": -1.0}, "sent_at"),
    ],
)
def test_frames(spark, change, error):
    good = {"protocol": "sig/1", "type": "frame", "seq": 1, "sample_rate_hz": 256.0, "channel": "CH-1", "samples_uv": [1.0], "sent_at_unix_ms": None}
    schema = "protocol string, type string, seq long, sample_rate_hz double, channel string, samples_uv array<double>, sent_at_unix_ms double"
    got = spark.createDataFrame([tuple((good | change).values())], schema).select(ev.frame_error("sig/1")).first()[0]
    assert got is None if error is None else got.startswith(error)


def test_traces(spark):
    def codes(*marks):
        df = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(marks)], "trace int, pos int, stage string, ts long")
        return [r.code for r in ev.mark_codes(df).orderBy("pos").collect()]

    assert codes(("drdy", 1000), ("spi_done", 1075), ("process", 1180), ("event", 1220), ("observer", 1260)) == ["OK"] * 5
    assert codes(("spi_done", 5), ("drdy", 100), ("drdy", 101), ("spi_done", 99), ("spi_done", 100), ("x", 1)) == [
        "STAGE_ORDER", "OK", "DUPLICATE_STAGE", "TIME_ORDER", "OK", "ARGUMENT"]
    df = spark.createDataFrame([(1000, 1220), (1000, None), (5, 4)], "a long, b long")
    assert [tuple(r[0]) for r in df.select(ev.stage_delta(F.col("a"), F.col("b"))).collect()] == [("OK", 220), ("MISSING_STAGE", None), ("TIME_ORDER", None)]


def test_record_budgets_against_brute_force(spark):
    rng = random.Random(5)
    recs = [(s, i, rng.randrange(1, 30)) for s in (1, 2) for i in range(1, 60)]
    files = [(s, i, rng.randrange(20, 200)) for s in (1, 2) for i in range(1, 12)]
    got = {(r.s, r.pos): r.file_no for r in ev.record_owner(
        spark.createDataFrame(recs, "s int, pos int, size int"), spark.createDataFrame(files, "s int, file_no int, budget int"), "s").collect()}
    for s in (1, 2):
        at, bounds = 0, []
        for _, i, b in [f for f in files if f[0] == s]:
            bounds.append((at, i))
            at += b
        at = 0
        for _, i, z in [r for r in recs if r[0] == s]:
            assert got[s, i] == max(b for b in bounds if b[0] <= at)[1]
            at += z


# ---- ledger -------------------------------------------------------------------------------------------------------------


def game(*players, **state):
    g = lg.Ledger()
    for p in players:
        g.apply({"type": "ADD_PLAYER", "player": p})
    g.apply({"type": "START"})
    g.s |= state
    return g


def roll(g, who, *dice):
    g.apply({"type": "ROLL", "player": who, "dice": dice})


def test_purchase_and_rent():
    g = game("a", "b")
    roll(g, "a", 1, 3)
    assert g.s["pending"] == {"pos": 4, "player": "a"}
    g.apply({"type": "BUY", "player": "b"})
    g.apply({"type": "BUY", "player": "a"})
    assert g.s["players"]["a"]["cash"] == 1420 and g.s["own"] == {"4": {"owner": "a", "level": 0}}
    g.apply({"type": "UPGRADE", "player": "a", "tile": 4})
    g.apply({"type": "UPGRADE", "player": "a", "tile": "__proto__"})
    assert g.s["own"]["4"]["level"] == 1 and g.s["players"]["a"]["cash"] == 1380
    g.apply({"type": "END_TURN", "player": "a"})
    roll(g, "b", 1, 3)
    assert g.s["players"]["b"]["cash"] == 1500 - 24 and g.s["players"]["a"]["cash"] == 1380 + 24


@pytest.mark.parametrize("cash", [0, 5, 10, 39, 40, 41, 500, 1500])
def test_tax_is_never_more_than_there_is(spark, cash):
    g = game("a", "b", "c")
    g.s["players"]["a"]["cash"] = cash
    roll(g, "a", 1, 1)
    p = g.s["players"]["a"]
    tax = spark.createDataFrame([(cash,)], "c long").select(lg.tax(F.col("c"))).first()[0]
    assert p["cash"] == cash - tax >= 0 and g.s["pot"] == 200 + tax and p["alive"] is (cash > tax)


def test_pot_card_is_capped():
    g = game("a", "b", pot=30)
    g._card("a", g.s["players"]["a"], *lg.DECK[0])
    assert g.s["players"]["a"]["cash"] == 1530 and g.s["pot"] == 0


def test_three_doubles_jail_and_bond():
    g = game("a", "b")
    g.s["players"]["a"]["pos"] = 11
    for _ in range(3):
        g.s["pending"] = None
        roll(g, "a", 3, 3)
    p = g.s["players"]["a"]
    assert p["jailed"] and p["pos"] == 12
    for _ in range(3):
        g.s["pending"] = None
        roll(g, "a", 1, 2)
    assert not g.s["players"]["a"]["jailed"]


def actions(seed, n=400):
    rng = random.Random(seed)
    out = [(f"g{seed}", i, "ADD_PLAYER", p, None, None, None) for i, p in enumerate("abcd")] + [(f"g{seed}", 4, "START", "a", None, None, None)]
    turn = 0
    for i in range(n):
        who = "abcd"[turn % 4]
        kind = rng.choice(["ROLL", "BUY", "END_TURN", "UPGRADE", "PASS_BUY", "NONSENSE"])
        turn += kind == "END_TURN"
        out.append((f"g{seed}", 5 + i, kind, who, 1000 + i, [rng.randrange(1, 7), rng.randrange(1, 7)], rng.randrange(-2, 26)))
    return out


SCHEMA = "game_id string, serial long, type string, player string, seq long, dice array<int>, tile int"


def test_replay_is_deterministic_and_drops_echoes(spark):
    acts = [a for s in range(4) for a in actions(s)]
    once = spark.createDataFrame(acts, SCHEMA)
    twice = spark.createDataFrame(acts + [(g, s + 10_000, *rest) for g, s, *rest in acts if rest[2] is not None], SCHEMA)
    a = {r.game_id: r.state for r in lg.replayed(once).collect()}
    b = {r.game_id: r.state for r in lg.replayed(twice.orderBy(F.rand(3))).collect()}
    assert a == b and len(a) == 4
    for s in range(4):
        g = lg.Ledger()
        for _, _, kind, who, _, dice, tile in actions(s):
            g.apply({"type": kind, "player": who, "dice": dice, "tile": tile})
            assert all(p["cash"] >= -50 for p in g.s["players"].values()) and g.s["pot"] >= 0


def test_log_is_a_ring():
    g = lg.Ledger()
    for i in range(200):
        g.note(str(i))
    assert len(g.s["log"]) == 120 and g.s["log"][-1] == "199"


def test_running(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, t, 2.0), (1, t + dt.timedelta(1), None), (1, t + dt.timedelta(2), 4.0)], "k int, ts timestamp, v double")
    assert rows(ev.running(e, "k", ["ts"], "v"), "run_n", "run_avg") == [(1, 2.0), (1, 2.0), (2, 3.0)]
    assert rows(ev.ring(e, "k", [F.desc("ts")], 2), "age") == [(1,), (2,)]


def test_turns_and_last_players(spark):
    from quillspan.operators import ledger as lg

    rows = [([True, False, True], 0, 2), ([True, False, True], 2, 0), ([False, True], 1, 1), ([False, False], 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, alive array<boolean>, at int, want int")
    assert all(r.got == r.want for r in df.withColumn("got", lg.next_alive(F.col("alive"), F.col("at"))).collect())
    p = spark.createDataFrame([("g", "a", True), ("g", "b", False), ("h", "a", True), ("h", "b", True), ("i", "a", None)], "game string, player string, alive boolean")
    got = {r.game: (r.alive, r.winner) for r in lg.last_alive(p, "game", "player", F.col("alive")).collect()}
    assert got == {"g": (1, "a"), "h": (2, None), "i": (0, None)}


def test_streaks(spark):
    hits = [True, True, False, None, True, True, True, False]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(hits)] + [("l", 3, True)], "key string, at int, hit boolean")
    got = {(r.key, r["at"]): r.streak for r in ev.streaks(df, "key", ["at"], F.col("hit")).collect()}
    assert [got["k", i] for i in range(8)] == [1, 2, 0, 0, 1, 2, 3, 0] and got["l", 3] == 1
    assert ev.streaks(df.limit(0), "key", ["at"], F.col("hit")).count() == 0
