import numpy as np
import pytest

from quillspan.llm import mixing as mx

DOCS = "doc_id long, source string, text string, n_tokens string, shard int"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, ["Big", " big ", "BIG"][i % 3], f"the heron number {i} watched the marsh", "", 0) for i in range(3000)]
    rows += [(10_000 + i, "small", f"a small willow {i} of many", "", 0) for i in range(60)]
    rows += [(11_000 + i, "small", f"a small willow {i} of many", "", 0) for i in range(60)]  # the same texts again
    rows += [(20_000 + i, None, "no source", "", 0) for i in range(50)] + [(30_000 + i, "unlisted", "x", "", 0) for i in range(50)]
    rows += [(40_000, "mid", None, "", 0), (40_001, "mid", "", "", 0)] + [(40_010 + i, "mid", f"middle field {i} is cold", "", 0) for i in range(400)]
    t = [("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.1, 4), ("absent", 0.1, 2), (None, 0.2, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark, tables):
    docs, targets = tables
    mix = mx.mixed(docs, targets, shards=8).cache()
    r = {x.source: x for x in mx.report(docs, targets, mix).collect()}
    present = {"big": 5 / 9, "mid": 3 / 9, "small": 1 / 9}
    for s, want in present.items():
        assert abs(r[s].share_reached - want) < 0.01 and r[s].most_uses <= r[s].max_repeats
    assert r["absent"].share_reached == 0 and r["small"].most_uses == 4 and abs(sum(x.share_reached for x in r.values()) - 1) < 1e-9
    got = mix.toPandas()
    assert not got.duplicated(["source", "doc_id", "use"]).any() and set(got["source"]) == set(present)
    assert got[got["source"] == "small"]["doc_id"].max() < 11_000  # a repeated text goes by its smallest id
    counts = got.groupby("shard").size()
    assert len(counts) == 8 and counts.max() < 1.5 * counts.min()


def test_equal_input_gives_equal_output(spark, tables):
    docs, targets = tables
    a, b = (sorted(map(tuple, mx.mixed(d, targets, shards=4).collect())) for d in (docs, docs.repartition(7, "text")))
    assert a == b
    assert sorted(map(tuple, mx.mixed(docs, targets, shards=4, seed=1).collect())) != a


def test_given_total_caps_small_sources(spark, tables):
    docs, targets = tables
    mix = mx.mixed(docs, targets, total=40_000, shards=4)
    r = {x.source: x for x in mx.report(docs, targets, mix).collect()}
    assert r["small"].most_uses == 4 and r["small"].share_reached < 1 / 9 and r["big"].share_reached > 0.4


def test_tree_keeps_quotas():
    rng = np.random.default_rng(0)
    q = np.array([1000, 1, 0, 333])
    for shards in (1, 3, 8):
        t = mx.split_tree(q, shards, rng)
        assert t.shape == (shards, 4) and (t.sum(0) == q).all() and t.sum(1).max() - t.sum(1).min() <= 2


def test_empty(spark, tables):
    docs, targets = tables
    assert mx.mixed(docs.limit(0), targets).count() == 0 and mx.mixed(docs, targets.limit(0)).count() == 0


def test_registered_mix_leaves_no_text_out(spark, tables, tmp_path):
    from quillspan.llm import q_mixing

    docs, targets = tables
    one = spark.createDataFrame([(50_000, "absent", "one short text", "", 0)], DOCS)
    docs.unionByName(one).write.parquet(str(tmp_path / "documents.parquet"))
    targets.write.parquet(str(tmp_path / "mix_targets.parquet"))
    mix = q_mixing.QUERIES["p7_mixed"](spark, str(tmp_path)).cache()
    held = mx.texts(docs.unionByName(one), targets)
    assert held.join(mix, ["source", "doc_id"], "left_anti").count() == 0
    r = {x.source: x for x in q_mixing.QUERIES["p7_report"](spark, str(tmp_path)).collect()}
    assert r["big"].texts_used == 3000 and r["absent"].most_uses == 2 and r["absent"].share_reached < 0.1
    assert all(x.most_uses <= x.max_repeats for x in r.values() if x.most_uses)


def test_whole_mix_keeps_its_last_block():
    import pandas as pd

    rng = np.random.default_rng(3)
    sizes = pd.DataFrame([(s, b, int(rng.integers(1, 10**12))) for s in "abc" for b in range(50)], columns=["source", "block", "tokens"])
    for shares in ((0.1, 0.7, 0.2), (0.3, 0.3, 0.4), (1e-9, 0.5, 0.5)):
        t = pd.DataFrame({"source": list("abc"), "share": shares, "repeats": [1, 2, 3]})
        got = mx.plan(sizes, t, mx.WHOLE, 8, 1)
        assert len(got[["source", "block"]].drop_duplicates()) == 150 and not got.duplicated(["source", "block", "use"]).any()


def test_shards_follow_the_size_of_the_mix(spark, tables, monkeypatch):
    docs, targets = tables
    few, many = (mx.mixed(docs, targets, shard_tokens=n) for n in (1 << 22, 1000))
    assert few.select("shard").distinct().count() == 1 and many.select("shard").distinct().count() > 10
    monkeypatch.setattr(mx, "BROADCAST_DRAWS", 0)
    shuffled = mx.mixed(docs, targets, shard_tokens=1000)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, many.collect()))
