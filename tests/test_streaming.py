import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspan.operators import events as ev
from quillspan.operators import ledger as lg
from quillspan.streaming import logs
from tests.test_operators import SCHEMA, actions

EVENTS = "k long, seq long, ts timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches as files and streams them one file a trigger."""

    def make(batches, schema):
        src = tmp_path / "src"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[str(src)])

    return make


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def rows(*pairs):
    t = dt.datetime(2024, 1, 1)
    return [(k, s, t + dt.timedelta(seconds=s)) for k, s in pairs]


def test_gaps_stream_as_in_batch(spark, feed):
    batches = [rows((1, 3), (2, 1)), rows((1, 7), (2, 2)), rows((1, 6), (1, 8), (2, 9))]
    got = sorted(tuple(r) for r in drained(spark, logs.gap_state(feed(batches, EVENTS), "k", "seq"), "gaps", "append"))
    assert got == [(1, 3, 0, False), (1, 6, 0, True), (1, 7, 3, False), (1, 8, 0, False), (2, 1, 0, False), (2, 2, 0, False), (2, 9, 6, False)]
    every = spark.createDataFrame([(*r, i) for i, b in enumerate(batches) for r in b], EVENTS + ", at int")
    batch = ev.monotone(every, "k", ["at", "seq"], "seq")
    assert sorted((r.k, r.seq, r.rejected) for r in batch.collect()) == [(k, s, bad) for k, s, _, bad in got]


def test_echoes(spark, feed):
    batches = [rows((1, 1), (1, 2)), rows((1, 2), (1, 3)), rows((1, 1))]
    got = drained(spark, logs.deduplicated(feed(batches, EVENTS), ["k", "seq"], "ts"), "echoes", "append")
    assert sorted((r.k, r.seq) for r in got) == [(1, 1), (1, 2), (1, 3)]


def test_ring(spark, feed):
    batches = [rows((1, 1), (1, 2), (1, 3)), rows((1, 4))]
    got = drained(spark, logs.ring_state(feed(batches, EVENTS), "k", "seq", 2), "ring", "update")
    assert sorted(r.newest for r in got)[-1] == [4, 3]


def test_ledger_stream_reaches_the_state_of_the_batch(spark, feed):
    acts = actions(1, 120)
    got = drained(spark, logs.ledger_state(feed([acts[:40], acts[40:90], acts[90:]], SCHEMA)), "ledger", "update")
    last = max(got, key=lambda r: r.actions)
    want = lg.replayed(spark.createDataFrame(acts, SCHEMA)).first()
    assert (last.actions, last.pot, last.over, last.winner) == (want.actions, want.pot, want.over, want.winner)


def test_fan_out(spark, feed, tmp_path):
    seen = [[], []]
    q = logs.fan_out(
        feed([rows((1, 1)), rows((1, 2))], EVENTS),
        [lambda b, e: seen[0].append(b.count()), lambda b, e: seen[1].append(b.agg(F.max("seq")).first()[0])],
        str(tmp_path / "cp"),
    )
    q.processAllAvailable()
    q.stop()
    assert sum(seen[0]) == 2 and max(seen[1]) == 2


def test_updates_are_replayed_from_any_serial(spark, tmp_path):
    from quillspan.sources.updates import updates

    log = tmp_path / "log"
    log.write_text("".join(f"{i}\tu{i}\n" for i in range(1, 6)))
    path = str(log)

    def fetch(after):
        rows = [line.rstrip("\n").split("\t") for line in open(path)]
        return [(int(a), b) for a, b in rows if int(a) > after]

    def read(after, stop):
        q = updates(spark, f"updates{after}", fetch, after).writeStream.format("memory").queryName(f"u{after}").start()
        q.processAllAvailable()
        with open(path, "a") as f:
            f.write(stop)
        q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(f"u{after}").orderBy("serial").collect()]

    assert read(0, "6\tu6\n") == [(i, f"u{i}") for i in range(1, 7)]
    assert read(4, "7\tu7\n") == [(i, f"u{i}") for i in range(5, 8)]
