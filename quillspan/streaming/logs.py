"""Streaming forms of the event operators. Each is checked against its batch form on the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.operators.ledger import DEFAULT, Ledger, Rules


def deduplicated(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Echoes once within the time that late events may take; the state is bounded by that time."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def gap_state(events: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, missing, rejected) per event: the last accepted number of each key is the state.

    An event whose number does not exceed it is rejected and changes nothing; otherwise what lies between is missing.
    """
    out = f"{key} long, {seq} long, missing long, rejected boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for f in frames:
            for v in sorted(f[seq].tolist()):
                bad = last is not None and v <= last
                rows.append((k[0], v, 0 if bad or last is None else v - last - 1, bad))
                last = last if bad else v
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, seq, "missing", "rejected"])

    return events.groupBy(key).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.NoTimeout)


def ring_state(events: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, newest array<long>): the last ``k`` numbers of each key after each batch; the state holds k of them."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for f in frames:
            kept = sorted([*kept, *f[seq].tolist()], reverse=True)[:k]
        state.update((kept,))
        yield pd.DataFrame({key: [name[0]], "newest": [kept]})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} long, newest array<long>", "kept array<long>", "update", GroupStateTimeout.NoTimeout
    )


def ledger_state(actions: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(game_id, actions, pot, over, winner) of each game after each batch: the batch fold's reducer over kept state.

    Actions of a batch are taken in serial order; batches must come in order, as an event log gives them.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else (None, 0)
        game = Ledger(rules, json.loads(text) if text else None)
        for f in [pd.concat(list(frames)).sort_values("serial")]:
            for r in f.itertuples(index=False):
                dice = None if r.dice is None else tuple(int(x) for x in r.dice)
                game.apply({"type": r.type, "player": r.player, "dice": dice, "tile": None if pd.isna(r.tile) else int(r.tile)})
                n += 1
        state.update((json.dumps(game.s), n))
        s = game.s
        yield pd.DataFrame([(name[0], n, s["pot"], s["over"], s["winner"])], columns=["game_id", "actions", "pot", "over", "winner"])

    return actions.groupBy("game_id").applyInPandasWithState(
        step, "game_id string, actions long, pot long, over boolean, winner string", "state string, n long", "update", GroupStateTimeout.NoTimeout
    )


def fan_out(stream: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One listener, many subscribers: every batch goes to each, in order."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for s in subscribers:
            s(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, ts: str, by: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Native extra: counts in event-time windows; later events than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), by).agg(F.count(F.lit(1)).alias("n"))
