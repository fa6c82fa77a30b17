"""A ledger kept by replaying actions: a deterministic fold per game, and its rules in closed form.

The board, the deck and the amounts are parameters with the defaults of :data:`DEFAULT`; the fold knows no clock and no
chance: dice travel in the actions. Batch: actions of a game in serial order through ``applyInPandas`` (a game is one
group by nature; games are independent). Stream: the same reducer under ``applyInPandasWithState``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tile kinds by position: (kind, price, upgrade, rents).
TILES: list[tuple[str, int | None, int | None, list[int] | None]] = [
    ("GO", None, None, None),
    ("PROP", 60, 30, [6, 18, 54, 160, 250]),
    ("TAX", None, None, None),
    ("PROP", 60, 30, [6, 18, 54, 160, 250]),
    ("PROP", 80, 40, [8, 24, 72, 200, 320]),
    ("PROP", 100, 50, [10, 30, 90, 260, 400]),
    ("POT", None, None, None),
    ("PROP", 120, 60, [12, 36, 108, 300, 450]),
    ("PROP", 120, 60, [12, 36, 108, 300, 450]),
    ("EXCH", 150, None, None),
    ("AIRDROP", None, None, None),
    ("PROP", 140, 70, [14, 42, 126, 350, 560]),
    ("JAIL", None, None, None),
    ("PROP", 160, 80, [16, 48, 144, 400, 640]),
    ("PROP", 180, 90, [18, 54, 162, 450, 720]),
    ("EVENT", None, None, None),
    ("PROP", 180, 90, [18, 54, 162, 450, 720]),
    ("PROP", 200, 100, [22, 66, 198, 550, 880]),
    ("RUG", None, None, None),
    ("EXCH", 200, None, None),
    ("PROP", 220, 110, [24, 72, 216, 600, 960]),
    ("EVENT", None, None, None),
    ("EXCH", 200, None, None),
    ("PROP", 240, 120, [26, 78, 234, 650, 1040]),
]
#: Cards: (kind, value or target, from the pot, into the pot).
DECK: list[tuple[str, int, bool, bool]] = [
    ("cash", 200, True, False),
    ("cash", -100, False, True),
    ("cash", 150, False, False),
    ("jail", 0, False, False),
    ("cash", 80, False, False),
    ("cash", -120, False, True),
    ("move", 0, False, False),
    ("cash", 100, False, False),
]


@dataclass(frozen=True)
class Rules:
    """Fixed values as defaults."""

    tiles: list = field(default_factory=lambda: TILES)
    deck: list = field(default_factory=lambda: DECK)
    salary: int = 200
    pot: int = 200
    jail: int = 12
    jail_turns: int = 3
    bond: int = 50
    cash: int = 1500
    tax_percent: int = 10
    tax_floor: int = 40
    airdrop: int = 120
    exchange_rent: tuple = (25, 50, 100)
    log_size: int = 120


DEFAULT = Rules()


class Ledger:
    """The state of one game and what actions make of it. Invalid actions change nothing."""

    def __init__(self, rules: Rules = DEFAULT, state: dict | None = None) -> None:
        self.rules = rules
        self.s = state or {
            "players": {}, "order": [], "turn": 0, "own": {}, "pot": rules.pot, "over": False, "winner": None,
            "pending": None, "draws": 0, "again": False, "doubles": 0, "phase": "lobby", "log": [],
        }

    def note(self, text: str) -> None:
        self.s["log"] = [*self.s["log"], text][-self.rules.log_size :]

    def apply(self, a: dict) -> None:
        handler = {
            "ADD_PLAYER": self.join, "START": self.start, "ROLL": self.roll, "BUY": self.buy, "PASS_BUY": self.decline,
            "UPGRADE": self.upgrade, "END_TURN": self.end_turn, "RESET": self.reset,
        }.get(a.get("type"))
        if handler:
            handler(a)

    # players
    def join(self, a: dict) -> None:
        who = a.get("player")
        bad = not isinstance(who, str) or not 0 < len(who) <= 64 or who in ("__proto__", "constructor", "prototype")
        if self.s["phase"] != "lobby" or bad or who in self.s["players"] or len(self.s["order"]) >= 6:
            return
        self.s["players"][who] = {"cash": self.rules.cash, "pos": 0, "jailed": False, "left": 0, "alive": True}
        self.s["order"].append(who)
        self.note(f"{who} joined")

    def start(self, a: dict) -> None:
        if self.s["phase"] == "lobby" and sum(p["alive"] for p in self.s["players"].values()) >= 2:
            self.s["phase"] = "play"

    def reset(self, a: dict) -> None:
        self.__init__(self.rules)

    def _mover(self, a: dict) -> dict | None:
        p = self.s["players"].get(a.get("player"))
        turn = self.s["order"][self.s["turn"]] if self.s["order"] else None
        return p if p and p["alive"] and turn == a["player"] and not self.s["pending"] and not self.s["over"] else None

    # a roll and where it leads
    def roll(self, a: dict) -> None:
        p = self._mover(a)
        if p is None:
            return
        one, two = a.get("dice") or (1, 1)
        double = one == two
        self.s["again"], self.s["phase"] = False, "play"
        if p["jailed"]:
            if double:
                p["jailed"], p["left"], self.s["doubles"] = False, 0, 0
            elif p["left"] > 0:
                p["left"] -= 1
                if p["left"]:
                    return
                p["jailed"] = False
                self._to_pot(p, self.rules.bond)
        self.s["doubles"] = self.s["doubles"] + 1 if double else 0
        if self.s["doubles"] >= 3:
            self._jail(p)
            return
        size = len(self.rules.tiles)
        reached = p["pos"] + one + two
        p["pos"] = reached % size
        if reached >= size:
            p["cash"] += self.rules.salary
        self._land(a["player"], p)
        self.s["again"] = double and not self.s["pending"] and not self.s["over"]

    def _land(self, who: str, p: dict) -> None:
        kind, price, _, _ = self.rules.tiles[p["pos"]]
        if kind in ("PROP", "EXCH"):
            held = self.s["own"].get(str(p["pos"]))
            if held is None:
                if p["cash"] >= price:
                    self.s["pending"] = {"pos": p["pos"], "player": who}
            elif held["owner"] != who:
                due = self.rent(p["pos"], held)
                paid = min(p["cash"], due)
                p["cash"] -= paid
                self.s["players"][held["owner"]]["cash"] += paid
                if p["cash"] <= 0 < due:
                    self._bankrupt(who)
        elif kind == "TAX":
            due = max(self.rules.tax_floor, p["cash"] * self.rules.tax_percent // 100)
            self._to_pot(p, max(0, min(due, p["cash"])))
            self._broke(who)
        elif kind == "AIRDROP":
            p["cash"] += self.rules.airdrop
        elif kind == "POT":
            p["cash"], self.s["pot"] = p["cash"] + self.s["pot"], 0
        elif kind == "RUG":
            self._jail(p)
        elif kind == "EVENT":
            card = self.rules.deck[self.s["draws"] % len(self.rules.deck)]
            self.s["draws"] += 1
            self._card(who, p, *card)

    def _card(self, who: str, p: dict, kind: str, value: int, from_pot: bool, to_pot: bool) -> None:
        if kind == "jail":
            self._jail(p)
        elif kind == "move":
            p["cash"] += self.rules.salary if value < p["pos"] else 0
            p["pos"] = value % len(self.rules.tiles)
        else:
            if value > 0 and from_pot:
                value = min(value, self.s["pot"])
                self.s["pot"] -= value
            p["cash"] += value
            self.s["pot"] += -value if value < 0 and to_pot else 0
            self._broke(who)

    def rent(self, pos: int, held: dict) -> int:
        kind, _, _, rents = self.rules.tiles[pos]
        if kind == "EXCH":
            n = sum(h["owner"] == held["owner"] and self.rules.tiles[int(k)][0] == "EXCH" for k, h in self.s["own"].items())
            return self.rules.exchange_rent[min(max(n, 1), len(self.rules.exchange_rent)) - 1]
        return rents[held["level"]] if held["level"] < len(rents) else rents[0]

    def _to_pot(self, p: dict, amount: int) -> None:
        p["cash"] -= amount
        self.s["pot"] += amount

    def _jail(self, p: dict) -> None:
        p["pos"], p["jailed"], p["left"], self.s["doubles"] = self.rules.jail, True, self.rules.jail_turns, 0

    def _broke(self, who: str) -> None:
        if self.s["players"][who]["cash"] <= 0:
            self._bankrupt(who)

    def _bankrupt(self, who: str) -> None:
        self.s["players"][who] |= {"alive": False, "cash": 0}
        self.s["own"] = {k: h for k, h in self.s["own"].items() if h["owner"] != who}
        self.note(f"{who} went bankrupt")
        self._finish()

    def _finish(self) -> None:
        left = [w for w in self.s["order"] if self.s["players"][w]["alive"]]
        if len(left) <= 1:
            self.s["over"], self.s["winner"] = True, left[0] if left else None

    # what a player may do besides
    def _offer(self, a: dict) -> dict | None:
        o = self.s["pending"]
        return o if o and o["player"] == a.get("player") else None

    def buy(self, a: dict) -> None:
        if o := self._offer(a):
            p, price = self.s["players"][o["player"]], self.rules.tiles[o["pos"]][1]
            self.s["pending"] = None
            if p["cash"] >= price:
                p["cash"] -= price
                self.s["own"][str(o["pos"])] = {"owner": o["player"], "level": 0}

    def decline(self, a: dict) -> None:
        if self._offer(a):
            self.s["pending"] = None

    def upgrade(self, a: dict) -> None:
        p, at = self.s["players"].get(a.get("player")), a.get("tile")
        if not p or not p["alive"] or self.s["pending"] or not isinstance(at, int) or not 0 <= at < len(self.rules.tiles):
            return
        held, (kind, _, cost, _) = self.s["own"].get(str(at)), self.rules.tiles[at]
        if held and held["owner"] == a["player"] and kind == "PROP" and held["level"] < 4 and p["cash"] >= cost:
            p["cash"] -= cost
            held["level"] += 1

    def end_turn(self, a: dict) -> None:
        if self._mover(a) is None:
            return
        self.s["again"] = False
        n = len(self.s["order"])
        for k in range(1, n + 1):
            i = (self.s["turn"] + k) % n
            if self.s["players"][self.s["order"][i]]["alive"]:
                break
        self.s["turn"] = i
        self._finish()


_STATE = "game_id string, actions int, pot long, over boolean, winner string, state string"


def _actions(f: pd.DataFrame) -> Iterable[dict]:
    for r in f.itertuples(index=False):
        dice = None if r.dice is None else tuple(int(x) for x in r.dice)
        yield {"type": r.type, "player": r.player, "dice": dice, "tile": None if pd.isna(r.tile) else int(r.tile)}


def replayed(actions: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Final state of each game. ``actions``: game_id, serial, type, player, seq, dice, tile. Echoes (a player's equal
    seq) count once; unknown seqs always count."""
    echo = F.when(F.col("seq").isNotNull(), F.concat_ws("#", "player", "seq")).otherwise(F.concat_ws("#", F.lit("?"), "serial"))
    once = actions.withColumn("_echo", echo)
    kept = once.groupBy("game_id", "_echo").agg(F.min(F.struct("serial", "type", "player", "dice", "tile")).alias("_a"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("serial")
        game = Ledger(rules)
        for a in _actions(f):
            game.apply(a)
        s = game.s
        row = (f["game_id"].iloc[0], len(f), s["pot"], s["over"], s["winner"], json.dumps(s, sort_keys=True))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _STATE.split(", ")])

    return kept.select("game_id", "_a.*").groupBy("game_id").applyInPandas(fold, _STATE)


# ---- rules in closed form ----------------------------------------------------------------------------------------------


def tax(cash: Column, rules: Rules = DEFAULT) -> Column:
    """A tenth, at least the floor, at most what there is, never negative."""
    due = F.greatest(F.lit(rules.tax_floor), F.floor(cash * rules.tax_percent / 100))
    return F.greatest(F.lit(0), F.least(due, cash))


def wrapped(pos: Column, roll: Column, rules: Rules = DEFAULT) -> Column:
    """struct(pos, salary) after a roll."""
    size = len(rules.tiles)
    return F.struct(F.pmod(pos + roll, F.lit(size)).alias("pos"), F.when(pos + roll >= size, rules.salary).otherwise(0).alias("salary"))


def pot_payout(pot: Column, amount: int) -> Column:
    return F.least(pot, F.lit(amount))


def tile_at(index: Column, rules: Rules = DEFAULT) -> Column:
    """The kind of a tile by any index, negative ones counted from the end."""
    return F.element_at(F.array(*[F.lit(t[0]) for t in rules.tiles]), F.pmod(index, F.lit(len(rules.tiles))).cast("int") + 1)


def tiles(spark, rules: Rules = DEFAULT) -> DataFrame:
    rows = [(i, k, p, u, r) for i, (k, p, u, r) in enumerate(rules.tiles)]
    return spark.createDataFrame(rows, "i int, kind string, price int, up int, rent array<int>")


def tiered_rent(owned: Column, rules: Rules = DEFAULT) -> Column:
    tiers = rules.exchange_rent
    return F.element_at(F.array(*[F.lit(t) for t in tiers]), F.least(F.greatest(owned, F.lit(1)), F.lit(len(tiers))).cast("int"))


def next_alive(alive: Column, at: Column) -> Column:
    """Whose turn comes after seat ``at``: the next one alive in circular order, itself where no other is."""
    n = F.size(alive)
    seats = F.transform(F.sequence(F.lit(1), n), lambda k: F.pmod(at + k, n).cast("int"))
    return F.coalesce(F.get(F.filter(seats, lambda i: F.get(alive, i)), F.lit(0)), at.cast("int"))


def last_alive(players: DataFrame, game: str, player: str, alive: Column) -> DataFrame:
    """(game, alive, winner): how many are left, and who where it is one."""
    left = F.count_if(alive)
    return players.groupBy(game).agg(left.alias("alive"), F.when(left == 1, F.min(F.when(alive, F.col(player)))).alias("winner"))
