"""Ledger queries: rules in closed form, and games replayed from orders."""

from pyspark.sql import functions as F

from quillspan.operators import ledger as lg
from quillspan.session import table


def actions(s, d):
    """A game for each nation: its customers join (six at most do), the first starts, and orders are rolls and answers."""
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("game_id"))
    none = F.lit(None)
    seat = F.struct("c_custkey")
    first = c.groupBy("game_id").agg(F.slice(F.array_sort(F.collect_set(seat)), 1, 6).alias("seats"))
    joins = first.select("game_id", F.posexplode("seats").alias("i", "seat")).select(
        "game_id", (F.col("i") - 10).cast("long").alias("serial"), F.lit("ADD_PLAYER").alias("type"),
        F.col("seat.c_custkey").cast("string").alias("player"), none.cast("long").alias("seq"),
        none.cast("array<int>").alias("dice"), none.cast("int").alias("tile"),
    )
    start = joins.where("serial = -10").withColumn("serial", F.lit(-1).cast("long")).withColumn("type", F.lit("START"))
    o = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(first, "game_id")
    turn = F.row_number().over(_in_game()) - 1
    # whoever's order it is, the seats take turns: roll, answer the offer, end the turn
    o = o.withColumn("k", turn).withColumn("player", F.element_at("seats", (F.floor(F.col("k") / 3) % F.size("seats")).cast("int") + 1)["c_custkey"].cast("string"))
    play = o.select(
        "game_id",
        F.col("k").cast("long").alias("serial"),
        F.element_at(F.array(F.lit("ROLL"), F.lit("BUY"), F.lit("END_TURN")), (F.col("k") % 3).cast("int") + 1).alias("type"),
        "player",
        F.col("o_orderkey").alias("seq"),
        F.array((F.col("o_orderkey") % 6 + 1).cast("int"), (F.floor(F.col("o_totalprice")) % 6 + 1).cast("int")).alias("dice"),
        none.cast("int").alias("tile"),
    )
    return joins.unionByName(start).unionByName(play)


def _in_game():
    from pyspark.sql import Window

    return Window.partitionBy("game_id").orderBy("o_orderkey")


def _tiles(s, d):
    kind = lg.tile_at(F.col("p_size") - 30)
    return table(s, d, "part").select("p_partkey", kind.alias("kind"))


def _rents(s, d):
    """Suppliers as exchanges: how many a nation holds decides its tier."""
    owned = table(s, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("owned"))
    return owned.select("s_nationkey", "owned", lg.tiered_rent(F.col("owned")).alias("rent"))


QUERIES = {
    "ledger_tax": lambda s, d: table(s, d, "customer").select("c_custkey", lg.tax(F.floor("c_acctbal").cast("long")).cast("long").alias("tax")),
    "ledger_wrap": lambda s, d: table(s, d, "part").select("p_partkey", lg.wrapped(F.col("p_size") % 24, F.lit(7)).alias("w")).select("p_partkey", "w.pos", "w.salary"),
    "ledger_payout": lambda s, d: table(s, d, "part").select("p_partkey", lg.pot_payout(F.col("p_size") * 10, 200).alias("paid")),
    "tile_lookup": _tiles,
    "tier_rent": _rents,
    "ledger_replay": lambda s, d: lg.replayed(actions(s, d)).select("game_id", "actions", "pot", "over", "winner"),
}

ORACLE = {
    "ledger_tax": """select c_custkey, cast(greatest(0, least(greatest(40, floor(floor(c_acctbal) * 10 / 100)), floor(c_acctbal))) as bigint) tax from customer""",
    "ledger_wrap": "select p_partkey, (p_size % 24 + 7) % 24 pos, case when p_size % 24 + 7 >= 24 then 200 else 0 end salary from part",
    "ledger_payout": "select p_partkey, least(p_size * 10, 200) paid from part",
    "tile_lookup": """select p_partkey, ['GO','PROP','TAX','PROP','PROP','PROP','POT','PROP','PROP','EXCH','AIRDROP','PROP','JAIL','PROP','PROP','EVENT','PROP','PROP','RUG','EXCH','PROP','EVENT','EXCH','PROP'][((p_size - 30) % 24 + 24) % 24 + 1] kind from part""",
    "tier_rent": "select s_nationkey, count(*) owned, [25, 50, 100][cast(least(greatest(count(*), 1), 3) as int)] rent from supplier group by 1",
}
