"""Filling containers of fixed capacity with whole texts.

Method: a linear grouping scheme. Sizes above a quarter of the capacity are large. Their histogram is cut into groups of
equal cardinality and every size rounded up to the largest of its group, which leaves a few sizes; how many containers to
fill by which configuration of these sizes is a linear program, solved by column generation (pricing is a knapsack over
the capacity). Rounded-down counts of configurations become containers, the rest is filled first-fit. Then actual texts
take the slots of their group, and the small texts go best-fit, largest first, into the room that remains.

Scale. The driver sees a histogram of sizes (at most the capacity's rows for each container) and works out slots by
arithmetic; which text takes which slot is its rank in its group, from counts of hash buckets and a numbering within a
bucket. The small texts and the remaining rooms are spread over shards of about ``shard_rows`` rows by hash, and each
shard is filled for itself: no group of rows grows with the data, equal texts and hot sources included.

Defined results
---------------
* A text larger than the capacity, and only such, is split: full pieces in containers of their own, the rest as a text of
  its size. Texts without tokens (null, empty) take no room and have no row. Repeated texts are packed each by its id.
* Containers without positive capacity are skipped; containers of equal name are kept apart by capacity.
* Every piece has exactly one row; the pieces of a container never exceed its capacity. Equal input gives equal output.
* Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tokens import VOCABULARY, counted
from quillspan.session import cut, spread

LARGE = 4  # a text above capacity / LARGE is large
UNITS = 512  # sizes are rounded up to capacity / UNITS for pricing
GROUPS = 96


def linear_groups(sizes: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Upper ends of the groups: sizes ascending, cut so that each group holds about as many texts."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    total = np.cumsum(counts)
    ends = sizes[np.searchsorted(total, np.linspace(total[-1] / groups, total[-1], groups) - 1e-6)]
    return np.unique(np.append(ends, sizes[-1]))


def price(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """The configuration of most value that fits: an unbounded knapsack over whole units, one more text a round.

    Large texts are more than a quarter of the room, so that there are three rounds at most.
    """
    out = np.zeros(len(size), dtype=np.int64)
    use = np.flatnonzero((value > 1e-12) & (size <= room))
    if not len(use):
        return out
    s, v = size[use], value[use]
    left = np.arange(room + 1)[None, :] - s[:, None]
    fits, left = left >= 0, np.maximum(left, 0)
    best, took = np.zeros(room + 1), []
    for _ in range(room // int(s.min())):
        got = np.where(fits, best[left] + v[:, None], -1.0)
        k = got.argmax(0)
        most = got[k, np.arange(room + 1)]
        more = most > best + 1e-12
        if not more.any():
            break
        took.append(np.where(more, k, -1))
        best = np.where(more, most, best)
    c = room
    for k in reversed(took):
        if k[c] >= 0:
            out[use[k[c]]] += 1
            c -= int(s[k[c]])
    return out


def configurations(size: np.ndarray, need: np.ndarray, room: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use them, so that all ``need`` find a slot. Sizes and room in whole units."""
    k = len(size)
    if k == 0 or need.sum() == 0:
        return []
    basis = np.diag(room // size).astype(float)
    x = np.linalg.solve(basis, need.astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        dual = inverse.sum(0)  # every container costs one
        col = price(dual, size, room)
        if dual @ col <= 1 + 1e-7:
            break
        d = inverse @ col
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = col
        x = np.linalg.solve(basis, need.astype(float))
        x = np.maximum(x, 0)
    used = [(basis[:, j].astype(np.int64), int(x[j] + 1e-6)) for j in range(k)]
    used = [(c, n) for c, n in used if n > 0 and c.any()]
    left = need - sum((c * n for c, n in used), np.zeros(k, dtype=np.int64))
    left = np.maximum(left, 0)
    order = np.argsort(-size)
    while left.any():  # fewer containers than sizes: each round empties one configuration of the rest
        free, c = room, np.zeros(k, dtype=np.int64)
        for g in order:
            n = min(int(left[g]), int(free // size[g]))
            c[g], free = n, free - n * size[g]
        times = int(min(left[g] // c[g] for g in np.flatnonzero(c)))
        used.append((c, max(1, times)))
        left = np.maximum(left - c * max(1, times), 0)
    return used


def configured(capacity: int, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Group ends and configurations for the large texts of a capacity, given as a histogram of sizes, ascending.

    Sizes are rounded up to whole units. One that would not fit any more is taken as the whole room: its text stands alone.
    """
    end = linear_groups(tokens, counts)
    unit = max(1, capacity // UNITS)
    room = capacity // unit
    size = np.minimum(-(-end // unit), room)
    need = np.bincount(np.searchsorted(end, tokens), weights=counts, minlength=len(end)).astype(np.int64)
    return end, configurations(size, need, room)


def slots(used: list[tuple[np.ndarray, int]], groups: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group: first rank, first container and slots a container, for each configuration that has slots for it."""
    out = {}
    first = np.concatenate([[0], np.cumsum([n for _, n in used])]).astype(np.int64)
    for g in range(groups):
        rows = [(j, int(c[g]), n) for j, (c, n) in enumerate(used) if c[g] > 0]
        rank = np.concatenate([[0], np.cumsum([a * n for _, a, n in rows])]).astype(np.int64)
        out[g] = (rank[:-1], first[[j for j, _, _ in rows]], np.array([a for _, a, _ in rows], dtype=np.int64))
    return out


def pieces(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens): a row for each text and container; oversize texts in pieces."""
    # the containers table is fixed: a few rows, put into the plan as literals, so that texts are multiplied by no join
    kinds = sorted({(r[0], r[1]) for r in containers.where("capacity_tokens > 0").select("container", "capacity_tokens").collect()})
    if not kinds:
        return sized.sparkSession.createDataFrame([], "container string, capacity int, doc_id long, piece int, tokens int")
    listed = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).alias("capacity")) for k, c in kinds])
    parts = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    last = F.col("n_tokens") - (parts - 1) * F.col("capacity")
    return (
        sized.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.inline(listed))
        .select(
            "container",
            "capacity",
            "doc_id",
            F.posexplode(
                F.transform(F.sequence(F.lit(1), parts), lambda i: F.when(i < parts, F.col("capacity")).otherwise(last))
            ).alias("piece", "tokens"),
        )
        .withColumn("tokens", F.col("tokens").cast("int"))
    )


def _numbered(large: DataFrame, n: int, bucket_rows: int) -> DataFrame:
    """``large`` with ``rank``: 0.. within (container, capacity, grp), by hash buckets of about ``bucket_rows`` rows."""
    buckets = max(8, n // bucket_rows + 1)
    keyed = large.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    at = Window.partitionBy("container", "capacity", "grp")
    before = (
        keyed.groupBy("container", "capacity", "grp", "bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(at.orderBy("bucket")) - F.col("_n"))
        .drop("_n")
    )
    within = F.row_number().over(
        Window.partitionBy("container", "capacity", "grp", "bucket").orderBy("doc_id", "piece")
    )
    return (
        keyed.withColumn("_in", within - 1)
        .join(before, ["container", "capacity", "grp", "bucket"])
        .withColumn("rank", F.col("_before") + F.col("_in"))
        .drop("_before", "_in", "bucket")
    )


def best_fit(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard: rooms (piece = -1, ``tokens`` the free room of ``bin``) and small texts; the texts with their bin."""
    capacity, shard = int(frame["capacity"].iloc[0]), int(frame["shard"].iloc[0])
    rooms = frame[(frame["piece"] < 0) & (frame["tokens"] > 0)].sort_values(["tokens", "bin"])
    items = frame[frame["piece"] >= 0].sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
    if not len(items):
        return pd.DataFrame()  # an empty frame with text columns is no result
    free: dict[int, list[str]] = {}
    mask = 0
    for room, name in zip(rooms["tokens"].tolist(), rooms["bin"].tolist(), strict=True):
        free.setdefault(room, []).append(name)
        mask |= 1 << room
    opened, out = 0, []
    for size in items["tokens"].tolist():
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            names = free[room]
            name = names.pop()
            if not names:
                mask &= ~(1 << room)
        else:
            room, name = capacity, f"s{shard}-{opened}"
            opened += 1
        left = room - size
        if left:
            free.setdefault(left, []).append(name)
            mask |= 1 << left
        out.append(name)
    return items.assign(bin=out)[["container", "capacity", "doc_id", "piece", "tokens", "bin"]]


_OUT = "container string, capacity int, doc_id long, piece int, tokens int, bin string"


def packed(
    documents: DataFrame, containers: DataFrame, tokenizer: str = VOCABULARY, shard_rows: int = 20_000
) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens, bin): where every text goes, for each container."""
    spark = documents.sparkSession
    sized = cut(counted(spread(documents.select("doc_id", "text")), tokenizer).select("doc_id", "n_tokens"))
    every = pieces(sized, containers)
    whole = every.where("tokens = capacity").withColumn(
        "bin", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    )
    partial = every.where("tokens < capacity")
    # at most `capacity` rows for each container
    histogram = partial.groupBy("container", "capacity", "tokens").count().toPandas()
    ends: dict[tuple[str, int], np.ndarray] = {}
    plans: dict[tuple[str, int], dict] = {}
    rows = {}
    for (name, capacity), h in histogram.groupby(["container", "capacity"]):
        h = h.sort_values("tokens")
        big = h[h["tokens"] * LARGE > capacity]
        end, used = configured(capacity, big["tokens"].to_numpy(), big["count"].to_numpy())
        ends[name, capacity] = end
        plans[name, capacity] = slots(used, len(end))
        rows[name, capacity] = (int(big["count"].sum()), sum(n for _, n in used), int(h["count"].sum() - big["count"].sum()))
    held = spark.sparkContext.broadcast((ends, plans))  # GROUPS entries for each container

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            grp = np.full(len(f), -1)
            for key, at in f.groupby(["container", "capacity"]).indices.items():
                t, end = f["tokens"].to_numpy()[at], held.value[0][key]
                big = t * LARGE > key[1]
                grp[at[big]] = np.searchsorted(end, t[big])
            yield f.assign(grp=grp)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bins = np.empty(len(f), dtype=object)
            rank = f["rank"].to_numpy()
            for (name, capacity, g), at in f.groupby(["container", "capacity", "grp"]).indices.items():
                first_rank, first_bin, a = held.value[1][name, capacity][g]
                r = rank[at]
                j = np.searchsorted(first_rank, r, side="right") - 1
                bins[at] = [f"c{b}" for b in first_bin[j] + (r - first_rank[j]) // a[j]]
            yield f.assign(bin=bins)[["container", "capacity", "doc_id", "piece", "tokens", "bin"]]

    marked = partial.mapInPandas(
        grouped, "container string, capacity int, doc_id long, piece int, tokens int, grp int"
    )
    n_large = sum(r[0] for r in rows.values())
    large = cut(_numbered(marked.where("grp >= 0"), n_large, 10 * shard_rows).mapInPandas(placed, _OUT))
    shards = {k: max(1, max(r[1], r[2]) // shard_rows + 1) for k, r in rows.items()}
    shard_of = F.lit(1)
    for (name, capacity), n in shards.items():  # a few containers
        shard_of = F.when((F.col("container") == name) & (F.col("capacity") == capacity), n).otherwise(shard_of)
    rooms = (
        large.groupBy("container", "capacity", "bin")
        .agg((F.col("capacity") - F.sum("tokens")).cast("int").alias("tokens"))
        .select("container", "capacity", F.lit(-1).cast("long").alias("doc_id"), F.lit(-1).alias("piece"), "tokens", "bin",
                F.pmod(F.xxhash64("bin"), shard_of).cast("int").alias("shard"))
    )
    small = marked.where("grp < 0").select(
        "container", "capacity", "doc_id", "piece", "tokens", F.lit("").alias("bin"),
        F.pmod(F.xxhash64("doc_id", "piece"), shard_of).cast("int").alias("shard"),
    )
    filled = rooms.unionByName(small).groupBy("container", "capacity", "shard").applyInPandas(best_fit, _OUT)
    return whole.select(large.columns).unionByName(large).unionByName(filled)


def report(assigned: DataFrame) -> DataFrame:
    """Per container: bins used, the least number possible by volume, and the share of the room that is filled."""
    per = assigned.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"))
    return per.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"),
        F.ceil(F.sum("t") / F.first("capacity")).alias("least_bins"),
        F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"),
        F.max("t").alias("fullest"),
    )


def invariants(assigned: DataFrame) -> DataFrame:
    """Per container: texts placed, containers over capacity, pieces placed more than once, texts split that would fit."""
    kind = ["container", "capacity"]
    bins = assigned.groupBy(*kind, "bin").agg(F.sum("tokens").alias("t")).groupBy(*kind).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    texts = assigned.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("p"), F.sum("tokens").alias("t"))
    per = texts.groupBy(*kind).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > F.col("p")).alias("repeated"),
        F.count_if((F.col("p") > 1) & (F.col("t") <= F.col("capacity"))).alias("split_without_need"),
    )
    return per.join(bins, kind)
