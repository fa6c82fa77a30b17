"""Best representative of each duplicate group, field by field, by token-level consensus.

Method. The usable values of a group's field are aligned progressively into a profile (a list of columns, each holding
the votes of the tokens that fell into it, gaps included). Each column elects its strongest token; the elected tokens
are the consensus; the existing value closest to it (edit distance) is emitted, and of the records that carry it the
one that ranks first.

Votes. ``weighted``: a value's vote is the summed weight (by trust) of its records. ``strict``: precedence; the record of
best rank (trust, recency, id) outvotes all others together, column by column. The values of every group and field are
aligned under either vote. (A value that holds more than half of all votes wins every column of any alignment; under
``strict`` one always does, so that the consensus is the value of the best-ranked record.)

Scale. Equal values are combined before the first shuffle (``groupBy(group, field, value)``). Groups of up to ``BLOCK``
records are then decided one after another where they meet. In larger ones every part of the values is folded into one
partial profile per group and field, and partials meet by group and are folded as a stream, one profile in memory at a
time. Values are spread by group, field and a salt for that, so a group that holds a third of the rows costs ``SALTS``
partials; a partial is as large as the variety of tokens in a column times the columns.

Defined results
---------------
* A group is two or more records with the same keys. A record whose key cannot be formed (null, or not the expected
  number of distinct lines) is in no group. Records delivered again are members like any other.
* Null, blank and unusable values take no part; a field without usable value gives no row.
* Missing or unlisted engines rank last, all alike; a missing run time is oldest; remaining ties go to the smallest id.
* Empty tables give empty results. Extra columns, clashing names included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut

#: The forms and validations that count as usable, lower case; N is any number.
FORMS = ["5-7-5", "5-7-5 (approximate)", "free-form 3-line"]
VALIDATION_PATTERN = r"^(exact|approximate \(off by \d+\)|not 5-7-5 \(short modern form\))$"

_GROUP = ["packet_id", "page_no", "_lines"]
_KEYS = [*_GROUP, "field"]
#: Into so many parts the values of a group and field are spread for their partial profiles.
SALTS = 32
#: Records of a group up to which its values are aligned in one go; those of a larger one meet in partial profiles.
BLOCK = 4096
#: Values held before decided groups are handed on.
_HELD = 50_000
_GAP = "\x00"
_FAR = (1 << 30, 0, 0)


def line_key(line_ids: Column) -> Column:
    """A set of lines whatever its order and spelling: case, blanks, dashes and leading zeros do not count.

    Null unless it names exactly three different lines.
    """
    named = F.transform(
        line_ids,
        lambda x: F.regexp_replace(
            F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), r"[\s\-_.]+", "_"),
            r"(?<![0-9])0+(?=[0-9])",
            "",
        ),
    )
    kept = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x != ""))))
    return F.when((F.size(kept) == 3) & (F.size(line_ids) == 3), F.array_join(kept, "|"))


def usable(field: str) -> Column:
    """The field's canonical value where it is usable, else null."""
    if field == "score":
        ok = F.col("score").between(0.0, 1.0) & ~F.isnan("score")
        return F.when(ok, F.col("score").cast("string"))
    text = F.lower(F.regexp_replace(F.col(field), r"(?U)^\s+|\s+$", ""))
    if field == "form":
        return F.when(text.isin(FORMS), text)
    return F.when(text.rlike(VALIDATION_PATTERN), text)


def ranked(candidates: DataFrame, engines: DataFrame, fields: list[str]) -> DataFrame:
    """Group key, candidate_id, _rank (trust, age, id; the smallest is to be preferred) and _v_<field>, usable values or null."""
    # the engine list may repeat a name in another spelling; its best rank counts. 5 rows: Spark broadcasts by size
    listed = (
        engines.select(F.lower(F.trim("engine")).alias("_engine"), F.col("trust_rank").alias("_trust"))
        .where("_engine is not null and _engine != ''")
        .groupBy("_engine")
        .agg(F.min("_trust").alias("_trust"))
    )
    base = candidates.select(
        "packet_id",
        "page_no",
        line_key(F.col("line_ids")).alias("_lines"),
        "candidate_id",
        F.lower(F.trim("engine")).alias("_engine"),
        F.coalesce(-F.unix_micros(F.col("run_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("_age"),
        *[usable(f).alias(f"_v_{f}") for f in fields],
    ).where("packet_id is not null and page_no is not null and _lines is not null")
    trust = F.coalesce("_trust", F.lit(1 << 20))
    return base.join(listed, "_engine", "left").select(
        *_GROUP,
        "candidate_id",
        F.struct(trust.alias("_trust"), F.col("_age"), F.col("candidate_id").alias("_id")).alias("_rank"),
        *[f"_v_{f}" for f in fields],
    )


def ranked_values(base: DataFrame, fields: list[str]) -> DataFrame:
    """Long form: one row per group, field and distinct usable value, with its best record and summed weight."""
    # '' is the membership row: it carries group size and smallest id, whatever is usable
    long = base.select(
        *_GROUP,
        "candidate_id",
        "_rank",
        F.inline(
            F.array(
                F.struct(F.lit("").alias("field"), F.lit("").alias("value")),
                *[F.struct(F.lit(f).alias("field"), F.col(f"_v_{f}").alias("value")) for f in fields],
            )
        ),
    ).where("value is not null")
    return long.groupBy(*_KEYS, "value").agg(
        F.min("_rank").alias("best"),
        F.count(F.lit(1)).alias("n"),
        F.min("candidate_id").alias("first_id"),
        F.sum(1.0 / (1.0 + F.col("_rank._trust"))).alias("weight"),
    )


# ---- profiles: plain Python values, folded per group ------------------------------------------------------------


def tokens(value: str) -> list[str]:
    """Words and brackets of a phrase; the characters of a figure."""
    return list(value) if value[:1].isdigit() and " " not in value and "-" not in value else value.split(" ")


def single(toks: list[str], vote: tuple) -> list[dict]:
    return [{t: vote} for t in toks]


def _better(a: tuple, b: tuple) -> tuple:
    """Merge two votes (weight, rank): weights add, the better rank stays."""
    return (a[0] + b[0], min(a[1], b[1]))


def _total(profile: list[dict]) -> tuple:
    """The votes of all values in a profile: those of any one column, as gaps vote too."""
    out = None
    for v in profile[0].values() if profile else ():
        out = v if out is None else _better(out, v)
    return out or (0.0, _FAR)


def align(p: list[dict], q: list[dict]) -> list[dict]:
    """Global alignment of two profiles; columns without counterpart meet a gap that carries the other side's votes."""
    if not p or not q:
        return p or q
    if len(p) == len(q) and all(x.keys() == y.keys() for x, y in zip(p, q, strict=True)):
        return [{t: _better(v, y[t]) for t, v in x.items()} for x, y in zip(p, q, strict=True)]
    n, m = len(p), len(q)
    score = [[-0.5 * j for j in range(m + 1)]] + [[-0.5 * i] + [0.0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        x, row, up = p[i - 1], score[i], score[i - 1]
        for j in range(1, m + 1):
            same = up[j - 1] + (1.0 if not x.keys().isdisjoint(q[j - 1]) else -1.0)
            row[j] = max(same, up[j] - 0.5, row[j - 1] - 0.5)
    tp, tq = _total(p), _total(q)
    out, i, j = [], n, m
    while i or j:
        if i and j:
            hit = 1.0 if not p[i - 1].keys().isdisjoint(q[j - 1]) else -1.0
            if score[i][j] == score[i - 1][j - 1] + hit:
                col = dict(p[i - 1])
                for t, v in q[j - 1].items():
                    col[t] = _better(col[t], v) if t in col else v
                out.append(col)
                i, j = i - 1, j - 1
                continue
        if i and score[i][j] == score[i - 1][j] - 0.5:
            x, t, i = p[i - 1], tq, i - 1
        else:
            x, t, j = q[j - 1], tp, j - 1
        col = dict(x)
        col[_GAP] = _better(col[_GAP], t) if _GAP in col else t
        out.append(col)
    return out[::-1]


def consensus(profile: list[dict], strict: bool) -> list[str]:
    """Per column the token of the best rank (strict) or of the most weight; ties to the better rank, then the token."""
    won = []
    for col in profile:
        key = (lambda t, c=col: (c[t][1], t)) if strict else (lambda t, c=col: (-c[t][0], c[t][1], t))
        won.append(min(col, key=key))
    return [t for t in won if t != _GAP]


_PARTIAL = "packet_id long, page_no int, _lines string, field string, profile string"


def _pack(profile: list[dict]) -> str:
    import json

    return json.dumps([[[t, v[0], *v[1]] for t, v in c.items()] for c in profile], separators=(",", ":"))


def _unpack(text: str) -> list[dict]:
    import json

    return [{t: (w, (a, b, c)) for t, w, a, b, c in col} for col in json.loads(text)]


def _fold_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values, sorted by group, to one partial profile per run of a group."""
    yield from _fold(frames, lambda r: single(tokens(r.value), (r.weight, (r.trust, r.age, r.id))))


def _fold_partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _fold(frames, lambda r: _unpack(r.profile))


def _fold(frames, read) -> Iterator[pd.DataFrame]:
    key, profile, out = None, [], []
    for frame in frames:
        for r in frame.itertuples(index=False):
            k = (r.packet_id, r.page_no, r[2], r.field)
            if k != key:
                if key is not None:
                    out.append((*key, _pack(profile)))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=[*_KEYS, "profile"])
                        out = []
                key, profile = k, read(r)
            else:
                profile = align(profile, read(r))
    if key is not None:
        out.append((*key, _pack(profile)))
    yield pd.DataFrame(out, columns=[*_KEYS, "profile"])


_ELECTION = "group_candidate_id long, field string, consensus string, ids array<long>, choices array<string>"


def _elections(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """Values, sorted by group, field and rank, to the consensus of each group and field beside the values it may fall on.

    Each group begins with its membership row; a record alone is in no group. A value's place in its run is its rank.
    """
    group, first, field, out, held = None, None, None, [], 0
    run: list[tuple] = []

    def decided() -> tuple:
        profile: list[dict] = []
        for i, (_, value, weight) in enumerate(run):
            profile = align(profile, single(tokens(value), (weight, (i, 0, 0))))
        return first, field, _joined(consensus(profile, strict)), [r[0] for r in run], [r[1] for r in run]

    def handed_on() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        names = ["group_candidate_id", "field", "consensus", "ids", "choices"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for *g, f, value, weight, rank_id, n, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group or f != field:
                if run:
                    out.append(decided())
                    held, run = held + len(run), []
                    if held >= _HELD:
                        yield handed_on()
                        out, held = [], 0
                if g != group:
                    group, first = g, first_id if n >= 2 else None
                field = f
            if f and first is not None:
                run.append((rank_id, value, weight))
    if run:
        out.append(decided())
    yield handed_on()


def elected(values: DataFrame, strict: bool = False) -> DataFrame:
    """(group, field, consensus): the elected tokens of each group and field."""
    flat = values.select(
        *_KEYS,
        "value",
        "weight",
        F.col("best._trust").cast("long").alias("trust"),
        F.col("best._age").alias("age"),
        F.col("best._id").alias("id"),
    )
    spread = flat.repartition(*_KEYS, F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    partial = spread.sortWithinPartitions(*_KEYS, "trust", "age", "id").mapInPandas(_fold_values, _PARTIAL)
    final = partial.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "profile").mapInPandas(_fold_partials, _PARTIAL)

    @F.pandas_udf("string")
    def elect(profiles: pd.Series) -> pd.Series:
        return profiles.map(lambda p: _joined(consensus(_unpack(p), strict)))

    return final.select(*_KEYS, elect("profile").alias("consensus"))


def _joined(toks: list[str]) -> str:
    return ("" if all(len(t) == 1 for t in toks) else " ").join(toks)


def survivors(candidates: DataFrame, engines: DataFrame, fields: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(group_candidate_id, field, candidate_id, value): for each group and field the record that serves it best."""
    fields = fields or ["score", "form", "validation"]
    values = cut(ranked_values(ranked(candidates, engines, fields), fields))
    # at most one group for every BLOCK records, so few that they can be broadcast
    large = F.broadcast(values.where((F.col("field") == "") & (F.col("n") > BLOCK)).select(*_GROUP, F.col("first_id").alias("group_candidate_id")))
    return _in_one_go(values.join(large, _GROUP, "left_anti"), strict).unionByName(_in_parts(values.where("field != ''").join(large, _GROUP), strict))


def votes(base: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values, and per group and field the strongest of them and whether it holds the majority of the weight."""
    values = cut(ranked_values(base, fields))
    top = values.where("field != ''").groupBy(*_KEYS).agg(
        F.sum("weight").alias("_all"), F.max_by(F.struct("value", "best", "weight"), F.struct("weight", -F.col("best._trust"))).alias("_top")
    )
    return values, top.withColumn("_settled", F.col("_top.weight") * 2 > F.col("_all"))


def _in_one_go(values: DataFrame, strict: bool) -> DataFrame:
    by_rank = ["best._trust", "best._age", "best._id"]
    runs = values.repartition(*_GROUP).sortWithinPartitions(*_KEYS, *by_rank).select(*_KEYS, "value", "weight", "best._id", "n", "first_id")
    closest = F.array_min(
        F.transform(
            F.arrays_zip("ids", "choices"),
            lambda c, i: F.struct(F.levenshtein(c["choices"], F.col("consensus")).alias("d"), i.alias("i"), c["ids"].alias("candidate_id"), c["choices"].alias("value")),
        )
    )
    elections = runs.mapInArrow(lambda batches: _elections(batches, strict), _ELECTION).select("group_candidate_id", "field", closest.alias("_s"))
    return elections.select("group_candidate_id", "field", "_s.candidate_id", "_s.value")


def _in_parts(values: DataFrame, strict: bool) -> DataFrame:
    closest = (
        values.join(elected(values, strict), _KEYS)
        .groupBy("group_candidate_id", *_KEYS)
        .agg(F.min_by(F.struct(F.col("best._id").alias("candidate_id"), "value"), F.struct(F.levenshtein("value", "consensus"), "best")).alias("_s"))
    )
    return closest.select("group_candidate_id", "field", "_s.candidate_id", "_s.value")
