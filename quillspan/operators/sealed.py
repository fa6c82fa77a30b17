"""Sealed streams: files encrypted in records, delivered in pieces whose borders are not theirs (aes128gcm content coding).

A file's stream is a head of 21 bytes (salt, record size, no key id) and records: AES-GCM over data, a delimiter (1, in the
last record 2) and zeros. A transfer is its files' streams one after another, cut into pieces.

Pieces are taken apart where they lie: each yields the parts of heads and records it holds, and only the parts of a record
that a border cuts need each other. So no state is carried from piece to piece, a transfer of any length has no hot task,
and what is lost is read again by itself. Cipher and padding are Catalyst's; Python derives two short keys for each file.

Defined results: ``plain`` is null and ``error`` says why where a record is incomplete, has a wrong key or tag, no or the
wrong delimiter; a file whose head is broken or missing has one row with that error. Null pieces are missing pieces.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the head and of what a record adds to its data, and the names that keys are derived by.
HEAD, TAG = 21, 16
KEY_INFO, NONCE_INFO = b"Content-Encoding: aes128gcm\x00", b"Content-Encoding: nonce\x00"


def hkdf(secret: bytes, salt: bytes, info: bytes, size: int) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    key = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out = block = b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:size]


def derived(secret: Column, salt: Column) -> Column:
    """struct(key, nonce) of a stream; both null where secret or salt is."""

    @F.pandas_udf("struct<key:binary,nonce:binary>")
    def derive(secrets: pd.Series, salts: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if a is None or b is None else (hkdf(bytes(a), bytes(b), KEY_INFO, 16), hkdf(bytes(a), bytes(b), NONCE_INFO, 12))
            for a, b in zip(secrets, salts, strict=True)
        ]
        return pd.DataFrame(rows, columns=["key", "nonce"])

    return derive(secret, salt)


def _nonce(base: Column, seq: Column) -> Column:
    """The base with the record's number xored into its last four bytes."""
    h = F.hex(base)
    last = F.conv(F.substring(h, 17, 8), 16, 10).cast("bigint").bitwiseXOR(seq.cast("bigint"))
    return F.unhex(F.concat(F.substring(h, 1, 16), F.lpad(F.hex(last), 8, "0")))


def _joined(parts: Column) -> Column:
    """Parts (offset, bytes) in order, as one."""
    return F.aggregate(F.array_sort(parts), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["bytes"]))


def _records(data: Column, size: Column) -> Column:
    """array<binary>: the data of each record; one empty record for empty data."""
    room = size - TAG - 1
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / room).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * room + 1, room))


def sealed(files: DataFrame, data: str = "data", secret: str = "secret", salt: str = "salt", record_size: int = 65_536) -> DataFrame:
    """``files`` with ``stream``: the data under the secret, in records of ``record_size`` bytes."""
    k = F.col("_k")
    head = F.concat(F.col(salt), F.unhex(F.lit(f"{record_size:08x}00")))
    chunks = _records(F.col(data), F.lit(record_size))
    seal = lambda c, i: F.substring(  # noqa: E731  the engine puts the nonce in front
        F.aes_encrypt(
            F.concat(c, F.when(i == F.size(F.col("_c")) - 1, F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01")))),
            k["key"], F.lit("GCM"), F.lit("DEFAULT"), _nonce(k["nonce"], i),
        ),
        F.lit(13), F.lit(1 << 30),
    )
    made = files.withColumn("_k", derived(F.col(secret), F.col(salt))).withColumn("_c", chunks)
    body = F.aggregate(F.transform("_c", seal), F.unhex(F.lit("")), lambda a, r: F.concat(a, r))
    return made.withColumn("stream", F.concat(head, body)).drop("_k", "_c")


def _parts(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """(transfer, file_no, length, off, bytes): what each piece holds of each file; off counts within the file's stream."""
    # the list of a transfer's files travels with its description and is short beside its pieces
    ranges = F.array_sort(F.collect_list(F.struct("file_no", "length")))
    starts = F.aggregate(
        "_f",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<file_no:int,start:bigint,length:bigint>>)").alias("out")),
        lambda a, f: F.struct(
            (a["at"] + f["length"]).alias("at"),
            F.array_append(a["out"], F.struct(f["file_no"].cast("int").alias("file_no"), a["at"].alias("start"), f["length"].cast("bigint").alias("length"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    listed = files.groupBy("transfer").agg(ranges.alias("_f")).select("transfer", starts.alias("_f"))
    size = F.length("content")
    over = F.filter("_f", lambda f: (f["start"] < F.col("at") + size) & (f["start"] + f["length"] > F.col("at")))
    cut = pieces.where("content is not null").join(listed, "transfer").select("transfer", "at", "content", F.explode(over).alias("f"))
    lo = F.greatest(F.col("f.start"), F.col("at"))
    hi = F.least(F.col("f.start") + F.col("f.length"), F.col("at") + size)
    return cut.select(
        "transfer", "f.file_no", "f.length", (lo - F.col("f.start")).alias("off"),
        F.substring("content", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("bytes"),
    )


def opened(pieces: DataFrame, files: DataFrame, secrets: DataFrame) -> DataFrame:
    """(transfer, file_no, seq, plain, error): the records of every file of every transfer.

    ``pieces``: transfer, at (the offset of the piece), content; ``files``: transfer, file_no, length (of the stream);
    ``secrets``: transfer, secret.
    """
    parts = _parts(pieces, files)
    place = F.struct("off", "bytes")
    heads = parts.where(F.col("off") < HEAD).groupBy("transfer", "file_no").agg(F.substring(_joined(F.collect_list(place)), 1, HEAD).alias("_h"))
    size = F.conv(F.hex(F.substring("_h", 17, 4)), 16, 10).cast("bigint")
    keyed = (
        files.select("transfer", F.col("file_no").cast("int").alias("file_no"), F.col("length").cast("bigint").alias("length"))
        .join(heads, ["transfer", "file_no"], "left")
        .join(secrets.select("transfer", "secret"), "transfer", "left")
        .withColumn("rs", F.when(F.length("_h") == HEAD, size))
        .withColumn(
            "error",
            F.when(F.col("rs").isNull(), "no head")
            .when(F.hex(F.substring("_h", 21, 1)) != "00", "key id is not supported")
            .when(F.col("rs") <= TAG + 1, "record size too small")
            .when(F.col("secret").isNull(), "no secret"),
        )
        .withColumn("_k", derived(F.col("secret"), F.substring("_h", 1, 16)))
        .drop("_h", "secret")
    )
    good = keyed.where("error is null").drop("error", "length")
    body = F.col("length") - HEAD
    first = F.greatest(F.col("off"), F.lit(HEAD)) - HEAD
    last = F.col("off") + F.length("bytes") - HEAD - 1
    spread = parts.where(F.col("off") + F.length("bytes") > HEAD).join(good, ["transfer", "file_no"]).select(
        "*", F.explode(F.sequence(F.floor(first / F.col("rs")), F.floor(last / F.col("rs")))).alias("seq")
    )
    lo = F.greatest(F.col("off"), F.col("seq") * F.col("rs") + HEAD)
    hi = F.least(F.col("off") + F.length("bytes"), (F.col("seq") + 1) * F.col("rs") + HEAD)
    held = spread.select(
        "transfer", "file_no", "seq", "rs", "length", "_k",
        F.struct(lo.alias("off"), F.substring("bytes", (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int")).alias("bytes")).alias("_p"),
    )
    # a record is of bounded size; most have one part
    records = held.groupBy("transfer", "file_no", "seq").agg(
        _joined(F.collect_list("_p")).alias("_r"), F.first("rs").alias("rs"), F.first("length").alias("length"), F.first("_k").alias("_k")
    )
    ends = (F.col("seq") + 1) * F.col("rs") >= body
    due = F.least(F.col("rs"), body - F.col("seq") * F.col("rs"))
    whole = F.length("_r") == due
    clear = F.when(whole & (due > TAG), F.try_aes_decrypt(F.concat(_nonce(F.col("_k.nonce"), F.col("seq")), "_r"), F.col("_k.key"), F.lit("GCM"), F.lit("DEFAULT")))
    # zeros after the delimiter, in hexadecimal: pairs
    marked = F.regexp_replace(F.hex(clear), "^((?:..)*?)(?:00)*$", "$1")
    out = records.withColumn("_m", marked).select(
        "transfer", "file_no", "seq",
        F.when(~whole, "incomplete").when(due <= TAG, "too short").when(F.col("_m").isNull(), "wrong key or tag").when(F.col("_m") == "", "no delimiter")
        .when(F.substring("_m", -2, 2) != F.when(ends, "02").otherwise("01"), "wrong delimiter").alias("error"),
        F.unhex(F.expr("substring(_m, 1, length(_m) - 2)")).alias("plain"),
    ).withColumn("plain", F.when(F.col("error").isNull(), F.col("plain")))
    broken = keyed.where("error is not null").select("transfer", "file_no", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("binary").alias("plain"), "error")
    return out.select("transfer", "file_no", "seq", "plain", "error").unionByName(broken)


def contents(records: DataFrame) -> DataFrame:
    """(transfer, file_no, records, data, error): files put together again, for files that fit a row; data null with any error."""
    place = F.struct(F.col("seq").alias("off"), F.col("plain").alias("bytes"))
    per = records.groupBy("transfer", "file_no").agg(
        F.count("seq").alias("records"), F.min("error").alias("error"), (F.max("seq") + 1).alias("_n"), _joined(F.collect_list(place)).alias("_d")
    )
    lost = F.coalesce("error", F.when(F.col("_n") != F.col("records"), "missing records"))
    return per.select("transfer", "file_no", "records", F.when(lost.isNull(), F.col("_d")).alias("data"), lost.alias("error"))
