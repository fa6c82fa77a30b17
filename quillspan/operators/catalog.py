"""Catalogues of content: fingerprints, redundancy, families, twins, drift.

All aggregations combine before their shuffle; joins are on hashes or paths, where AQE splits what is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import family


def fingerprint(x: Column) -> Column:
    return F.sha2(x, 256)


def redundancy(rows: DataFrame, key: str = "sha256", ident: str = "doc_id", size: str = "bytes") -> DataFrame:
    """Content held more than once: (key, copies, first_id, bytes)."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id"), F.max(size).alias("bytes"))
        .where("copies > 1")
    )


def summary(rows: DataFrame, key: str = "sha256", size: str = "bytes") -> DataFrame:
    """One row: entries, bytes, distinct contents, redundant copies."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    return per.agg(
        F.sum("n").alias("entries"),
        F.sum("b").alias("bytes"),
        F.count(F.lit(1)).alias("distinct_contents"),
        F.sum(F.col("n") - 1).alias("redundant_copies"),
    )


def families(rows: DataFrame, path: str = "path") -> DataFrame:
    """(family, builds, sample): works and how many builds of each; the sample is the first path."""
    return rows.groupBy(family(F.col(path)).alias("family")).agg(
        F.count(F.lit(1)).alias("builds"), F.min(path).alias("sample")
    )


def top_families(rows: DataFrame, k: int = 22) -> DataFrame:
    """The report's list: works with several builds, most builds first."""
    return families(rows).where("builds > 1").orderBy(F.desc("builds"), "family").limit(k)


def twins(rows: DataFrame, other: DataFrame, key: str = "sha256", payload: str = "path", size: str = "bytes") -> DataFrame:
    """``rows`` whose content ``other`` holds too, with the first place it is held at; empty content has no twin."""
    held = other.where(F.col(size) > 0).groupBy(key).agg(F.min(payload).alias("held_as"))
    return rows.join(held, key)


def without_twin(rows: DataFrame, other: DataFrame, key: str = "sha256", size: str = "bytes") -> DataFrame:
    return rows.join(other.where(F.col(size) > 0).select(key), key, "left_anti")


def drift(stored: DataFrame, current: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``key`` + status: OK, DRIFT, MISSING (not stored) or GONE (stored only), by comparing row hashes."""
    h = F.xxhash64(*columns)
    a = stored.select(*key, h.alias("_a"))
    b = current.select(*key, h.alias("_b"))
    return a.join(b, key, "full_outer").select(
        *key,
        F.when(F.col("_a").isNull(), "MISSING")
        .when(F.col("_b").isNull(), "GONE")
        .when(F.col("_a") == F.col("_b"), "OK")
        .otherwise("DRIFT")
        .alias("status"),
    )


def span(rows: DataFrame, stamp: str = "mtime") -> DataFrame:
    """First and last of the stamps that are no blanks, and their number."""
    s = F.nullif(F.col(stamp), F.lit(""))
    return rows.agg(F.min(s).alias("first"), F.max(s).alias("last"), F.count(s).alias("dated"))


def by_priority(rows: DataFrame, key: str, rank: Column, tie: str) -> DataFrame:
    """The row of smallest rank for each key, ties by ``tie``; a combining aggregate."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(rank, tie)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def listings(files: DataFrame, latest: bool) -> DataFrame:
    """The first or last listing of each path of a collection."""
    at = F.struct("listed_at", "file_id")
    pick = F.max_by if latest else F.min_by
    return files.groupBy("collection", "path").agg(
        pick("sha256", at).alias("sha256"), pick("length", at).alias("length")
    )


def labelled(rows: DataFrame, labels: DataFrame, address: str, label: str, default: str = "") -> DataFrame:
    """``rows`` with the label of their address; of several labels the first by name, ``default`` for none."""
    one = labels.groupBy(address).agg(F.min(label).alias(label))
    return rows.join(one, address, "left").withColumn(label, F.coalesce(label, F.lit(default)))
