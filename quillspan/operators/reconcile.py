"""Comparing sets of records: differences, unions with provenance, unresolved references, verdicts of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(required: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys required but not there."""
    return required.select(*key).distinct().join(actual.select(*key), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``key`` + side ('left' or 'right') of what only one of them has: one full join, no second scan."""
    left = a.select(*key).distinct().withColumn("_l", F.lit(1))
    right = b.select(*key).distinct().withColumn("_r", F.lit(1))
    return (
        left.join(right, key, "full_outer")
        .where("_l is null or _r is null")
        .select(*key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))
    )


def merged(a: DataFrame, b: DataFrame, key: list[str], names: tuple[str, str]) -> DataFrame:
    """Union on a key with ``found_by``; equal columns come from the left where it has the key.

    Several right rows of one key are one, the last by all columns; left keys are taken to be unique.
    """
    rest = [c for c in b.columns if c not in key]
    last = b.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r"))
    left = a.withColumn("_in", F.lit(True))
    j = left.join(last, key, "full_outer")
    shared = [c for c in a.columns if c not in key]
    columns = [F.coalesce(F.col(c), F.col(f"_r.{c}")).alias(c) if c in rest else F.col(c) for c in shared]
    extra = [F.col(f"_r.{c}").alias(f"{names[1]}_{c}") for c in rest]
    found = F.array_compact(
        F.array(F.when(F.col("_in"), F.lit(names[0])), F.when(F.col("_r").isNotNull(), F.lit(names[1])))
    )
    return j.select(*key, *columns, *extra, found.alias("found_by"))


def unresolved(citing: DataFrame, cited: DataFrame, ident: str, ids: str, scope: list[str], target: str) -> DataFrame:
    """(ident, unresolved): the ids a record cites that ``cited`` lacks in the same scope, in the order cited."""
    each = citing.select(ident, *scope, F.posexplode(ids).alias("_i", target))
    known = cited.select(*scope, target).distinct()
    return (
        each.join(known, [*scope, target], "left_anti")
        .groupBy(ident)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", target))), lambda s: s[target]).alias("unresolved"))
    )


def unknown_keys(keys: Column, known: list[str]) -> Column:
    """Sorted keys that are not known."""
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known])))


def verdict(rules: list[tuple[str, str, Column]]) -> Column:
    """struct(errors, warnings, infos, verdict) of (severity, message, failing condition); null conditions do not fail."""
    def of(kind: str) -> Column:
        return F.array_compact(
            F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for s, m, c in rules if s == kind], F.lit(None).cast("string"))
        )

    errors, warnings = of("error"), of("warning")
    return F.struct(
        errors.alias("errors"),
        warnings.alias("warnings"),
        of("info").alias("infos"),
        F.when(F.size(errors) > 0, "FAIL").when(F.size(warnings) > 0, "WARN").otherwise("OK").alias("verdict"),
    )


def rollup(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """One row: checked, failed, warned, passed."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col(column) == "FAIL").alias("failed"),
        F.count_if(F.col(column) == "WARN").alias("warned"),
        F.count_if(F.col(column) != "FAIL").alias("passed"),
    )


def same_columns(df: DataFrame, contract: list[str]) -> bool:
    """Whether a table has exactly the contracted header, in order."""
    return df.columns == contract


def enriched(base: DataFrame, key: str, others: list[DataFrame]) -> DataFrame:
    """``base`` with optional one-to-one companions by key."""
    return reduce(lambda acc, o: acc.join(o, key, "left"), others, base)


#: What a package manifest may hold, and what the messenger's icon should measure.
MANIFEST_KEYS = ["name", "source_code_url", "min_api"]
ICON_RANGE = (128, 512)


def package_verdict() -> Column:
    """Rules over a package row: file_name, is_zip, entries array<struct<path,method,size>>, manifest map, manifest_error,
    icon struct<path,width,height,valid>. Methods are the container's numbers, 0 stored and 8 deflated."""
    paths = F.transform("entries", lambda e: e["path"])
    nested = F.filter(paths, lambda p: p.endswith("index.html"))
    has = lambda p: F.array_contains(paths, p)
    icon = F.col("icon")
    small, large = F.least(icon["width"], icon["height"]), F.lit(ICON_RANGE[1])
    zipped = F.col("is_zip")
    unsafe = F.exists(paths, lambda p: p.startswith("/") | p.contains("\\") | F.array_contains(F.split(p, "/"), ".."))
    unknown = F.array_except(F.map_keys("manifest"), F.array(*[F.lit(k) for k in MANIFEST_KEYS]))
    return verdict(
        [
            ("error", "extension is not .xdc", ~F.lower("file_name").endswith(".xdc")),
            ("error", "not a ZIP file", ~zipped),
            ("error", "compression is neither stored nor deflated", zipped & F.exists("entries", lambda e: ~e["method"].isin(0, 8))),
            ("error", "unsafe entry path", zipped & unsafe),
            ("error", "index.html is not at the root", zipped & ~has("index.html") & (F.size(nested) > 0)),
            ("error", "index.html is missing", zipped & ~has("index.html") & (F.size(nested) == 0)),
            ("error", "webxdc.js must not be shipped", zipped & has("webxdc.js")),
            ("warning", "manifest of another format", zipped & (has("manifest.json") | has("manifest.xml"))),
            ("error", "manifest does not parse", zipped & F.col("manifest_error").isNotNull()),
            ("error", "manifest has no name", F.col("manifest").isNotNull() & (F.coalesce(F.col("manifest")["name"], F.lit("")) == "")),
            ("warning", "manifest has no source_code_url", F.col("manifest").isNotNull() & (F.coalesce(F.col("manifest")["source_code_url"], F.lit("")) == "")),
            ("info", "manifest has unknown keys", F.size(unknown) > 0),
            ("info", "no manifest", zipped & ~has("manifest.toml")),
            ("error", "icon is not valid", icon.isNotNull() & ~icon["valid"]),
            ("warning", "icon is not square", icon["valid"] & (icon["width"] != icon["height"])),
            ("warning", "icon size is out of range", icon["valid"] & ~small.between(F.lit(ICON_RANGE[0]), large)),
            ("info", "no icon", zipped & icon.isNull()),
        ]
    )
