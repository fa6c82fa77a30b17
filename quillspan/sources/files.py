"""Directories, archives, manifests and tables read from files. Python only where bytes must be taken apart."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import natural_key, title

#: Suffixes of pictures.
IMAGE_SUFFIXES = "png jpg jpeg tif tiff bmp webp gif jp2 ppm pgm".split()
#: The columns of the catalogue file.
CATALOGUE = ["sha256", "bytes", "mtime", "path", "title"]


def tree(spark: SparkSession, root: str, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """(path, bytes, modified[, content]) of all files under ``root``; paths relative, excluded directory names left out.

    A file reached by several links is one row, that of its smallest path.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^(?:file:/*|hdfs://[^/]*/)", "/")
    base = "/" + root.replace("file:", "").strip("/") + "/"
    f = f.withColumn("path", F.when(rel.startswith(base), F.substring(rel, F.lit(len(base) + 1), F.length(rel))).otherwise(rel))
    for name in exclude or []:
        f = f.where(~F.concat(F.lit("/"), F.col("path")).contains(f"/{name}/"))
    out = f.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.dropDuplicates(["path"])


def catalogue(spark: SparkSession, root: str, dates: DataFrame | None = None) -> DataFrame:
    """The catalogue of a tree: sha256, bytes, mtime, path, title. ``dates``: (path, mtime) known from elsewhere; the file
    system's day otherwise."""
    files = tree(spark, root)
    day = F.date_format("modified", "yyyy-MM-dd")
    if dates is not None:
        files = files.join(dates.select("path", F.col("mtime").alias("_m")), "path", "left")
        day = F.coalesce(F.nullif("_m", F.lit("")), day)
    head = F.decode(F.substring("content", 1, 1 << 18), "ISO-8859-1")
    return files.select(F.sha2("content", 256).alias("sha256"), "bytes", day.alias("mtime"), "path", title(head).alias("title")).orderBy(F.lower("path"), "path")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Picture files in natural order; an empty listing is an error."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = tree(spark, root, content=False).where(suffix.isin(IMAGE_SUFFIXES))
    if found.isEmpty():
        raise FileNotFoundError(f"no images under {root}")
    return found.orderBy(natural_key(F.col("path")), "path")


def contracted_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A CSV whose header must be exactly ``header``; all columns strings."""
    first = spark.read.text(path).limit(1).collect()
    got = [c.strip().strip('"') for c in first[0][0].split(",")] if first else []
    if got != header:
        raise ValueError(f"header is {got}, expected {header}")
    fields = ", ".join(f"`{c}` string" for c in header)
    return spark.read.csv(path, schema=fields, header=True, enforceSchema=False, multiLine=True, escape='"')


def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="sha256 string, bytes bigint, mtime string, path string, title string", quote="", comment=None)


def _entries(frames):
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [
                        (path, i.filename, i.compress_type, i.compress_size, i.file_size, "%04d-%02d-%02d" % i.date_time[:3], z.read(i), None)
                        for i in z.infolist()
                        if not i.is_dir()
                    ]
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
                rows.append((path, None, None, None, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["archive", "entry", "method", "packed", "size", "mtime", "content", "error"])


def zip_entries(archives: DataFrame) -> DataFrame:
    """The entries of ZIP archives (path, content): one row each; a file that is no archive gives one row with its error."""
    return archives.select("path", "content").mapInPandas(
        _entries, "archive string, entry string, method int, packed long, size long, mtime string, content binary, error string"
    )


def _toml(text: str | None) -> tuple[dict | None, str | None]:
    if text is None:
        return None, None
    try:
        import tomllib

        flat = {k: v if isinstance(v, str) else str(v) for k, v in tomllib.loads(text).items() if not isinstance(v, dict)}
        return flat, None
    except (ValueError, TypeError) as e:
        return None, str(e)


def manifest(text: str):
    """Column struct(values, error): top-level keys of a TOML manifest as strings, or why it does not parse."""

    @F.pandas_udf("struct<values:map<string,string>,error:string>")
    def parse(batch: pd.Series) -> pd.DataFrame:
        got = [_toml(t) for t in batch]
        return pd.DataFrame({"values": [v for v, _ in got], "error": [e for _, e in got]})

    return parse(text)


def packages(archives: DataFrame) -> DataFrame:
    """Rows for :func:`quillspan.operators.reconcile.package_verdict`: one per archive."""
    from quillspan.functions.bytes import jpeg_size, png_size

    e = zip_entries(archives)
    icon = F.col("entry").isin("icon.png", "icon.jpg")
    sized = e.withColumn("_m", F.when(F.col("entry") == "manifest.toml", F.decode("content", "ISO-8859-1"))).withColumn("_toml", manifest("_m"))
    jpeg, png = jpeg_size(F.when(icon, F.col("content"))), png_size(F.col("content"))
    width = F.when(F.col("entry") == "icon.png", png["width"]).otherwise(jpeg["width"].cast("bigint"))
    height = F.when(F.col("entry") == "icon.png", png["height"]).otherwise(jpeg["height"].cast("bigint"))
    sized = sized.withColumn(
        "_icon", F.when(icon, F.struct(F.col("entry").alias("path"), width.alias("width"), height.alias("height"), width.isNotNull().alias("valid")))
    )
    return sized.groupBy("archive").agg(
        F.regexp_extract(F.first("archive"), r"([^/]*)$", 1).alias("file_name"),
        (F.count("error") == 0).alias("is_zip"),
        F.collect_list(F.when(F.col("entry").isNotNull(), F.struct(F.col("entry").alias("path"), "method", "size"))).alias("entries"),
        F.max_by("_toml.values", F.col("_m").isNotNull()).alias("manifest"),
        F.max("_toml.error").alias("manifest_error"),
        F.min_by("_icon", F.when(F.col("_icon").isNotNull(), F.when(F.col("entry") == "icon.png", 0).otherwise(1))).alias("icon"),
    )
