"""Sidecars beside transcripts, and frames from an observer feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the sidecar files; never inferred.
PROVENANCE = (
    "schema string, source struct<path:string,uri:string,mime:string,sha256:string,last_modified:string>, "
    "master struct<path:string,mime:string,sha256:string,width:int,height:int>, xena struct<path:string,sha256:string,wrapper:string,payload_element:string>, "
    "exif struct<DateTime:string,Make:string,Model:string,Exif:struct<DateTimeOriginal:string>>, warnings array<string>"
)
OCR_META = (
    "schema string, engine string, backend string, options struct<lang:string,psm:int,oem:int,profile:string>, "
    "transform struct<scale:double,border:int,steps:array<string>>"
)
FRAME = "protocol string, type string, seq long, sample_rate_hz double, channel string, samples_uv array<double>, sent_at_unix_ms double"


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON sidecars, one document a file, keyed by their stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[A-Za-z]+)*\.json$", 1)
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("stem", stem)


def captured(exif: Column) -> Column:
    """When a picture was taken: the nested time, else the flat one."""
    return F.coalesce(F.nullif(exif["Exif"]["DateTimeOriginal"], F.lit("")), F.nullif(exif["DateTime"], F.lit("")))


def camera(exif: Column) -> Column:
    """Make and model, as far as known; null for neither."""
    return F.nullif(F.concat_ws(" ", F.nullif(exif["Make"], F.lit("")), F.nullif(exif["Model"], F.lit(""))), F.lit(""))


def frame_feed(spark: SparkSession, landing: str, gateway: str | None = None) -> DataFrame:
    """Frames that a gateway's messages left as JSON lines in ``landing``, as a stream. Only secure gateways are named."""
    if gateway is not None and not gateway.startswith("wss:"):
        raise ValueError("only wss: gateways")
    return spark.readStream.schema(FRAME).json(landing)


def with_defaults(given: Column, defaults: dict[str, str]) -> Column:
    """A map with default entries where keys are missing."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def bounded_tail(samples: Column, most: int) -> Column:
    """The last ``most`` values of a buffer."""
    kept = F.least(F.size(samples), F.lit(most))
    return F.when(kept > 0, F.slice(samples, -kept, kept)).otherwise(samples)
