"""Tab-separated alignment hits of 17 or 19 fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxon_from_file

_SHORT = (
    "score string, name1 string, strand1 string, zstart1 long, end1 long, length1 long, name2 string, strand2 string, zstart2 long, end2 long, length2 long, "
    "diff string, cigar string, identity string, percent_identity string, continuity string, percent_continuity string"
)
_LONG = _SHORT + ", coverage string, percent_coverage string"


def hit_schema(long: bool = False) -> str:
    return _LONG if long else _SHORT


def typed_hits(raw: DataFrame) -> DataFrame:
    """Names without their ``>`` and percentages as numbers."""
    out = raw
    for c in ("name1", "name2"):
        out = out.withColumn(c, F.regexp_replace(c, "^>", ""))
    for c in out.columns:
        if c.startswith("percent_"):
            out = out.withColumn(c, F.rtrim(F.col(c), F.lit("%")).cast("double"))
    return out


def read_hits(spark: SparkSession, path: str, long: bool = False, strict: bool = True) -> DataFrame:
    """Hits with the taxon of their file. ``strict``: a malformed line is an error; else it is in ``_corrupt_record``."""
    schema = hit_schema(long) + ("" if strict else ", _corrupt_record string")
    reader = spark.read.option("sep", "\t").option("quote", "").option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(schema)
    raw = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    return typed_hits(raw).withColumn("taxon", taxon_from_file(F.col("file"))).drop("file")
