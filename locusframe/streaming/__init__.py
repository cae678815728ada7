"""Structured Streaming over folders of hit files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contig_name_lenient, locus_name, taxon_from_file
from ..sources.hits import hit_schema, typed_hits


def stream_hits(spark: SparkSession, folder: str, long: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Hits of files as they appear, with their taxon."""
    reader = spark.readStream.option("sep", "\t").option("quote", "").option("maxFilesPerTrigger", files_per_trigger).schema(hit_schema(long))
    raw = reader.csv(folder).select("*", F.col("_metadata.file_path").alias("file"))
    return typed_hits(raw).withColumn("taxon", taxon_from_file(F.col("file"))).drop("file")


def running_matches(hits: DataFrame) -> DataFrame:
    """(taxon, contig, locus): each pair once, whatever the number of its hits; the state is the pairs seen."""
    named = hits.select("taxon", contig_name_lenient(F.col("name1")).alias("contig"), locus_name(F.col("name2")).alias("locus"))
    return named.dropDuplicates(["taxon", "contig", "locus"])


def running_counts(hits: DataFrame) -> DataFrame:
    """Hits and their mean identity by taxon; to be written in update or complete mode."""
    return hits.groupBy("taxon").agg(F.count(F.lit(1)).alias("hits"), F.avg("percent_identity").alias("mean_identity"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by time window and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
