"""BED intervals of three, four or nine columns; ``track`` lines are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(track|browser|#)") & (F.trim("value") != ""))
    p = F.split("value", "\t")
    return lines.select(p[0].alias("chromo"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"), F.get(p, F.lit(3)).alias("name"))


def bed_lines(bed: DataFrame, colour: str | None = None) -> DataFrame:
    """Lines of four columns, or of nine with a colour."""
    tail = [] if colour is None else [F.lit(x) for x in ("450", "+", "0", "0", colour)]
    return bed.select(F.concat_ws("\t", "chromo", F.col("start").cast("string"), F.col("end").cast("string"), "name", *tail).alias("value"))
