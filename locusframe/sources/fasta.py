"""FASTA and FASTQ files (plain or gzip) as DataFrames, by Spark's own text reader.

A record separator of a newline and ``>`` lets Spark split plain files; a file's order is kept as the byte
offset of the block and the place in it, so ``ord`` sorts a file's records. Lines are numbered block by block,
so a large plain file is never one task's; a gzip file is one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in the file, from 0: the lines of the blocks before, and the place in the block."""
    lines = _lines(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    passed = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("ord")) - 1
    return lines.withColumn("place", place).join(passed, ["file", "block"]).withColumn("line", F.col("passed") + F.col("place"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, id, description, sequence): the description is the whole header; sequence lines are trimmed and joined.

    Text before the first header is an error, as is a header without a name.
    """
    raw = _lines(spark, path, "\n>").where(F.trim("value") != "")
    # only a file's first record keeps its mark, and it is in the file's first block
    first = F.row_number().over(Window.partitionBy("file").orderBy("ord")) == 1
    marked = raw.where("block = 0").withColumn("first", first).unionByName(raw.where("block > 0").withColumn("first", F.lit(False)))
    body = F.when(~F.col("first"), F.col("value")).when(F.ltrim("value").startswith(">"), F.substring(F.ltrim("value"), 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("data before the first header in "), "file")).cast("string"))
    cut = marked.select("file", "ord", F.split(body, "\n", 2).alias("p"))
    header = F.rtrim(F.translate(F.col("p")[0], "\r", ""))
    sequence = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "")
    named = F.when(F.trim(header) == "", F.raise_error(F.concat(F.lit("a record without a name in "), "file")).cast("string")).otherwise(header)
    return cut.select("file", "ord", F.split(F.ltrim(named), r"\s+")[0].alias("id"), named.alias("description"), sequence.alias("sequence"))


def fasta_lengths(records: DataFrame) -> DataFrame:
    return records.select("file", "id", F.length("sequence").alias("n"))


def count_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(file, contigs): lines that begin with ``>``."""
    return _lines(spark, path).groupBy("file").agg(F.count_if(F.col("value").startswith(">")).alias("contigs"))


def validate_fasta(spark: SparkSession, path: str, alphabet: str = "ACGTRYSWKMBDHVNXacgtryswkmbdhvnx-?.*") -> DataFrame:
    """(file, line, message): data before a header, records without name or sequence, characters outside the alphabet."""
    order = Window.partitionBy("file").orderBy("ord")
    numbered = _lines(spark, path).withColumn("line", F.row_number().over(order)).withColumn("text", F.trim("value"))
    header = F.col("text").startswith(">")
    ahead = numbered.where("text <> ''").withColumn("next", F.lead("text").over(order)).withColumn("headers", F.sum(header.cast("int")).over(order))
    bad = "[^" + "".join("\\" + c if not c.isalnum() else c for c in alphabet) + "]"
    problems = F.array_compact(
        F.array(
            F.when(~header & (F.col("headers") == 0), "data before the first header"),
            F.when(header & (F.trim(F.substring("text", 2, 1 << 30)) == ""), "header without a name"),
            F.when(header & (F.col("next").isNull() | F.col("next").startswith(">")), "empty sequence"),
            F.when(~header & F.col("text").rlike(bad), "character outside the alphabet"),
        )
    )
    return ahead.select("file", "line", F.explode(problems).alias("message"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_no, id, seq): the first word of every fourth line's successor; qualities are passed over."""
    at = _numbered(spark, path).select("file", F.floor(F.col("line") / 4).alias("read_no"), (F.col("line") % 4).alias("part"), "value").where("part < 2")
    both = at.groupBy("file", "read_no").agg(F.max(F.when(F.col("part") == 0, F.col("value"))).alias("head"), F.max(F.when(F.col("part") == 1, F.col("value"))).alias("line"))
    return both.where("line is not null").select("file", "read_no", F.substring("head", 2, 1 << 30).alias("id"), F.split(F.ltrim("line"), r"\s+")[0].alias("seq"))


def fastq_lengths(reads: DataFrame) -> DataFrame:
    return reads.select("file", F.col("read_no"), F.length("seq").alias("n"))


def count_reads(spark: SparkSession, path: str) -> DataFrame:
    """(file, reads): a quarter of the lines, rounded down."""
    return _lines(spark, path).groupBy("file").agg(F.floor(F.count(F.lit(1)) / 4).alias("reads"))
