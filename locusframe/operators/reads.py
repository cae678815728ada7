"""Read files and records: lengths, numbering, pairing, classes, sampling plans, archive records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import capitalise_first, ungap

# How names of read files end.
READ_PATTERNS = {"r1": r"(?i)[._-](?:R1|READ1)(?:[._-].*)?\.f(?:ast)?q(?:\.gz)?$", "r2": r"(?i)[._-](?:R2|READ2)(?:[._-].*)?\.f(?:ast)?q(?:\.gz)?$", "singleton": r"(?i)[._-](?:singletons?|unpaired|single)(?:[._-].*)?\.f(?:ast)?q(?:\.gz)?$"}


def length_report(lengths: DataFrame, by: str | None = "file", long_from: int | None = 1000) -> DataFrame:
    """Records, total, mean, standard error, extremes and median of ``n``, and how many are ``long_from`` at least."""
    n = F.count("n")
    out = [n.alias("reads"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.when(n > 1, F.stddev_samp("n") / F.sqrt(n)).alias("sem"), F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", F.lit(0.5)).alias("median")]
    if long_from is not None:
        out.append(F.count_if(F.col("n") >= long_from).alias("long"))
    return lengths.groupBy(by).agg(*out) if by else lengths.agg(*out)


def chunk_records(records: DataFrame, size: int = 10_000) -> DataFrame:
    """``chunk`` (from 0) of every record: every ``size`` records of a file by their order."""
    return records.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1) / size).cast("long"))


def unmix_reads(records: DataFrame, new_style: bool = False) -> DataFrame:
    """Records (id, ...) with pair, mate and kind: r1, r2 or singleton.

    Mates are neighbours in name order: ``x/1`` then ``x/2``, or ``x 1:..`` then ``x 2:..``.
    """
    pattern = r"^(\S+)\s+([12])(?::.*)?$" if new_style else r"^(\S+)/([12])$"
    named = records.withColumn("pair", F.regexp_extract("id", pattern, 1)).withColumn("mate", F.regexp_extract("id", pattern, 2))
    order = Window.partitionBy("pair").orderBy("mate", "id")
    kind = (
        F.when((F.col("mate") == "1") & (F.lead("mate").over(order) == "2") & (F.col("pair") != ""), "r1")
        .when((F.col("mate") == "2") & (F.lag("mate").over(order) == "1") & (F.col("pair") != ""), "r2")
        .otherwise("singleton")
    )
    return named.withColumn("kind", kind)


def read_class(name: Column) -> Column:
    """r1, r2, singleton or null by a read file's name."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(READ_PATTERNS.items()):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def classify_reads(files: DataFrame) -> DataFrame:
    """One row a folder with its r1, r2 and singleton file; ``n_*`` above 1 means duplicates.

    ``files`` has folder and name.
    """
    known = files.withColumn("kind", read_class(F.col("name"))).where("kind is not null")
    return known.groupBy("folder").agg(*[x for k in READ_PATTERNS for x in (F.min(F.when(F.col("kind") == k, F.col("name"))).alias(k), F.count_if(F.col("kind") == k).alias(f"n_{k}"))])


# Endings of contig files, in the order in which they are tried.
CONTIG_ENDINGS = (".fa", ".fasta", ".contigs.fasta", ".contigs.fa", ".gz", ".fasta.gz", ".fa.gz")


def contig_files(taxa: DataFrame, files: DataFrame) -> DataFrame:
    """(taxon, name): the contig file of each taxon; ``files`` has (name). A taxon without one is an error.

    Endings come first, then the name as it is, the name with hyphens for underscores or the other way round,
    and either in lower case; the first file that is there counts.
    """
    swapped = F.when(F.col("taxon").contains("-"), F.translate("taxon", "-", "_")).otherwise(F.translate("taxon", "_", "-"))
    tried = [x for ending in CONTIG_ENDINGS for stem in (F.col("taxon"), swapped) for name in (F.concat(stem, F.lit(ending)),) for x in (name, F.lower(name))]
    asked = taxa.select("taxon", F.posexplode(F.array(*tried)).alias("place", "name"))
    found = asked.join(files.select("name").distinct(), "name").groupBy("taxon").agg(F.min(F.struct("place", "name")).alias("x"))
    missing = F.raise_error(F.concat(F.lit("no contig file of "), "taxon")).cast("string")
    return taxa.select("taxon").distinct().join(found, "taxon", "left").select("taxon", F.coalesce("x.name", missing).alias("name"))


def sample_plan(files: DataFrame, wanted: int) -> DataFrame:
    """Per folder and class, the proportion to sample so that ``wanted`` reads come out of all classes together.

    ``files`` has folder, kind, reads; at most all reads of a class are taken.
    """
    whole = Window.partitionBy("folder")
    return files.withColumn("proportion", F.least(F.lit(1.0), F.lit(float(wanted)) / F.sum("reads").over(whole)))


def sample_reads(records: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Records (folder, kind, id) kept by a hash of seed and pair name, so mates stay together."""
    share = (F.pmod(F.xxhash64(F.lit(seed), F.regexp_replace("id", r"/[12]$", "")), F.lit(1 << 30)) / float(1 << 30))
    return records.join(plan.select("folder", "kind", "proportion"), ["folder", "kind"]).where(share < F.col("proportion")).drop("proportion")


def merge_plan(files: DataFrame) -> DataFrame:
    """(target, ord, name): which files, in order, make up each sample's read file; ``files`` has sample and name."""
    kind = read_class(F.col("name"))
    named = files.withColumn("kind", kind).where("kind is not null").withColumn("target", F.concat("sample", F.lit("-"), F.upper("kind"), F.lit(".fastq.gz")))
    return named.withColumn("ord", F.row_number().over(Window.partitionBy("target").orderBy("name")) - 1).select("target", "ord", "name")


def archive_records(aln: DataFrame, species: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Numbered submission records (number, id, organism, sequence) in order of locus and row.

    Numbers come from counts of each locus and a place inside it, so only one short row a locus is ordered globally.
    """
    rows = aln.where(~F.col("taxon").isin(list(exclude))) if exclude else aln
    if species:
        table = F.create_map(*[F.lit(x) for kv in species.items() for x in kv])
        rows = rows.withColumn("taxon", F.coalesce(F.try_element_at(table, F.col("taxon")), F.col("taxon")))
    rows = rows.withColumn("sequence", F.upper(ungap(F.col("seq")))).where("sequence <> ''")
    per = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.orderBy("locus")) - F.col("n")).select("locus", "before")
    place = F.row_number().over(Window.partitionBy("locus").orderBy("row_ord", "taxon")) - 1
    numbered = rows.join(before, "locus").withColumn("number", F.col("before") + place)
    parts = F.split("taxon", "_")
    code = F.concat(F.upper(F.left(parts[0], F.lit(1))), F.lower(F.substring(parts[0], 2, 2)))
    return numbered.select("number", F.concat(code, F.lit("_"), F.col("number").cast("string")).alias("id"), capitalise_first(F.replace(F.col("taxon"), F.lit("_"), F.lit(" "))).alias("organism"), "locus", "sequence")
