"""Which contig is which locus: one-to-one matching of hits with removal of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contig_name, contig_name_lenient, locus_name
from ..functions.names import PROBE_PATTERN


def all_named_hits(hits: DataFrame, pattern: str = PROBE_PATTERN) -> DataFrame:
    """(taxon, contig, fallback, locus, strand) of every hit; ``fallback`` tells that the contig's header has no known form."""
    return hits.select(
        "taxon",
        contig_name_lenient(F.col("name1")).alias("contig"),
        contig_name(F.col("name1")).isNull().alias("fallback"),
        locus_name(F.col("name2"), pattern).alias("locus"),
        F.col("strand2").alias("strand"),
    )


def named_hits(hits: DataFrame, pattern: str = PROBE_PATTERN) -> DataFrame:
    """Distinct (taxon, contig, fallback, locus, strand) of hits."""
    return all_named_hits(hits, pattern).distinct()


def without_probe_dupes(named: DataFrame, dupes: DataFrame | None) -> DataFrame:
    """Hits whose locus is no duplicate; ``dupes`` has the column locus."""
    return named if dupes is None else named.join(dupes.select("locus"), "locus", "left_anti")


def contigs_of_several_loci(named: DataFrame) -> DataFrame:
    """(taxon, contig, n_loci) of contigs that hit more than one locus."""
    return named.groupBy("taxon", "contig").agg(F.count_distinct("locus").alias("n_loci")).where("n_loci > 1")


def loci_of_several_contigs(named: DataFrame) -> DataFrame:
    """(taxon, locus, n_contigs) of loci that more than one contig hits."""
    return named.groupBy("taxon", "locus").agg(F.count_distinct("contig").alias("n_contigs")).where("n_contigs > 1")


def flagged_pairs(named: DataFrame) -> DataFrame:
    """Distinct (taxon, contig, locus) with the smallest strand, both counts, and whether it is the first of its locus and contig.

    A pair's contig is dropped if it hits several loci or any of its loci several contigs, so the counts
    are taken by windows over the pairs: no self-join, and ``named`` need not be distinct. Strands are one
    character, so their smallest is that of a number, by which Spark aggregates in hash tables.
    """
    pairs = named.groupBy("taxon", "contig", "locus").agg(F.min(F.ascii("strand")).alias("sign"))
    pairs = pairs.select("taxon", "contig", "locus", F.char(F.col("sign").cast("long")).alias("strand"))
    by_locus = Window.partitionBy("taxon", "locus")
    by_contig = Window.partitionBy("taxon", "contig")
    counted = pairs.withColumn("first_of_locus", F.row_number().over(by_locus.orderBy("contig")) == 1).withColumn("n_contigs", F.count(F.lit(1)).over(by_locus))
    counted = counted.withColumn("first_of_contig", F.row_number().over(by_contig.orderBy("locus")) == 1)
    return counted.withColumn("n_loci", F.count(F.lit(1)).over(by_contig)).withColumn("shared", F.max("n_contigs").over(by_contig))


def match_map(hits: DataFrame, dupes: DataFrame | None = None, pattern: str = PROBE_PATTERN, keep_shared: bool = False) -> DataFrame:
    """(uce, taxon, contig, strand): each taxon's one-to-one matches.

    With hits on both strands the strand is the smaller sign, ``+``. ``keep_shared`` keeps contigs of loci
    that several contigs hit.
    """
    pairs = flagged_pairs(without_probe_dupes(all_named_hits(hits, pattern), dupes))
    kept = pairs.where("n_loci = 1") if keep_shared else pairs.where("n_loci = 1 and shared = 1")
    return kept.select(F.col("locus").alias("uce"), "taxon", "contig", "strand")


def match_summary(hits: DataFrame, contigs: DataFrame, dupes: DataFrame | None = None, pattern: str = PROBE_PATTERN) -> DataFrame:
    """Per taxon: unique matches, contigs, loci dropped as probe duplicates or for several contigs, and contigs dropped for several loci.

    ``contigs`` has (taxon, total_contigs). All counts are of one table of pairs.
    """
    named = all_named_hits(hits, pattern)
    one = lambda c: F.count(F.when(c, 1))
    counts = flagged_pairs(without_probe_dupes(named, dupes)).groupBy("taxon").agg(
        one((F.col("n_loci") == 1) & (F.col("shared") == 1)).alias("unique_matches"),
        one(F.col("first_of_locus") & (F.col("n_contigs") > 1)).alias("loci_dropped"),
        one(F.col("first_of_contig") & (F.col("n_loci") > 1)).alias("contigs_dropped"),
    )
    out = contigs.join(counts, "taxon", "left")
    if dupes is not None:
        probe = named.join(dupes.select("locus"), "locus", "left_semi").groupBy("taxon").agg(F.count_distinct("locus").alias("probe_dupes"))
        out = out.join(probe, "taxon", "left")
    else:
        out = out.withColumn("probe_dupes", F.lit(0).cast("long"))
    return out.fillna(0, ["unique_matches", "probe_dupes", "loci_dropped", "contigs_dropped"]).select("taxon", "unique_matches", "total_contigs", "probe_dupes", "loci_dropped", "contigs_dropped")


def duplicates_report(named: DataFrame) -> DataFrame:
    """Per taxon and kind (contig or locus): each duplicated name with its partners, sorted and joined by commas.

    Only the pairs of duplicated names are gathered, both kinds together.
    """
    contig = F.when(F.col("n_loci") > 1, F.struct(F.lit("contig").alias("kind"), F.col("contig").alias("name"), F.col("locus").alias("partner")))
    locus = F.when(F.col("n_contigs") > 1, F.struct(F.lit("locus").alias("kind"), F.col("locus").alias("name"), F.col("contig").alias("partner")))
    listed = flagged_pairs(named).where("n_loci > 1 or n_contigs > 1").select("taxon", F.explode(F.array_compact(F.array(contig, locus))).alias("x"))
    partners = F.array_join(F.sort_array(F.collect_set("x.partner")), ",").alias("partners")
    return listed.groupBy("taxon", F.col("x.kind").alias("kind"), F.col("x.name").alias("name")).agg(partners).select("taxon", "kind", "name", "partners")


def probe_self_dupes(self_hits: DataFrame, pattern: str = PROBE_PATTERN) -> DataFrame:
    """Loci of probes that hit other loci's probes, lower-cased.

    A target with several hits flags itself and every other locus among them; with a single foreign hit it
    flags only itself.
    """
    named = self_hits.select(locus_name(F.col("name1"), pattern).alias("target"), locus_name(F.col("name2"), pattern).alias("query"))
    counts = named.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    foreign = named.where("target <> query").join(counts, "target")
    flagged = foreign.select(F.explode(F.when(F.col("n") > 1, F.array("target", "query")).otherwise(F.array("target"))).alias("locus"))
    return flagged.select(F.lower("locus").alias("locus")).distinct()


def probe_self_dupes_by_name(self_hits: DataFrame) -> DataFrame:
    """The same rule over raw names (the text before ``|``, trimmed) without a pattern."""
    raw = lambda c: F.trim(F.split_part(F.col(c), F.lit("|"), F.lit(1)))
    named = self_hits.select(raw("name1").alias("target"), raw("name2").alias("query"))
    counts = named.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    foreign = named.where("target <> query").join(counts, "target")
    return foreign.select(F.explode(F.when(F.col("n") > 1, F.array("target", "query")).otherwise(F.array("target"))).alias("name")).distinct()


def probes_without_dupes(probes: DataFrame, dupes: DataFrame, pattern: str = PROBE_PATTERN) -> DataFrame:
    """Probe records (id, ...) whose locus is no duplicate."""
    return probes.withColumn("locus", locus_name(F.col("id"), pattern)).join(dupes.select("locus"), "locus", "left_anti")


def bed_without_dupes(bed: DataFrame, dupes: DataFrame, pattern: str = PROBE_PATTERN, names_are_loci: bool = False) -> DataFrame:
    """Intervals whose locus is no duplicate: of probes, by the pattern, or of loci, by their names."""
    locus = F.col("name") if names_are_loci else locus_name(F.col("name"), pattern)
    return bed.withColumn("__locus", locus).join(dupes.select(F.col("locus").alias("__locus")).distinct(), "__locus", "left_anti").drop("__locus")


def assembly_contigs(wanted: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ord, header, sequence) of listed contigs; ``wanted`` has (ord, assembly, contig), ``contigs`` (assembly, contig, sequence).

    An assembly's name ends before ``|``; the taxon in the header is what comes before its first dot, hyphens
    as underscores. Lines of assemblies that can't be read are left out; a contig that its assembly lacks is an
    error.
    """
    named = wanted.withColumn("assembly", F.split_part("assembly", F.lit("|"), F.lit(1)))
    known = contigs.select("assembly").distinct()
    found = named.join(known, "assembly", "left_semi").join(contigs.withColumn("__there", F.lit(True)), ["assembly", "contig"], "left")
    lost = F.raise_error(F.concat(F.lit("no contig "), "contig", F.lit(" in "), "assembly")).cast("string")
    taxon = F.translate(F.split_part("assembly", F.lit("."), F.lit(1)), "-", "_")
    return found.select("ord", F.concat(taxon, F.lit("|"), F.when(F.col("__there"), F.col("contig")).otherwise(lost)).alias("header"), "sequence")


def pivot_matches(matches: DataFrame, taxa: list[str], value: str = "flag") -> DataFrame:
    """The wide table: one row a locus and one column a taxon, 0/1 flags or ``contig(strand)``."""
    cell = F.lit(1) if value == "flag" else F.concat("contig", F.lit("("), "strand", F.lit(")"))
    wide = matches.groupBy("uce").pivot("taxon", taxa).agg(F.first(cell))
    return wide.fillna(0, taxa) if value == "flag" else wide


def slice_barcodes(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """The part of each contig that a barcode hit covers, turned to the barcode's strand.

    ``hits``: name1 (contig), name2, zstart1, end1, strand2; ``contigs``: id, sequence.
    """
    from ..functions import reverse_complement_upper

    joined = hits.join(contigs.withColumnRenamed("id", "name1"), "name1")
    part = F.substring(F.col("sequence"), F.col("zstart1") + 1, F.col("end1") - F.col("zstart1"))
    return joined.select("name1", "name2", "strand2", F.when(F.col("strand2") == "-", reverse_complement_upper(part)).otherwise(F.upper(part)).alias("sequence"))
