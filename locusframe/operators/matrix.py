"""Taxon-by-locus matrices: complete, incomplete, losses, presence, occupancy, extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_sequence, reverse_complement


def matches_by_taxon(matches: DataFrame, taxa: Sequence[str] | None = None) -> DataFrame:
    """(taxon, uce) whose contig serves one locus only in that taxon."""
    m = matches if taxa is None else matches.where(F.col("taxon").isin(list(taxa)))
    one = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("taxon", "contig")))
    return one.where("n = 1").select("taxon", "uce")


def complete_matrix(by_taxon: DataFrame, n_taxa: int) -> DataFrame:
    """Loci that every one of ``n_taxa`` taxa has."""
    return by_taxon.groupBy("uce").agg(F.count_distinct("taxon").alias("n_taxa")).where(F.col("n_taxa") == n_taxa).select("uce")


def incomplete_matrix(by_taxon: DataFrame, loci: DataFrame) -> DataFrame:
    """Known loci that one taxon has at least."""
    return loci.select("uce").distinct().join(by_taxon.select("uce").distinct(), "uce", "left_semi")


def locus_losses(by_taxon: DataFrame, loci: DataFrame) -> DataFrame:
    """Per taxon, how many of all loci it lacks."""
    total = loci.select("uce").distinct().agg(F.count(F.lit(1)).alias("total"))
    have = by_taxon.groupBy("taxon").agg(F.count_distinct("uce").alias("have"))
    return have.crossJoin(F.broadcast(total)).select("taxon", (F.col("total") - F.col("have")).alias("lost"))  # one row


def missing_report(by_taxon: DataFrame, loci: DataFrame) -> DataFrame:
    """(taxon, uce) of the loci that a taxon lacks; one row for each lacking pair.

    The grid of taxa and loci is built from the (few) taxa as an array on each locus, so no cross join.
    """
    taxa = by_taxon.groupBy("uce").agg(F.collect_set("taxon").alias("have"))
    every = by_taxon.agg(F.collect_set("taxon").alias("all_taxa"))
    grid = loci.select("uce").distinct().join(taxa, "uce", "left").join(F.broadcast(every), F.lit(True))
    return grid.select(F.explode(F.array_except("all_taxa", F.coalesce("have", F.array().cast("array<string>")))).alias("taxon"), "uce")


def presence(records: DataFrame) -> DataFrame:
    """Distinct (locus, taxon): a taxon's second record of a locus counts once."""
    return records.select("locus", "taxon").distinct()


def presence_pivot(records: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """One row a locus, one 0/1 column a taxon."""
    return presence(records).groupBy("locus").pivot("taxon", list(taxa)).agg(F.first(F.lit(1))).fillna(0, list(taxa))


def shared_by_at_least(records: DataFrame) -> DataFrame:
    """(n_taxa, loci): loci that n taxa have at least, for every n that occurs."""
    per = presence(records).groupBy("locus").agg(F.count(F.lit(1)).alias("n_taxa"))
    counts = per.groupBy("n_taxa").agg(F.count(F.lit(1)).alias("exactly"))
    # one row for each number of taxa: as many as there are taxa at most
    return counts.select("n_taxa", F.sum("exactly").over(Window.orderBy(F.col("n_taxa").desc())).alias("loci"))


def specific_counts(records: DataFrame, base: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Loci of the base taxon that ``least`` taxa have at least, with counts, and per taxon how many of them it has."""
    p = presence(records)
    per = p.groupBy("locus").agg(F.count(F.lit(1)).alias("n_taxa"), F.max((F.col("taxon") == base).cast("int")).alias("in_base"))
    hits = per.where((F.col("n_taxa") >= least) & (F.col("in_base") == 1)).select("locus", "n_taxa")
    return hits, p.join(hits.select("locus"), "locus", "left_semi").groupBy("taxon").agg(F.count(F.lit(1)).alias("loci"))


def occupancy_cuts(n_taxa: int, low: float = 0.0, high: float = 1.0, step: float = 0.1) -> list[tuple[float, int]]:
    """(fraction, cut): fractions by repeated addition, cuts rounded half away from zero."""
    if not 0 < step <= 1 or low >= high:
        raise ValueError("the step must be in (0, 1] and low below high")
    out, f = [], low
    while f < high:
        out.append((f, int(n_taxa * f + 0.5)))
        f += step
    return out


def incomplete_matrix_estimates(flags: DataFrame, taxa: Sequence[str], low: float = 0.0, high: float = 1.0, step: float = 0.1) -> DataFrame:
    """Loci in each class of occupancy: (fraction, cut, loci).

    A locus belongs to the class below the first cut that exceeds its number of taxa; one below the first
    cut, or below none, belongs to the last class. A null flag counts as absent.
    """
    cuts = occupancy_cuts(len(taxa), low, high, step)
    count = sum((F.coalesce(F.col(f"`{t}`").cast("int"), F.lit(0)) for t in taxa), F.lit(0))
    first = F.lit(None).cast("int")
    for k in range(len(cuts) - 1, -1, -1):
        first = F.when(F.col("n") < cuts[k][1], F.lit(k)).otherwise(first)
    place = F.when(first.isNull() | (first == 0), F.lit(len(cuts) - 1)).otherwise(first - 1)
    counted = flags.select(count.alias("n")).select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("loci"))
    names = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(c).alias("cut")) for f, c in cuts])
    return counted.select(F.get(names, F.col("place"))["fraction"].alias("fraction"), F.get(names, F.col("place"))["cut"].alias("cut"), "loci")


def locus_extraction(matches: DataFrame, loci: DataFrame, contigs: DataFrame, strict: bool = False) -> DataFrame:
    """Cleaned, oriented sequences of the wanted loci: (taxon, locus, header, sequence).

    ``contigs`` has (taxon, contig, sequence); names are compared in lower case, and of several contigs of
    one name the first (by ``ord`` if there is one) counts. ``strict`` makes a missing contig an error.
    """
    order = F.col("ord") if "ord" in contigs.columns else F.lit(0)
    first = contigs.groupBy("taxon", F.lower("contig").alias("node")).agg(F.min_by("sequence", order).alias("sequence"))
    wanted = matches.join(loci.select("uce").distinct(), "uce", "left_semi").withColumn("node", F.lower("contig"))
    joined = wanted.join(first, ["taxon", "node"], "left" if strict else "inner")
    raw = F.coalesce("sequence", F.raise_error(F.concat(F.lit("no contig "), "contig")).cast("string")) if strict else F.col("sequence")
    clean = clean_sequence(raw)
    oriented = F.when(F.col("strand") == "-", reverse_complement(clean)).otherwise(clean)
    return joined.select("taxon", F.col("uce").alias("locus"), F.concat("uce", F.lit("_"), "taxon", F.lit(" |"), "uce").alias("header"), oriented.alias("sequence"))


def matrix_config(taxa: DataFrame, loci: DataFrame) -> DataFrame:
    """Lines of an ``[Organisms]`` / ``[Loci]`` file, sorted: (section, line)."""
    sorted_of = lambda df, c: df.agg(F.sort_array(F.collect_set(c)).alias("line"))
    both = sorted_of(taxa, "taxon").withColumn("section", F.lit("Organisms")).unionByName(sorted_of(loci, "uce").withColumn("section", F.lit("Loci")))
    return both.select("section", F.explode("line").alias("line"))


def union_databases(own: DataFrame, other: DataFrame) -> DataFrame:
    """Match tables of two studies as one; taxa of the other are marked with ``*``."""
    return own.unionByName(other.withColumn("taxon", F.concat("taxon", F.lit("*"))), allowMissingColumns=True)
