"""Per-column statistics of alignments.

Two forms give the same numbers. The cell form explodes sequences into (locus, pos, row, character) and is
all built-in aggregation; every character becomes a row, so it suits moderate alignments. The kernel form
reads a locus's rows once in an Arrow batch and counts with numpy; it is for many or long loci.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The characters that a statistic passes over.
NOT_INFORMATIVE = ("-", "N", "?")
NOT_DIFFERENT = ("-", "N", "?", "X")
#: Candidates that win a tie for the major allele.
MAJOR_CANDIDATES = tuple("acgtryswkmbdhv")


def cells(aln: DataFrame, keep: tuple[str, ...] = ("row_ord", "taxon")) -> DataFrame:
    """(locus, pos, ch, ...): one row for each character; positions from 0."""
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    return aln.select("locus", *keep, F.posexplode(chars).alias("pos", "ch"))


def column_states(aln: DataFrame) -> DataFrame:
    """(locus, pos, ch, n) with upper-cased characters."""
    return cells(aln, ()).groupBy("locus", "pos", F.upper("ch").alias("ch")).agg(F.count(F.lit(1)).alias("n"))


def site_statistics(aln: DataFrame) -> DataFrame:
    """Per locus: length, informative, differences and counted sites.

    Informative: two states at least that two rows have each (not ``- N ?``). Different: two states at least
    (not X either). Counted: different, or one state that two rows have.
    """
    informative, different = ~F.col("ch").isin(*NOT_INFORMATIVE), ~F.col("ch").isin(*NOT_DIFFERENT)
    per = column_states(aln).groupBy("locus", "pos").agg(
        F.count_if(informative & (F.col("n") >= 2)).alias("often"), F.count_if(different).alias("states"), F.coalesce(F.max(F.when(different, F.col("n"))), F.lit(0)).alias("most")
    )
    return per.groupBy("locus").agg(
        F.count(F.lit(1)).alias("length"),
        F.count_if(F.col("often") >= 2).alias("informative"),
        F.count_if(F.col("states") >= 2).alias("differences"),
        F.count_if((F.col("states") >= 2) | ((F.col("states") == 1) & (F.col("most") > 1))).alias("counted"),
    )


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    rows = rows.sort_values("row_ord", kind="stable")
    return np.stack([np.frombuffer(s.upper().encode("latin-1"), np.uint8) for s in rows["seq"]])


def site_statistics_kernel(aln: DataFrame) -> DataFrame:
    """The same as :func:`site_statistics` by one numpy pass for each locus; rows of unequal length are an error."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows)
        states = np.unique(m)
        n = np.stack([(m == s).sum(0) for s in states])
        informative = ~np.isin(states, [ord(c) for c in NOT_INFORMATIVE])
        different = ~np.isin(states, [ord(c) for c in NOT_DIFFERENT])
        often = (n[informative] >= 2).sum(0)
        kinds, most = (n[different] > 0).sum(0), n[different].max(0, initial=0)
        return pd.DataFrame(
            {"locus": [rows["locus"].iloc[0]], "length": [m.shape[1]], "informative": [int((often >= 2).sum())], "differences": [int((kinds >= 2).sum())], "counted": [int(((kinds >= 2) | ((kinds == 1) & (most > 1))).sum())]}
        )

    return aln.select("locus", "row_ord", "seq").groupBy("locus").applyInPandas(count, "locus string, length long, informative long, differences long, counted long")


def character_totals(aln: DataFrame, by_locus: bool = True) -> DataFrame:
    """How often each upper-cased character occurs, per locus or in all."""
    keys = ["locus"] if by_locus else []
    return cells(aln, ()).groupBy(*keys, F.upper("ch").alias("ch")).agg(F.count(F.lit(1)).alias("n"))


def align_summary(aln: DataFrame) -> DataFrame:
    """Per locus: taxa, length, sites, GC per cent (gaps alone aren't in the denominator), gaps and the four bases."""
    gc = F.sum(F.when(F.col("ch").isin("G", "C"), F.col("n")).otherwise(0))
    rest = F.sum(F.when(F.col("ch") != "-", F.col("n")).otherwise(0))
    of = lambda c: F.sum(F.when(F.col("ch") == c, F.col("n")).otherwise(0))
    chars = character_totals(aln).groupBy("locus").agg(
        F.when(rest == 0, F.lit(0.0)).otherwise(F.round(gc / rest * 100, 2)).alias("gc_percent"), of("-").alias("gaps"), of("A").alias("a"), of("C").alias("c"), of("G").alias("g"), of("T").alias("t")
    )
    taxa = aln.groupBy("locus").agg(F.count(F.lit(1)).alias("taxa"))
    return site_statistics(aln).join(chars, "locus").join(taxa, "locus")


def confidence_95(column: str) -> F.Column:
    """1.96 standard errors; NaN for one value."""
    n = F.count(column)
    return F.when(n > 1, 1.96 * F.stddev_samp(column) / F.sqrt(n)).otherwise(F.lit(float("nan")))


def aggregate_summary(summary: DataFrame) -> DataFrame:
    """One row over all loci: sums, means, 95 % intervals, extremes of lengths, sites and taxa."""
    out = [F.count(F.lit(1)).alias("loci")]
    for c in ("length", "informative", "differences", "counted", "taxa"):
        out += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"), confidence_95(c).alias(f"{c}_ci"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return summary.agg(*out)


def occupancy_series(aln: DataFrame) -> DataFrame:
    """(percent, min_taxa, loci) for 50 % to 95 %: loci with ceil((p - 0.01) * most taxa) taxa at least."""
    per = aln.groupBy("locus").agg(F.count(F.lit(1)).alias("taxa"))
    by = per.groupBy("taxa").agg(F.count(F.lit(1)).alias("loci"))  # as many rows as there are numbers of taxa
    most = by.agg(F.max("taxa").alias("most")).select("most", F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5))).alias("percent"))
    wanted = most.select("percent", F.ceil((F.col("percent") / 100.0 - 0.01) * F.col("most")).alias("min_taxa"))
    joined = by.join(F.broadcast(wanted), F.col("taxa") >= F.col("min_taxa"), "right")  # ten rows
    return joined.groupBy("percent", "min_taxa").agg(F.coalesce(F.sum("loci"), F.lit(0)).alias("loci"))


def taxa_histogram(aln: DataFrame) -> DataFrame:
    return aln.groupBy("locus").agg(F.count(F.lit(1)).alias("taxa")).groupBy("taxa").agg(F.count(F.lit(1)).alias("loci"))


def taxon_locus_counts(aln: DataFrame) -> DataFrame:
    """Per taxon, alignments in which its row has more than one kind of character."""
    varied = F.length(F.replace(F.col("seq"), F.left("seq", F.lit(1)), F.lit(""))) > 0
    return aln.groupBy("taxon").agg(F.count_if(F.coalesce(varied, F.lit(False))).alias("loci"))


def consensus_majority(aln: DataFrame) -> DataFrame:
    """Per locus: the most frequent upper-cased character of each column, gaps too, ties to the first row's; N below a half."""
    per = cells(aln).groupBy("locus", "pos", F.upper("ch").alias("ch")).agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("first"))
    best = per.groupBy("locus", "pos").agg(F.max_by("ch", F.struct(F.col("n"), -F.col("first"))).alias("ch"), F.max("n").alias("n"), F.sum("n").alias("rows"))
    return _joined(best.withColumn("ch", F.when(F.col("n") / F.col("rows") >= 0.5, F.col("ch")).otherwise("N")))


def consensus_threshold(aln: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per locus: the single most frequent character other than ``-`` and ``.`` where it has that share, else X."""
    per = cells(aln, ()).groupBy("locus", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    real = ~F.col("ch").isin("-", ".")
    top = per.groupBy("locus", "pos").agg(F.sum(F.when(real, F.col("n"))).alias("all"), F.max(F.when(real, F.col("n"))).alias("most"))
    best = per.where(real).join(top, ["locus", "pos"]).where("n = most").groupBy("locus", "pos").agg(F.count(F.lit(1)).alias("tied"), F.first("ch").alias("ch"))
    chosen = F.when((F.col("tied") == 1) & (F.col("most") / F.col("all") >= threshold), F.col("ch")).otherwise("X")
    return _joined(top.join(best, ["locus", "pos"], "left").withColumn("ch", chosen))


def _joined(columns: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return columns.groupBy("locus").agg(F.array_join(F.transform(ordered, lambda x: x["ch"]), "").alias("consensus"))


def alleles(aln: DataFrame) -> DataFrame:
    """Every cell against its column's major allele: (locus, taxon, pos, type, position_from_center).

    End gaps are missing, as are n and ?; a gap elsewhere is an allele. Ties go to the first candidate code,
    else to the first tied character. ``type`` is null for missing cells.
    """
    from ..functions import end_gaps_to_missing

    lengths = aln.groupBy("locus").agg(F.max(F.length("seq")).alias("length"))
    c = cells(aln.withColumn("seq", F.lower(end_gaps_to_missing(F.col("seq")))))
    missing = F.col("ch").isin("n", "?")
    per = c.where(~missing).groupBy("locus", "pos", "ch").agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("first"))
    major = per.groupBy("locus", "pos").agg(F.max_by("ch", F.struct(F.col("n"), F.col("ch").isin(*MAJOR_CANDIDATES).cast("int"), -F.col("first"))).alias("major"))
    kind = (
        F.when(missing, F.lit(None).cast("string"))
        .when(F.col("ch") == F.col("major"), "majallele")
        .when(F.col("major") == "-", "insertion")
        .when(F.col("ch") == "-", "deletion")
        .otherwise("substitution")
    )
    return c.join(major, ["locus", "pos"], "left").join(lengths, "locus").select("locus", "taxon", "pos", kind.alias("type"), (F.col("pos") - F.col("length") / 2.0).alias("position_from_center"))


def allele_sites(typed: DataFrame) -> DataFrame:
    """Per locus and position: counts of each type, bases (cells that aren't missing) and missing cells."""
    count = lambda t: F.count_if(F.coalesce(F.col("type") == t, F.lit(False)))
    return typed.groupBy("locus", "pos", "position_from_center").agg(
        count("majallele").alias("majallele"), count("substitution").alias("substitutions"), count("deletion").alias("deletions"), count("insertion").alias("insertions"), F.count_if(F.col("type").isNull()).alias("missing"), F.count("type").alias("bases")
    )


def substitution_profile(sites: DataFrame) -> DataFrame:
    """Substitutions over bases by distance from the centre, where there are any."""
    out = sites.groupBy("position_from_center").agg(F.sum("substitutions").alias("substitutions"), F.sum("bases").alias("bp"))
    return out.where("substitutions <> 0").select("substitutions", "bp", (F.col("substitutions").cast("double") / F.col("bp")).alias("freq"), "position_from_center")


def missing_profile(sites: DataFrame) -> DataFrame:
    """Missing cells over all by distance from the centre, where some are present."""
    out = sites.groupBy("position_from_center").agg(F.sum("bases").alias("present"), F.sum("missing").alias("absent"))
    return out.where("present <> 0").select("present", "absent", (F.col("absent").cast("double") / (F.col("absent") + F.col("present"))).alias("freq"), "position_from_center")


def with_rank(df: DataFrame, by: str, name: str = "ord") -> DataFrame:
    """Ranks from 0 inside a locus."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("locus").orderBy(by)) - 1)
