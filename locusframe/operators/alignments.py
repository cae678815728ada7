"""Filters, recodings and reshaping of alignments (locus, row_ord, taxon, seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import degenerate_to_n, ry_binary, ry_recode, strip_locus_prefix, ungap

_EMPTY = r"^(\?*|-*)$"


def violations(aln: DataFrame) -> DataFrame:
    """(locus, problem): rows without a name, repeated taxa, rows of unequal length."""
    bad_name = aln.where(F.coalesce(F.col("taxon"), F.lit("")) == "").select("locus", F.lit("empty taxon").alias("problem"))
    repeated = aln.groupBy("locus", "taxon").count().where("count > 1").select("locus", F.concat(F.lit("repeated taxon "), F.col("taxon")).alias("problem"))
    unequal = aln.groupBy("locus").agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b")).where("a <> b").select("locus", F.lit("unequal lengths").alias("problem"))
    return bad_name.union(repeated).union(unequal).distinct()


def filter_alignments(aln: DataFrame, with_data: Sequence[str] = (), min_length: int = 0, min_taxa: int = 0) -> DataFrame:
    """Alignments in which any of the named taxa has data, long enough, with enough taxa that have data; 0 turns a test off."""
    full = (F.length("seq") > 0) & ~F.col("seq").rlike(_EMPTY)
    tests = aln.groupBy("locus").agg(F.max(F.length("seq")).alias("nchar"), F.count_if(full).alias("full"), F.bool_or(F.col("taxon").isin(list(with_data)) & full).alias("named"))
    ok = F.lit(True)
    if with_data:
        ok = ok & F.col("named")
    if min_length:
        ok = ok & (F.col("nchar") >= min_length)
    if min_taxa:
        ok = ok & (F.col("full") >= min_taxa)
    return aln.join(tests.where(ok).select("locus"), "locus", "left_semi")


def loci_with_min_taxa(aln: DataFrame, taxa: int, percent: float = 0.75) -> DataFrame:
    """Loci with floor(percent * taxa) rows at least."""
    return aln.groupBy("locus").agg(F.count(F.lit(1)).alias("n_taxa")).where(F.col("n_taxa") >= F.floor(F.lit(percent * taxa)))


def screen_problems(aln: DataFrame, screen_n: bool = True, screen_x: bool = True) -> DataFrame:
    """Alignments without N or X (in either case) in any row."""
    wanted = ("Nn" if screen_n else "") + ("Xx" if screen_x else "")
    if not wanted:
        return aln
    return aln.join(aln.where(F.col("seq").rlike(f"[{wanted}]")).select("locus").distinct(), "locus", "left_anti")


def remove_empty_taxa(aln: DataFrame) -> DataFrame:
    """Without rows that are empty, all gaps or all ``?``; a mix of both stays."""
    return aln.where(~F.col("seq").rlike(_EMPTY))


def extract_taxa(aln: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of some taxa, or of all but some; alignments with more than one row left."""
    if bool(include) == bool(exclude):
        raise ValueError("give either taxa to include or taxa to exclude")
    kept = aln.where(F.col("taxon").isin(list(include))) if include else aln.where(~F.col("taxon").isin(list(exclude)))
    return kept.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("locus"))).where("__n > 1").drop("__n")


def extract_taxon(aln: DataFrame, taxon: str) -> DataFrame:
    """One taxon's ungapped, upper-cased sequences by locus; empty ones go."""
    return aln.where(F.col("taxon") == taxon).select(F.col("locus").alias("id"), ungap(F.col("seq"), upper=True).alias("sequence")).where("sequence <> ''")


def move_by_names(aln: DataFrame, names: DataFrame, opposite: bool = False) -> DataFrame:
    """Alignments whose lower-cased file name is listed; ``opposite``: whose stem is not."""
    listed = names.select(F.lower("name").alias("__name")).distinct()
    if opposite:
        keyed = aln.withColumn("__name", F.lower("locus"))
        return keyed.join(listed, "__name", "left_anti").drop("__name")
    return aln.withColumn("__name", F.lower("file")).join(listed, "__name", "left_semi").drop("__name")


def recode_ry(aln: DataFrame, binary: bool = False) -> DataFrame:
    return aln.withColumn("seq", ry_binary(F.col("seq")) if binary else ry_recode(F.col("seq")))


def convert_degenerate(aln: DataFrame) -> DataFrame:
    return aln.withColumn("seq", degenerate_to_n(F.col("seq")))


def remove_locus_names(aln: DataFrame, stem: str = "locus") -> DataFrame:
    return aln.withColumn("taxon", strip_locus_prefix(F.col("taxon"), F.col(stem)))


def explode_alignments(aln: DataFrame, names: dict[str, str] | None = None, exclude: Sequence[str] = (), with_locus: bool = False) -> DataFrame:
    """Ungapped records (locus, taxon, id, sequence): renamed taxa, some left out, the locus in front if asked for."""
    kept = aln.where(~F.col("taxon").isin(list(exclude))) if exclude else aln
    named = F.col("taxon")
    if names:
        named = F.coalesce(F.get(F.array(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("taxon"))), F.lit(0)), F.col("taxon"))
    label = F.concat("locus", F.lit("_"), "name") if with_locus else F.col("name")
    return kept.withColumn("name", named).select("locus", "taxon", label.alias("id"), ungap(F.col("seq")).alias("sequence"))


def missing_data_rows(aln: DataFrame, organisms: Sequence[str], min_taxa: int = 3, missing: str = "?") -> DataFrame:
    """Every organism in every alignment of ``min_taxa`` rows: absent ones are rows of the missing character.

    Rows that are there come first in their order, then the absent ones in the organisms' order.
    """
    per = aln.groupBy("locus").agg(F.collect_set("taxon").alias("have"), F.max(F.length("seq")).alias("nchar"), F.count(F.lit(1)).alias("n"), F.max("row_ord").alias("last")).where(F.col("n") >= min_taxa)
    listed = F.array(*[F.lit(o) for o in organisms])
    absent = per.select("locus", "nchar", "last", F.posexplode(F.filter(listed, lambda o: ~F.array_contains(F.col("have"), o))).alias("k", "taxon"))
    padded = absent.select("locus", (F.col("last") + 1 + F.col("k")).cast("int").alias("row_ord"), "taxon", F.repeat(F.lit(missing), F.col("nchar").cast("int")).alias("seq"))
    present = aln.join(per.select("locus"), "locus", "left_semi").select("locus", F.col("row_ord").cast("int").alias("row_ord"), "taxon", "seq")
    return present.unionByName(padded)
