"""Probe design: tiling, probe records, subsets, full probes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gc_fraction, header_map, key_locus, masked_fraction


@dataclass(frozen=True)
class Tiling:
    length: int = 120
    density: float = 2.0
    flush_left: bool = False
    mask: float | None = None
    remove_ambiguous: bool = True
    remove_gc: bool = False
    two_probes: bool = False

    def __post_init__(self):
        if self.length < 1 or not 0 < self.density <= self.length:
            raise ValueError("the length must be positive and the density in (0, length]")


def middle_tiles(n: Column, tiling: Tiling) -> Column:
    """Sorted (start, end) of tiles laid from the middle outwards, in fractions that are cut off to whole bases."""
    overlap = tiling.length - tiling.length / tiling.density
    step = tiling.length - overlap
    right = n / 2.0 - overlap / 2
    left = n / 2.0 + overlap / 2
    reach = F.lit(float(tiling.length))
    rights = F.when(right + reach <= n, F.sequence(F.lit(0), F.floor((n - right - reach) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    lefts = F.when(left - reach >= 0, F.sequence(F.lit(0), F.floor((left - reach) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")  # noqa: E731  towards zero
    tile = lambda a: F.struct(cut(a).alias("start"), cut(a + reach).alias("end"))
    return F.array_sort(F.concat(F.transform(rights, lambda k: tile(right + k * step)), F.transform(lefts, lambda k: tile(left - reach - k * step))))


def flush_left_tiles(n: Column, tiling: Tiling) -> Column:
    """(start, end) of tiles from the left end; the overlap is rounded half to even, and the last may hang over."""
    stride = tiling.length - round(tiling.length - tiling.length / tiling.density)
    if stride <= 0:
        raise ValueError("the density leaves no stride")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda a: F.struct(a.alias("start"), (a + tiling.length).alias("end")))


def tiles(records: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """The record's columns with k (from 1), start and end of each tile; numbers are given before anything is dropped."""
    n = F.length("sequence")
    made = flush_left_tiles(n, tiling) if tiling.flush_left else middle_tiles(n, tiling)
    if tiling.two_probes:
        size = F.col("__size")
        first = F.floor(size / 2).cast("int") - F.when(size % 2 == 0, 1).otherwise(0)
        second = F.least(first + 1, size.cast("int") - 1)
        made_two = F.array_sort(F.array(F.get("__tiles", first), F.get("__tiles", second)))
        records = records.withColumn("__tiles", made).withColumn("__size", F.size("__tiles")).where("__size > 0")
        out = records.select(*[c for c in records.columns if not c.startswith("__")], F.posexplode(made_two).alias("k", "tile"))
    else:
        out = records.select("*", F.posexplode(made).alias("k", "tile"))
    keep = [c for c in out.columns if c not in ("k", "tile")]
    return out.select(*keep, (F.col("k") + 1).alias("k"), F.col("tile.start").alias("start"), F.col("tile.end").alias("end"))


def keep_rule(made: DataFrame, tiling: Tiling) -> DataFrame:
    """Tiles with their bases as ``part`` that stay: inside the sequence and by each rule that is asked for."""
    made = made.where((F.col("start") >= 0) & (F.col("end") <= F.length("sequence")))
    made = made.withColumn("part", F.substring(F.col("sequence"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    ok = F.length("part") >= tiling.length
    if tiling.mask is not None:
        ok = ok & (masked_fraction(F.col("part")) < tiling.mask)
    if tiling.remove_ambiguous:
        ok = ok & ~F.upper("part").contains("N")
    if tiling.remove_gc:
        ok = ok & gc_fraction(F.col("part")).between(0.3, 0.7)
    return made.where(ok)


def tiled_probes(records: DataFrame, tiling: Tiling = Tiling(), prefix: str = "uce-", designer: str = "designer", design: str = "design") -> DataFrame:
    """Kept probes (locus, k, id, header, sequence, chromo, global_start, global_end).

    ``records`` has locus, chromo, chromo_start, sequence. A probe goes if it hangs over an end, is masked by
    the share ``mask`` at least, has N, or its GC share is outside 0.3 to 0.7 (each rule if asked for).
    """
    made = keep_rule(tiles(records, tiling), tiling)
    a, b = F.col("chromo_start") + F.col("start"), F.col("chromo_start") + F.col("end")
    probe = F.concat(F.lit(prefix), F.col("locus").cast("string"), F.lit("_p"), "k")
    fields = [("design", F.lit(design)), ("designer", F.lit(designer)), ("probes-locus", F.col("locus")), ("probes-probe", F.col("k")), ("probes-global-chromo", F.col("chromo")), ("probes-global-start", a), ("probes-global-end", b), ("probes-local-start", F.col("start")), ("probes-local-end", F.col("end"))]
    meta = F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in fields])
    return made.select("locus", "k", probe.alias("id"), F.concat(probe, F.lit(" |"), meta).alias("header"), F.upper("part").alias("sequence"), "chromo", a.alias("global_start"), b.alias("global_end"))


def probe_loci_bed(probes: DataFrame) -> DataFrame:
    """One interval a locus over its kept probes."""
    return probes.groupBy("locus").agg(F.max_by("chromo", "k").alias("chromo"), F.min("global_start").alias("start"), F.max("global_end").alias("end"))


def listed_tiles(records: DataFrame, listed: DataFrame, tiling: Tiling = Tiling(), prefix: str = "", start_index: int = 0) -> DataFrame:
    """Kept probes (ord, k, id, source, sequence, chromo, global_start, global_end) of several taxa's loci, in the list's order.

    ``listed`` has (ord, locus); ``records`` has locus, taxon, taxon_ord, chromo, chromo_start, sequence. A locus's
    probe numbers run on over its taxa and count those that are left out, too.
    """
    wanted = records.join(listed.select("locus", "ord"), "locus")
    made = number_across_taxa(tiles(wanted, tiling), start_index)
    kept = keep_rule(made, tiling)
    return kept.select(
        "ord", "k", F.concat(F.lit(prefix), F.col("locus").cast("string"), F.lit("_p"), "k").alias("id"), F.col("taxon").alias("source"), F.upper("part").alias("sequence"),
        "chromo", (F.col("chromo_start") + F.col("start")).alias("global_start"), (F.col("chromo_start") + F.col("end")).alias("global_end"),
    )


def subset_counts(probes: DataFrame, place: int = 4) -> DataFrame:
    """(taxon, probes): how many probes name each taxon in their metadata field at ``place`` (from 0)."""
    field = F.get(F.split(F.element_at(F.split("header", r"\|", 2), 2), ","), F.lit(place))
    return probes.groupBy(F.element_at(F.split(field, ":", 2), 2).alias("taxon")).agg(F.count(F.lit(1)).alias("probes"))


def number_across_taxa(tiled: DataFrame, start_index: int = 1) -> DataFrame:
    """Probe numbers that run on over a locus's taxa: by taxon order and tile."""
    order = Window.partitionBy("locus").orderBy("taxon_ord", "k")
    return tiled.withColumn("k", F.row_number().over(order) - 1 + start_index)


def probe_subsets(probes: DataFrame, taxa: list[str], place: int = 4) -> DataFrame:
    """Probes whose metadata field at ``place`` (from 0) names one of the taxa."""
    field = F.get(F.split(F.element_at(F.split("header", r"\|", 2), 2), ","), F.lit(place))
    return probes.where(F.element_at(F.split(field, ":", 2), 2).isin(taxa))


def probes_excluding(probes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Probes whose name up to the first ``_`` is not listed."""
    return probes.withColumn("__locus", key_locus(F.col("id"))).join(excluded.select(F.col("locus").alias("__locus")).distinct(), "__locus", "left_anti").drop("__locus")


def fragments(records: DataFrame) -> DataFrame:
    """Probe records (id, header, sequence) as fragments with their keys and coordinates.

    Coordinates must be there, spans agree and sequences be A, C, G, T of that length; else it is an error.
    """
    m = header_map(F.col("header"))
    of = lambda key: F.try_element_at(m, F.lit(key))
    number = lambda key: F.coalesce(of(key), F.raise_error(F.concat(F.lit(f"no {key} in "), "id")).cast("string")).cast("long")
    fallback = F.regexp_replace("id", r"^(.+)_p\d+$", "$1")
    out = records.select(
        "id",
        F.coalesce(of("probes-locus"), fallback).alias("locus"),
        F.coalesce(of("probes-source"), F.lit("unknown")).alias("source"),
        F.coalesce(of("probes-global-chromo"), F.raise_error(F.concat(F.lit("no chromosome in "), "id")).cast("string")).alias("chromo"),
        F.coalesce(of("design"), F.lit("unknown")).alias("design"),
        F.coalesce(of("designer"), F.lit("unknown")).alias("designer"),
        *[number(f"probes-{k}").alias(k.replace("-", "_")) for k in ("local-start", "local-end", "global-start", "global-end")],
        F.upper("sequence").alias("sequence"),
    )
    span = F.col("local_end") - F.col("local_start")
    bad = (span <= 0) | (span != F.col("global_end") - F.col("global_start")) | (F.length("sequence") != span) | ~F.col("sequence").rlike("^[ACGT]*$")
    return out.withColumn("sequence", F.when(bad, F.raise_error(F.concat(F.lit("bad coordinates or bases in "), "id")).cast("string")).otherwise(F.col("sequence")))


FRAGMENT_KEY = ("locus", "source", "chromo", "design", "designer")


def fragment_islands(parts: DataFrame) -> DataFrame:
    """Fragments with the number of their island: those whose local ranges touch or overlap."""
    order = Window.partitionBy(*FRAGMENT_KEY).orderBy("local_start", "local_end", "id")
    reach = F.max("local_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("__new", F.when(reach.isNull() | (F.col("local_start") > reach), 1).otherwise(0))
    return marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def merged_islands(marked: DataFrame) -> DataFrame:
    """Each island as one sequence; ``ok`` is false where coordinates or overlapping bases conflict.

    Fragments are laid on each other in order of their start: each must agree with what is already there.
    """
    offset = F.col("global_start") - F.col("local_start")
    part = F.struct("local_start", "local_end", "id", "sequence")
    grouped = marked.groupBy(*FRAGMENT_KEY, "island").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.min(offset).alias("offset"), F.max(offset).alias("other"), F.min("local_start").alias("local_start"), F.max("local_end").alias("local_end"), F.min(F.struct("local_start", "local_end", "id")).alias("first")
    )

    def lay(acc: Column, x: Column) -> Column:
        at = (x["local_start"] - F.col("local_start")).cast("int")
        lap = F.least(F.length(acc["seq"]) - at, F.length(x["sequence"]))
        agrees = F.substring(acc["seq"], at + 1, lap) == F.substring(x["sequence"], F.lit(1), lap)
        return F.struct(F.concat(acc["seq"], F.substring(x["sequence"], lap + 1, F.length(x["sequence"]))).alias("seq"), (acc["ok"] & agrees).alias("ok"))

    laid = F.aggregate("parts", F.struct(F.lit("").alias("seq"), F.lit(True).alias("ok")), lay)
    out = grouped.withColumn("laid", laid)
    return out.select(*FRAGMENT_KEY, "island", "local_start", "local_end", "offset", F.col("first.id").alias("id"), F.col("laid.seq").alias("sequence"), (F.col("laid.ok") & (F.col("offset") == F.col("other"))).alias("ok"))


def full_probes(records: DataFrame) -> DataFrame:
    """For each locus and source, the longest island of probes that merges without conflict.

    Ties go to the smaller first name. A group in which no island merges is an error.
    """
    islands = merged_islands(fragment_islands(fragments(records)))
    rank = F.struct(~F.col("ok"), F.col("local_start") - F.col("local_end"), "id", "local_start")
    value = F.struct("ok", "local_start", "local_end", "offset", "sequence")
    best = islands.groupBy(*FRAGMENT_KEY).agg(F.min_by(value, rank).alias("v"))
    sequence = F.when(F.col("v.ok"), F.col("v.sequence")).otherwise(F.raise_error(F.concat(F.lit("conflicting probes of locus "), "locus")).cast("string"))
    merged = best.select(*FRAGMENT_KEY, "v.local_start", "v.local_end", (F.col("v.local_start") + F.col("v.offset")).alias("global_start"), (F.col("v.local_end") + F.col("v.offset")).alias("global_end"), sequence.alias("sequence"))
    order = Window.partitionBy("locus").orderBy("source", "chromo", "design", "designer")
    return merged.withColumn("probe", F.row_number().over(order))
