"""Intervals on chromosomes: BED tables, proximity clusters, ordered merges, screens, slice plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locus_name
from ..functions.names import PROBE_PATTERN


def bed_from_hits(hits: DataFrame, identity: float = 90.0, continuity: float = 90.0, names: DataFrame | None = None) -> DataFrame:
    """(chromo, start, end, name) of hits that are identical and continuous enough, of listed names if there is a list."""
    good = hits.where((F.col("percent_identity") >= identity) & (F.col("percent_continuity") >= continuity))
    bed = good.select(F.col("name1").alias("chromo"), F.col("zstart1").alias("start"), F.col("end1").alias("end"), F.col("name2").alias("name"))
    return bed if names is None else bed.join(names.select("name").distinct(), "name", "left_semi").select("chromo", "start", "end", "name")


def probe_bed(hits: DataFrame) -> DataFrame:
    """Every hit as an interval under its probe's name (before ``|``)."""
    return hits.select(F.col("name1").alias("chromo"), F.col("zstart1").alias("start"), F.col("end1").alias("end"), F.trim(F.split_part(F.col("name2"), F.lit("|"), F.lit(1))).alias("name"))


def locus_bed(hits: DataFrame, pattern: str = PROBE_PATTERN, wide: int = 1000) -> DataFrame:
    """One interval for each locus and chromosome over its hits; ``wide`` warns of long ones with several hits."""
    named = hits.select(F.col("name1").alias("chromo"), "zstart1", "end1", locus_name(F.col("name2"), pattern).alias("name"))
    out = named.groupBy("chromo", "name").agg(F.min(F.least("zstart1", "end1")).alias("start"), F.max(F.greatest("zstart1", "end1")).alias("end"), F.count(F.lit(1)).alias("hits"))
    return out.select("chromo", "start", "end", "name", "hits", ((F.col("hits") > 1) & (F.col("end") - F.col("start") > wide)).alias("wide"))


def bed_from_headers(records: DataFrame, locus_prefix: str = "") -> DataFrame:
    """(chromo, start, end, name) from ``|contig:..|coords:a-b|locus:n`` in record names."""
    parts = F.split("id", r"\|")
    value = lambda key: F.element_at(F.filter(F.transform(parts, lambda p: F.split(p, ":", 2)), lambda kv: kv[0] == key), 1)[1]
    ends = F.split(value("coords"), "-")
    return records.select(value("contig").alias("chromo"), ends[0].cast("long").alias("start"), ends[1].cast("long").alias("end"), F.concat(F.lit(locus_prefix), value("locus")).alias("name"))


def filter_bed_by_loci(bed: DataFrame, loci: DataFrame) -> DataFrame:
    """Intervals whose name up to the first ``_`` is a locus."""
    return bed.withColumn("locus", F.split_part("name", F.lit("_"), F.lit(1))).join(loci.select("locus").distinct(), "locus", "left_semi").drop("locus")


#: Bases of a chromosome that are worked on at a time, and islands that are folded together.
STRETCH, ISLANDS = 1_000_000, 1024


def islands(intervals: DataFrame, distance: int, ties: Sequence[str] = ()) -> DataFrame:
    """``intervals`` with ``island``, from 1 on each chromosome: one begins more than ``distance`` after all ends before it.

    A chromosome is worked on in stretches of ``STRETCH`` bases, as it may hold a third of all rows: what a
    stretch needs of those before it is their largest end and their number of islands, a row a stretch.
    """
    stretch = ["chromo", "stretch"]
    before = Window.partitionBy("chromo").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*stretch).orderBy("start", "end", *ties)
    placed = intervals.withColumn("stretch", F.floor(F.col("start") / STRETCH).cast("long"))
    carried = placed.groupBy(*stretch).agg(F.max("end").alias("top")).select(*stretch, F.max("top").over(before).alias("carried"))
    reach = F.greatest(F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    marked = placed.join(carried, stretch).withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + distance), 1).otherwise(0))
    counts = marked.groupBy(*stretch).agg(F.sum("new").alias("n")).select(*stretch, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    number = F.col("passed") + F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(counts, stretch).withColumn("island", number).drop("stretch", "carried", "new", "passed")


def proximity_clusters(positions: DataFrame, distance: int = 10_000) -> DataFrame:
    """(chromo, cluster, n, start, end, loci): groups of intervals that begin within ``distance`` of all before them.

    A cluster needs two intervals at least, and ``loci`` are sorted.
    """
    numbered = islands(positions.distinct(), distance, ("locus",)).withColumnRenamed("island", "cluster")
    grouped = numbered.groupBy("chromo", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("locus")).alias("loci"))
    return grouped.where("n > 1")


def screened_loci(positions: DataFrame, distance: int = 10_000) -> DataFrame:
    """Loci that stay: those that are in no cluster, or the lowest of each of theirs."""
    bad = proximity_clusters(positions, distance).select(F.explode(F.slice("loci", F.lit(2), F.greatest(F.size("loci") - 1, F.lit(0)))).alias("locus")).distinct()
    return positions.select("locus").distinct().join(bad, "locus", "left_anti")


def fold_intervals(rows: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Intervals in arrival order: one joins the taxa of every known interval that it overlaps, else it is new.

    A joined interval keeps its bounds, so the order matters. Known intervals stand in lists by blocks of
    coordinates, so that only near ones are looked at.
    """
    kept: list[tuple[int, int, set[str]]] = []
    blocks: dict[int, list[int]] = {}
    size = 4096
    for start, end, taxon in rows:
        near = {k for b in range(start // size, max(start, end - 1) // size + 1) for k in blocks.get(b, ())}
        met = [k for k in near if start < kept[k][1] and kept[k][0] < end]
        for k in met:
            kept[k][2].add(taxon)
        if not met:
            kept.append((start, end, {taxon}))
            for b in range(start // size, max(start, end - 1) // size + 1):
                blocks.setdefault(b, []).append(len(kept) - 1)
    return [(a, b, sorted(t)) for a, b, t in kept]


def multi_merge(intervals: DataFrame) -> DataFrame:
    """(chromo, start, end, taxa): the ordered fold of each chromosome; ``intervals`` has chromo, start, end, taxon, ord.

    Only overlapping intervals meet, so a chromosome is split where none covers it, and each part is one group.
    Within a part the fold depends on the order and can't be split: a part is as large as its coverage is unbroken.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        out = fold_intervals(zip(rows["start"], rows["end"], rows["taxon"]))
        return pd.DataFrame({"chromo": rows["chromo"].iloc[0], "start": [a for a, _, _ in out], "end": [b for _, b, _ in out], "taxa": [t for _, _, t in out]})

    parts = islands(intervals.select("chromo", "start", "end", "taxon", "ord"), -1, ("ord",))
    some = parts.withColumn("part", F.floor(F.col("island") / ISLANDS))  # neighbours together: a group has its cost
    return some.groupBy("chromo", "part").applyInPandas(kernel, "chromo string, start long, end long, taxa array<string>")


def merged_presence(merged: DataFrame, taxa: list[str]) -> DataFrame:
    """The wide presence table of merged intervals, numbered in order of chromosome and start.

    Numbers are a chromosome's offset and a place on it, so only one row a chromosome is ordered globally.
    """
    counts = merged.groupBy("chromo").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("chromo", (F.sum("n").over(Window.orderBy("chromo")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("chromo").orderBy("start", "end", F.array_join("taxa", ","))) - 1
    named = merged.join(offsets, "chromo").withColumn("uce", (F.col("before") + place).cast("long"))
    return named.select("uce", "chromo", F.col("start"), F.col("end").alias("stop"), *[F.array_contains("taxa", t).cast("int").alias(t) for t in taxa])


def widen(bed: DataFrame, buffer_to: int | None = None) -> DataFrame:
    """Intervals brought to a length around their middle; an odd difference is rounded up to even."""
    if buffer_to is None:
        return bed
    lack = F.lit(buffer_to) - (F.col("end") - F.col("start"))
    half = F.when(lack > 0, F.floor((lack + 1) / 2)).otherwise(0)
    return bed.withColumn("__h", half).withColumn("start", F.col("start") - F.col("__h")).withColumn("end", F.col("end") + F.col("__h")).drop("__h")


def slice_genomes(bed: DataFrame, genomes: DataFrame) -> DataFrame:
    """``bed`` rows with their sequence; ``genomes`` has (chromo, sequence), and ranges are clamped to it."""
    joined = bed.join(genomes, "chromo")
    start = F.greatest(F.col("start"), F.lit(0))
    end = F.least(F.col("end"), F.length("sequence"))
    return joined.withColumn("sequence", F.substring(F.col("sequence"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")))


def strip_masked(sliced: DataFrame, filter_mask: float | None = None, max_n: int = 0, min_length: int = 0) -> DataFrame:
    """Slices with few enough N, masked bases and enough length; limits themselves pass."""
    from ..functions import masked_fraction, n_count

    ok = (n_count(F.col("sequence")) <= max_n) & (F.length("sequence") >= min_length)
    if filter_mask is not None:
        ok = ok & (F.coalesce(masked_fraction(F.col("sequence")), F.lit(0.0)) <= filter_mask)
    return sliced.where(ok)


def genome_sequences(bed: DataFrame, genomes: DataFrame, buffer_to: int | None = None, filter_mask: float | None = None, max_n: int = 0) -> DataFrame:
    """(header, chromo, start, end, sequence) of intervals, brought to a length and screened; ``bed`` has ord, chromo, start, end.

    A slice shorter than ``buffer_to`` goes (a genome's end), as does one with too many N or masked bases.
    """
    kept = strip_masked(slice_genomes(widen(bed, buffer_to), genomes), filter_mask, max_n, buffer_to or 0)
    header = F.concat(F.lit("slice_"), "ord", F.lit(" |"), "chromo", F.lit(":"), "start", F.lit("-"), "end")
    return kept.select(header.alias("header"), "chromo", "start", "end", "sequence")


#: Names of one interval that travel in one row at most, and tasks of bins for each shuffle partition.
NAMES, TASKS = 4096, 4


def gathered(intervals: DataFrame) -> DataFrame:
    """(chromo, start, end, names): the names of equal intervals together, repeats and nulls too, ``NAMES`` a row at most."""
    same = Window.partitionBy("chromo", "start", "end").orderBy("name")
    lots = intervals.select("chromo", "start", "end", "name", F.floor((F.row_number().over(same) - 1) / NAMES).alias("lot"))
    none = F.array_repeat(F.lit(None).cast(intervals.schema["name"].dataType), F.count_if(F.col("name").isNull()).cast("int"))
    return lots.groupBy("chromo", "start", "end", "lot").agg(F.concat(F.collect_list("name"), none).alias("names")).drop("lot")


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """Pairs (chromo, a_start, a_end, a_name, b_start, b_end, b_name) of half-open intervals that share a base.

    An equi-join on chromosome and bin, to which each interval goes that it touches; a pair is taken in the bin
    where the later of its starts lies, so once. Equal intervals travel as one, with a list of their names, so that
    what is shuffled grows with the different ones. In its bin ``a`` is expanded before the join, and of the pairs
    found ``b`` after it: all that one row of ``a`` gives is held at once, so a row has one name.
    """

    # a fixed number of tasks, as what a bin expands to is not told by its bytes, by which adaptive execution joins them
    tasks = TASKS * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(x: DataFrame, side: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))
        binned = gathered(x.where("start < end")).withColumn("bin", F.explode(bins))
        dealt = binned.repartition(tasks, "chromo", "bin")
        return dealt.select("chromo", "bin", *[F.col(c).alias(f"{side}_{c}") for c in ("start", "end", "names")])

    single = spread(a, "a").select("chromo", "bin", "a_start", "a_end", F.explode("a_names").alias("a_name"))
    met = single.join(spread(b, "b"), ["chromo", "bin"])
    own = F.floor(F.greatest("a_start", "b_start") / bin_size) == F.col("bin")
    pairs = met.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & own)
    return pairs.select("chromo", "a_start", "a_end", "a_name", "b_start", "b_end", F.explode("b_names").alias("b_name"))


def slice_plan(hits: DataFrame, pattern: str = PROBE_PATTERN, contig_orient: bool = False, gap: int = 500) -> DataFrame:
    """Per locus of one genome: contig, first start, end of the last hit by start, strand, hits, and why it is dropped.

    Dropped: hits on several contigs, on both strands, or more than ``gap`` apart.
    """
    strand = F.col("strand1" if contig_orient else "strand2")
    named = hits.select(locus_name(F.col("name2"), pattern).alias("uce"), F.col("name1").alias("contig"), F.col("zstart1").alias("s"), F.col("end1").alias("e"), strand.alias("strand"))
    order = Window.partitionBy("uce", "contig").orderBy("s", "e")
    spaced = named.withColumn("far", F.coalesce(F.col("s") - F.lag("e").over(order) > gap, F.lit(False))).withColumn("sign", F.ascii("strand"))
    # a contig's hits first, which are together and in order already; then a locus's few contigs
    last = F.struct("s", "e")
    each = spaced.groupBy("uce", "contig").agg(F.min("s").alias("min"), F.max(last).alias("last"), F.min("sign").alias("low"), F.max("sign").alias("high"), F.count(F.lit(1)).alias("n"), F.bool_or("far").alias("far"))
    per = each.groupBy("uce").agg(
        F.count("contig").alias("contigs"), F.min("contig").alias("contig"), F.min("min").alias("min"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("probes"), F.bool_or("far").alias("far")
    )
    per = per.withColumn("max", F.col("last.e")).withColumn("strand", F.char(F.col("low").cast("long")))
    why = F.when(F.col("contigs") > 1, "duplicate").when(F.col("low") < F.col("high"), "orientation").when(F.col("far"), "length")
    return per.select("uce", "contig", "min", "max", "strand", "probes", why.alias("dropped"))


def slice_bounds(plan: DataFrame, lengths: DataFrame, flank: int | None = None, width: int | None = None) -> DataFrame:
    """Kept loci with the slice's bounds: a fixed ``width`` around the match, or ``flank`` on both sides.

    ``lengths`` has (contig, contig_length). A width whose left side falls off the contig ends at the width.
    """
    kept = plan.where("dropped is null").join(lengths, "contig")
    if width is not None:
        lack = F.lit(width) - F.abs(F.col("max") - F.col("min"))
        half = F.when(lack > 0, F.floor((lack + 1) / 2)).otherwise(F.lit(0))
        left, right = F.col("min") - half, F.col("max") + half
        start, end = F.greatest(left, F.lit(0)), F.when(left < 0, F.lit(width).cast("long")).otherwise(right)
    else:
        by = F.lit(flank or 0)
        start, end = F.greatest(F.col("min") - by, F.lit(0)), F.least(F.col("max") + by, F.col("contig_length"))
    return kept.withColumn("slice_start", start.cast("long")).withColumn("slice_end", end.cast("long")).drop("dropped")


def slice_sequences(bounds: DataFrame, contigs: DataFrame, width: int | None = None) -> DataFrame:
    """Records (header, sequence) of the slices; ``contigs`` has (contig, sequence).

    With a flank, N at both ends and then lower-case bases go and the strand is only named; with a width the
    sequence is turned on the minus strand, and slices shorter than the width go. Loci are numbered, and short
    slices found, from ``bounds`` alone, which has no sequences; only then do the slices meet their contigs, by a
    shuffle, as contigs grow with the data.
    """
    from ..functions import reverse_complement_plain

    start, end = F.greatest("slice_start", F.lit(0)), F.least("slice_end", "contig_length")
    size = F.greatest(end - start, F.lit(0))
    wide = bounds if width is None else bounds.where(size >= width)
    numbered = wide.withColumn("k", F.row_number().over(Window.orderBy("uce")) - 1)  # one short row a locus
    cut = numbered.join(contigs.hint("merge"), "contig").withColumn("raw", F.substring(F.col("sequence"), (start + 1).cast("int"), size.cast("int")))
    if width is not None:
        kept = cut
        turned = F.col("strand") != "+"
        orient = F.when(turned, "revcomp").otherwise(F.col("strand"))
        seq = F.when(turned, reverse_complement_plain(F.col("raw"))).otherwise(F.col("raw"))
        head, a, b = F.concat(F.lit("slice_"), "k"), F.col("slice_start"), F.col("slice_end")
    else:
        no_n = F.ltrim(F.col("raw"), F.lit("Nn"))
        lead_n = F.length("raw") - F.length(no_n)
        inner = F.rtrim(no_n, F.lit("Nn"))
        seq0 = F.btrim(inner, F.lit("acgt"))
        lead = lead_n + F.length(inner) - F.length(F.ltrim(inner, F.lit("acgt")))
        kept = cut.withColumn("seq0", seq0).withColumn("lead", lead)
        orient, seq = F.col("strand"), F.col("seq0")
        a = F.col("slice_start") + F.col("lead")
        b = a + F.length("seq0")
        head = F.concat(F.lit("Node_"), "k", F.lit("_length_"), F.length("seq0"), F.lit("_cov_1000"))
    header = F.concat(head, F.lit("|contig:"), "contig", F.lit("|slice:"), a, F.lit("-"), b, F.lit("|uce:"), "uce", F.lit("|match:"), "min", F.lit("-"), "max", F.lit("|orient:"), orient, F.lit("|probes:"), "probes")
    return kept.select("uce", header.alias("header"), seq.alias("sequence"))


def pack_units(lengths: Iterable[tuple[str, int]], most: int = 10_000_000) -> Iterator[list[str]]:
    """Scaffolds in order, gathered until their length exceeds ``most``."""
    unit: list[str] = []
    held = 0
    for name, n in lengths:
        unit.append(name)
        held += n
        if held > most:
            yield unit
            unit, held = [], 0
    if unit:
        yield unit
