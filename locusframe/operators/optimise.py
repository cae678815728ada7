"""Which taxa share most loci: branch and bound over bit sets, one task for each group size or sample."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def taxon_bits(by_taxon: DataFrame, taxa: Sequence[str]) -> tuple[list[int], list[str]]:
    """Each taxon's loci as a bit set, and the loci in bit order.

    The driver gets one row a locus of the chosen taxa; the kernel needs the whole matrix at once.
    """
    rows = by_taxon.where(F.col("taxon").isin(list(taxa))).groupBy("uce").agg(F.collect_set("taxon").alias("taxa")).orderBy("uce").collect()
    bits = dict.fromkeys(taxa, 0)
    for k, r in enumerate(rows):
        for t in r.taxa:
            bits[t] |= 1 << k
    return [bits[t] for t in taxa], [r.uce for r in rows]


def best_group(bits: Sequence[int], size: int, whole: int) -> tuple[tuple[int, ...], int]:
    """(places, shared loci as bits) of the first group, in list order, that shares most loci.

    A branch is left when even all loci that it still shares are no more than the best group's.
    """
    best: tuple[tuple[int, ...], int] | None = None
    most = -1
    stack: list[tuple[tuple[int, ...], int]] = [((), whole)]
    while stack:
        chosen, shared = stack.pop()
        if shared.bit_count() <= most:
            continue
        if len(chosen) == size:
            best, most = (chosen, shared), shared.bit_count()
            continue
        first = chosen[-1] + 1 if chosen else 0
        last = len(bits) - (size - len(chosen))
        stack += [((*chosen, k), shared & bits[k]) for k in range(last, first - 1, -1)]
    if best is None:
        raise ValueError(f"no group of {size} taxa among {len(bits)}")
    return best


def _names(bits: int, loci: Sequence[str]) -> list[str]:
    return [u for k, u in enumerate(loci) if bits >> k & 1]


def optimise_exhaustive(by_taxon: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """(size, organisms, loci, n_loci): the best group of every size."""
    spark = by_taxon.sparkSession
    bits, loci = taxon_bits(by_taxon, taxa)
    names, whole = list(taxa), (1 << len(loci)) - 1

    def kernel(batches):
        for rows in batches:
            out = [(int(n), *best_group(bits, int(n), whole)) for n in rows["size"]]
            yield pd.DataFrame([(n, [names[k] for k in g], _names(s, loci), s.bit_count()) for n, g, s in out], columns=["size", "organisms", "loci", "n_loci"])

    sizes = spark.range(1, len(taxa) + 1, numPartitions=max(1, len(taxa))).select(F.col("id").alias("size"))
    return sizes.mapInPandas(kernel, "size long, organisms array<string>, loci array<string>, n_loci long")


class SplitMix64:
    """The public SplitMix64 generator."""

    def __init__(self, seed: int):
        self.state = seed & (1 << 64) - 1

    def next(self) -> int:
        mask = (1 << 64) - 1
        self.state = z = (self.state + 0x9E3779B97F4A7C15) & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    def below(self, n: int) -> int:
        """Uniform in 0..n-1, by rejecting the values that would favour some."""
        least = (1 << 64) % n
        while (x := self.next()) < least:
            pass
        return x % n


def draw(n: int, count: int, rng: SplitMix64) -> list[int]:
    """``count`` of n places without replacement."""
    pool = list(range(n))
    for k in range(count):
        j = k + rng.below(n - k)
        pool[k], pool[j] = pool[j], pool[k]
    return pool[:count]


def optimise_random(by_taxon: DataFrame, taxa: Sequence[str], samples: int = 10, sample_size: int = 10, seed: int = 0) -> DataFrame:
    """(sample, organisms, loci, n_loci): for each sample of ``sample_size + 1`` taxa the best group of ``sample_size``.

    The best sample is the first with most loci; how often a taxon is left out follows from the rows.
    """
    if not 0 < sample_size < len(taxa) or samples < 1:
        raise ValueError("the sample size must be below the number of taxa, and samples positive")
    rng = SplitMix64(seed)
    drawn = [draw(len(taxa), sample_size + 1, rng) for _ in range(samples)]  # one stream of numbers, so drawn in order
    bits, loci = taxon_bits(by_taxon, taxa)
    names, whole = list(taxa), (1 << len(loci)) - 1

    def kernel(batches):
        for rows in batches:
            out = []
            for n in rows["sample"]:
                places = drawn[int(n)]
                group, shared = best_group([bits[p] for p in places], sample_size, whole)
                out.append((int(n), [names[places[k]] for k in group], _names(shared, loci), shared.bit_count()))
            yield pd.DataFrame(out, columns=["sample", "organisms", "loci", "n_loci"])

    numbers = by_taxon.sparkSession.range(0, samples, numPartitions=min(samples, 64)).select(F.col("id").alias("sample"))
    return numbers.mapInPandas(kernel, "sample long, organisms array<string>, loci array<string>, n_loci long")


def exclusion_tallies(samples: DataFrame, drawn: DataFrame) -> DataFrame:
    """(taxon, excluded): in how many samples the best group leaves a drawn taxon out; ``drawn`` has (sample, taxon)."""
    kept = samples.select("sample", F.explode("organisms").alias("taxon"))
    return drawn.join(kept, ["sample", "taxon"], "left_anti").groupBy("taxon").agg(F.count(F.lit(1)).alias("excluded"))


def drawn_taxa(spark: SparkSession, taxa: Sequence[str], samples: int = 10, sample_size: int = 10, seed: int = 0) -> DataFrame:
    """(sample, place, taxon): the taxa that ``optimise_random`` draws."""
    rng = SplitMix64(seed)
    rows = [(n, k, taxa[p]) for n in range(samples) for k, p in enumerate(draw(len(taxa), sample_size + 1, rng))]
    return spark.createDataFrame(rows, "sample long, place int, taxon string")
