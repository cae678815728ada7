"""External programs as functions over groups: an aligner takes and returns named sequences.

No program is bundled. ``CommandAligner`` runs one on FASTA text; ``pad_rows`` only brings rows to one length,
for tests, and is no alignment method.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = list[tuple[str, str]]
Aligner = Callable[[Rows], Rows]


@dataclass(frozen=True)
class CommandAligner:
    """A program that reads FASTA on its input and writes aligned FASTA; a failure is an error with what it said."""

    command: tuple[str, ...]
    timeout: float = 3600

    def __call__(self, rows: Rows) -> Rows:
        from ..sources.alignment import parse_fasta

        text = "".join(f">{n}\n{s}\n" for n, s in rows)
        done = subprocess.run(self.command, input=text, capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return parse_fasta(done.stdout)


def pad_rows(rows: Rows) -> Rows:
    width = max(len(s) for _, s in rows)
    return [(n, s.ljust(width, "-")) for n, s in rows]


def check_program(name: str) -> str | None:
    """Where a program is, or None."""
    return shutil.which(name)


# Options of the hit search, and the columns that the reader of hits expects.
_SEARCH = "--strand=both --seed=12of19 --transition --nogfextend --nochain --gap=400,30 --xdrop=910 --ydrop=8370 --hspthresh=3000 --gappedthresh=3000 --noentropy".split()
_COLUMNS = "score,name1,strand1,zstart1,end1,length1,name2,strand2,zstart2,end2,length2,diff,cigar,identity,continuity"


def hit_search_command(target: str, query: str, output: str, identity: float = 92.5, coverage: float = 83.0, min_match: int | None = None, with_coverage: bool = False, program: str = "lastz") -> list[str]:
    """A hit search with tab-separated output; ``with_coverage`` gives the long form of hits (19 fields)."""
    if with_coverage and min_match is not None:
        raise ValueError("the long form is limited by coverage")
    limit = f"--coverage={coverage:g}" if min_match is None else f"--matchcount={min_match}"
    names = "[multiple]" if with_coverage else "[multiple,nameparse=full]"
    columns = _COLUMNS + (",coverage" if with_coverage else "")
    return [program, target + names, f"{query}[nameparse=full]", *_SEARCH, limit, f"--identity={identity:g}", f"--output={output}", f"--format=general-:{columns}"]


def mapping_commands(species: str, assembly: str, genome: Sequence[str], prefix: str, reads: Sequence[str], output: str, rate: float = 0.05, threads: int = 1, bam: bool = False, fresh: bool = False, program: str = "probebwa") -> list[list[str]]:
    """Index, hash and map one or two read files; a fresh index is not built again."""
    if not 1 <= len(reads) <= 2:
        raise ValueError("give one read file or two")
    index = [] if fresh else [[program, "build-genome", "--species", species, "--assembly", assembly, "-G", prefix, *genome], [program, "build-hash", "--genome", prefix, "-H", prefix]]
    kind = ["--outputformat", "bam"] if bam else []
    return [*index, [program, "map", "--genome", prefix, "--hash", prefix, "--substitution-rate", f"{rate:g}", "--threads", str(threads), *kind, "--output", output, "-M", *reads]]


def index_is_fresh(index: str, sources: Sequence[str]) -> bool:
    """Whether an index is there and no source is newer, or missing."""
    try:
        made = os.path.getmtime(index)
        return all(os.path.getmtime(s) <= made for s in sources)
    except OSError:
        return False


def trim_command(source: str, target: str, program: str = "trimal") -> list[str]:
    return [program, "-in", source, "-out", target, "-automated1", "-fasta"]


def reduce_command(source: str, folder: str, program: str = "raxmlHPC-SSE3") -> list[str]:
    """Writes ``source.reduced`` without repeated rows and columns of missing data, if there are any."""
    return [program, "-f", "c", "-m", "GTRGAMMA", "-s", source, "-w", folder, "-n", "test"]


def group_and_align(records: DataFrame, taxa: int, aligner: Aligner, complete: bool = True, keep_ambiguous: bool = False) -> DataFrame:
    """Records (locus, taxon, sequence) aligned locus by locus: (locus, row_ord, taxon, seq).

    Loci without all taxa go (or, if incomplete ones are wanted, those with fewer than three); so do sequences
    with N, unless kept. ``_phased`` at the end of a locus's name goes, however often.
    """
    from ..session import ship_package

    ship_package(records.sparkSession)
    named = records.withColumn("locus", F.regexp_replace("locus", r"(_phased)+$", ""))
    clean = named if keep_ambiguous else named.where(~F.col("sequence").rlike("[Nn]"))
    enough = clean.groupBy("locus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (taxa if complete else 3)).select("locus")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("taxon", kind="stable")
        out = aligner(list(zip(rows["taxon"], rows["sequence"])))
        return pd.DataFrame({"locus": rows["locus"].iloc[0], "row_ord": range(len(out)), "taxon": [n for n, _ in out], "seq": [s for _, s in out]})

    return clean.join(enough, "locus", "left_semi").select("locus", "taxon", "sequence").groupBy("locus").applyInPandas(kernel, "locus string, row_ord int, taxon string, seq string")


def reconstruct_loci(probes: DataFrame, aligner: Aligner, threshold: float = 0.7) -> DataFrame:
    """(locus, sequence): a locus's only probe, or the consensus of its aligned probes; ``probes`` has id, sequence."""
    from .sites import consensus_threshold

    keyed = probes.withColumn("locus", F.split_part("id", F.lit("_"), F.lit(1)))
    counts = keyed.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))
    single = keyed.join(counts.where("n = 1"), "locus").select("locus", "sequence")
    many = keyed.join(counts.where("n > 1"), "locus").select("locus", F.col("id").alias("taxon"), "sequence")
    aligned = group_and_align(many, 1, aligner, keep_ambiguous=True)
    return single.unionByName(consensus_threshold(aligned, threshold).withColumnRenamed("consensus", "sequence"))


def block_options(taxa: int, b1: float = 0.5, b2: float = 0.85, b3: int = 8, b4: int = 10) -> Sequence[str]:
    """Options of a block trimmer: the least rows for conserved and flanking columns from shares of the taxa, rounded half up."""
    if b4 < 2:
        raise ValueError("blocks have two columns at least")
    least = int(b1 * taxa + 0.5) + 1
    return ("-t=DNA", f"-b1={least}", f"-b2={max(least, int(b2 * taxa + 0.5))}", f"-b3={b3}", f"-b4={b4}", "-b5=h", "-p=n")
