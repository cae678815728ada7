"""File-level work: converting alignments, assembler output, joined gzip files, command lines, number texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import degenerate_to_n


def convert_alignments(spark: SparkSession, folder: str, source: str, target: str, path: str, mode: str = "errorifexists") -> None:
    """All alignments of a folder as NEXUS or FASTA files, one folder a locus."""
    from ..sources import read_alignments
    from ..sources.sinks import explode_to, nexus_files

    aln = read_alignments(spark, folder, source)
    if target == "nexus":
        nexus_files(aln).repartition("locus").write.mode(mode).partitionBy("locus").text(path)
    elif target == "fasta":
        explode_to(aln.select("locus", F.col("taxon").alias("id"), F.col("seq").alias("sequence")), path, "locus", mode=mode)
    else:
        raise ValueError(f"can't write {target}")


def assembler_contigs(records: DataFrame, longer_than: int = 100) -> DataFrame:
    """Contigs named by number, length and coverage (the words of their header), degenerate bases as N, short ones left out."""
    words = F.split("description", " ")
    named = records.where(F.size(words) >= 3).select(F.concat(F.lit("NODE_"), words[0], F.lit("_length_"), words[1], F.lit("_cov_"), words[2]).alias("id"), degenerate_to_n(F.col("sequence")).alias("sequence"))
    return named.where(F.length("sequence") > longer_than)


def join_members(plan: DataFrame, folder: str, target: str) -> DataFrame:
    """(target, files, bytes): the files of each target joined byte by byte, as gzip members may be.

    ``plan`` has target, ord, name. Each target is written by one task, in order, block by block, to storage
    that all executors see; only names pass through the group.
    """
    from ..session import ship_package

    ship_package(plan.sparkSession)
    listed = plan.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))

    def work(batches):
        import pandas as pd
        from pyarrow import fs

        def at(uri: str, name: str):
            if "://" in uri:
                system, path = fs.FileSystem.from_uri(uri)
            else:
                system, path = fs.LocalFileSystem(), uri
            return system, f"{path.rstrip('/')}/{name}"

        for rows in batches:
            out = []
            for name, parts in zip(rows["target"], rows["names"]):
                system, path = at(target, name)
                written = 0
                with system.open_output_stream(path, compression=None) as sink:
                    for part in parts:
                        own, source = at(folder, part)
                        with own.open_input_stream(source, compression=None) as f:
                            while block := f.read(1 << 20):
                                sink.write(block)
                                written += len(block)
                out.append((name, len(parts), written))
            yield pd.DataFrame(out, columns=["target", "files", "bytes"])

    return listed.mapInPandas(work, "target string, files long, bytes long")


def assembly_command(program: str, out: str, r1: str, r2: str, single: str | None = None, kmer: int = 31, threads: int = 1, memory: int = 8) -> list[list[str]]:
    """The command lines of an assembly of paired reads, in order; running them is left to the caller."""
    if program == "spades":
        extra = ["--pe1-s", single] if single else []
        return [["spades.py", "--careful", "--sc", "--memory", str(memory), "--threads", str(threads), "--cov-cutoff", "auto", "--pe1-1", r1, "--pe1-2", r2, "-o", out, *extra]]
    if program == "velvet":
        extra = ["-short", single] if single else []
        return [["velveth", out, str(kmer), "-fastq.gz" if r1.endswith(".gz") else "-fastq", "-separate", "-shortPaired", r1, r2, *extra], ["velvetg", out, "-cov_cutoff", "auto", "-exp_cov", "auto", "-min_contig_lgth", "100"]]
    if program == "abyss":
        extra = [f"se={single}"] if single else []
        return [["abyss-pe", f"k={kmer}", f"j={threads}", f"name={out}", f"in={r1} {r2}", *extra]]
    raise ValueError(f"unknown assembler {program}")


def number_text(x: float, grouped: bool = False) -> str:
    """The shortest text of a number, ``.0`` for whole floats, ``nan``; with commas at thousands if asked for."""
    if x != x:
        return "nan"
    text = f"{x:,}" if grouped else repr(x)
    return text


def report_line(name: str, report: dict, columns: Sequence[str] = ("reads", "total", "mean", "sem", "least", "most", "median", "long")) -> str:
    """A length report as comma-separated text; without reads, all but the counts is ``Div/0``."""
    if not report.get("reads"):
        return ",".join([name, "0", *["Div/0"] * 4, str(report.get("long") or 0)])
    return ",".join([name, *(number_text(report[c]) for c in columns if c in report)])
