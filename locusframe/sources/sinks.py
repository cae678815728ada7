"""Writers: FASTA, NEXUS, PHYLIP, sets, BED, summaries, partitioned exports; Spark's commit protocol does the rest."""

from __future__ import annotations

import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wrap_sequence

# Column names of the classic summary files.
LEGACY_NAMES = {"taxa": "taxa", "length": "length", "informative": "informative_sites", "differences": "differences", "counted": "counted_sites", "gaps": "- count", "a": "a count", "c": " c count", "g": " g count", "t": " t count"}


def safe_name(name: str) -> str:
    """A value that may become a file's name; separators and dots alone are errors."""
    if not name or name in (".", "..") or re.search(r"[/\\\0]", name):
        raise ValueError(f"{name!r} can't be a file's name")
    return name


def repeated_stems(files: DataFrame, column: str = "file") -> DataFrame:
    """Stems that two inputs share: their outputs would be one file."""
    stem = F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]*$", "")
    return files.groupBy(stem.alias("stem")).count().where("count > 1")


def fasta_text(records: DataFrame, header: str = "id", width: int = 60) -> DataFrame:
    """One text value for each record: the header line and wrapped sequence."""
    return records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrap_sequence(F.col("sequence"), width)).alias("value"))


def write_fasta(records: DataFrame, path: str, header: str = "id", width: int = 60, mode: str = "errorifexists") -> None:
    fasta_text(records, header, width).write.mode(mode).text(path)


def explode_to(records: DataFrame, path: str, by: str, header: str = "id", mode: str = "errorifexists") -> None:
    """One folder for each value of a column; values that can't be names are an error."""
    key = F.when(F.col(by).rlike(r"[/\\\x00]") | F.col(by).isin("", ".", ".."), F.raise_error(F.concat(F.lit("bad name "), F.col(by))).cast("string")).otherwise(F.col(by))
    text = records.select(key.alias(by), F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrap_sequence(F.col("sequence"))).alias("value"))
    text.repartition(by).write.mode(mode).partitionBy(by).text(path)


def nexus_label(name: str) -> str:
    from ..functions.names import NEXUS_SPECIAL

    quoted = name.replace("'", "''")
    return f"'{quoted}'" if any(c in NEXUS_SPECIAL for c in quoted) else quoted


def nexus_text(rows: list[tuple[str, str]], interleave: bool | None = None) -> str:
    """A NEXUS data block; blocks of 70 columns where there are more than 1000 or if asked for."""
    n = len(rows[0][1]) if rows else 0
    blocks = n > 1000 if interleave is None else interleave
    labels = [nexus_label(name) for name, _ in rows]
    pad = max(map(len, labels), default=0) + 1
    step = 70 if blocks else max(n, 1)
    lines = ["#NEXUS", "begin data;", f"dimensions ntax={len(rows)} nchar={n};", f"format datatype=dna missing=? gap=-{' interleave' if blocks else ''};", "matrix"]
    for at in range(0, n, step):
        lines += [label.ljust(pad) + seq[at : at + step] for label, (_, seq) in zip(labels, rows)]
        if blocks:
            lines.append("")
    return "\n".join([*lines, ";", "end;", ""])


def nexus_files(aln: DataFrame, interleave: bool | None = None) -> DataFrame:
    """(locus, value): each alignment's file as one text value."""
    from ..session import ship_package

    ship_package(aln.sparkSession)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_ord", kind="stable")
        return pd.DataFrame({"locus": [rows["locus"].iloc[0]], "value": [nexus_text(list(zip(rows["taxon"], rows["seq"])), interleave)]})

    return aln.select("locus", "row_ord", "taxon", "seq").groupBy("locus").applyInPandas(kernel, "locus string, value string")


def alignment_text(rows: list[tuple[str, str]], fmt: str) -> str:
    """An alignment as a file of one of the formats that ``read_alignments`` knows."""
    n = len(rows[0][1]) if rows else 0
    head = f"{len(rows)} {n}\n"
    wide = max((len(name) for name, _ in rows), default=0) + 1
    if fmt == "nexus":
        return nexus_text(rows)
    if fmt == "fasta":
        return "".join(f">{name}\n{seq}\n" for name, seq in rows)
    if fmt == "phylip":
        if any(len(name) > 10 for name, _ in rows):
            raise ValueError("strict names have ten characters at most")
        return head + "".join(f"{name:<10}{seq}\n" for name, seq in rows)
    if fmt == "phylip-relaxed":
        return head + "".join(f"{name} {seq}\n" for name, seq in rows)
    if fmt == "phylip-sequential":
        return head + "".join(f"{name} {seq[:60]}\n" + "".join(f"{seq[at : at + 60]}\n" for at in range(60, n, 60)) for name, seq in rows)
    if fmt == "clustal":
        return "CLUSTAL W\n\n" + "\n".join("".join(f"{name:<{wide}}{seq[at : at + 60]}\n" for name, seq in rows) for at in range(0, n, 60))
    if fmt == "stockholm":
        return "# STOCKHOLM 1.0\n" + "".join(f"{name:<{wide}}{seq}\n" for name, seq in rows) + "//\n"
    if fmt == "emboss":
        return "# alignment\n\n" + "\n".join("".join(f"{name:<{wide}} {at + 1} {seq[at : at + 50]} {min(at + 50, n)}\n" for name, seq in rows) for at in range(0, n, 50))
    raise ValueError(f"can't write {fmt}")


def alignment_files(aln: DataFrame, fmt: str) -> DataFrame:
    """(name, value): each alignment's file of a format, named by its locus."""
    from ..session import ship_package
    from .alignment import EXTENSIONS

    ship_package(aln.sparkSession)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_ord", kind="stable")
        name = f"{safe_name(rows['locus'].iloc[0])}.{EXTENSIONS[fmt][0]}"
        return pd.DataFrame({"name": [name], "value": [alignment_text(list(zip(rows["taxon"], rows["seq"])), fmt)]})

    return aln.select("locus", "row_ord", "taxon", "seq").groupBy("locus").applyInPandas(kernel, "name string, value string")


def write_named(files: DataFrame, folder: str) -> int:
    """Write each row's value (text or bytes) as the file ``name`` of a folder all executors see; how many were written.

    A file is written beside its place and then moved there, so a task that is run again leaves whole files
    only. Names that aren't plain, and names that come twice, are errors; a folder that has files is one too.
    """
    from pyarrow import fs

    from ..session import ship_package

    ship_package(files.sparkSession)

    def place(uri: str):
        if "://" not in uri:
            return fs.LocalFileSystem(), uri.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)

    system, path = place(folder)
    system.create_dir(path, recursive=True)
    if system.get_file_info(fs.FileSelector(path)):
        raise ValueError(f"{folder} is not empty")

    def work(batches):
        own, base = place(folder)
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                part = f"{base}/.{uuid.uuid4().hex}"
                with own.open_output_stream(part) as f:
                    f.write(value.encode() if isinstance(value, str) else value)
                own.move(part, f"{base}/{safe_name(name)}")
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    names = files.mapInArrow(work, "name string").groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names")).first()
    if names.n != names.names:
        raise ValueError("two files have one name")
    return names.n


def guard_paths(source: str, target: str) -> None:
    """An error if a target is its own source."""
    plain = lambda p: re.sub(r"/+$", "", p.removeprefix("file://").removeprefix("file:"))
    if plain(source) == plain(target):
        raise ValueError(f"{target} is also the input")


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A summary as CSV files with the classic column names in their header."""
    legacy_summary(summary).write.mode(mode).option("header", True).csv(path)


def legacy_summary(summary: DataFrame) -> DataFrame:
    """A summary under the column names of the classic files."""
    return summary.select(*[F.col(c).alias(LEGACY_NAMES.get(c, c)) for c in summary.columns])


def write_matches(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The long match table as Parquet, partitioned by taxon, so that a taxon's reads prune to its files."""
    matches.repartition("taxon").sortWithinPartitions("uce").write.mode(mode).partitionBy("taxon").parquet(path)
