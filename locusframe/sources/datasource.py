"""Python data sources after ``register``: ``spark.read.format`` of twobit, alignment, fasta, fastq or lastz.

The last three take a ``path`` (a file or a folder that all executors see) and read each file, plain or gzip, as
a stream; plain files that are large are better read by ``read_fasta``, ``read_fastq`` and ``read_hits``, which
split them.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Span(InputPartition):
    def __init__(self, path: str, name: str, start: int, end: int):
        self.path, self.name, self.start, self.end = path, name, start, end


class TwoBitSource(DataSource):
    """Options: ``path``, and ``chunk`` (bases a row, 1,000,000). Each chunk is a partition of its own."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chromo string, start long, end long, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return _TwoBitReader(self.options["path"], int(self.options.get("chunk", 1_000_000)))


class _TwoBitReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self):
        from .twobit import TwoBit, _open

        with _open(self.path) as f:
            genome = TwoBit(f)
            sizes = {n: genome.sequence(n).size for n in genome.offsets}
        return [_Span(self.path, n, a, min(size, a + self.chunk)) for n, size in sorted(sizes.items()) for a in range(0, size, self.chunk)]

    def read(self, partition: _Span):
        from .twobit import TwoBit, _open

        with _open(partition.path) as f:
            yield partition.name, partition.start, partition.end, TwoBit(f).slice(partition.name, partition.start, partition.end)


class AlignmentSource(DataSource):
    """Options: ``path`` (a local or shared folder) and ``format`` (nexus). Each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "alignment"

    def schema(self) -> str:
        return "file string, locus string, row_ord int, taxon string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _AlignmentReader(self.options["path"], self.options.get("format", "nexus"))


class _AlignmentReader(DataSourceReader):
    def __init__(self, path: str, fmt: str):
        self.path, self.fmt = path, fmt

    def partitions(self):
        from .alignment import EXTENSIONS

        names = sorted(n for n in os.listdir(self.path) if n.rsplit(".", 1)[-1] in EXTENSIONS[self.fmt])
        return [_Span(os.path.join(self.path, n), n, 0, 0) for n in names]

    def read(self, partition: _Span):
        from .alignment import PARSERS, check_rows

        with open(partition.path, encoding="utf-8") as f:
            rows = check_rows(PARSERS[self.fmt](f.read()))
        for k, (taxon, seq) in enumerate(rows):
            yield partition.name, partition.name.split(".")[0], k, taxon, seq


def _text_lines(path: str) -> Iterator[str]:
    opened = gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8")
    with opened as f:
        for line in f:
            yield line.rstrip("\r\n")


def fasta_records(lines: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(id, description, sequence) of records; text before the first header and headers without a name are errors."""
    head: str | None = None
    parts: list[str] = []
    for line in lines:
        if not line.startswith(">"):
            if line.strip() and head is None:
                raise ValueError("data before the first header")
            parts.append("".join(line.split()))
            continue
        if head is not None:
            yield head.split()[0], head, "".join(parts)
        head, parts = line[1:].rstrip(), []
        if not head.strip():
            raise ValueError("a record without a name")
    if head is not None:
        yield head.split()[0], head, "".join(parts)


def fastq_records(lines: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(id, seq, quality) of reads of four lines; an unfinished last one is passed over."""
    at = iter(lines)
    for head, seq, _, quality in zip(at, at, at, at):
        yield head[1:], seq.split()[0] if seq.split() else "", quality


def hit_records(lines: Iterable[str]) -> Iterator[tuple]:
    """Hits of 17 or 19 fields; fields that the short form lacks are null."""
    for number, line in enumerate(lines, 1):
        f = line.split("\t")
        if len(f) not in (17, 19):
            raise ValueError(f"line {number} has {len(f)} fields")
        pct = [float(x.rstrip("%")) for x in (f[14], f[16], *f[18:])]
        yield f[1].removeprefix(">"), f[2], int(f[3]), int(f[4]), f[6].removeprefix(">"), f[7], int(f[8]), int(f[9]), pct[0], pct[1], pct[2] if len(pct) > 2 else None


class _FileReader(DataSourceReader):
    """A partition for each file; rows are the file's name and what ``parse`` gives."""

    def __init__(self, path: str, parse):
        self.path, self.parse = path.removeprefix("file://").removeprefix("file:"), parse

    def partitions(self):
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n[0] not in "._")
        return [_Span(n, os.path.basename(n), 0, 0) for n in names]

    def read(self, partition: _Span):
        for row in self.parse(_text_lines(partition.path)):
            yield (partition.name, *row)


class FastaSource(DataSource):
    """FASTA files: file, id, description, sequence."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, id string, description string, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"], fasta_records)


class FastqSource(DataSource):
    """FASTQ files: file, id, seq, quality."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, id string, seq string, quality string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"], fastq_records)


class HitSource(DataSource):
    """Hit files of 17 or 19 fields: names, strands, places, percentages."""

    @classmethod
    def name(cls) -> str:
        return "lastz"

    def schema(self) -> str:
        return "file string, name1 string, strand1 string, zstart1 long, end1 long, name2 string, strand2 string, zstart2 long, end2 long, percent_identity double, percent_continuity double, percent_coverage double"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"], hit_records)


def register(spark: SparkSession) -> None:
    for source in (TwoBitSource, AlignmentSource, FastaSource, FastqSource, HitSource):
        spark.dataSource.register(source)
