"""Alignment files: NEXUS, PHYLIP (strict, relaxed, sequential), CLUSTAL, Stockholm, EMBOSS and FASTA.

A file is one alignment and is parsed whole in an Arrow batch on an executor.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rows = list[tuple[str, str]]

# File extensions of each format.
EXTENSIONS = {
    "nexus": ("nexus", "nex"),
    "fasta": ("fasta", "fsa", "aln", "fa"),
    "phylip": ("phylip", "phy"),
    "phylip-relaxed": ("phylip", "phy", "phylip-relaxed"),
    "phylip-sequential": ("phylip", "phy", "phylip-sequential"),
    "clustal": ("clustal", "clw"),
    "stockholm": ("stockholm",),
    "emboss": ("emboss",),
}


def _gather(pairs: Iterable[tuple[str, str]]) -> Rows:
    """Chunks of one label joined, labels in the order of their first chunk."""
    out: dict[str, list[str]] = {}
    for label, chunk in pairs:
        out.setdefault(label, []).append(chunk)
    if not out:
        raise ValueError("the alignment has no sequences")
    return [(k, "".join(v)) for k, v in out.items()]


_NEXUS = re.compile(r"'((?:[^']|'')*)'|\[|\]|([^'\[\]]+)")


def _without_comments(text: str) -> str:
    """Bracketed comments, nested ones too, become a blank; line ends in them and quoted text stay."""
    out, depth = [], 0
    for m in _NEXUS.finditer(text):
        piece = m[0]
        if piece == "[":
            depth += 1
            out.append(" " if depth == 1 else "")
        elif piece == "]" and depth:
            depth -= 1
        elif depth:
            out.append("\n" * piece.count("\n"))
        else:
            out.append(piece)
    if depth:
        raise ValueError("a comment has no end")
    return "".join(out)


def parse_nexus(text: str) -> Rows:
    m = re.search(r"(?im)^[ \t]*matrix(?=\s|$)", clean := _without_comments(text))
    if not m:
        raise ValueError("no matrix block")
    body = re.match(r"((?:'(?:[^']|'')*'|[^';])*);?", clean[m.end() :])[1]

    def rows() -> Iterator[tuple[str, str]]:
        for line in body.splitlines():
            if found := re.match(r"\s*(?:'((?:[^']|'')*)'|(\S+))(.*)", line):
                label = found[2] if found[1] is None else found[1].replace("''", "'")
                if not label:
                    raise ValueError(f"a row has no name: {line.strip()}")
                yield label, "".join(found[3].split())

    return _gather(rows())


def _label(line: str, strict: bool) -> tuple[str, str]:
    """A row's name and the bases after it; strict names have ten columns."""
    name, bases = (line[:10], line[10:]) if strict else (line.split(None, 1) + [""])[:2]
    return name.strip(), "".join(bases.split())


def _sequential(lines: list[str], taxa: int, width: int, strict: bool) -> Rows:
    """One row after the other, each over as many lines as it takes."""
    rows, left = [], iter(lines)
    for _ in range(taxa):
        name, bases = _label(next(left, ""), strict)
        while len(bases) < width and (more := next(left, None)) is not None:
            bases += "".join(more.split())
        rows.append((name, bases))
    return rows + [("", x) for x in left]


def _interleaved(lines: list[str], taxa: int, strict: bool) -> Rows:
    """Blocks of one line a row; later blocks may repeat the names."""
    rows = [_label(line, strict) for line in lines[:taxa]]
    for at in range(taxa, len(lines), taxa):
        for k, line in enumerate(lines[at : at + taxa]):
            name, bases = _label(line, strict)
            rows[k] = (rows[k][0], rows[k][1] + (bases if name == rows[k][0] and bases else "".join(line.split())))
    return rows


def parse_phylip(text: str, strict: bool = False) -> Rows:
    """Rows in blocks or one after the other: the reading that gives the dimensions of the first line."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or len(lines[0].split()) < 2:
        raise ValueError("no PHYLIP dimensions")
    taxa, width = (int(x) for x in lines[0].split()[:2])
    if taxa < 1:
        raise ValueError("there must be a taxon")
    for rows in (_interleaved(lines[1:], taxa, strict), _sequential(lines[1:], taxa, width, strict)):
        if len(rows) == taxa and all(name and len(bases) == width for name, bases in rows):
            return rows
    raise ValueError(f"expected {taxa} rows of {width} characters")


def parse_clustal(text: str) -> Rows:
    fields = (x.split() for x in text.splitlines()[1:] if x.strip() and not x[0].isspace())
    return _gather((f[0], f[1]) for f in fields if len(f) > 1)


def parse_stockholm(text: str) -> Rows:
    body = text.split("\n//", 1)[0]
    fields = [x.split() for x in map(str.strip, body.splitlines()) if x and x[0] != "#" and x != "//"]
    if any(len(f) < 2 for f in fields):
        raise ValueError("a row has no sequence")
    return _gather((f[0], f[1]) for f in fields)


def parse_emboss(text: str) -> Rows:
    fields = (x.split() for x in text.splitlines() if x.strip() and x[0] != "#" and not x[0].isspace())
    return _gather((f[0], f[2]) for f in fields if len(f) > 3 and f[1].isdigit() and f[-1].isdigit())


def parse_fasta(text: str) -> Rows:
    head, *records = re.split(r"(?m)^>", text)
    if head.strip():
        raise ValueError("data before the first header")
    return _gather((r.split(None, 1)[0], "".join(r.split("\n", 1)[1].split()) if "\n" in r else "") for r in records)


PARSERS: dict[str, Callable[[str], Rows]] = {
    "nexus": parse_nexus,
    "fasta": parse_fasta,
    "phylip": lambda t: parse_phylip(t, strict=True),
    "phylip-relaxed": parse_phylip,
    "phylip-sequential": parse_phylip,
    "clustal": parse_clustal,
    "stockholm": parse_stockholm,
    "emboss": parse_emboss,
}


def check_rows(rows: Rows, keep_first: bool = False) -> Rows:
    """Names there and unique (the first of repeated ones stays if asked for), sequences of one length."""
    if any(not label for label, _ in rows):
        raise ValueError("a row has no name")
    if keep_first:
        rows = list({label: (label, seq) for label, seq in reversed(rows)}.values())[::-1]
    if len({label for label, _ in rows}) != len(rows):
        raise ValueError("a name occurs twice")
    if len({len(seq) for _, seq in rows}) > 1:
        raise ValueError("rows differ in length")
    return rows


def read_alignments(spark: SparkSession, folder: str, fmt: str = "nexus", check: bool = True) -> DataFrame:
    """(file, locus, row_ord, taxon, seq) of all files of a format; the locus is the file's name up to its first dot."""
    from ..session import ship_package

    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt}")
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS[fmt]) + "}").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = PARSERS[fmt](content.decode("utf-8"))
                    rows = check_rows(rows) if check else rows
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_pydict(
                    {"file": [name] * len(rows), "locus": [name.split(".")[0]] * len(rows), "row_ord": pa.array(range(len(rows)), pa.int32()), "taxon": [x for x, _ in rows], "seq": [x for _, x in rows]}
                )

    return named.mapInArrow(work, "file string, locus string, row_ord int, taxon string, seq string")


def parse_charsets(text: str) -> list[tuple[str, int, int]]:
    """(name, start, stop) of ``charset`` lines, half-open from 0; charpartitions and sets that begin at 0 are passed over."""
    found = re.findall(r"(?im)^\s*charset\s+(?:'((?:[^']|'')*)'|(\S+))\s*=\s*(\d+)\s*-\s*(\d+)\s*;", text)
    return [((q or w).replace("''", "'"), int(a) - 1, int(b)) for q, w, a, b in found if int(a) > 0]
