"""2bit genomes: an index of sequences, and slices read from only the bytes they need."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's signature and base codes.
SIGNATURE = 0x1A412743
BASES = np.frombuffer(b"TCAG", np.uint8)


def _open(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = path[len("file:") :] if path.startswith("file:") else path
        return fs.LocalFileSystem().open_input_file(path)
    f, p = fs.FileSystem.from_uri(path)
    return f.open_input_file(p)


@dataclass
class Sequence:
    name: str
    size: int
    packed_at: int
    n_blocks: list[tuple[int, int]]
    masks: list[tuple[int, int]]


class TwoBit:
    """Random access to a 2bit file through a seekable file object."""

    def __init__(self, file):
        self.file = file
        head = self._at(0, 16)
        self.order = "<" if struct.unpack("<I", head[:4])[0] == SIGNATURE else ">"
        signature, version, count, _ = struct.unpack(self.order + "4I", head)
        if signature != SIGNATURE or version not in (0, 1):
            raise ValueError("this is no 2bit file")
        wide = 8 if version else 4
        self.offsets: dict[str, int] = {}
        at = 16
        for _ in range(count):
            (n,) = self._at(at, 1)
            raw = self._at(at + 1, n + wide)
            self.offsets[raw[:n].decode()] = int.from_bytes(raw[n:], "little" if self.order == "<" else "big")
            at += 1 + n + wide

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("the 2bit file ends too early")
        return out

    def _ints(self, at: int, n: int) -> tuple[int, ...]:
        return struct.unpack(f"{self.order}{n}I", self._at(at, 4 * n))

    def sequence(self, name: str) -> Sequence:
        if name not in self.offsets:
            raise KeyError(f"no sequence {name}")
        at = self.offsets[name]
        size, n = self._ints(at, 2)
        blocks = []
        at += 8
        starts = self._ints(at, n)
        blocks.append(list(zip(starts, self._ints(at + 4 * n, n))))
        at += 8 * n
        (m,) = self._ints(at, 1)
        starts = self._ints(at + 4, m)
        blocks.append(list(zip(starts, self._ints(at + 4 + 4 * m, m))))
        return Sequence(name, size, at + 4 + 8 * m + 4, *blocks)

    def slice(self, name: str, start: int = 0, end: int | None = None) -> str:
        """Bases of a range, clamped to the sequence: masked ones in lower case, then unknown ones as N."""
        s = self.sequence(name)
        start, end = max(0, start), min(s.size, s.size if end is None else end)
        if start >= end:
            return ""
        first = start // 4
        packed = np.frombuffer(self._at(s.packed_at + first, (end + 3) // 4 - first), np.uint8)
        codes = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
        out = BASES[codes[start - 4 * first : end - 4 * first]].copy()
        for a, n in s.masks:
            lo, hi = max(a, start) - start, min(a + n, end) - start
            if lo < hi:
                out[lo:hi] |= 0x20
        for a, n in s.n_blocks:
            lo, hi = max(a, start) - start, min(a + n, end) - start
            if lo < hi:
                out[lo:hi] = ord("N")
        return out.tobytes().decode("ascii")


def write_twobit_bytes(sequences: dict[str, str]) -> bytes:
    """A 2bit file: N of either case as unknown blocks, lower case as masks."""
    import re

    names = list(sequences)
    index_size = 16 + sum(1 + len(n.encode()) + 4 for n in names)
    bodies = []
    for name in names:
        seq = sequences[name]
        runs = lambda p, seq=seq: [(m.start(), m.end() - m.start()) for m in re.finditer(p, seq)]
        code = np.zeros(-(-len(seq) // 4) * 4, np.uint8)
        for k, b in enumerate("TCAG"):
            code[: len(seq)][np.frombuffer(seq.upper().encode(), np.uint8) == ord(b)] = k
        q = code.reshape(-1, 4)
        body = struct.pack("<I", len(seq))
        for found in (runs("[Nn]+"), runs("[a-z]+")):
            body += struct.pack(f"<{1 + 2 * len(found)}I", len(found), *[a for a, _ in found], *[n for _, n in found])
        bodies.append(body + struct.pack("<I", 0) + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes())
    out, at = struct.pack("<4I", SIGNATURE, 0, len(names), 0), index_size
    for name, body in zip(names, bodies):
        out += bytes((len(name.encode()),)) + name.encode() + struct.pack("<I", at)
        at += len(body)
    return out + b"".join(bodies)


def twobit_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of a genome, sorted by name; read on the driver, as an index is short."""
    with _open(path) as f:
        tb = TwoBit(f)
        return spark.createDataFrame([(n, tb.sequence(n).size) for n in sorted(tb.offsets)], "name string, size long")


def read_twobit(intervals: DataFrame, path: str) -> DataFrame:
    """``intervals`` (chromo, start, end, ...) with their sequence; tasks read only the bytes of their intervals.

    The file must be on storage that all executors see. Intervals are sorted inside a task, so that reads go forwards.
    """
    from pyspark.sql import types as T

    from ..session import ship_package

    ship_package(intervals.sparkSession)
    schema = T.StructType([*intervals.schema.fields, T.StructField("sequence", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            tb = TwoBit(f)
            for b in batches:
                seqs = [tb.slice(c, s, e) for c, s, e in zip(*(b.column(x).to_pylist() for x in ("chromo", "start", "end")))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seqs, pa.string())], names=[*b.schema.names, "sequence"])

    return intervals.sortWithinPartitions("chromo", "start").mapInArrow(work, schema)


def whole_genome(index: DataFrame) -> DataFrame:
    return index.select(F.col("name").alias("chromo"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
