"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the longest one seen before in the same text, with one more code
point. The phrase set is hashed, and the smallest hash values are the fingerprint; the share of common
values among the smallest of two fingerprints' union estimates the likeness of the phrase sets, which
follows how well one text compresses given the other.

``compare_neighbours`` walks the documents in descending identifier order. Identifier ranges are
partitions; the first document of each also goes to the partition before it, so every document meets the
next one without a global window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts_for, small_batches

#: Hash values in a fingerprint.
VALUES = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    have = len(_powers[0])
    if have < n:
        size = max(n, 2 * have, 4096)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def parse(text: str, start: int = 0, seen: set[str] | None = None) -> list[int]:
    """The phrases' ends from ``start`` on; ``seen`` holds the phrases before and gets the new ones.

    What is left at the end, a phrase seen before, has no end in the list. Every phrase but its last code
    point is a phrase, so the longest match is found by growing or shrinking a guess.
    """
    seen = set() if seen is None else seen
    ends, n, guess = [], len(text), 1
    add, append = seen.add, ends.append
    at = start
    while at < n:
        to = at + guess
        phrase = text[at:to]
        if phrase in seen:
            to += 1
            phrase = text[at:to]
            while phrase in seen:
                if to >= n:
                    return ends
                to += 1
                phrase = text[at:to]
            if to > n:
                return ends
        else:
            while to - at > 1:
                shorter = text[at : to - 1]
                if shorter in seen:
                    break
                to, phrase = to - 1, shorter
            if to > n:  # the guess passed the text's end: the phrase ends there
                to = n
                phrase = text[at:to]
                if phrase in seen:
                    return ends
        add(phrase)
        append(to)
        guess = max(1, to - at - 1)
        at = to
    return ends


def fingerprint(text: str, ends: list[int], values: int = VALUES) -> np.ndarray:
    """The smallest ``values`` distinct 32-bit hashes of the phrases, ascending."""
    if not ends:
        return np.zeros(0, np.uint32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _power(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * up[:-1], out=sums[1:])
    to = np.array(ends)
    begin = np.empty_like(to)
    begin[0], begin[1:] = 0, to[:-1]
    hashes = mix64((sums[to] - sums[begin]) * down[begin] + (to - begin).astype(np.uint64) * _MIX_LENGTH)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:values]


_MIX_LENGTH = np.uint64(0xD1B54A32D192ED03)


def likeness(a: np.ndarray, b: np.ndarray, values: int = VALUES) -> float:
    """The common share of the smallest ``values`` of both together; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, counts = np.unique(np.concatenate((a, b)), return_counts=True)
    return float((counts[:values] == 2).sum() / min(values, len(both)))


def as_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


class _Document:
    """A text's parse; ``edit`` parses the same text with another end, from where they part."""

    __slots__ = ("doc_id", "text", "ends", "values")

    def __init__(self, doc_id: int | None, text: str, values: int):
        self.doc_id, self.text = doc_id, text
        self.ends = parse(text)
        self.values = fingerprint(text, self.ends, values)

    def edit(self, following: str, values: int) -> tuple[str, np.ndarray]:
        n = len(self.text)
        keep = n - n // 2
        edited = self.text[:keep] + following[: n // 2]
        common: list[int] = []
        seen: set[str] = set()
        at = 0
        for to in self.ends:
            if to > keep:
                break
            seen.add(self.text[at:to])
            common.append(to)
            at = to
        ends = common + parse(edited, at, seen)
        return edited, fingerprint(edited, ends, values)


def ordered_ranges(docs: DataFrame, id_col: str, parts: int) -> tuple[list[int], dict[int, int], dict[int, int | None]]:
    """Splits of the identifiers into ranges; for each non-empty one, the range before it in descending order
    (the highest follows the lowest) and its largest identifier. The driver gets a row for each range."""
    probs = [k / parts for k in range(1, parts)]
    splits = sorted({int(x) for x in docs.approxQuantile(id_col, probs, 1 / (4 * parts))}) if probs else []
    rows = docs.select(F.col(id_col).cast("long").alias("id")).select(_range_of(splits)("id").alias("part"), "id").groupBy("part").agg(F.max("id").alias("most")).collect()
    most = {r.part: r.most for r in rows}
    order = sorted(most, reverse=True)
    return splits, {p: order[k - 1] for k, p in enumerate(order)}, most


def _range_of(splits: list[int]):
    bounds = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        # identifiers stay whole numbers: a column with nulls would turn into doubles
        out[known.to_numpy()] = np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return of


def compare_neighbours(docs: DataFrame, values: int = VALUES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness, and that to the next document's.

    The next document is the one with the next smaller identifier, null identifiers last and, among rows
    of one identifier, the next by text; after the last comes the first, so a lone document is its own next
    one. The edited text has the last half of the code points (rounded down) replaced by as many of the
    next text's first, or all it has. Null texts are empty; the fingerprint of an empty text is empty, and
    two empty ones have likeness 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts_for(docs, 16.0, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits, before, most = ordered_ranges(src.select("doc_id"), "doc_id", parts)
    if not most:
        before, most = {0: 0}, {0: None}
    firsts = spark.createDataFrame([(p, most[p], before[p]) for p in most], "part int, most long, before int")
    rows = src.withColumn("part", _range_of(splits)("doc_id")).join(F.broadcast(firsts), "part")  # one row a range
    goes = F.when(F.col("doc_id").eqNullSafe(F.col("most")), F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))))
    rows = rows.select("doc_id", "text", F.explode(goes.otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("extra"))))).alias("to"))
    rows = rows.select(F.col("to.part").alias("part"), F.col("to.extra").alias("extra"), "doc_id", "text")
    dealt = rows.repartitionById(len(splits) + 1, "part").sortWithinPartitions("extra", F.col("doc_id").desc_nulls_last(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Document | None = None
        done = False
        for batch in batches:
            out = []
            for doc_id, text, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("extra").to_pylist()):
                if done or (extra and last is None):
                    continue
                here = _Document(doc_id, text, values)
                if last is not None:
                    edited, print_ = last.edit(text, values)
                    out.append((last.doc_id, len(last.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(last.values), as_hex(print_), likeness(last.values, print_, values), likeness(last.values, here.values, values)))
                last, done = here, extra
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
