"""Three-stage trimming of alignments in a numpy kernel, one task's loci after the other.

Block edges, then each row's edges against the consensus, then block edges again with end gaps turned into
missing data. The first edge is where a window's share of good columns exceeds the threshold, the last where
it reaches it; a search that finds nothing ends at the last index, as in the method that this reproduces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrimOptions:
    window: int = 20
    proportion: float = 0.65
    threshold: float = 0.65
    max_divergence: float = 0.20
    min_length: int = 100

    def __post_init__(self):
        if self.window < 1:
            raise ValueError("the window must be positive")
        for name in ("proportion", "threshold", "max_divergence"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")


_GAP, _MISSING, _N = ord("-"), ord("?"), ord("N")


def window_share(flags: np.ndarray, window: int) -> np.ndarray:
    """For each position, the share of true flags in the window that begins there, cut off at the end."""
    sums = np.concatenate(([0], np.cumsum(flags)))
    ends = np.minimum(np.arange(len(flags)) + window, len(flags))
    return (sums[ends] - sums[:-1]) / (ends - np.arange(len(flags)))


def good_columns(rows: np.ndarray, majority: int) -> np.ndarray:
    """Columns with ``majority`` gaps at most in which some other character occurs that often."""
    states = np.unique(rows)
    counts = [(rows == s).sum(0) for s in states if s != _GAP]
    most = np.max(counts, axis=0) if counts else np.zeros(rows.shape[1], int)
    return ((rows == _GAP).sum(0) <= majority) & (most >= majority)


def _first(found: np.ndarray) -> int | None:
    at = np.flatnonzero(found)
    return int(at[0]) if len(at) else None


def _edges(good: np.ndarray, window: int, threshold: float) -> tuple[int, int]:
    n = len(good)
    start = _first(good & (window_share(good, window) > threshold))
    back = good[::-1]
    end = _first(back & (window_share(back, window) >= threshold))
    return (n - 1 if start is None else start), (n - 1 if end is None else n - end)


def _gap_runs(row: np.ndarray) -> tuple[int, int]:
    """(first index that is no gap, index after the last)."""
    real = np.flatnonzero(row != _GAP)
    return (int(real[0]), int(real[-1]) + 1) if len(real) else (len(row), 0)


def trim_block(rows: np.ndarray, o: TrimOptions, end_gaps_missing: bool) -> np.ndarray | None:
    if not rows.size:
        return None
    good = good_columns(rows, round(o.proportion * len(rows)))  # half to even
    start, end = _edges(good, o.window, o.threshold)
    if not end:
        return None
    out = rows[:, start:end].copy() if start < end else rows[:, :0]
    if out.shape[1] < o.min_length or (out.shape[1] and (out == _GAP).all(1).any()):
        return None
    if end_gaps_missing:
        for row in out:
            first, last = _gap_runs(row)
            row[:first], row[last:] = _MISSING, _MISSING
    return out


def majority_consensus(rows: np.ndarray) -> np.ndarray:
    """The most frequent character of each column, ties to the one that a row has first; N below a half."""
    best, most, first = np.zeros(rows.shape[1], np.uint8), np.zeros(rows.shape[1], int), np.full(rows.shape[1], len(rows))
    for s in np.unique(rows):
        here = rows == s
        count, at = here.sum(0), np.where(here.any(0), here.argmax(0), len(rows))
        better = (count > most) | ((count == most) & (at < first))
        best, most, first = np.where(better, s, best), np.where(better, count, most), np.where(better, at, first)
    return np.where(most / len(rows) >= 0.5, best, _N).astype(np.uint8)


def trim_rows(rows: np.ndarray, o: TrimOptions) -> np.ndarray | None:
    """Each row's divergent ends become gaps; a row that is nothing but gaps drops the alignment."""
    if not rows.size:
        return None
    upper = np.where((rows >= 97) & (rows <= 122), rows - 32, rows).astype(np.uint8)
    consensus = majority_consensus(upper)
    n = rows.shape[1]
    for row in upper:
        first, last = _gap_runs(row)
        differs = row[first:last] != consensus[first:last] if first < last else np.zeros(0, bool)
        lead = trail = 0
        if len(differs):
            ok = _first(window_share(differs, o.window) < o.max_divergence)
            lead = len(differs) - 1 if ok is None else ok
            ok = _first(window_share(differs[::-1], o.window) < o.max_divergence)
            trail = len(differs) - 1 if ok is None else len(differs) - ok
        row[: min(first + lead, n)] = _GAP
        row[min(first + trail, n) :] = _GAP
        if (row == _GAP).all() or n < o.min_length:
            return None
    return upper


def trim_alignment(rows: np.ndarray, o: TrimOptions) -> np.ndarray | None:
    """Rows of an alignment as a byte matrix; None if it is dropped."""
    out = trim_block(rows, o, False)
    out = trim_rows(out, o) if out is not None else None
    return trim_block(out, o, True) if out is not None else None


def trim_alignments(aln: DataFrame, options: TrimOptions = TrimOptions()) -> DataFrame:
    """Trimmed alignments (locus, row_ord, taxon, seq); dropped ones have no rows."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_ord", kind="stable")
        out = trim_alignment(np.stack([np.frombuffer(s.encode("latin-1"), np.uint8) for s in rows["seq"]]), options)
        if out is None:
            return rows.iloc[:0]
        return rows.assign(seq=[r.tobytes().decode("latin-1") for r in out])

    return aln.select("locus", F.col("row_ord").cast("int").alias("row_ord"), "taxon", "seq").groupBy("locus").applyInPandas(kernel, "locus string, row_ord int, taxon string, seq string")


def good_column_flags(aln: DataFrame, proportion: float = 0.65) -> DataFrame:
    """(locus, pos, good) by aggregation alone."""
    from .sites import cells

    majority = F.bround(F.lit(proportion) * F.col("rows"))
    per = cells(aln, ()).groupBy("locus", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    columns = per.groupBy("locus", "pos").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("ch") == "-", F.col("n"))), F.lit(0)).alias("gaps"), F.coalesce(F.max(F.when(F.col("ch") != "-", F.col("n"))), F.lit(0)).alias("most"))
    return columns.select("locus", "pos", ((F.col("gaps") <= majority) & (F.col("most") >= majority)).alias("good"))


def trim_windows(flags: DataFrame, window: int = 20) -> DataFrame:
    """(locus, pos, good, share): the share of good columns in the window that begins at each column."""
    frame = Window.partitionBy("locus").orderBy("pos").rowsBetween(0, window - 1)
    return flags.withColumn("share", F.avg(F.col("good").cast("int")).over(frame))


def block_edges(windows: DataFrame, threshold: float = 0.65, window: int = 20) -> DataFrame:
    """(locus, start, end) of the first stage, by windows over both directions."""
    back = Window.partitionBy("locus").orderBy(F.col("pos").desc()).rowsBetween(0, window - 1)
    w = windows.withColumn("back", F.avg(F.col("good").cast("int")).over(back))
    edges = w.groupBy("locus").agg(
        F.max("pos").alias("last"), F.min(F.when(F.col("good") & (F.col("share") > threshold), F.col("pos"))).alias("start"), F.max(F.when(F.col("good") & (F.col("back") >= threshold), F.col("pos") + 1)).alias("end")
    )
    return edges.select("locus", F.coalesce("start", "last").alias("start"), F.coalesce("end", "last").alias("end"))
