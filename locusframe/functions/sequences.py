"""Sequence transforms and fractions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC codes, and the purine/pyrimidine alphabets.
_IUPAC = ("ACGTMRWSYKVHDBXN", "TGCAKYWSRMBDHVXN")
_PURINES, _PYRIMIDINES, _OTHER_CODES = "AGR", "CTY", "SWKMBDHV"
_DEGENERATE = "RYSWKMBDHVX"


def _both_cases(source: str, target: str) -> tuple[str, str]:
    return source + source.lower(), target + target.lower()


def reverse_complement(seq: Column) -> Column:
    """Reverse complement over all IUPAC codes, case kept; other characters pass."""
    return F.reverse(F.translate(seq, *_both_cases(*_IUPAC)))


def reverse_complement_plain(seq: Column) -> Column:
    """Reverse complement of A, C, G, T only, case kept."""
    return F.reverse(F.translate(seq, *_both_cases("ACGT", "TGCA")))


def reverse_complement_upper(seq: Column) -> Column:
    """Upper-cased reverse complement of A, C, G, T."""
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def ry_recode(seq: Column) -> Column:
    """Purines to R, pyrimidines to Y, other codes to ``?``; N and gaps stay."""
    source = _PURINES + _PYRIMIDINES
    lowered = source.lower()
    return F.translate(seq, source + lowered + _OTHER_CODES + _OTHER_CODES.lower(), "RRRYYY" + "rrryyy" + "?" * 2 * len(_OTHER_CODES))


def ry_binary(seq: Column) -> Column:
    """Purines to 1, pyrimidines to 0, other codes and N to ``?``."""
    source, other = _PURINES + _PYRIMIDINES, _OTHER_CODES + "N"
    return F.translate(seq, source + source.lower() + other + other.lower(), "111000" * 2 + "?" * 2 * len(other))


def degenerate_to_n(seq: Column) -> Column:
    """Every degenerate code, in either case, to N."""
    source = _DEGENERATE + _DEGENERATE.lower()
    return F.translate(seq, source, "N" * len(source))


def clean_sequence(seq: Column) -> Column:
    """Without N, n and commas, then without lower-case bases at both ends."""
    return F.btrim(F.translate(seq, "Nn,", ""), F.lit("acgtn"))


def ungap(seq: Column, upper: bool = False) -> Column:
    """Without gaps and missing characters."""
    out = F.translate(seq, "-?", "")
    return F.upper(out) if upper else out


def leading_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(F.ltrim(seq, F.lit("-")))


def trailing_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, F.lit("-")))


def is_all_gaps(seq: Column) -> Column:
    """True for a non-empty sequence of gaps."""
    return (F.length(seq) > 0) & (F.length(F.btrim(seq, F.lit("-"))) == 0)


def end_gaps_to_missing(seq: Column) -> Column:
    """Gap runs at both ends become ``?``."""
    core = F.btrim(seq, F.lit("-"))
    flanked = F.concat(F.repeat(F.lit("?"), leading_gaps(seq)), core, F.repeat(F.lit("?"), trailing_gaps(seq)))
    return F.when(F.length(core) == 0, F.repeat(F.lit("?"), F.length(seq))).otherwise(flanked)


def _share(count: Column, whole: Column) -> Column:
    return F.when(whole > 0, count.cast("double") / whole)


def masked_fraction(seq: Column) -> Column:
    """Lower-case letters over the length; null for an empty sequence."""
    return _share(F.length(F.regexp_replace(seq, "[^a-z]", "")), F.length(seq))


def n_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "Nn", ""))).cast("long")


def gc_fraction(seq: Column) -> Column:
    """G and C of either case over the length; null for an empty sequence."""
    return _share(F.length(seq) - F.length(F.translate(seq, "GCgc", "")), F.length(seq))


def wrap_sequence(seq: Column, width: int = 60) -> Column:
    """Lines of ``width`` characters, without a newline at the end."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
