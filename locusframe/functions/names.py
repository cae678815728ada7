"""Names of loci, contigs, taxa and header fields as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How probe headers and the headers of common assemblers look.
PROBE_PATTERN = r"^(uce-\d+)(?:_p\d+.*)"
CONTIG_PATTERNS = (
    r"comp\d+_c\d+_seq\d+|c\d+_g\d+_i\d+|TR\d+\|c\d+_g\d+_i\d+|TRINITY_DN\d+_c\d+_g\d+_i\d+",
    r"node_\d+",
    r"node_\d+",
    r"contig-\d+_\d+",
    r"NODE_\d+_length_\d+_cov_\d+.\d+",
    r"k\d+_\d+",
    r"contig_\d+",
)
NEXUS_SPECIAL = " \t\n()[]{}\\,;:=*'\"`+-<>"


def _first_group(text: Column, pattern: str, strict: bool) -> Column:
    """Group 1, or null (an error if ``strict``) where the pattern doesn't match: never an empty string."""
    miss = F.raise_error(F.concat(F.lit(f"no match of {pattern}: "), F.coalesce(text, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(miss)


def locus_name(header: Column, pattern: str = PROBE_PATTERN, strict: bool = False) -> Column:
    """A probe header's locus."""
    return _first_group(header, pattern, strict)


def contig_name(header: Column, patterns: Sequence[str] = CONTIG_PATTERNS, strict: bool = False) -> Column:
    """A contig header's node name; of the patterns, in any case, the first that matches wins."""
    return _first_group(header, f"(?i)^({'|'.join(patterns)}).*", strict)


def contig_name_lenient(header: Column, patterns: Sequence[str] = CONTIG_PATTERNS) -> Column:
    """The node name, else the header's first word."""
    first_word = F.split(F.ltrim(header), r"\s+")[0]
    return F.coalesce(contig_name(header, patterns), F.when(first_word != "", first_word))


def taxon_from_file(path: Column) -> Column:
    """A file's base name up to its first dot, hyphens as underscores."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.translate(F.split_part(base, F.lit("."), F.lit(1)), "-", "_")


def key_locus(key: Column, sep: str = "_") -> Column:
    """The part of a record's name before the first separator."""
    return F.split_part(key, F.lit(sep), F.lit(1))


def key_taxon(key: Column, sep: str = "_") -> Column:
    """The parts after the first separator, joined by hyphens."""
    parts = F.split(key, re.escape(sep))
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "-")


def strip_locus_prefix(name: Column, stem: Column) -> Column:
    """A taxon without reverse markers and its locus in front; the locus is the stem without the characters of ``_phased`` at its ends."""
    locus = F.regexp_replace(F.btrim(stem, F.lit("_phased")), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_replace(name, F.concat(F.lit("^(_R_)*"), locus, F.lit("_*")), F.lit(""))


def strip_reverse_marker(name: Column) -> Column:
    """Without the characters ``_`` and ``R`` in front."""
    return F.ltrim(name, F.lit("_R_"))


def nexus_name(name: Column) -> Column:
    """A NEXUS label: quotes doubled, and quoted if it has a special character."""
    escaped = F.replace(name, F.lit("'"), F.lit("''"))
    special = "[" + "".join("\\" + c if c in "()[]{}\\^$.|?*+-" else c for c in NEXUS_SPECIAL) + "]"
    return F.when(escaped.rlike(special), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(escaped)


def header_map(header: Column) -> Column:
    """The ``key:value`` fields after a header's first ``|``."""
    return F.str_to_map(F.element_at(F.split(header, r"\|", 2), 2), F.lit(","), F.lit(":"))


def header_field(header: Column, key: str) -> Column:
    return F.get(F.array(F.element_at(header_map(header), key)), F.lit(0))


def capitalise_first(text: Column) -> Column:
    """The first letter upper, all others lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))
