"""Column functions over names and sequences, all of them Spark built-ins."""

from .names import (
    capitalise_first,
    contig_name,
    contig_name_lenient,
    header_field,
    header_map,
    key_locus,
    key_taxon,
    locus_name,
    nexus_name,
    strip_locus_prefix,
    strip_reverse_marker,
    taxon_from_file,
)
from .sequences import (
    clean_sequence,
    degenerate_to_n,
    end_gaps_to_missing,
    gc_fraction,
    is_all_gaps,
    leading_gaps,
    masked_fraction,
    n_count,
    reverse_complement,
    reverse_complement_plain,
    reverse_complement_upper,
    ry_binary,
    ry_recode,
    trailing_gaps,
    ungap,
    wrap_sequence,
)

__all__ = [
    "capitalise_first",
    "clean_sequence",
    "contig_name",
    "contig_name_lenient",
    "degenerate_to_n",
    "end_gaps_to_missing",
    "gc_fraction",
    "header_field",
    "header_map",
    "is_all_gaps",
    "key_locus",
    "key_taxon",
    "leading_gaps",
    "locus_name",
    "masked_fraction",
    "n_count",
    "nexus_name",
    "reverse_complement",
    "reverse_complement_plain",
    "reverse_complement_upper",
    "ry_binary",
    "ry_recode",
    "strip_locus_prefix",
    "strip_reverse_marker",
    "taxon_from_file",
    "trailing_gaps",
    "ungap",
    "wrap_sequence",
]
