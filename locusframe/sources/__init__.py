"""Readers and writers: sequence files, hits, alignments, intervals, genomes, configurations."""

from .alignment import read_alignments
from .bed import read_bed
from .config import read_config
from .fasta import count_contigs, count_reads, fasta_lengths, fastq_lengths, read_fasta, read_fastq, validate_fasta
from .hits import read_hits
from .twobit import read_twobit, twobit_index, write_twobit_bytes

__all__ = [
    "count_contigs",
    "count_reads",
    "fasta_lengths",
    "fastq_lengths",
    "read_alignments",
    "read_bed",
    "read_config",
    "read_fasta",
    "read_fastq",
    "read_hits",
    "read_twobit",
    "twobit_index",
    "validate_fasta",
    "write_twobit_bytes",
]
