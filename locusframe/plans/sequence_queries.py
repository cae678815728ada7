"""Queries of sequence functions and length reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import reads
from .proxies import Proxy
from .registry import query

_IUPAC = "'ACGTMRWSYKVHDBXNacgtmrwsykvhdbxn', 'TGCAKYWSRMBDHVXNtgcakywsrmbdhvxn'"
_SCALARS = {
    "clean_sequence": (fn.clean_sequence, "trim(replace(replace(replace(seq, 'N', ''), 'n', ''), ',', ''), 'acgtn')"),
    "reverse_complement": (fn.reverse_complement, f"reverse(translate(seq, {_IUPAC}))"),
    "reverse_complement_plain": (fn.reverse_complement_plain, "translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')"),
    "reverse_complement_upper": (fn.reverse_complement_upper, "reverse(translate(upper(seq), 'ACGT', 'TGCA'))"),
    "ry_recode": (fn.ry_recode, "translate(translate(translate(seq, 'AGRagr', 'RRRrrr'), 'CTYcty', 'YYYyyy'), 'SWKMBDHVswkmbdhv', '????????????????')"),
    "ry_binary": (fn.ry_binary, "translate(translate(translate(seq, 'AGRagr', '111111'), 'CTYcty', '000000'), 'SWKMBDHVNswkmbdhvn', '??????????????????')"),
    "degenerate_to_n": (fn.degenerate_to_n, "regexp_replace(seq, '[RYSWKMBDHVXryswkmbdhvx]', 'N', 'g')"),
    "ungap": (fn.ungap, "replace(replace(seq, '-', ''), '?', '')"),
    "end_gaps_to_missing": (fn.end_gaps_to_missing, "CASE WHEN trim(seq, '-') = '' THEN repeat('?', length(seq)) ELSE repeat('?', length(seq) - length(ltrim(seq, '-'))) || trim(seq, '-') || repeat('?', length(seq) - length(rtrim(seq, '-'))) END"),
    "wrap_sequence": (lambda c: fn.wrap_sequence(c, 30), "substr(seq, 1, 30) || chr(10) || substr(seq, 31, 30) || chr(10) || substr(seq, 61)"),
}


def _scalar(name: str, function, sql: str) -> None:
    @query("sequences", sql=f"SELECT doc_id, {sql} AS result FROM sequences", name=name)
    def run(p: Proxy) -> DataFrame:
        return p.sequences.select("doc_id", function(F.col("seq")).alias("result"))


for _name, (_function, _sql) in _SCALARS.items():
    _scalar(_name, _function, _sql)


@query(
    "sequences",
    sql="""SELECT doc_id, round(length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq)::DOUBLE, 9) AS gc, round(length(regexp_replace(seq, '[^a-z]', '', 'g')) / length(seq)::DOUBLE, 9) AS masked,
    CAST(length(regexp_replace(seq, '[^Nn]', '', 'g')) AS BIGINT) AS n FROM sequences""",
)
def gc_masked_n_fraction(p: Proxy) -> DataFrame:
    s = F.col("seq")
    return p.sequences.select("doc_id", F.round(fn.gc_fraction(s), 9).alias("gc"), F.round(fn.masked_fraction(s), 9).alias("masked"), fn.n_count(s).alias("n"))


_REPORT = """count(n) AS reads, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(n)), 6) AS sem, min(n) AS least, max(n) AS most, round(median(n), 6) AS median"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "sem", "median")})


@query(sql=f"SELECT source AS file, {_REPORT}, count(*) FILTER (n >= 1000) AS long FROM (SELECT source, n_chars AS n FROM documents) AS d GROUP BY source")
def fasta_length_report(p: Proxy) -> DataFrame:
    return _rounded(reads.length_report(p.documents.select(F.col("source").alias("file"), F.col("n_chars").alias("n"))))


@query("reads", sql=f"SELECT file, {_REPORT} FROM reads GROUP BY file")
def fastq_length_report(p: Proxy) -> DataFrame:
    return _rounded(reads.length_report(p.reads, long_from=None))


@query(
    "probes",
    sql="""SELECT id, split_part(id, '_', 1) AS locus, array_to_string(list_slice(string_split(id, '_'), 2, 99), '-') AS taxon, regexp_extract(header, 'probes-source:([^,]*)', 1) AS source,
    upper(substr(id, 1, 1)) || lower(substr(id, 2)) AS capitalised, CASE WHEN id LIKE '%-%' THEN '''' || id || '''' ELSE id END AS nexus FROM probes""",
)
def name_functions(p: Proxy) -> DataFrame:
    c = F.col("id")
    return p.probes.select("id", fn.key_locus(c).alias("locus"), fn.key_taxon(c).alias("taxon"), fn.header_field(F.col("header"), "probes-source").alias("source"), fn.capitalise_first(c).alias("capitalised"), fn.nexus_name(c).alias("nexus"))


@query("aln", sql="SELECT locus, taxon, taxon AS stripped, ltrim('_R_' || taxon, '_R') AS unmarked FROM aln")
def strip_names(p: Proxy) -> DataFrame:
    named = p.aln.withColumn("raw", F.concat(F.lit("_R_"), "locus", F.lit("_"), "taxon"))
    return named.select("locus", "taxon", fn.strip_locus_prefix(F.col("raw"), F.concat("locus", F.lit("_phased"))).alias("stripped"), fn.strip_reverse_marker(F.concat(F.lit("_R_"), "taxon")).alias("unmarked"))
