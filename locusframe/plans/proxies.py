"""Sequences, hits, alignments, intervals and reads derived from the tables of a data folder.

Each proxy is one SQL text that both engines run; ``{table}`` stands for a table. Loci, contigs and
alignments grow with the tables. Every row of a table takes part: missing taxa come from rows dealt to another
taxon (``matches``) and from rows that are all gaps (``gappy_aln``), not from rows left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TAXA = tuple(f"taxon_{k}" for k in range(7))
ROW_TAXA = tuple(f"taxon_{k}" for k in range(8))

_BASES = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_NOISE = "'0123456789abcdef', 'ACGTACGTACGT-N?-'"

PROXIES = {
    # alignment hits: contigs are orders, loci neighbouring orders, so some contigs and loci conflict
    "hits": """
        SELECT 'taxon_' || CAST(l_suppkey % 7 AS STRING) AS taxon,
            CASE WHEN l_linenumber = 7 THEN 'scaffold' || CAST(l_orderkey AS STRING) || ' part'
                 ELSE 'NODE_' || CAST(l_orderkey AS STRING) || '_length_' || CAST(200 + l_orderkey % 900 AS STRING) || '_cov_3.19' END AS name1,
            '+' AS strand1, CAST(l_orderkey % 800 + 100 * l_linenumber AS BIGINT) AS zstart1, CAST(l_orderkey % 800 + 100 * l_linenumber + 120 AS BIGINT) AS end1,
            'uce-' || CAST(l_orderkey + l_partkey % 3 AS STRING) || '_p' || CAST(l_linenumber AS STRING) || ' |source:design,probes-locus:' || CAST(l_orderkey + l_partkey % 3 AS STRING) AS name2,
            CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand2,
            CAST(80 + l_partkey % 21 AS DOUBLE) AS percent_identity, CAST(75 + l_suppkey % 26 AS DOUBLE) AS percent_continuity
        FROM {lineitem}""",
    # probes against probes: most hit themselves, some another locus
    "self_hits": """
        SELECT 'uce-' || CAST(p_partkey AS STRING) || '_p1 |x' AS name1,
            'uce-' || CAST(CASE WHEN p_size % 9 = k THEN p_partkey + 1 ELSE p_partkey END AS STRING) || '_p2 |x' AS name2
        FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS both_ends
        WHERE k = 0 OR p_size % 2 = 0""",
    "probes": """
        SELECT 'uce-' || CAST(p_partkey AS STRING) || '_p' || CAST(p_size % 3 AS STRING) AS id,
            'uce-' || CAST(p_partkey AS STRING) || '_p' || CAST(p_size % 3 AS STRING) || ' |design:d,designer:x,probes-locus:' || CAST(p_partkey AS STRING)
                || ',probes-probe:1,probes-source:taxon_' || CAST(p_size % 7 AS STRING) AS header,
            translate(md5(p_name), """
    + _BASES
    + """) AS sequence
        FROM {part}""",
    # a taxon-by-locus matrix that only the last taxon has most loci of; a few contigs serve two loci
    "matches": """
        SELECT DISTINCT 'uce-' || CAST(k AS STRING) AS uce, 'taxon_' || CAST(t AS STRING) AS taxon,
            'NODE_' || CAST((k - CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) * 7 + t AS STRING) AS contig,
            CASE WHEN (k + t) % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM (SELECT l_partkey AS k, CASE WHEN (l_partkey * 13 + (l_suppkey % 7) * (l_partkey % 5)) % 17 > 4 THEN l_suppkey % 7 ELSE 6 END AS t FROM {lineitem}) AS dealt""",
    "loci": "SELECT 'uce-' || CAST(p_partkey AS STRING) AS uce FROM {part}",
    "contigs": """
        SELECT taxon, contig, 'n,' || translate(md5(contig || taxon), '0123456789abcdef', 'ACGTacgtACGTNnRY') || translate(md5(taxon || contig), '0123456789abcdef', 'ACGTACGTACGTACKM') || 'acg' AS sequence
        FROM (SELECT DISTINCT taxon, contig FROM ({matches}) AS m) AS c""",
    "presence": "SELECT uce AS locus, taxon FROM ({matches}) AS m UNION ALL SELECT uce AS locus, taxon FROM ({matches}) AS n WHERE taxon = 'taxon_3'",
    # eight rows an alignment: a locus's bases, a stretch of noise and end gaps in each row
    "aln": """
        SELECT locus, row_ord, taxon, CASE WHEN row_ord = 7 AND n % 5 = 0 THEN repeat('-', 96) ELSE seq END AS seq
        FROM (
            SELECT n, 'uce-' || CAST(n AS STRING) AS locus, CAST(r AS INT) AS row_ord, 'taxon_' || CAST(r AS STRING) AS taxon,
                repeat('-', CAST(d % 5 AS INT)) || substr(base, CAST(d % 5 + 1 AS INT), CAST(20 + d * 7 % 50 - d % 5 AS INT)) || substr(noise, 1, 12)
                    || substr(base, CAST(33 + d * 7 % 50 AS INT), CAST(64 - d * 7 % 50 - d % 3 AS INT)) || repeat('-', CAST(d % 3 AS INT)) AS seq
            FROM (
                SELECT doc_id AS d, CAST(floor(doc_id / 8.0) AS BIGINT) AS n, doc_id % 8 AS r,
                    translate(md5('a' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING)) || md5('b' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING)) || md5('c' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING)), """
    + _BASES
    + """) AS base,
                    translate(md5('d' || CAST(doc_id AS STRING) || lang), """
    + _NOISE
    + """) AS noise
                FROM {documents}) AS parts) AS rows_of""",
    # the same with some rows of nothing but gaps, so that alignments have different numbers of taxa
    "gappy_aln": """
        SELECT locus, row_ord, taxon, CASE WHEN row_ord >= 4 AND length(replace(seq, '?', '')) <= 93 THEN repeat('-', CAST(length(seq) AS INT)) ELSE seq END AS seq
        FROM ({aln}) AS all_rows""",
    # alignments with rare N and X, so that some loci have none in any row
    "screen_aln": """
        SELECT locus, row_ord, taxon,
            CASE WHEN substr(md5(locus || taxon), 1, 1) = '0' THEN seq WHEN substr(md5(locus || taxon), 1, 2) = '1f' THEN translate(seq, 'N', 'x') ELSE translate(seq, 'N', 'A') END AS seq
        FROM ({aln}) AS all_rows""",
    # near-random alignments of 32 columns
    "random_aln": """
        SELECT 'uce-' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING) AS locus, CAST(doc_id % 8 AS INT) AS row_ord, 'taxon_' || CAST(doc_id % 8 AS STRING) AS taxon,
            translate(md5(CAST(doc_id AS STRING) || ':' || lang), '0123456789abcdef', 'AAAACCCCGGtTTN-?') AS seq
        FROM {documents}""",
    "sequences": """
        SELECT doc_id, translate(md5(text) || md5(CAST(doc_id AS STRING)), '0123456789abcdef', 'ACGTacgtRYSWKNn-') AS seq FROM {documents}""",
    "intervals": """
        SELECT DISTINCT 'chr' || CAST(user_id % 20 AS STRING) AS chromo, CAST(floor(value * 100) AS BIGINT) AS start, CAST(floor(value * 100) AS BIGINT) + 50 AS "end",
            event_id % 500 AS locus
        FROM {events} WHERE value IS NOT NULL""",
    "reads": """
        SELECT 'file_' || CAST(o_custkey % 5 AS STRING) AS file, o_orderkey AS ord,
            CASE WHEN o_orderkey % 4 = 3 THEN 'single' || CAST(o_orderkey AS STRING)
                 ELSE 'read' || CAST(o_orderkey - o_orderkey % 2 AS STRING) || '/' || CAST(o_orderkey % 2 + 1 AS STRING) END AS id,
            CAST(50 + o_custkey % 101 AS BIGINT) AS n
        FROM {orders}""",
    "read_files": """
        SELECT 'sample_' || CAST(c_custkey % 50 AS STRING) AS folder,
            c_name || CASE c_custkey % 4 WHEN 0 THEN '_R1_001.fastq.gz' WHEN 1 THEN '_R2_001.fastq.gz' WHEN 2 THEN '-READ-singleton.fastq.gz' ELSE '.txt' END AS name
        FROM {customer}""",
    "tiling_loci": """
        SELECT p_partkey AS locus, 'chr' || CAST(p_size % 10 AS STRING) AS chromo, CAST(p_partkey * 1000 AS BIGINT) AS chromo_start,
            substr(translate(md5(p_name) || md5(p_brand || p_name) || md5(p_type || p_name) || md5('x' || p_name) || md5('y' || p_name) || md5('z' || p_name), '0123456789abcdef', 'ACGTACGTACGTacgt'), 1, CAST(100 + p_size AS INT)) AS sequence
        FROM {part}""",
}


def _expand(name: str, table) -> str:
    def one(m: re.Match) -> str:
        return _expand(m[1], table) if m[1] in PROXIES else table(m[1])

    return re.sub(r"\{(\w+)\}", one, PROXIES[name])


def duck(name: str) -> str:
    """The proxy as a DuckDB subquery body."""
    return _expand(name, lambda t: t)


def spark_sql(name: str, sf_dir: str) -> str:
    return _expand(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`").replace('"end"', "`end`")


class Proxy:
    """The proxies of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROXIES:
            return self.spark.sql(spark_sql(name, self.sf_dir))
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_(sql: str, *names: str) -> str:
    """DuckDB SQL with proxies in front as common table expressions."""
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({duck(n)})" for n in names) + ",\n" + sql.lstrip()[15:]
    return "WITH " + ",\n".join(f"{n} AS ({duck(n)})" for n in names) + "\n" + sql.lstrip() if not sql.lstrip().upper().startswith("WITH ") else "WITH " + ",\n".join(f"{n} AS ({duck(n)})" for n in names) + ",\n" + sql.lstrip()[5:]
