"""Queries of alignment statistics, filters, trimming and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignments, concat, sites, trim
from .proxies import ROW_TAXA, Proxy
from .registry import query

_CELLS = "cells AS (SELECT locus, row_ord, taxon, i - 1 AS pos, substr(seq, i, 1) AS ch FROM {t}, range(1, 129) AS r(i) WHERE i <= length(seq))"
_SITES = """
states AS (SELECT locus, pos, upper(ch) AS ch, count(*) AS n FROM cells GROUP BY ALL),
columns_ AS (SELECT locus, pos, count(*) FILTER (ch NOT IN ('-', 'N', '?') AND n >= 2) AS often, count(*) FILTER (ch NOT IN ('-', 'N', '?', 'X')) AS states,
    coalesce(max(n) FILTER (ch NOT IN ('-', 'N', '?', 'X')), 0) AS most FROM states GROUP BY locus, pos),
site_stats AS (SELECT locus, count(*) AS length, count(*) FILTER (often >= 2) AS informative, count(*) FILTER (states >= 2) AS differences,
    count(*) FILTER (states >= 2 OR (states = 1 AND most > 1)) AS counted FROM columns_ GROUP BY locus)"""
_SUMMARY = (
    _SITES
    + """,
chars AS (SELECT locus, round(100.0::DOUBLE * sum(n) FILTER (ch IN ('G', 'C')) / sum(n) FILTER (ch <> '-'), 2) AS gc_percent, CAST(coalesce(sum(n) FILTER (ch = '-'), 0) AS BIGINT) AS gaps,
    CAST(coalesce(sum(n) FILTER (ch = 'A'), 0) AS BIGINT) AS a, CAST(coalesce(sum(n) FILTER (ch = 'C'), 0) AS BIGINT) AS c, CAST(coalesce(sum(n) FILTER (ch = 'G'), 0) AS BIGINT) AS g, CAST(coalesce(sum(n) FILTER (ch = 'T'), 0) AS BIGINT) AS t FROM states GROUP BY locus),
summary AS (SELECT s.*, c.gc_percent, c.gaps, c.a, c.c, c.g, c.t, n.taxa FROM site_stats s JOIN chars c ON s.locus = c.locus JOIN (SELECT locus, count(*) AS taxa FROM aln GROUP BY locus) n ON s.locus = n.locus)"""
)
_ALN = _CELLS.format(t="aln")


@query("aln", sql=f"WITH {_ALN}, {_SITES} SELECT * FROM site_stats")
def informative_sites(p: Proxy) -> DataFrame:
    return sites.site_statistics(p.aln)


@query("random_aln", sql=f"WITH {_CELLS.format(t='random_aln')}, {_SITES} SELECT * FROM site_stats")
def informative_sites_kernel(p: Proxy) -> DataFrame:
    return sites.site_statistics_kernel(p.random_aln)


@query("aln", sql=f"WITH {_ALN}, {_SUMMARY} SELECT * FROM summary")
def align_summary(p: Proxy) -> DataFrame:
    return sites.align_summary(p.aln)


def _agg_sql() -> str:
    out = ["count(*) AS loci"]
    for c in ("length", "informative", "differences", "counted", "taxa"):
        out += [f"CAST(sum({c}) AS BIGINT) AS {c}_sum", f"round(avg({c}), 6) AS {c}_mean", f"round(1.96 * stddev_samp({c}) / sqrt(count(*)), 6) AS {c}_ci", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max"]
    return ", ".join(out)


@query("aln", sql=f"WITH {_ALN}, {_SUMMARY} SELECT {_agg_sql()} FROM summary")
def aggregate_summary(p: Proxy) -> DataFrame:
    out = sites.aggregate_summary(sites.align_summary(p.aln))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_ci"))})


@query("aln", sql=f"WITH {_ALN} SELECT upper(ch) AS ch, count(*) AS n FROM cells GROUP BY 1")
def character_totals(p: Proxy) -> DataFrame:
    return sites.character_totals(p.aln, by_locus=False)


_SOME = "uneven AS (SELECT * FROM gappy_aln WHERE NOT regexp_full_match(seq, '-*|\\?*'))"


def _uneven(p: Proxy) -> DataFrame:
    """Alignments of different numbers of rows."""
    return alignments.remove_empty_taxa(p.gappy_aln)


@query(
    "gappy_aln",
    sql=f"""WITH {_SOME}, per AS (SELECT locus, count(*) AS taxa FROM uneven GROUP BY locus),
    wanted AS (SELECT CAST(q AS INT) AS percent, CAST(ceil((q / 100.0::DOUBLE - 0.01::DOUBLE) * (SELECT max(taxa) FROM per)) AS BIGINT) AS min_taxa FROM range(50, 100, 5) AS r(q))
    SELECT percent, min_taxa, (SELECT count(*) FROM per WHERE taxa >= min_taxa) AS loci FROM wanted""",
)
def occupancy_series(p: Proxy) -> DataFrame:
    return sites.occupancy_series(_uneven(p))


@query("gappy_aln", sql=f"WITH {_SOME} SELECT taxa, count(*) AS loci FROM (SELECT locus, count(*) AS taxa FROM uneven GROUP BY locus) AS n GROUP BY taxa")
def taxa_histogram(p: Proxy) -> DataFrame:
    return sites.taxa_histogram(_uneven(p))


@query("aln", sql="SELECT taxon, count(*) FILTER (length(replace(seq, substr(seq, 1, 1), '')) > 0) AS loci FROM aln GROUP BY taxon")
def taxon_locus_counts(p: Proxy) -> DataFrame:
    return sites.taxon_locus_counts(p.aln)


_TYPED = """
fixed AS (SELECT locus, row_ord, taxon, length(seq) AS length, lower(CASE WHEN trim(seq, '-') = '' THEN repeat('?', length(seq)) ELSE repeat('?', length(seq) - length(ltrim(seq, '-'))) || trim(seq, '-') || repeat('?', length(seq) - length(rtrim(seq, '-'))) END) AS seq FROM aln),
cells AS (SELECT locus, row_ord, taxon, length, i - 1 AS pos, substr(seq, i, 1) AS ch FROM fixed, range(1, 129) AS r(i) WHERE i <= length),
ranked AS (SELECT locus, pos, ch, row_number() OVER (PARTITION BY locus, pos ORDER BY count(*) DESC, CASE WHEN ch IN ('a','c','g','t','r','y','w','s','k','m','b','d','h','v') THEN 0 ELSE 1 END, min(row_ord)) AS place
    FROM cells WHERE ch NOT IN ('n', '?') GROUP BY locus, pos, ch),
typed AS (SELECT c.locus, c.taxon, CAST(c.pos AS INT) AS pos, CASE WHEN c.ch IN ('n', '?') THEN NULL WHEN c.ch = m.ch THEN 'majallele' WHEN m.ch = '-' THEN 'insertion' WHEN c.ch = '-' THEN 'deletion' ELSE 'substitution' END AS type,
    c.pos - c.length / 2.0::DOUBLE AS position_from_center FROM cells c LEFT JOIN ranked m ON c.locus = m.locus AND c.pos = m.pos AND m.place = 1),
by_locus AS (SELECT locus, pos, position_from_center, count(*) FILTER (type = 'majallele') AS majallele, count(*) FILTER (type = 'substitution') AS substitutions, count(*) FILTER (type = 'deletion') AS deletions,
    count(*) FILTER (type = 'insertion') AS insertions, count(*) FILTER (type IS NULL) AS missing, count(type) AS bases FROM typed GROUP BY locus, pos, position_from_center)"""


@query("aln", sql=f"WITH {_TYPED} SELECT taxon, type, count(*) AS cells, CAST(sum(pos) AS BIGINT) AS positions FROM typed GROUP BY taxon, type")
def smilogram_by_taxon(p: Proxy) -> DataFrame:
    return sites.alleles(p.aln).groupBy("taxon", "type").agg(F.count(F.lit(1)).alias("cells"), F.sum("pos").alias("positions"))


@query("aln", sql=f"WITH {_TYPED} SELECT * FROM by_locus")
def smilogram_by_locus(p: Proxy) -> DataFrame:
    return sites.allele_sites(sites.alleles(p.aln))


@query("aln", sql=f"WITH {_TYPED} SELECT CAST(sum(substitutions) AS BIGINT) AS substitutions, CAST(sum(bases) AS BIGINT) AS bp, round(sum(substitutions)::DOUBLE / sum(bases), 9) AS freq, position_from_center FROM by_locus GROUP BY position_from_center HAVING sum(substitutions) <> 0")
def smilogram_substitutions(p: Proxy) -> DataFrame:
    return sites.substitution_profile(sites.allele_sites(sites.alleles(p.aln))).withColumn("freq", F.round("freq", 9))


@query("aln", sql=f"WITH {_TYPED} SELECT CAST(sum(bases) AS BIGINT) AS present, CAST(sum(missing) AS BIGINT) AS absent, round(sum(missing)::DOUBLE / (sum(missing) + sum(bases)), 9) AS freq, position_from_center FROM by_locus GROUP BY position_from_center HAVING sum(bases) <> 0")
def smilogram_missing(p: Proxy) -> DataFrame:
    return sites.missing_profile(sites.allele_sites(sites.alleles(p.aln))).withColumn("freq", F.round("freq", 9))


@query(
    "aln",
    sql=f"""WITH {_ALN}, ranked AS (SELECT locus, pos, upper(ch) AS ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY locus, pos) AS rows_, row_number() OVER (PARTITION BY locus, pos ORDER BY count(*) DESC, min(row_ord)) AS place FROM cells GROUP BY locus, pos, upper(ch))
    SELECT locus, string_agg(CASE WHEN n / rows_::DOUBLE >= 0.5 THEN ch ELSE 'N' END, '' ORDER BY pos) AS consensus FROM ranked WHERE place = 1 GROUP BY locus""",
)
def consensus_majority(p: Proxy) -> DataFrame:
    return sites.consensus_majority(p.aln)


@query(
    "random_aln",
    sql=f"""WITH {_CELLS.format(t='random_aln')}, n AS (SELECT locus, pos, ch, count(*) AS n FROM cells GROUP BY ALL),
    top AS (SELECT locus, pos, sum(n) FILTER (ch NOT IN ('-', '.')) AS total, max(n) FILTER (ch NOT IN ('-', '.')) AS most FROM n GROUP BY locus, pos),
    best AS (SELECT t.locus, t.pos, total, most, list(n.ch) FILTER (n.ch NOT IN ('-', '.') AND n.n = most) AS tied FROM top t JOIN n ON t.locus = n.locus AND t.pos = n.pos GROUP BY t.locus, t.pos, total, most)
    SELECT locus, string_agg(CASE WHEN len(tied) = 1 AND most / total::DOUBLE >= 0.4 THEN tied[1] ELSE 'X' END, '' ORDER BY pos) AS consensus FROM best GROUP BY locus""",
)
def consensus_threshold(p: Proxy) -> DataFrame:
    return sites.consensus_threshold(p.random_aln, 0.4)


_FULL = "NOT regexp_full_match(seq, '-*|\\?*')"


@query("aln", sql=f"SELECT locus, row_ord, taxon, seq FROM aln WHERE locus IN (SELECT locus FROM aln GROUP BY locus HAVING bool_or(taxon IN ('taxon_7') AND {_FULL}) AND max(length(seq)) >= 90 AND count(*) FILTER ({_FULL}) >= 7)")
def filter_alignments(p: Proxy) -> DataFrame:
    return alignments.filter_alignments(p.aln, ["taxon_7"], 90, 7)


@query("gappy_aln", sql=f"WITH {_SOME} SELECT locus, count(*) AS n_taxa FROM uneven GROUP BY locus HAVING count(*) >= floor(0.75 * 8)")
def min_taxa_loci(p: Proxy) -> DataFrame:
    return alignments.loci_with_min_taxa(_uneven(p), 8, 0.75)


@query("random_aln", sql="SELECT * FROM random_aln WHERE locus NOT IN (SELECT locus FROM random_aln WHERE regexp_matches(seq, '[Xx]|NNN|[Nn].*[Nn].*[Nn].*[Nn].*[Nn].*[Nn]'))")
def screen_repeated_n(p: Proxy) -> DataFrame:
    return p.random_aln.join(p.random_aln.where(F.col("seq").rlike("[Xx]|NNN|([Nn].*){6}")).select("locus").distinct(), "locus", "left_anti").select("locus", "row_ord", "taxon", "seq")


@query("screen_aln", sql="SELECT * FROM screen_aln WHERE locus NOT IN (SELECT locus FROM screen_aln WHERE regexp_matches(seq, '[NnXx]'))")
def screen_nx(p: Proxy) -> DataFrame:
    return alignments.screen_problems(p.screen_aln)


@query("aln", sql=f"SELECT * FROM aln WHERE {_FULL}")
def remove_empty_taxa(p: Proxy) -> DataFrame:
    return alignments.remove_empty_taxa(p.aln)


@query("gappy_aln", sql=f"WITH {_SOME}, kept AS (SELECT * FROM uneven WHERE taxon IN ('taxon_1', 'taxon_5', 'taxon_7')) SELECT * FROM kept WHERE locus IN (SELECT locus FROM kept GROUP BY locus HAVING count(*) > 1)")
def extract_taxa(p: Proxy) -> DataFrame:
    return alignments.extract_taxa(_uneven(p), include=["taxon_1", "taxon_5", "taxon_7"])


@query("aln", sql="SELECT locus AS id, upper(replace(replace(seq, '-', ''), '?', '')) AS sequence FROM aln WHERE taxon = 'taxon_7' AND replace(replace(seq, '-', ''), '?', '') <> ''")
def extract_taxon(p: Proxy) -> DataFrame:
    return alignments.extract_taxon(p.aln, "taxon_7")


@query("aln", sql="SELECT * FROM aln WHERE locus IN (SELECT 'uce-' || CAST(s_suppkey AS VARCHAR) FROM supplier)")
def move_by_conf(p: Proxy) -> DataFrame:
    names = p.supplier.select(F.concat(F.lit("uce-"), "s_suppkey", F.lit(".nex")).alias("name"))
    return alignments.move_by_names(p.aln.withColumn("file", F.concat("locus", F.lit(".nex"))), names).select("locus", "row_ord", "taxon", "seq")


@query("random_aln", sql="SELECT locus, row_ord, taxon, translate(translate(seq, 'AGagCTctRrYy', 'RRrrYYyyRrYy'), 'SWKMBDHVswkmbdhv', '????????????????') AS seq FROM random_aln")
def recode_alignments(p: Proxy) -> DataFrame:
    return alignments.recode_ry(p.random_aln)


@query("aln", sql="SELECT locus, taxon, locus || '_' || CASE WHEN taxon = 'taxon_2' THEN 'renamed' ELSE taxon END AS id, replace(replace(seq, '-', ''), '?', '') AS sequence FROM aln WHERE taxon <> 'taxon_3'")
def explode_alignments(p: Proxy) -> DataFrame:
    return alignments.explode_alignments(p.aln, {"taxon_2": "renamed"}, ["taxon_3"], with_locus=True)


_ORGANISMS = [*ROW_TAXA, "taxon_8", "taxon_9"]
_LISTED = ", ".join(f"({k}, '{o}')" for k, o in enumerate(_ORGANISMS))


@query(
    "gappy_aln",
    sql=f"""WITH {_SOME}, per AS (SELECT locus, max(length(seq)) AS n, max(row_ord) AS last FROM uneven GROUP BY locus HAVING count(*) >= 3),
    absent AS (SELECT p.locus, p.last, p.n, o.k, o.taxon FROM per p, (VALUES {_LISTED}) AS o(k, taxon) WHERE NOT EXISTS (SELECT 1 FROM uneven s WHERE s.locus = p.locus AND s.taxon = o.taxon))
    SELECT locus, row_ord, taxon, seq FROM uneven WHERE locus IN (SELECT locus FROM per)
    UNION ALL SELECT locus, CAST(last + row_number() OVER (PARTITION BY locus ORDER BY k) AS INT), taxon, repeat('?', n) FROM absent""",
)
def missing_data_rows(p: Proxy) -> DataFrame:
    return alignments.missing_data_rows(_uneven(p), _ORGANISMS)


_SETS = """lengths AS (SELECT locus, CAST(max(length(seq)) AS BIGINT) AS n FROM uneven GROUP BY locus),
sets AS (SELECT locus AS name, CAST(sum(n) OVER (ORDER BY locus) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY locus) AS BIGINT) AS stop, CAST(row_number() OVER (ORDER BY locus) - 1 AS INT) AS ord FROM lengths)"""


@query("gappy_aln", sql=f"WITH {_SOME}, {_SETS} SELECT * FROM sets")
def charsets(p: Proxy) -> DataFrame:
    return concat.charsets(_uneven(p))


_MATRIX = """taxa AS (SELECT s.taxon, min(t.ord) AS first, min_by(s.row_ord, t.ord) AS row_ord FROM uneven s JOIN sets t ON s.locus = t.name GROUP BY s.taxon),
matrix AS (SELECT x.taxon, CAST(row_number() OVER (ORDER BY min(x.first), min(x.row_ord), x.taxon) - 1 AS INT) AS ord, string_agg(coalesce(s.seq, repeat('?', CAST(t.stop - t.start AS INT))), '' ORDER BY t.ord) AS seq
    FROM taxa x CROSS JOIN sets t LEFT JOIN uneven s ON s.locus = t.name AND s.taxon = x.taxon GROUP BY x.taxon)"""


@query("gappy_aln", sql=f"WITH {_SOME}, {_SETS}, {_MATRIX} SELECT * FROM matrix")
def concat_matrix(p: Proxy) -> DataFrame:
    return concat.concat_matrix(_uneven(p))


@query("gappy_aln", sql=f"WITH {_SOME} SELECT locus, taxon, seq FROM uneven WHERE length(replace(replace(seq, '-', ''), '?', '')) > 0")
def split_concat(p: Proxy) -> DataFrame:
    a = _uneven(p)
    return concat.split_concat(concat.concat_matrix(a), concat.charsets(a))


@query("random_aln", sql="SELECT 'a' AS partition, locus || taxon AS taxon, substr(seq, 1, 3) || substr(seq, 8, 2) AS seq FROM random_aln UNION ALL SELECT 'b', locus || taxon, substr(seq, 4, 4) FROM random_aln")
def partition_slices(p: Proxy) -> DataFrame:
    rows = p.random_aln.select(F.concat("locus", "taxon").alias("taxon"), "seq")
    return concat.partition_slices(rows, [("a", [(1, 3), (8, 9)]), ("b", [(4, 7)])])


@query(
    "aln",
    sql="""WITH drawn AS (SELECT r.replicate, l.locus, n, row_number() OVER (PARTITION BY r.replicate ORDER BY md5('11:' || r.replicate || ':' || l.locus), l.locus) AS draw
        FROM (SELECT locus, max(length(seq)) AS n FROM aln GROUP BY locus) l, (VALUES (1), (2), (3)) AS r(replicate)),
    grid AS (SELECT d.*, t.taxon FROM drawn d, (SELECT DISTINCT taxon FROM aln) t WHERE draw <= 10)
    SELECT g.replicate, g.taxon, string_agg(coalesce(a.seq, repeat('?', g.n)), '' ORDER BY draw) AS seq FROM grid g LEFT JOIN aln a ON g.locus = a.locus AND g.taxon = a.taxon GROUP BY g.replicate, g.taxon""",
)
def sample_concat(p: Proxy) -> DataFrame:
    return concat.sample_concat(p.aln, 10, 3, seed=11)


@query("gappy_aln", sql=f"WITH {_SOME}, {_SETS} SELECT CAST(-1 AS INT) AS ord, 'begin sets;' AS line UNION ALL SELECT ord, 'charset ''' || name || ''' = ' || CAST(start + 1 AS VARCHAR) || '-' || CAST(stop AS VARCHAR) || ';' FROM sets UNION ALL SELECT CAST(max(ord) + 1 AS INT), 'charpartition combined = ' || string_agg(name || ':' || name, ', ' ORDER BY ord) || ';' || chr(10) || 'end;' FROM sets")
def sets_block(p: Proxy) -> DataFrame:
    return concat.charset_text(concat.charsets(_uneven(p)))


_GOOD = """per AS (SELECT locus, pos, ch, count(*) AS n FROM cells GROUP BY ALL),
columns_ AS (SELECT locus, pos, sum(n) AS rows_, coalesce(sum(n) FILTER (ch = '-'), 0) AS gaps, coalesce(max(n) FILTER (ch <> '-'), 0) AS most FROM per GROUP BY locus, pos),
good AS (SELECT locus, CAST(pos AS INT) AS pos, gaps <= round_even(0.65::DOUBLE * rows_, 0) AND most >= round_even(0.65::DOUBLE * rows_, 0) AS good FROM columns_)"""


@query("aln", sql=f"WITH {_ALN}, {_GOOD} SELECT * FROM good")
def good_columns(p: Proxy) -> DataFrame:
    return trim.good_column_flags(p.aln)


_WINDOWS = "windows AS (SELECT locus, pos, good, avg(good::INT) OVER (PARTITION BY locus ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS share FROM good)"


@query("aln", sql=f"WITH {_ALN}, {_GOOD}, {_WINDOWS} SELECT locus, pos, good, round(share, 9) AS share FROM windows")
def trim_windows(p: Proxy) -> DataFrame:
    return trim.trim_windows(trim.good_column_flags(p.aln)).withColumn("share", F.round("share", 9))


@query(
    "aln",
    sql=f"""WITH {_ALN}, {_GOOD}, {_WINDOWS}, both_ AS (SELECT *, avg(good::INT) OVER (PARTITION BY locus ORDER BY pos DESC ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS back FROM windows)
    SELECT locus, coalesce(min(pos) FILTER (good AND share > 0.65), max(pos)) AS start, coalesce(max(pos + 1) FILTER (good AND back >= 0.65), max(pos)) AS "end" FROM both_ GROUP BY locus""",
)
def block_edges(p: Proxy) -> DataFrame:
    return trim.block_edges(trim.trim_windows(trim.good_column_flags(p.aln)))


@query()
def trim_alignments(p: Proxy) -> DataFrame:
    return trim.trim_alignments(alignments.remove_empty_taxa(p.aln), trim.TrimOptions(min_length=50))


@query(
    "aln",
    sql="""SELECT locus, 'repeated taxon taxon_6' AS problem FROM aln WHERE row_ord IN (6, 7) GROUP BY locus HAVING count(*) = 2
    UNION ALL SELECT locus, 'unequal lengths' FROM aln GROUP BY locus HAVING bool_or(row_ord = 2) AND bool_or(row_ord <> 2) UNION ALL SELECT locus, 'empty taxon' FROM aln WHERE row_ord = 4""",
)
def alignment_violations(p: Proxy) -> DataFrame:
    broken = p.aln.withColumn("taxon", F.when(F.col("row_ord") == 7, "taxon_6").when(F.col("row_ord") == 4, "").otherwise(F.col("taxon")))
    return alignments.violations(broken.withColumn("seq", F.when(F.col("row_ord") == 2, F.left("seq", F.lit(95))).otherwise(F.col("seq"))))
