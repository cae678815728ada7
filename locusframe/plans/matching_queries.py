"""Queries of contig matching and of taxon-by-locus matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contig_name, contig_name_lenient, locus_name
from ..operators import matching, matrix, optimise
from .proxies import TAXA, Proxy
from .registry import query

_NAMED = """
named AS (
    SELECT DISTINCT taxon, CASE WHEN starts_with(name1, 'NODE_') THEN split_part(name1, '_length', 1) ELSE split_part(name1, ' ', 1) END AS contig,
        split_part(name2, '_p', 1) AS locus, strand2 AS strand
    FROM hits)"""
_MAP = (
    _NAMED
    + """,
bad_contigs AS (SELECT taxon, contig FROM named GROUP BY taxon, contig HAVING count(DISTINCT locus) > 1),
bad_loci AS (SELECT taxon, locus FROM named GROUP BY taxon, locus HAVING count(DISTINCT contig) > 1),
dropped AS (SELECT * FROM bad_contigs UNION SELECT n.taxon, n.contig FROM named n JOIN bad_loci b ON n.taxon = b.taxon AND n.locus = b.locus),
match_map AS (
    SELECT n.locus AS uce, n.taxon, n.contig, min(n.strand) AS strand
    FROM named n LEFT JOIN dropped d ON n.taxon = d.taxon AND n.contig = d.contig WHERE d.taxon IS NULL
    GROUP BY n.locus, n.taxon, n.contig)"""
)


@query("hits", sql="SELECT DISTINCT name2, split_part(name2, '_p', 1) AS locus FROM hits")
def extract_locus_name(p: Proxy) -> DataFrame:
    return p.hits.select("name2", locus_name(F.col("name2")).alias("locus")).distinct()


@query("hits", sql="SELECT DISTINCT name1, CASE WHEN starts_with(name1, 'NODE_') THEN split_part(name1, '_length', 1) END AS contig FROM hits")
def extract_contig_name(p: Proxy) -> DataFrame:
    return p.hits.select("name1", contig_name(F.col("name1")).alias("contig")).distinct()


@query("hits", sql="SELECT DISTINCT name1, CASE WHEN starts_with(name1, 'NODE_') THEN split_part(name1, '_length', 1) ELSE split_part(name1, ' ', 1) END AS contig, NOT starts_with(name1, 'NODE_') AS fallback FROM hits", name="contig_name_lenient")
def _contig_name_lenient(p: Proxy) -> DataFrame:
    return p.hits.select("name1", contig_name_lenient(F.col("name1")).alias("contig"), contig_name(F.col("name1")).isNull().alias("fallback")).distinct()


@query("hits", sql=f"WITH {_MAP} SELECT * FROM match_map")
def match_map(p: Proxy) -> DataFrame:
    return matching.match_map(p.hits)


@query(
    "hits",
    sql=f"""WITH {_MAP},
    totals AS (SELECT taxon, count(DISTINCT contig) AS total_contigs FROM named GROUP BY taxon)
    SELECT t.taxon, coalesce(u.n, 0) AS unique_matches, t.total_contigs, CAST(0 AS BIGINT) AS probe_dupes, coalesce(l.n, 0) AS loci_dropped, coalesce(c.n, 0) AS contigs_dropped
    FROM totals t LEFT JOIN (SELECT taxon, count(*) AS n FROM match_map GROUP BY taxon) u ON t.taxon = u.taxon
    LEFT JOIN (SELECT taxon, count(*) AS n FROM bad_loci GROUP BY taxon) l ON t.taxon = l.taxon
    LEFT JOIN (SELECT taxon, count(*) AS n FROM bad_contigs GROUP BY taxon) c ON t.taxon = c.taxon""",
)
def match_summary(p: Proxy) -> DataFrame:
    hits = p.hits
    totals = matching.all_named_hits(hits).groupBy("taxon").agg(F.count_distinct("contig").alias("total_contigs"))
    return matching.match_summary(hits, totals)


@query("hits", sql=f"WITH {_NAMED} SELECT taxon, contig, count(DISTINCT locus) AS n_loci FROM named GROUP BY taxon, contig HAVING count(DISTINCT locus) > 1")
def contigs_multi_locus(p: Proxy) -> DataFrame:
    return matching.contigs_of_several_loci(matching.named_hits(p.hits))


@query("hits", sql=f"WITH {_NAMED} SELECT taxon, locus, count(DISTINCT contig) AS n_contigs FROM named GROUP BY taxon, locus HAVING count(DISTINCT contig) > 1")
def loci_multi_contig(p: Proxy) -> DataFrame:
    return matching.loci_of_several_contigs(matching.named_hits(p.hits))


@query(
    "hits",
    sql=f"""WITH {_NAMED}
    SELECT taxon, 'contig' AS kind, contig AS name, string_agg(DISTINCT locus, ',' ORDER BY locus) AS partners FROM named GROUP BY taxon, contig HAVING count(DISTINCT locus) > 1
    UNION ALL SELECT taxon, 'locus', locus, string_agg(DISTINCT contig, ',' ORDER BY contig) FROM named GROUP BY taxon, locus HAVING count(DISTINCT contig) > 1""",
)
def duplicates_report(p: Proxy) -> DataFrame:
    return matching.duplicates_report(matching.all_named_hits(p.hits))


_DUPES = """
pairs AS (SELECT split_part(name1, '_p', 1) AS target, split_part(name2, '_p', 1) AS query FROM self_hits),
sized AS (SELECT target, query, count(*) OVER (PARTITION BY target) AS n FROM pairs),
dupes AS (SELECT DISTINCT lower(unnest(CASE WHEN n > 1 THEN [target, query] ELSE [target] END)) AS locus FROM sized WHERE target <> query)"""


@query("self_hits", sql=f"WITH {_DUPES} SELECT locus FROM dupes")
def probe_self_dupes(p: Proxy) -> DataFrame:
    return matching.probe_self_dupes(p.self_hits)


@query(
    "self_hits",
    sql="""WITH pairs AS (SELECT trim(split_part(name1, '|', 1)) AS target, trim(split_part(name2, '|', 1)) AS query FROM self_hits),
    sized AS (SELECT target, query, count(*) OVER (PARTITION BY target) AS n FROM pairs)
    SELECT DISTINCT unnest(CASE WHEN n > 1 THEN [target, query] ELSE [target] END) AS name FROM sized WHERE target <> query""",
)
def probe_self_dupes_by_name(p: Proxy) -> DataFrame:
    return matching.probe_self_dupes_by_name(p.self_hits)


@query("self_hits", "probes", sql=f"WITH {_DUPES} SELECT id, split_part(id, '_p', 1) AS locus FROM probes WHERE split_part(id, '_p', 1) NOT IN (SELECT locus FROM dupes)")
def probes_without_dupes(p: Proxy) -> DataFrame:
    return matching.probes_without_dupes(p.probes, matching.probe_self_dupes(p.self_hits)).select("id", "locus")


@query(
    "hits",
    "self_hits",
    sql=f"""WITH {_DUPES}, {_NAMED},
    clean AS (SELECT * FROM named WHERE locus NOT IN (SELECT locus FROM dupes)),
    dropped AS (SELECT taxon, contig FROM clean GROUP BY taxon, contig HAVING count(DISTINCT locus) > 1
        UNION SELECT c.taxon, c.contig FROM clean c JOIN (SELECT taxon, locus FROM clean GROUP BY taxon, locus HAVING count(DISTINCT contig) > 1) b ON c.taxon = b.taxon AND c.locus = b.locus)
    SELECT locus AS uce, taxon, contig, min(strand) AS strand FROM clean c ANTI JOIN dropped d ON c.taxon = d.taxon AND c.contig = d.contig GROUP BY locus, taxon, contig""",
)
def match_map_without_dupes(p: Proxy) -> DataFrame:
    return matching.match_map(p.hits, dupes=matching.probe_self_dupes(p.self_hits))


_BY_TAXON = """
by_taxon AS (SELECT taxon, uce FROM (SELECT *, count(*) OVER (PARTITION BY taxon, contig) AS n FROM matches) AS m WHERE n = 1)"""


@query("matches", sql=f"WITH {_BY_TAXON} SELECT * FROM by_taxon")
def matches_by_taxon(p: Proxy) -> DataFrame:
    return matrix.matches_by_taxon(p.matches)


@query("matches", sql=f"WITH {_BY_TAXON} SELECT uce FROM by_taxon GROUP BY uce HAVING count(DISTINCT taxon) = {len(TAXA)}")
def complete_matrix(p: Proxy) -> DataFrame:
    return matrix.complete_matrix(matrix.matches_by_taxon(p.matches), len(TAXA))


@query("matches", "loci", sql=f"WITH {_BY_TAXON} SELECT DISTINCT uce FROM loci WHERE uce IN (SELECT uce FROM by_taxon)")
def incomplete_matrix(p: Proxy) -> DataFrame:
    return matrix.incomplete_matrix(matrix.matches_by_taxon(p.matches), p.loci)


@query("matches", "loci", sql=f"WITH {_BY_TAXON} SELECT taxon, (SELECT count(DISTINCT uce) FROM loci) - count(DISTINCT uce) AS lost FROM by_taxon GROUP BY taxon")
def locus_losses(p: Proxy) -> DataFrame:
    return matrix.locus_losses(matrix.matches_by_taxon(p.matches), p.loci)


@query("matches", "loci", sql=f"WITH {_BY_TAXON} SELECT t.taxon, l.uce FROM (SELECT DISTINCT taxon FROM by_taxon) t, (SELECT DISTINCT uce FROM loci) l WHERE NOT EXISTS (SELECT 1 FROM by_taxon b WHERE b.taxon = t.taxon AND b.uce = l.uce)")
def missing_report(p: Proxy) -> DataFrame:
    return matrix.missing_report(matrix.matches_by_taxon(p.matches), p.loci)


_PIVOT = ", ".join(f"max(CASE WHEN taxon = '{t}' THEN 1 ELSE 0 END)::INT AS {t}" for t in TAXA)


@query("presence", sql=f"SELECT locus, {_PIVOT} FROM presence GROUP BY locus")
def presence_pivot(p: Proxy) -> DataFrame:
    return matrix.presence_pivot(p.presence, TAXA)


@query("matches", sql="SELECT uce, " + ", ".join(f"max(CASE WHEN taxon = '{t}' THEN contig || '(' || strand || ')' END) AS {t}" for t in TAXA) + " FROM matches GROUP BY uce")
def match_pivot(p: Proxy) -> DataFrame:
    return matching.pivot_matches(p.matches, list(TAXA), value="contig")


@query("presence", sql="WITH per AS (SELECT locus, count(DISTINCT taxon) AS n_taxa FROM presence GROUP BY locus) SELECT a.n_taxa, count(*) AS loci FROM (SELECT DISTINCT n_taxa FROM per) a JOIN per b ON b.n_taxa >= a.n_taxa GROUP BY a.n_taxa")
def shared_by_at_least(p: Proxy) -> DataFrame:
    return matrix.shared_by_at_least(p.presence)


_HITS4 = "hits4 AS (SELECT locus FROM presence GROUP BY locus HAVING count(DISTINCT taxon) >= 4 AND bool_or(taxon = 'taxon_0'))"


@query("presence", sql=f"WITH {_HITS4} SELECT taxon, count(DISTINCT locus) AS loci FROM presence WHERE locus IN (SELECT locus FROM hits4) GROUP BY taxon")
def specific_counts(p: Proxy) -> DataFrame:
    return matrix.specific_counts(p.presence, "taxon_0", 4)[1]


@query("presence", sql=f"WITH {_HITS4} SELECT locus, count(DISTINCT taxon) AS n_taxa FROM presence WHERE locus IN (SELECT locus FROM hits4) GROUP BY locus")
def specific_hits(p: Proxy) -> DataFrame:
    return matrix.specific_counts(p.presence, "taxon_0", 4)[0]


_CUTS = matrix.occupancy_cuts(len(TAXA))


@query(
    "matches",
    sql=f"""WITH cuts AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({f!r} AS DOUBLE), {c})" for k, (f, c) in enumerate(_CUTS))}) AS v(k, fraction, cut)),
    per AS (SELECT uce, count(DISTINCT taxon) AS n FROM matches GROUP BY uce),
    placed AS (SELECT uce, min(k) FILTER (n < cut) AS k FROM per, cuts GROUP BY uce),
    bins AS (SELECT CASE WHEN k IS NULL OR k = 0 THEN {len(_CUTS) - 1} ELSE k - 1 END AS k FROM placed)
    SELECT c.fraction, c.cut, count(*) AS loci FROM bins b JOIN cuts c ON b.k = c.k GROUP BY c.fraction, c.cut""",
)
def incomplete_matrix_estimates(p: Proxy) -> DataFrame:
    return matrix.incomplete_matrix_estimates(matching.pivot_matches(p.matches, list(TAXA)), TAXA)


_GROUPS = f"""
sets AS (SELECT row_number() OVER (ORDER BY taxon) - 1 AS k, taxon FROM (SELECT DISTINCT taxon FROM by_taxon) AS t),
masks AS (SELECT m FROM range(1, {1 << len(TAXA)}) AS r(m)),
grouped AS (SELECT m, list(s.taxon ORDER BY k) AS organisms, bit_count(m) AS size FROM masks JOIN sets s ON (m >> CAST(k AS BIGINT)) & 1 = 1 GROUP BY m),
locus_masks AS (SELECT uce, CAST(sum(1 << CAST(k AS BIGINT)) AS BIGINT) AS has FROM by_taxon b JOIN sets s ON b.taxon = s.taxon GROUP BY uce),
counted AS (SELECT g.m, size, organisms, (SELECT count(*) FROM locus_masks l WHERE l.has & g.m = g.m) AS n_loci FROM grouped g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n_loci DESC, organisms) AS place FROM counted)"""


@query("matches", sql=f"WITH {_BY_TAXON}, {_GROUPS} SELECT CAST(size AS BIGINT) AS size, array_to_string(organisms, ',') AS organisms, n_loci FROM ranked WHERE place = 1")
def optimise_exhaustive(p: Proxy) -> DataFrame:
    best = optimise.optimise_exhaustive(matrix.matches_by_taxon(p.matches), TAXA)
    return best.select("size", F.array_join("organisms", ",").alias("organisms"), "n_loci")


_EXTRACT = """
node AS (SELECT m.taxon, m.uce AS locus, m.strand, trim(replace(replace(replace(c.sequence, 'N', ''), 'n', ''), ',', ''), 'acgtn') AS clean
    FROM matches m JOIN contigs c ON m.taxon = c.taxon AND lower(m.contig) = lower(c.contig) WHERE m.uce IN (SELECT uce FROM loci)),
extracted AS (SELECT taxon, locus, locus || '_' || taxon || ' |' || locus AS header,
    CASE WHEN strand = '-' THEN reverse(translate(clean, 'ACGTMRWSYKVHDBXNacgtmrwsykvhdbxn', 'TGCAKYWSRMBDHVXNtgcakywsrmbdhvxn')) ELSE clean END AS sequence FROM node)"""


@query("matches", "contigs", "loci", sql=f"WITH {_EXTRACT} SELECT * FROM extracted")
def locus_extraction(p: Proxy) -> DataFrame:
    return matrix.locus_extraction(p.matches, p.loci, p.contigs)


@query("matches", "contigs", "loci", sql=f"WITH {_EXTRACT} SELECT locus, count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS bases FROM extracted GROUP BY locus")
def explode_by_locus(p: Proxy) -> DataFrame:
    return matrix.locus_extraction(p.matches, p.loci, p.contigs).groupBy("locus").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("sequence")).alias("bases"))


@query("matches", "contigs", "loci", sql=f"WITH {_EXTRACT} SELECT taxon, count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS bases FROM extracted GROUP BY taxon")
def explode_by_taxon(p: Proxy) -> DataFrame:
    return matrix.locus_extraction(p.matches, p.loci, p.contigs).groupBy("taxon").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("sequence")).alias("bases"))


@query("matches", "loci", sql=f"WITH {_BY_TAXON} SELECT DISTINCT 'Organisms' AS section, taxon AS line FROM by_taxon UNION ALL SELECT 'Loci', uce FROM by_taxon GROUP BY uce HAVING count(DISTINCT taxon) = {len(TAXA)}")
def matrix_config(p: Proxy) -> DataFrame:
    by = matrix.matches_by_taxon(p.matches)
    return matrix.matrix_config(by, matrix.complete_matrix(by, len(TAXA)))


@query("matches", sql="SELECT uce, taxon, contig, strand FROM matches UNION ALL SELECT uce, taxon || '*', contig, strand FROM matches WHERE taxon = 'taxon_1'")
def extended_matches(p: Proxy) -> DataFrame:
    own = p.matches
    return matrix.union_databases(own, own.where("taxon = 'taxon_1'"))


@query(
    "hits",
    "contigs",
    sql="""WITH named AS (SELECT 'NODE_' || CAST(row_number() OVER (ORDER BY taxon, contig) AS VARCHAR) AS id, sequence FROM contigs)
    SELECT h.name1, h.name2, h.strand2, CASE WHEN h.strand2 = '-' THEN translate(reverse(upper(substr(c.sequence, h.zstart1 + 1, h.end1 - h.zstart1))), 'ACGT', 'TGCA') ELSE upper(substr(c.sequence, h.zstart1 + 1, h.end1 - h.zstart1)) END AS sequence
    FROM (SELECT split_part(name1, '_length', 1) AS name1, name2, strand2, zstart1 % 40 AS zstart1, zstart1 % 40 + 20 AS end1 FROM hits) h JOIN named c ON h.name1 = c.id""",
)
def barcode_slices(p: Proxy) -> DataFrame:
    from pyspark.sql import Window

    numbers = p.contigs.select("taxon", "contig", F.concat(F.lit("NODE_"), F.row_number().over(Window.orderBy("taxon", "contig"))).alias("id"))  # names only
    named = p.contigs.join(numbers, ["taxon", "contig"]).select("id", "sequence")
    hits = p.hits.select(F.split_part("name1", F.lit("_length"), F.lit(1)).alias("name1"), "name2", "strand2", (F.col("zstart1") % 40).alias("zstart1"), (F.col("zstart1") % 40 + 20).alias("end1"))
    return matching.slice_barcodes(hits, named)
