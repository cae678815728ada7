"""Queries of intervals, probes and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, probes
from .proxies import TAXA, Proxy
from .registry import query


@query("hits", sql="""SELECT name1 AS chromo, zstart1 AS start, end1 AS "end", name2 AS name FROM hits WHERE percent_identity >= 90 AND percent_continuity >= 90""")
def lastz_bed_filter(p: Proxy) -> DataFrame:
    return intervals.bed_from_hits(p.hits)


@query("hits", sql="""SELECT name1 AS chromo, zstart1 AS start, end1 AS "end", trim(split_part(name2, '|', 1)) AS name FROM hits""")
def probe_bed(p: Proxy) -> DataFrame:
    return intervals.probe_bed(p.hits)


@query("hits", sql="""SELECT name1 AS chromo, split_part(name2, '_p', 1) AS name, min(least(zstart1, end1)) AS start, max(greatest(zstart1, end1)) AS "end", count(*) AS hits, count(*) > 1 AND max(greatest(zstart1, end1)) - min(least(zstart1, end1)) > 300 AS wide FROM hits GROUP BY name1, split_part(name2, '_p', 1)""")
def locus_bed(p: Proxy) -> DataFrame:
    return intervals.locus_bed(p.hits, wide=300)


@query("intervals", sql="""SELECT DISTINCT chromo, start, "end", 'uce-' || CAST(locus AS VARCHAR) AS name FROM intervals""")
def bed_from_fasta(p: Proxy) -> DataFrame:
    records = p.intervals.select(F.concat(F.lit("x|contig:"), "chromo", F.lit("|coords:"), "start", F.lit("-"), "end", F.lit("|locus:"), "locus").alias("id"))
    return intervals.bed_from_headers(records, "uce-").distinct()


@query("hits", "loci", sql="""SELECT name1 AS chromo, zstart1 AS start, end1 AS "end", trim(split_part(name2, '|', 1)) AS name FROM hits WHERE split_part(name2, '_', 1) IN (SELECT uce FROM loci)""")
def filter_bed_by_fasta(p: Proxy) -> DataFrame:
    return intervals.filter_bed_by_loci(intervals.probe_bed(p.hits), p.loci.select(F.col("uce").alias("locus")))


_CLUSTERS = """
reached AS (SELECT *, max("end") OVER (PARTITION BY chromo ORDER BY start, "end", locus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY chromo ORDER BY start, "end", locus ROWS UNBOUNDED PRECEDING) AS cluster FROM reached),
clusters AS (SELECT chromo, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(start) AS start, max("end") AS "end", list(DISTINCT locus ORDER BY locus) AS loci FROM numbered GROUP BY chromo, cluster HAVING count(*) > 1)"""


@query("intervals", sql=f"""WITH {_CLUSTERS} SELECT chromo, cluster, n, start, "end", array_to_string(loci, ',') AS loci FROM clusters""")
def proximity_clusters(p: Proxy) -> DataFrame:
    return intervals.proximity_clusters(p.intervals, 20).withColumn("loci", F.array_join(F.col("loci").cast("array<string>"), ","))


@query("intervals", sql=f"WITH {_CLUSTERS} SELECT DISTINCT locus FROM intervals WHERE locus NOT IN (SELECT unnest(loci[2:]) FROM clusters)")
def screened_loci(p: Proxy) -> DataFrame:
    return intervals.screened_loci(p.intervals, 20)


# the fold, one interval of each chromosome after the other: one that meets none of the kept is kept
_FOLD = """
ordered AS (SELECT chromo, start, "end", 'taxon_' || CAST(locus % 7 AS VARCHAR) AS taxon, row_number() OVER (PARTITION BY chromo ORDER BY locus % 7, locus, start) AS ord FROM intervals),
kept AS (
    SELECT chromo, CAST(0 AS BIGINT) AS ord, CAST([] AS STRUCT(a BIGINT, b BIGINT, o BIGINT)[]) AS found FROM (SELECT DISTINCT chromo FROM intervals) AS c
    UNION ALL
    SELECT k.chromo, o.ord, CASE WHEN len(list_filter(k.found, lambda x: x.a < o."end" AND o.start < x.b)) = 0 THEN list_append(k.found, {'a': o.start, 'b': o."end", 'o': o.ord}) ELSE k.found END
    FROM kept k JOIN ordered o ON o.chromo = k.chromo AND o.ord = k.ord + 1),
known AS (SELECT chromo, unnest(arg_max(found, ord)) AS x FROM kept GROUP BY chromo),
merged AS (SELECT k.chromo, x.a AS start, x.b AS "end", string_agg(DISTINCT o.taxon, ',' ORDER BY o.taxon) AS taxa FROM known k JOIN ordered o ON o.chromo = k.chromo AND o.ord >= x.o AND x.a < o."end" AND o.start < x.b GROUP BY k.chromo, x.a, x.b, x.o)"""


def _merged(p: Proxy) -> DataFrame:
    from pyspark.sql import Window

    rows = p.intervals.select("chromo", "start", "end", F.concat(F.lit("taxon_"), F.col("locus") % 7).alias("taxon"), F.struct((F.col("locus") % 7).alias("t"), F.col("locus"), F.col("start")).alias("o"))
    return intervals.multi_merge(rows.withColumn("ord", F.row_number().over(Window.partitionBy("chromo").orderBy("o"))))


@query("intervals", sql=f"""WITH RECURSIVE {_FOLD} SELECT chromo, start, "end", taxa FROM merged""")
def multi_merge_table(p: Proxy) -> DataFrame:
    return _merged(p).withColumn("taxa", F.array_join("taxa", ","))


@query("intervals", sql=f"""WITH RECURSIVE {_FOLD} SELECT row_number() OVER (ORDER BY chromo, start, "end", taxa) - 1 AS uce, chromo, start, "end" AS stop, {", ".join(f"CAST(contains(taxa, '{t}') AS INT) AS {t}" for t in TAXA)} FROM merged""")
def multi_merge_presence(p: Proxy) -> DataFrame:
    return intervals.merged_presence(_merged(p), list(TAXA))


@query("intervals", sql="""SELECT chromo, start - CASE WHEN 65 - ("end" - start) > 0 THEN 8 ELSE 0 END AS start, "end" + CASE WHEN 65 - ("end" - start) > 0 THEN 8 ELSE 0 END AS "end", locus FROM intervals""")
def widen_intervals(p: Proxy) -> DataFrame:
    return intervals.widen(p.intervals, 65)


_SLICED = """
placed AS (SELECT DISTINCT 'chr' || CAST(p_size % 10 AS VARCHAR) AS chromo, CAST(p_partkey % 80 AS BIGINT) AS start, CAST(p_partkey % 80 + 30 AS BIGINT) AS "end" FROM part),
genome AS (SELECT chromo, min_by(sequence, locus) AS genome FROM tiling_loci GROUP BY chromo),
cut AS (SELECT p.*, substr(genome, p.start + 1, least(p."end", length(genome)) - p.start) AS sequence FROM placed p JOIN genome g ON p.chromo = g.chromo)"""


@query("tiling_loci", sql=f"""WITH {_SLICED} SELECT * FROM cut WHERE length(sequence) >= 20 AND length(regexp_replace(sequence, '[^a-z]', '', 'g')) / length(sequence)::DOUBLE <= 0.25""")
def strip_masked_intervals(p: Proxy) -> DataFrame:
    bed = p.part.select(F.concat(F.lit("chr"), F.col("p_size") % 10).alias("chromo"), (F.col("p_partkey") % 80).alias("start"), (F.col("p_partkey") % 80 + 30).alias("end")).distinct()
    genome = p.tiling_loci.groupBy("chromo").agg(F.min_by("sequence", "locus").alias("sequence"))
    return intervals.strip_masked(intervals.slice_genomes(bed, genome), 0.25, 0, 20)


_TILES = """
n AS (SELECT locus, length(sequence) AS n FROM tiling_loci),
middle AS (SELECT DISTINCT locus, CAST(trunc(n / 2.0::DOUBLE - 10 + k * 20) AS BIGINT) AS start, CAST(trunc(n / 2.0::DOUBLE - 10 + k * 20 + 40) AS BIGINT) AS "end", 0 AS side FROM n, range(0, 20) AS r(k) WHERE n / 2.0::DOUBLE - 10 + k * 20 + 40 <= n
    UNION ALL SELECT locus, CAST(trunc(n / 2.0::DOUBLE + 10 - k * 20 - 40) AS BIGINT), CAST(trunc(n / 2.0::DOUBLE + 10 - k * 20) AS BIGINT), 1 FROM n, range(0, 20) AS r(k) WHERE n / 2.0::DOUBLE + 10 - k * 20 - 40 >= 0),
tiles AS (SELECT locus, row_number() OVER (PARTITION BY locus ORDER BY start, "end") AS k, start, "end" FROM middle)"""
_TILING = probes.Tiling(length=40, density=2.0, mask=0.5, remove_gc=True)


@query("tiling_loci", sql=f"""WITH {_TILES} SELECT locus, CAST(k AS INT) AS k, start, "end" FROM tiles""")
def tile_middle(p: Proxy) -> DataFrame:
    return probes.tiles(p.tiling_loci, _TILING).select("locus", "k", "start", "end")


@query("tiling_loci", sql="""SELECT locus, CAST(row_number() OVER (PARTITION BY locus ORDER BY s) AS INT) AS k, s AS start, s + 40 AS "end" FROM tiling_loci, range(0, 1000, 27) AS r(s) WHERE s < length(sequence)""")
def tile_flush_left(p: Proxy) -> DataFrame:
    return probes.tiles(p.tiling_loci, probes.Tiling(length=40, density=1.5, flush_left=True)).select("locus", "k", "start", "end")


_KEPT = """
parts AS (SELECT t.locus, t.k, t.start, t."end", l.chromo, l.chromo_start, substr(l.sequence, CAST(t.start + 1 AS BIGINT), 40) AS part FROM tiles t JOIN tiling_loci l ON t.locus = l.locus),
kept AS (SELECT * FROM parts WHERE length(part) = 40 AND length(regexp_replace(part, '[^a-z]', '', 'g')) / 40.0::DOUBLE < 0.5 AND length(regexp_replace(part, '[^GCgc]', '', 'g')) / 40.0::DOUBLE BETWEEN 0.3 AND 0.7)"""


@query("tiling_loci", sql=f"""WITH {_TILES}, {_KEPT} SELECT locus, 'uce-' || CAST(locus AS VARCHAR) || '_p' || CAST(k AS VARCHAR) AS id, upper(part) AS sequence, chromo, chromo_start + start AS global_start, chromo_start + "end" AS global_end FROM kept""")
def tiled_probes(p: Proxy) -> DataFrame:
    return probes.tiled_probes(p.tiling_loci, _TILING).select("locus", "id", "sequence", "chromo", "global_start", "global_end")


@query("tiling_loci", sql=f"""WITH {_TILES}, {_KEPT} SELECT locus, chromo, min(chromo_start + start) AS start, max(chromo_start + "end") AS "end" FROM kept GROUP BY locus, chromo""")
def tiled_loci_bed(p: Proxy) -> DataFrame:
    return probes.probe_loci_bed(probes.tiled_probes(p.tiling_loci, _TILING))


@query("tiling_loci", sql=f"""WITH {_TILES}, n2 AS (SELECT locus, max(k) AS n FROM tiles GROUP BY locus), two AS (SELECT t.locus, t.start, t."end", n FROM tiles t JOIN n2 USING (locus) WHERE (n % 2 = 0 AND k IN (n // 2, n // 2 + 1)) OR (n % 2 = 1 AND k IN (n // 2 + 1, least(n // 2 + 2, n))))
    SELECT locus, count(*) AS tiles, min(start) AS first, max("end") AS last FROM two GROUP BY locus""")
def tile_two_probes(p: Proxy) -> DataFrame:
    made = probes.tiles(p.tiling_loci, probes.Tiling(length=40, two_probes=True)).select("locus", "start", "end").distinct()
    return made.groupBy("locus").agg(F.count(F.lit(1)).alias("tiles"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("probes", sql="SELECT id, header FROM probes WHERE regexp_extract(header, 'probes-source:([^,]*)', 1) IN ('taxon_1', 'taxon_4')")
def probe_subsets(p: Proxy) -> DataFrame:
    return probes.probe_subsets(p.probes, ["taxon_1", "taxon_4"]).select("id", "header")


@query("probes", sql="SELECT id FROM probes WHERE split_part(id, '_', 1) NOT IN (SELECT 'uce-' || CAST(s_suppkey AS VARCHAR) FROM supplier)")
def probes_excluding(p: Proxy) -> DataFrame:
    return probes.probes_excluding(p.probes, p.supplier.select(F.concat(F.lit("uce-"), "s_suppkey").alias("locus"))).select("id")


def _fragments(p: Proxy) -> DataFrame:
    """Tiles of each locus as probe records, upper-cased."""
    made = probes.tiled_probes(p.tiling_loci, probes.Tiling(length=40, density=2.0, remove_ambiguous=False))
    return made.select("id", "header", "sequence")


@query("tiling_loci", sql=f"""WITH {_TILES} SELECT 'chr' AS kind, CAST(locus AS VARCHAR) AS locus, min(start) AS local_start, max("end") AS local_end FROM tiles GROUP BY locus""")
def full_probes(p: Proxy) -> DataFrame:
    return probes.full_probes(_fragments(p)).select(F.lit("chr").alias("kind"), "locus", "local_start", "local_end")


@query(
    "tiling_loci",
    sql=f"""WITH {_TILES}, spans AS (SELECT locus, min(start) AS a, max("end") AS b FROM tiles GROUP BY locus)
    SELECT CAST(s.locus AS VARCHAR) AS locus, 'unknown' AS source, l.chromo, 'design' AS design, 'designer' AS designer, a AS local_start, b AS local_end, l.chromo_start + a AS global_start, l.chromo_start + b AS global_end,
        upper(substr(l.sequence, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS sequence, CAST(1 AS INT) AS probe FROM spans s JOIN tiling_loci l ON s.locus = l.locus""",
)
def full_probe_sequences(p: Proxy) -> DataFrame:
    return probes.full_probes(_fragments(p))


_PLAN = """
named AS (SELECT split_part(name2, '_p', 1) AS uce, name1 AS contig, zstart1 AS s, end1 AS e, strand2 AS strand FROM hits),
spaced AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY uce, contig ORDER BY s, e) > 150, false) AS far FROM named),
plan AS (SELECT uce, min(contig) AS contig, min(s) AS "min", arg_max(e, (s, e)) AS "max", min(strand) AS strand, count(*) AS probes,
    CASE WHEN count(DISTINCT contig) > 1 THEN 'duplicate' WHEN count(DISTINCT strand) > 1 THEN 'orientation' WHEN bool_or(far) THEN 'length' END AS dropped FROM spaced GROUP BY uce)"""


@query("hits", sql=f"WITH {_PLAN} SELECT * FROM plan")
def slice_plan(p: Proxy) -> DataFrame:
    return intervals.slice_plan(p.hits, gap=150)


def _genome(p: Proxy) -> DataFrame:
    """A sequence for every contig that is hit."""
    seq = lambda c: F.translate(F.repeat(F.md5(F.col(c)), 60), "0123456789abcdef", "ACGTACGTACGTNacg")
    return p.hits.select(F.col("name1").alias("contig")).distinct().withColumn("sequence", seq("contig"))


def _lengths(p: Proxy) -> DataFrame:
    """The length of each, as an index of a genome has it."""
    return p.hits.select(F.col("name1").alias("contig")).distinct().withColumn("contig_length", F.lit(60 * 32))


_BOUNDS = """, kept AS (SELECT * FROM plan WHERE dropped IS NULL)"""


@query("hits", sql=f"""WITH {_PLAN}{_BOUNDS} SELECT uce, contig, "min", "max", strand, probes, CAST(1920 AS INT) AS contig_length, greatest("min" - 50, 0) AS slice_start, least("max" + 50, 1920) AS slice_end FROM kept""")
def slice_bounds_flank(p: Proxy) -> DataFrame:
    return intervals.slice_bounds(intervals.slice_plan(p.hits, gap=150), _lengths(p), flank=50)


_W = """, half AS (SELECT *, CASE WHEN 401 - abs("max" - "min") > 0 THEN (401 - abs("max" - "min") + 1) // 2 ELSE 0 END AS h FROM kept),
bounds AS (SELECT *, greatest("min" - h, 0) AS ss, CASE WHEN "min" - h < 0 THEN 401 ELSE "max" + h END AS se FROM half),
raw AS (SELECT *, substr(translate(repeat(md5(contig), 60), '0123456789abcdef', 'ACGTACGTACGTNacg'), CAST(ss + 1 AS BIGINT), CAST(least(se, 1920) - ss AS BIGINT)) AS raw FROM bounds)"""


@query("hits", sql=f"""WITH {_PLAN}{_BOUNDS}{_W} SELECT uce, CASE WHEN strand = '+' THEN raw ELSE reverse(translate(raw, 'ACGTacgt', 'TGCAtgca')) END AS sequence FROM raw WHERE length(raw) >= 401""")
def slice_sequences(p: Proxy) -> DataFrame:
    bounds = intervals.slice_bounds(intervals.slice_plan(p.hits, gap=150), _lengths(p), width=401)
    return intervals.slice_sequences(bounds, _genome(p), width=401).select("uce", "sequence")


_FLANK = """, raw AS (SELECT uce, contig, "min", "max", strand, probes, greatest("min" - 50, 0) AS ss,
    substr(translate(repeat(md5(contig), 60), '0123456789abcdef', 'ACGTACGTACGTNacg'), CAST(greatest("min" - 50, 0) + 1 AS BIGINT), CAST(least("max" + 50, 1920) - greatest("min" - 50, 0) AS BIGINT)) AS raw FROM kept),
inner_ AS (SELECT *, trim(raw, 'Nn') AS inside, length(raw) - length(ltrim(raw, 'Nn')) AS lead_n FROM raw),
cut AS (SELECT *, trim(inside, 'acgt') AS seq, ss + lead_n + length(inside) - length(ltrim(inside, 'acgt')) AS a, row_number() OVER (ORDER BY uce) - 1 AS k FROM inner_)"""


@query(
    "hits",
    sql=f"""WITH {_PLAN}{_BOUNDS}{_FLANK} SELECT uce, 'Node_' || k || '_length_' || length(seq) || '_cov_1000|contig:' || contig || '|slice:' || a || '-' || (a + length(seq)) || '|uce:' || uce || '|match:' || "min" || '-' || "max" || '|orient:' || strand || '|probes:' || probes AS header, seq AS sequence FROM cut""",
)
def slice_records_flank(p: Proxy) -> DataFrame:
    bounds = intervals.slice_bounds(intervals.slice_plan(p.hits, gap=150), _lengths(p), flank=50)
    return intervals.slice_sequences(bounds, _genome(p))
