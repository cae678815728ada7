"""Queries that write the proxies as files of each kind to the shared folder and read them back.

Their files stay there, as a query's rows are read after it returns; see ``session.shared_folder``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as seqs
from ..functions import taxon_from_file as taxon_of
from ..operators import concat, intervals, matching, matrix, optimise, probes, reads
from ..session import shared_folder
from ..sources import alignment, bed, config, datasource, fasta, hits, sinks, twobit
from .proxies import TAXA, Proxy
from .registry import query


@query("probes", sql="SELECT split_part(header, ' ', 1) AS id, header AS description, sequence, length(sequence) AS n FROM probes")
def fasta_files(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "fasta")
    sinks.write_fasta(p.probes, path, header="header", width=20)
    records = fasta.read_fasta(p.spark, path)
    return records.select("file", "id", "description", "sequence").join(fasta.fasta_lengths(records), ["file", "id"]).select("id", "description", "sequence", "n")


@query("probes", sql="SELECT count(*) AS contigs FROM probes")
def contig_counts(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "fasta")
    sinks.write_fasta(p.probes, path, header="header")
    return fasta.count_contigs(p.spark, path).agg(F.sum("contigs").alias("contigs"))


@query("probes", sql="""SELECT message, count(*) AS n FROM (SELECT unnest(CASE CAST(substr(md5(id), 1, 1) AS VARCHAR) WHEN '0' THEN ['character outside the alphabet'] WHEN '1' THEN ['empty sequence'] WHEN '2' THEN ['header without a name'] ELSE [] END) AS message FROM probes) AS m GROUP BY message""")
def fasta_problems(p: Proxy) -> DataFrame:
    kind = F.substring(F.md5("id"), 1, 1)
    name, seq = F.when(kind == "2", "").otherwise(F.col("id")), F.when(kind == "0", F.concat("sequence", F.lit("!"))).when(kind == "1", "").otherwise(F.col("sequence"))
    path = shared_folder(p.spark, "fasta")
    sinks.write_fasta(p.probes.select(name.alias("id"), seq.alias("sequence")), path)
    return fasta.validate_fasta(p.spark, path).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def _fastq(p: Proxy) -> str:
    path = shared_folder(p.spark, "fastq")
    quality = F.repeat(F.lit("I"), F.length("sequence"))
    p.probes.select(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), quality).alias("value")).write.text(path)
    return path


@query("probes", sql="SELECT id, sequence AS seq, length(sequence) AS n FROM probes")
def fastq_files(p: Proxy) -> DataFrame:
    read = fasta.read_fastq(p.spark, _fastq(p))
    return read.join(fasta.fastq_lengths(read), ["file", "read_no"]).select("id", "seq", "n")


@query("probes", sql="SELECT count(*) AS reads FROM probes")
def fastq_counts(p: Proxy) -> DataFrame:
    return fasta.count_reads(p.spark, _fastq(p)).agg(F.sum("reads").alias("reads"))


def _hit_lines(p: Proxy, long: bool) -> str:
    """The hits as tab-separated files of 17 or 19 fields, a folder a taxon's name."""
    path = shared_folder(p.spark, "hits")
    pct = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    fixed = {
        "score": F.lit("1000"), "length1": F.col("end1") - F.col("zstart1"), "zstart2": F.lit(0), "end2": F.lit(120), "length2": F.lit(120), "diff": F.lit("...."), "cigar": F.lit("120M"),
        "identity": F.lit("110/120"), "continuity": F.lit("115/120"), "percent_identity": pct("percent_identity"), "percent_continuity": pct("percent_continuity"), "name1": F.concat(F.lit(">"), "name1"), "coverage": F.lit("120/120"), "percent_coverage": F.lit("100.0%"),
    }
    names = [f.split()[0] for f in hits.hit_schema(long).split(", ")]
    p.hits.select([fixed.get(c, F.col(c)).alias(c) for c in names]).write.option("sep", "\t").option("quote", "").csv(path)
    return path


_HIT_COLUMNS = ("name1", "strand1", "zstart1", "end1", "length1", "name2", "strand2", "length2", "percent_identity", "percent_continuity")
_HITS_SQL = "SELECT name1, strand1, zstart1, end1, end1 - zstart1 AS length1, name2, strand2, CAST(120 AS BIGINT) AS length2, percent_identity, percent_continuity{} FROM hits"


@query("hits", sql=_HITS_SQL.format(""))
def hit_files(p: Proxy) -> DataFrame:
    return hits.read_hits(p.spark, _hit_lines(p, False)).select(*_HIT_COLUMNS)


@query("hits", sql=_HITS_SQL.format(", CAST(100 AS DOUBLE) AS percent_coverage"))
def hit_files_long(p: Proxy) -> DataFrame:
    return hits.read_hits(p.spark, _hit_lines(p, True), long=True).select(*_HIT_COLUMNS, "percent_coverage")


def _registered(p: Proxy, path: str, fmt: str) -> DataFrame:
    datasource.register(p.spark)
    return p.spark.read.format(fmt).load(path)


@query("probes", sql="SELECT split_part(header, ' ', 1) AS id, header AS description, sequence FROM probes")
def fasta_source(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "fasta")
    sinks.write_fasta(p.probes, path, header="header", width=20)
    return _registered(p, path, "fasta").select("id", "description", "sequence")


@query("probes", sql="SELECT id, sequence AS seq, length(sequence) AS n FROM probes")
def fastq_source(p: Proxy) -> DataFrame:
    return _registered(p, _fastq(p), "fastq").select("id", "seq", F.length("quality").alias("n"))


@query("hits", sql="SELECT name1, zstart1, end1, name2, strand2, percent_identity, percent_continuity, CAST(100 AS DOUBLE) AS percent_coverage FROM hits")
def lastz_source(p: Proxy) -> DataFrame:
    return _registered(p, _hit_lines(p, True), "lastz").select("name1", "zstart1", "end1", "name2", "strand2", "percent_identity", "percent_continuity", "percent_coverage")


def _alignment_query(fmt: str) -> None:
    @query("aln", sql="SELECT locus, row_ord, taxon, seq FROM aln", name=f"{fmt.replace('-', '_')}_files")
    def files(p: Proxy) -> DataFrame:
        folder = shared_folder(p.spark, fmt)
        sinks.write_named(sinks.alignment_files(p.aln, fmt), folder)
        return alignment.read_alignments(p.spark, folder, fmt).select("locus", "row_ord", "taxon", "seq")


for _format in ("nexus", "phylip", "phylip-relaxed", "phylip-sequential", "clustal", "stockholm", "emboss"):
    _alignment_query(_format)


@query("aln", sql="SELECT locus, row_ord, taxon, seq FROM aln")
def fasta_alignment_files(p: Proxy) -> DataFrame:
    folder = shared_folder(p.spark, "alignments")
    sinks.write_named(sinks.alignment_files(p.aln, "fasta"), folder)
    return alignment.read_alignments(p.spark, folder, "fasta").select("locus", "row_ord", "taxon", "seq")


@query("aln", sql="SELECT DISTINCT locus || '.nexus' AS file FROM aln")
def alignment_discovery(p: Proxy) -> DataFrame:
    """Only files of the format's endings are found."""
    folder = shared_folder(p.spark, "found")
    made = sinks.alignment_files(p.aln, "nexus")
    sinks.write_named(made.unionByName(made.select(F.concat("name", F.lit(".txt")).alias("name"), "value")), folder)
    return alignment.read_alignments(p.spark, folder).select("file").distinct()


@query("intervals", sql="""SELECT 'four' AS kind, chromo, start, "end", 'uce-' || CAST(locus AS VARCHAR) AS name FROM intervals UNION ALL SELECT 'nine', chromo, start, "end", 'uce-' || CAST(locus AS VARCHAR) FROM intervals""")
def bed_files(p: Proxy) -> DataFrame:
    rows = p.intervals.select("chromo", "start", "end", F.concat(F.lit("uce-"), "locus").alias("name"))
    read = []
    for kind, colour in (("four", None), ("nine", "100,149,237")):
        path = shared_folder(p.spark, "bed")
        head = p.spark.createDataFrame([('track name="x" description="y"',)], "value string")
        head.unionByName(bed.bed_lines(rows, colour)).write.text(path)
        read.append(bed.read_bed(p.spark, path).select(F.lit(kind).alias("kind"), "*"))
    return read[0].unionByName(read[1])


def _genome_file(p: Proxy) -> str:
    """The heads of ten chromosomes as one 2bit file; ten short rows pass the driver."""
    heads = p.tiling_loci.groupBy("chromo").agg(F.min_by("sequence", "locus").alias("sequence"))
    folder = shared_folder(p.spark, "twobit")
    sinks.write_named(p.spark.createDataFrame([("genome.2bit", twobit.write_twobit_bytes({r.chromo: r.sequence for r in heads.collect()}))], "name string, value binary"), folder)
    return f"{folder}/genome.2bit"


_HEADS = "heads AS (SELECT chromo, min_by(sequence, locus) AS sequence FROM tiling_loci GROUP BY chromo)"


@query("tiling_loci", sql=f"""WITH {_HEADS}, asked AS (SELECT DISTINCT 'chr' || CAST(p_size % 10 AS VARCHAR) AS chromo, CAST(p_partkey % 60 AS BIGINT) AS start, CAST(p_partkey % 60 + 33 AS BIGINT) AS "end" FROM part)
    SELECT a.chromo, start, "end", substr(sequence, start + 1, 33) AS sequence FROM asked a JOIN heads h ON a.chromo = h.chromo""")
def twobit_slices(p: Proxy) -> DataFrame:
    path = _genome_file(p)
    asked = p.part.select(F.concat(F.lit("chr"), F.col("p_size") % 10).alias("chromo"), (F.col("p_partkey") % 60).alias("start"), (F.col("p_partkey") % 60 + 33).alias("end")).distinct()
    return twobit.read_twobit(asked, path)


@query("tiling_loci", sql=f"WITH {_HEADS} SELECT chromo AS name, length(sequence) AS size FROM heads")
def twobit_sizes(p: Proxy) -> DataFrame:
    return twobit.twobit_index(p.spark, _genome_file(p))


_SETS = """lengths AS (SELECT locus, max(length(seq)) AS n FROM aln GROUP BY locus),
sets AS (SELECT locus AS name, CAST(sum(n) OVER (ORDER BY locus) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY locus) AS BIGINT) AS stop, CAST(row_number() OVER (ORDER BY locus) - 1 AS INT) AS ord FROM lengths)"""


@query("aln", sql=f"WITH {_SETS} SELECT name, start, stop FROM sets")
def charset_files(p: Proxy) -> DataFrame:
    """A sets block written, read and parsed: one row a locus."""
    path = shared_folder(p.spark, "sets")
    concat.charset_text(concat.charsets(p.aln)).coalesce(1).sortWithinPartitions("ord").select(F.col("line").alias("value")).write.text(path)
    whole = p.spark.read.text(path, wholetext=True)
    found = whole.rdd.flatMap(lambda r: alignment.parse_charsets(r.value))
    return p.spark.createDataFrame(found, "name string, start long, stop long")


@query("aln", sql=f"WITH {_SETS} SELECT 'locus_' || CAST(ord % 3 AS VARCHAR) AS partition, min(start) + 1 AS first, max(stop) AS last, count(*) AS ranges FROM sets GROUP BY ord % 3")
def raxml_partitions(p: Proxy) -> DataFrame:
    """Partition lines of several ranges, as a program of trees takes them, parsed on the driver like any configuration."""
    sets = concat.charsets(p.aln)
    ranges = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop"))), lambda x: F.concat((x["start"] + 1).cast("string"), F.lit("-"), x["stop"].cast("string"))), ", ")
    lines = sets.groupBy((F.col("ord") % 3).alias("k")).agg(F.concat(F.lit("DNA, locus_"), F.first(F.col("ord") % 3).cast("string"), F.lit(" = "), ranges).alias("line"), F.max("stop").alias("whole")).collect()
    parsed = config.parse_partitions("\n".join(r.line for r in lines), max(r.whole for r in lines))
    rows = [(name, min(a for a, _ in r), max(b for _, b in r), len(r)) for name, r in parsed]
    return p.spark.createDataFrame(rows, "partition string, first long, last long, ranges long")


@query("matches", sql="SELECT 'Organisms' AS section, CAST(row_number() OVER (ORDER BY taxon) - 1 AS INT) AS ord, taxon AS key, CAST(NULL AS VARCHAR) AS value FROM (SELECT DISTINCT taxon FROM matches) AS t UNION ALL SELECT 'Sizes', CAST(row_number() OVER (ORDER BY taxon) - 1 AS INT), taxon, CAST(n AS VARCHAR) FROM (SELECT taxon, count(*) AS n FROM matches GROUP BY taxon) AS c")
def config_files(p: Proxy) -> DataFrame:
    """Bare keys and values of a configuration; taxa are few."""
    sizes = sorted((r.taxon, r["count"]) for r in p.matches.groupBy("taxon").count().collect())
    text = "# taxa\n[Organisms]\n" + "".join(f"{t}\n" for t, _ in sizes) + "; sizes\n[Sizes]\n" + "".join(f"{t} : {n}\n" for t, n in sizes)
    return config.config_table(p.spark, config.parse_config(text))


@query("matches", sql="SELECT DISTINCT taxon FROM matches WHERE taxon NOT IN ('taxon_2', 'taxon_5')")
def config_taxa(p: Proxy) -> DataFrame:
    names = sorted(r.taxon for r in p.matches.select("taxon").distinct().collect())
    parsed = config.parse_config("[all]\n" + "".join(f"{n.replace('_', '-')}\n" for n in names) + "[Excludes]\ntaxon-2\ntaxon_5\n")
    return p.spark.createDataFrame([(t,) for t in config.taxa_of(parsed, "all")], "taxon string")


@query("matches", sql="SELECT uce, contig, strand, taxon FROM matches")
def match_store(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "matches")
    sinks.write_matches(p.matches, path)
    return p.spark.read.parquet(path).select("uce", "contig", "strand", "taxon")


@query("aln", sql=r"""SELECT locus, CAST(count(*) AS VARCHAR) AS "taxa", CAST(max(length(seq)) AS VARCHAR) AS "length", CAST(sum(length(regexp_replace(seq, '[^-]', '', 'g'))) AS VARCHAR) AS "- count" FROM aln GROUP BY locus""")
def summary_files(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "summary")
    summary = p.aln.groupBy("locus").agg(F.count(F.lit(1)).alias("taxa"), F.max(F.length("seq")).alias("length"), F.sum(F.length(F.regexp_replace("seq", "[^-]", ""))).alias("gaps"))
    sinks.write_summary(summary, path)
    return p.spark.read.option("header", True).csv(path)


_WHOLE = f"""{_SETS}, taxa AS (SELECT DISTINCT taxon FROM aln),
matrix AS (SELECT x.taxon, string_agg(coalesce(s.seq, repeat('?', CAST(t.stop - t.start AS INT))), '' ORDER BY t.ord) AS seq FROM taxa x CROSS JOIN sets t LEFT JOIN aln s ON s.locus = t.name AND s.taxon = x.taxon GROUP BY x.taxon)"""


@query("aln", sql=f"WITH {_WHOLE} SELECT CAST(count(*) AS VARCHAR) || ' ' || CAST(max(length(seq)) AS VARCHAR) AS value FROM matrix UNION ALL SELECT taxon || ' ' || seq FROM matrix")
def phylip_matrix_file(p: Proxy) -> DataFrame:
    path = shared_folder(p.spark, "phylip")
    concat.phylip_text(concat.concat_matrix(p.aln)).select(F.col("line").alias("value")).write.text(path)
    return p.spark.read.text(path)


@query("aln", sql=f"WITH {_WHOLE} SELECT 'a' AS partition, CAST(row_number() OVER (ORDER BY taxon) AS INT) AS ord, rpad(taxon, CAST(max(length(taxon)) OVER () + 2 AS INT), ' ') || substr(seq, 1, 30) || substr(seq, 41, 10) AS line FROM matrix UNION ALL SELECT 'a', 0, CAST(count(*) AS VARCHAR) || ' 40' FROM matrix")
def paml_blocks(p: Proxy) -> DataFrame:
    return concat.paml_text(concat.partition_slices(concat.concat_matrix(p.aln), [("a", [(1, 30), (41, 50)])]))


@query("read_files", sql="SELECT name, replace(split_part(name, '.', 1), '-', '_') AS taxon FROM read_files")
def file_taxa(p: Proxy) -> DataFrame:
    return p.read_files.select("name", taxon_of(F.concat(F.lit("s3://x/y/"), F.col("name"))).alias("taxon"))


@query("aln", sql="SELECT locus, row_ord, length(seq) - length(ltrim(seq, '-')) AS leading, length(seq) - length(rtrim(seq, '-')) AS trailing, length(seq) > 0 AND trim(seq, '-') = '' AS all_gaps FROM aln")
def gap_ends(p: Proxy) -> DataFrame:
    return p.aln.select("locus", "row_ord", seqs.leading_gaps(F.col("seq")).alias("leading"), seqs.trailing_gaps(F.col("seq")).alias("trailing"), seqs.is_all_gaps(F.col("seq")).alias("all_gaps"))


# -- operators on proxies of their own


@query(sql="SELECT 'taxon_' || CAST(s_suppkey AS VARCHAR) AS taxon, CASE s_suppkey % 3 WHEN 0 THEN 'taxon-' || CAST(s_suppkey AS VARCHAR) || '.fasta' WHEN 1 THEN 'taxon_' || CAST(s_suppkey AS VARCHAR) || '.contigs.fa' ELSE 'taxon_' || CAST(s_suppkey AS VARCHAR) || '.fa' END AS name FROM supplier")
def contig_files(p: Proxy) -> DataFrame:
    stem = F.concat(F.lit("taxon_"), "s_suppkey")
    kind = F.col("s_suppkey") % 3
    other = F.translate(stem, "_", "-")
    there = p.supplier.select(F.explode(F.when(kind == 0, F.array(F.concat(other, F.lit(".fasta")), F.concat(stem, F.lit(".fa.gz")))).when(kind == 1, F.array(F.concat(stem, F.lit(".contigs.fa")), F.concat(other, F.lit(".gz")))).otherwise(F.array(F.concat(stem, F.lit(".fa")), F.concat(other, F.lit(".fa"))))).alias("name"))
    return reads.contig_files(p.supplier.select(stem.alias("taxon")), there)


_DUPES = "dupes AS (SELECT DISTINCT 'uce-' || CAST(s_suppkey AS VARCHAR) AS locus FROM supplier)"


@query("probes", "loci", sql=f"""WITH {_DUPES} SELECT 'probe' AS kind, id AS name FROM probes WHERE split_part(id, '_p', 1) NOT IN (SELECT locus FROM dupes) UNION ALL SELECT 'locus', uce FROM loci WHERE uce NOT IN (SELECT locus FROM dupes)""")
def beds_without_dupes(p: Proxy) -> DataFrame:
    """The probes' and the loci's intervals without duplicate loci."""
    dupes = p.supplier.select(F.concat(F.lit("uce-"), "s_suppkey").alias("locus"))
    of = lambda names: names.select(F.lit("chr1").alias("chromo"), F.lit(0).alias("start"), F.lit(1).alias("end"), "name")
    kept = matching.bed_without_dupes(of(p.probes.withColumnRenamed("id", "name")), dupes).select(F.lit("probe").alias("kind"), "name")
    return kept.unionByName(matching.bed_without_dupes(of(p.loci.withColumnRenamed("uce", "name")), dupes, names_are_loci=True).select(F.lit("locus").alias("kind"), "name"))


@query("contigs", sql="SELECT taxon || '|' || contig AS header, sequence FROM contigs WHERE taxon <> 'taxon_4'")
def assembly_contigs(p: Proxy) -> DataFrame:
    """Contigs listed by assembly; one assembly can't be read."""
    name = F.concat(F.translate("taxon", "_", "-"), F.lit(".contigs.fasta"))
    wanted = p.contigs.select(F.lit(0).alias("ord"), F.concat(name, F.lit("|2")).alias("assembly"), "contig")
    return matching.assembly_contigs(wanted, p.contigs.where("taxon <> 'taxon_4'").select(name.alias("assembly"), "contig", "sequence")).select("header", "sequence")


_WIDE = """genome AS (SELECT chromo, min_by(sequence, locus) AS genome FROM tiling_loci GROUP BY chromo),
placed AS (SELECT DISTINCT 'chr' || CAST(p_size % 10 AS VARCHAR) AS chromo, CAST(p_partkey % 90 AS BIGINT) AS a, CAST(p_partkey % 90 + 20 + p_partkey % 7 AS BIGINT) AS b FROM part),
wide AS (SELECT chromo, a - h AS start, b + h AS "end" FROM (SELECT *, CASE WHEN 40 - (b - a) > 0 THEN (40 - (b - a) + 1) // 2 ELSE 0 END AS h FROM placed) AS x),
cut AS (SELECT w.*, substr(genome, greatest(start, 0) + 1, greatest(least("end", length(genome)) - greatest(start, 0), 0)) AS sequence FROM wide w JOIN genome g ON w.chromo = g.chromo)"""


@query("tiling_loci", sql=f"""WITH {_WIDE} SELECT chromo, start, "end", sequence FROM cut WHERE length(sequence) >= 40 AND length(regexp_replace(sequence, '[^a-z]', '', 'g')) / length(sequence)::DOUBLE <= 0.3""")
def genome_sequences(p: Proxy) -> DataFrame:
    """Odd and even differences widened, sliced and screened."""
    placed = p.part.select(F.concat(F.lit("chr"), F.col("p_size") % 10).alias("chromo"), (F.col("p_partkey") % 90).alias("start"), (F.col("p_partkey") % 90 + 20 + F.col("p_partkey") % 7).alias("end")).distinct().withColumn("ord", F.lit(0))
    genome = p.tiling_loci.groupBy("chromo").agg(F.min_by("sequence", "locus").alias("sequence"))
    return intervals.genome_sequences(placed, genome, buffer_to=40, filter_mask=0.3).select("chromo", "start", "end", "sequence")


@query("intervals", sql="""SELECT a.chromo, a.start AS a_start, a."end" AS a_end, a.locus AS a_name, b.start AS b_start, b."end" AS b_end, b.locus AS b_name FROM intervals a JOIN intervals b ON a.chromo = b.chromo AND a.start < b."end" AND a."end" > b.start""")
def interval_overlaps(p: Proxy) -> DataFrame:
    """All intervals with all, themselves included."""
    named = p.intervals.withColumnRenamed("locus", "name")
    return intervals.overlaps(named, named, bin_size=100)


@query(
    "tiling_loci",
    sql="""WITH listed AS (SELECT locus, CAST(row_number() OVER (ORDER BY md5(CAST(locus AS VARCHAR)), locus) - 1 AS INT) AS ord FROM tiling_loci),
    several AS (SELECT l.locus, ord, t AS taxon_ord, 'taxon_' || CAST(t AS VARCHAR) AS taxon, chromo, chromo_start + t AS chromo_start, substr(sequence, 1 + 3 * t, 100) AS sequence FROM listed l JOIN tiling_loci s ON l.locus = s.locus, range(0, 2) AS r(t)),
    n AS (SELECT *, length(sequence) AS n FROM several),
    middle AS (SELECT DISTINCT locus, ord, taxon_ord, taxon, chromo, chromo_start, sequence, CAST(trunc(n / 2.0::DOUBLE - 10 + k * 20) AS BIGINT) AS start FROM n, range(0, 20) AS r(k) WHERE n / 2.0::DOUBLE - 10 + k * 20 + 40 <= n
        UNION ALL SELECT locus, ord, taxon_ord, taxon, chromo, chromo_start, sequence, CAST(trunc(n / 2.0::DOUBLE + 10 - k * 20 - 40) AS BIGINT) FROM n, range(0, 20) AS r(k) WHERE n / 2.0::DOUBLE + 10 - k * 20 - 40 >= 0),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY locus ORDER BY taxon_ord, start) - 1 AS INT) AS k, substr(sequence, start + 1, 40) AS part FROM middle)
    SELECT ord, k, CAST(locus AS VARCHAR) || '_p' || CAST(k AS VARCHAR) AS id, taxon AS source, upper(part) AS sequence, chromo, chromo_start + start AS global_start, chromo_start + start + 40 AS global_end
    FROM numbered WHERE length(part) = 40 AND length(regexp_replace(part, '[^a-z]', '', 'g')) / 40.0::DOUBLE < 0.5 AND NOT contains(upper(part), 'N')""",
)
def listed_tiles(p: Proxy) -> DataFrame:
    """Two taxa's versions of the listed loci, tiled in the list's order."""
    from pyspark.sql import Window

    listed = p.tiling_loci.select("locus", (F.row_number().over(Window.orderBy(F.md5(F.col("locus").cast("string")), "locus")) - 1).cast("int").alias("ord"))
    both = p.tiling_loci.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("taxon_ord"))
    several = both.withColumn("taxon", F.concat(F.lit("taxon_"), "taxon_ord")).withColumn("chromo_start", F.col("chromo_start") + F.col("taxon_ord")).withColumn("sequence", F.substring(F.col("sequence"), 1 + 3 * F.col("taxon_ord"), F.lit(100)))
    return probes.listed_tiles(several, listed, probes.Tiling(length=40, density=2.0, mask=0.5, remove_ambiguous=True))


@query("probes", sql="SELECT regexp_extract(header, 'probes-source:([^,]*)', 1) AS taxon, count(*) AS probes FROM probes GROUP BY 1")
def probe_subset_counts(p: Proxy) -> DataFrame:
    return probes.subset_counts(p.probes)


_DRAWN = [(n, k, TAXA[place]) for n, drawn in [(n, d) for rng in [optimise.SplitMix64(7)] for n, d in [(n, optimise.draw(len(TAXA), 5, rng)) for n in range(10)]] for k, place in enumerate(drawn)]
_BEST = f"""by_taxon AS (SELECT taxon, uce FROM (SELECT *, count(*) OVER (PARTITION BY taxon, contig) AS n FROM matches) AS m WHERE n = 1),
drawn(sample, place, taxon) AS (VALUES {", ".join(f"({n}, {k}, '{t}')" for n, k, t in _DRAWN)}),
groups AS (SELECT d.sample, o.place AS out, d.place, d.taxon FROM drawn d JOIN (SELECT DISTINCT place FROM drawn) o ON d.place <> o.place),
shared AS (SELECT g.sample, g.out, b.uce FROM groups g JOIN by_taxon b ON g.taxon = b.taxon GROUP BY g.sample, g.out, b.uce HAVING count(*) = 4),
sized AS (SELECT s.sample, s.out, count(uce) AS n_loci FROM (SELECT DISTINCT sample, out FROM groups) s LEFT JOIN shared USING (sample, out) GROUP BY s.sample, s.out),
best AS (SELECT sample, arg_max(out, (n_loci, out)) AS out FROM sized GROUP BY sample)"""


@query("matches", sql=f"""WITH {_BEST} SELECT CAST(b.sample AS BIGINT) AS sample, (SELECT string_agg(taxon, ',' ORDER BY place) FROM groups g WHERE g.sample = b.sample AND g.out = b.out) AS organisms,
    coalesce((SELECT string_agg(uce, ',' ORDER BY uce) FROM shared s WHERE s.sample = b.sample AND s.out = b.out), '') AS loci, (SELECT n_loci FROM sized z WHERE z.sample = b.sample AND z.out = b.out) AS n_loci FROM best b""")
def optimise_random(p: Proxy) -> DataFrame:
    """The best group of each random sample of taxa."""
    best = optimise.optimise_random(matrix.matches_by_taxon(p.matches), TAXA, samples=10, sample_size=4, seed=7)
    return best.select("sample", F.array_join("organisms", ",").alias("organisms"), F.array_join("loci", ",").alias("loci"), "n_loci")


@query("matches", sql=f"WITH {_BEST} SELECT d.taxon, count(*) AS excluded FROM drawn d JOIN best b ON d.sample = b.sample AND d.place = b.out GROUP BY d.taxon")
def exclusion_tallies(p: Proxy) -> DataFrame:
    best = optimise.optimise_random(matrix.matches_by_taxon(p.matches), TAXA, samples=10, sample_size=4, seed=7)
    return optimise.exclusion_tallies(best, optimise.drawn_taxa(p.spark, TAXA, samples=10, sample_size=4, seed=7))
