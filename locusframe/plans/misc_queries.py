"""Queries of reads, records and gene trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reads, trees
from .proxies import Proxy
from .registry import query


@query("reads", sql="SELECT file, ord, CAST(floor((row_number() OVER (PARTITION BY file ORDER BY ord) - 1) / 100.0) AS BIGINT) AS chunk FROM reads")
def chunk_records(p: Proxy) -> DataFrame:
    return reads.chunk_records(p.reads, 100).select("file", "ord", "chunk")


@query(
    "reads",
    sql="""WITH named AS (SELECT id, regexp_extract(id, '^(\\S+)/([12])$', 1) AS pair, regexp_extract(id, '^(\\S+)/([12])$', 2) AS mate FROM reads),
    sized AS (SELECT *, count(DISTINCT mate) OVER (PARTITION BY pair) AS mates FROM named)
    SELECT id, CASE WHEN pair <> '' AND mates = 2 THEN 'r' || mate ELSE 'singleton' END AS kind FROM sized""",
)
def unmix_reads(p: Proxy) -> DataFrame:
    return reads.unmix_reads(p.reads).select("id", "kind")


@query(
    "read_files",
    sql="""SELECT folder, min(name) FILTER (name LIKE '%\\_R1\\_%' ESCAPE '\\') AS r1, count(*) FILTER (name LIKE '%\\_R1\\_%' ESCAPE '\\') AS n_r1,
    min(name) FILTER (name LIKE '%\\_R2\\_%' ESCAPE '\\') AS r2, count(*) FILTER (name LIKE '%\\_R2\\_%' ESCAPE '\\') AS n_r2,
    min(name) FILTER (name LIKE '%singleton%') AS singleton, count(*) FILTER (name LIKE '%singleton%') AS n_singleton FROM read_files WHERE name LIKE '%.gz' GROUP BY folder""",
)
def reads_classified(p: Proxy) -> DataFrame:
    return reads.classify_reads(p.read_files)


@query(
    "read_files",
    sql="""SELECT folder || CASE WHEN name LIKE '%\\_R1\\_%' ESCAPE '\\' THEN '-R1' WHEN name LIKE '%\\_R2\\_%' ESCAPE '\\' THEN '-R2' ELSE '-SINGLETON' END || '.fastq.gz' AS target, name,
    CAST(row_number() OVER (PARTITION BY folder, CASE WHEN name LIKE '%\\_R1\\_%' ESCAPE '\\' THEN 1 WHEN name LIKE '%\\_R2\\_%' ESCAPE '\\' THEN 2 ELSE 3 END ORDER BY name) - 1 AS INT) AS ord FROM read_files WHERE name LIKE '%.gz'""",
)
def merge_plan(p: Proxy) -> DataFrame:
    return reads.merge_plan(p.read_files.withColumnRenamed("folder", "sample"))


@query("reads", sql="SELECT folder, kind, reads, round(least(1.0::DOUBLE, 1000.0::DOUBLE / sum(reads) OVER (PARTITION BY folder)), 9) AS proportion FROM (SELECT file AS folder, CASE WHEN id LIKE 'single%' THEN 'singleton' ELSE 'r' || substr(id, length(id), 1) END AS kind, count(*) AS reads FROM reads GROUP BY ALL) AS c")
def sample_plan(p: Proxy) -> DataFrame:
    kind = F.when(F.col("id").startswith("single"), "singleton").otherwise(F.concat(F.lit("r"), F.right("id", F.lit(1))))
    counts = p.reads.groupBy(F.col("file").alias("folder"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("reads"))
    return reads.sample_plan(counts, 1000).withColumn("proportion", F.round("proportion", 9))


@query(
    "aln",
    sql="""WITH rows_ AS (SELECT locus, row_ord, CASE WHEN taxon = 'taxon_0' THEN 'gallus_gallus' ELSE taxon END AS taxon, upper(replace(replace(seq, '-', ''), '?', '')) AS sequence FROM aln WHERE taxon <> 'taxon_5'),
    numbered AS (SELECT *, row_number() OVER (ORDER BY locus, row_ord) - 1 AS number FROM rows_ WHERE sequence <> '')
    SELECT number, upper(substr(taxon, 1, 1)) || lower(substr(split_part(taxon, '_', 1), 2, 2)) || '_' || CAST(number AS VARCHAR) AS id, upper(substr(taxon, 1, 1)) || lower(substr(replace(taxon, '_', ' '), 2)) AS organism, locus, sequence FROM numbered""",
)
def ncbi_records(p: Proxy) -> DataFrame:
    return reads.archive_records(p.aln, {"taxon_0": "gallus_gallus"}, ("taxon_5",))


_SHAPES = ("((a:1,b:2)90:1,c:1,d:3)95;", "((c,d)80,a,b)70;", "((a,c)60,b,d)50;", "((a-x:1,b)85:2,(c,d:0.5)75:1);")


def _trees(p: Proxy) -> DataFrame:
    shapes = F.array(*[F.lit(t) for t in _SHAPES])
    return p.orders.select(F.concat(F.lit("tree_"), "o_orderkey").alias("tree_id"), F.concat(F.lit("section_"), F.col("o_custkey") % 5).alias("section"), F.get(shapes, (F.col("o_orderkey") % 3).cast("int")).alias("newick"), F.col("o_orderkey").alias("n"))


@query(sql="SELECT 'a,b' AS sides, count(*) FILTER (o_orderkey % 3 < 2) AS n FROM orders UNION ALL SELECT 'a,c', count(*) FILTER (o_orderkey % 3 = 2) FROM orders")
def tree_topology_counts(p: Proxy) -> DataFrame:
    counted = trees.topology_counts(_trees(p), "d")
    return counted.select(F.element_at(F.split("topology", "//"), 2).alias("sides"), "n")


@query(sql="""WITH m AS (SELECT 'section_' || CAST(o_custkey % 5 AS VARCHAR) AS section, CASE o_orderkey % 3 WHEN 0 THEN 92.5 WHEN 1 THEN 75.0 ELSE 55.0 END::DOUBLE AS m FROM orders)
    SELECT section, count(*) AS trees, round(avg(m), 6) AS mean_support, round(1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS ci FROM m GROUP BY section""")
def bootrep_support(p: Proxy) -> DataFrame:
    return trees.bootstrap_support(_trees(p)).withColumns({c: F.round(c, 6) for c in ("mean_support", "ci")})


@query(sql="""SELECT 'tree_' || CAST(o_orderkey AS VARCHAR) AS tree_id, CASE o_orderkey % 3 WHEN 0 THEN '((alpha:1,beta:2)90:1,c:1,d:3)95;' WHEN 1 THEN '((c,d)80,alpha,beta)70;' ELSE '((alpha,c)60,beta,d)50;' END AS newick FROM orders""")
def rename_leaves(p: Proxy) -> DataFrame:
    return trees.rename_leaves(_trees(p), {"a": "alpha", "b": "beta"}).select("tree_id", "newick")


@query(sql="""SELECT 'tree_' || CAST(o_orderkey AS VARCHAR) AS tree_id, CASE o_orderkey % 3 WHEN 0 THEN '(a:1,b:2,(c:1,d:3)95:1)90;' WHEN 1 THEN '((c,d)80,a,b)70;' ELSE '(a,c,(b,d)50)60;' END AS newick FROM orders""")
def reroot_trees(p: Proxy) -> DataFrame:
    return trees.reroot_trees(_trees(p), "a").select("tree_id", "newick")


@query(
    sql="""WITH loci AS (SELECT s_name AS locus, row_number() OVER (ORDER BY s_name) - 1 AS place FROM (SELECT DISTINCT s_name FROM supplier) AS s),
    slots AS (SELECT r.r AS replicate, s.place AS slot FROM range(20) AS r(r), loci s),
    drawn AS (SELECT CAST('0x' || substr(md5('5:' || replicate || ':' || slot), 1, 12) AS BIGINT) % (SELECT count(*) FROM loci) AS place FROM slots)
    SELECT l.locus, count(*) AS n FROM drawn d JOIN loci l ON d.place = l.place GROUP BY l.locus"""
)
def bootstrap_counts(p: Proxy) -> DataFrame:
    return trees.bootstrap_counts(trees.bootstrap_replicates(p.supplier.select(F.col("s_name").alias("locus")), 20, seed=5))


@query(sql="""WITH drawn AS (SELECT CAST(floor(o_orderkey / 50.0) AS BIGINT) AS replicate, o_orderkey % 50 AS slot, 'locus_' || CAST(o_custkey % 7 AS VARCHAR) AS locus FROM orders),
    nth AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY replicate, slot) AS nth FROM drawn),
    trees AS (SELECT 'locus_' || CAST(l_suppkey % 7 AS VARCHAR) AS locus, 'tree_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS newick, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey * 10 + l_linenumber) AS nth FROM lineitem)
    SELECT replicate, slot, n.locus, newick FROM nth n JOIN trees t ON n.locus = t.locus AND n.nth = t.nth""")
def sort_bootstraps(p: Proxy) -> DataFrame:
    drawn = p.orders.select(F.floor(F.col("o_orderkey") / 50).alias("replicate"), (F.col("o_orderkey") % 50).alias("slot"), F.concat(F.lit("locus_"), F.col("o_custkey") % 7).alias("locus"))
    lines = p.lineitem.select(F.concat(F.lit("locus_"), F.col("l_suppkey") % 7).alias("locus"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("tree_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("newick"))
    return trees.sort_bootstraps(drawn, lines)


@query(sql="""SELECT 'NODE_' || CAST(p_partkey AS VARCHAR) || '_length_' || CAST(p_size AS VARCHAR) || '_cov_' || CAST(p_size % 7 AS VARCHAR) AS id,
    regexp_replace(repeat(translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTRYkm'), 4), '[RYkm]', 'N', 'g') AS sequence FROM part WHERE p_size > 0""")
def assembler_contigs(p: Proxy) -> DataFrame:
    from ..operators.convert import assembler_contigs as convert

    header = F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string"))
    return convert(p.part.where("p_size > 0").select(header.alias("description"), F.repeat(F.translate(F.md5("p_name"), "0123456789abcdef", "ACGTACGTACGTRYkm"), F.lit(4)).alias("sequence")))
