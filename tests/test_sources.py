import gzip

import pytest
from pyspark.sql import functions as F

from locusframe import sources, streaming
from locusframe.operators import external, reads
from locusframe.sources import alignment, config, sinks, twobit


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one > two\nACG\n T\n\n>y\r\nGG\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">z\nAC\n")
    rows = sources.read_fasta(spark, str(tmp_path)).orderBy("file", "ord").collect()
    assert [(r.id, r.description, r.sequence) for r in rows] == [("x", "x one > two", "ACGT"), ("y", "y", "GG"), ("z", "z", "AC")]
    assert {r.contigs for r in sources.count_contigs(spark, str(tmp_path)).collect()} == {2, 1}
    (tmp_path / "bad.fasta").write_text("data\n>a\n>b\nAC1\n>\nA\n")
    issues = {(r.line, r.message) for r in sources.validate_fasta(spark, str(tmp_path / "bad.fasta")).collect()}
    assert issues == {(1, "data before the first header"), (2, "empty sequence"), (4, "character outside the alphabet"), (5, "header without a name")}
    with pytest.raises(Exception, match="before the first header"):
        sources.read_fasta(spark, str(tmp_path / "bad.fasta")).collect()
    sinks.write_fasta(sources.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"), width=2)
    assert "\n".join(sorted(p.read_text() for p in (tmp_path / "out").glob("part-*"))).split() == [">x", "AC", "GT", ">y", "GG"]


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a/1\nACGT extra\n+\nIIII\n@b\nAC\n+\nII\n")
    lengths = sources.fastq_lengths(sources.read_fastq(spark, str(tmp_path / "r.fastq")))
    assert sorted(r.n for r in lengths.collect()) == [2, 4]
    assert sources.count_reads(spark, str(tmp_path / "r.fastq")).first().reads == 2


def test_length_reports(spark):
    df = spark.createDataFrame([("f", n) for n in (100, 200, 300, 1200)], "file string, n long")
    r = reads.length_report(df).first()
    assert (r.reads, r.total, r.long, r.median, r.least, r.most) == (4, 1800, 1, 250.0, 100, 1200)


HIT = "9\t>c1\t+\t1\t5\t4\t>uce-1_p1 |x\t-\t0\t4\t4\t....\t4M\t4/4\t100.0%\t4/4\t97.5%"


def test_hits(spark, tmp_path):
    (tmp_path / "gallus-gallus.contigs.lastz").write_text(HIT + "\n")
    (r,) = sources.read_hits(spark, str(tmp_path)).collect()
    assert (r.taxon, r.name1, r.name2, r.zstart1, r.percent_identity, r.percent_continuity) == ("gallus_gallus", "c1", "uce-1_p1 |x", 1, 100.0, 97.5)
    (tmp_path / "b.lastz").write_text(HIT + "\t4/4\t100%\n")
    assert sources.read_hits(spark, str(tmp_path / "b.lastz"), long=True).first().percent_coverage == 100.0
    (tmp_path / "c.lastz").write_text("too\tfew\n")
    with pytest.raises(Exception):
        sources.read_hits(spark, str(tmp_path / "c.lastz")).collect()


def test_streaming(spark, tmp_path):
    folder = tmp_path / "hits"
    folder.mkdir()
    (folder / "t1.lastz").write_text("\n".join([HIT, HIT, HIT.replace("c1", "c2")]) + "\n")
    hits = streaming.stream_hits(spark, str(folder))
    q = streaming.running_matches(hits).writeStream.format("memory").queryName("pairs").outputMode("append").start()
    q.processAllAvailable()
    (folder / "t2.lastz").write_text(HIT + "\n")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT taxon, count(*) AS n FROM pairs GROUP BY taxon ORDER BY taxon").collect() == [("t1", 2), ("t2", 1)]
    q = streaming.running_counts(streaming.stream_hits(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.taxon: r.hits for r in spark.table("counts").collect()} == {"t1": 3, "t2": 1}


ROWS = [("uce-1_a", "ACGT-ACGT"), ("b", "ACGTAACGT")]


def test_nexus():
    assert alignment.parse_nexus(sinks.nexus_text(ROWS)) == ROWS
    long = [("a b", "AC" * 600), ("it's", "GT" * 600)]
    text = sinks.nexus_text(long)
    assert "interleave" in text and alignment.parse_nexus(text) == long
    assert alignment.parse_nexus("#NEXUS\nbegin data;\nMatrix [c [nested]] 'x;y' AC [z] GT\nb\tAC GT; end;") == [("x;y", "ACGT"), ("b", "ACGT")]
    for bad in ("#NEXUS", "matrix\na AC [x"):
        with pytest.raises(ValueError):
            alignment.parse_nexus(bad)


@pytest.mark.parametrize(
    ("fmt", "text"),
    [
        ("phylip-relaxed", "2 8\ntaxon_a ACGT\ntaxon_b GGGG\n\nTTTT\nCCCC\n"),
        ("phylip-relaxed", "2 8\ntaxon_a ACGT\ntaxon_b GGGG\n\ntaxon_a TTTT\ntaxon_b CCCC\n"),
        ("phylip-sequential", "2 8\ntaxon_a ACGT\n  TTTT\ntaxon_b GGGG\n  CCCC\n"),
        ("phylip", "2 8\ntaxon_a   ACGT TTTT\ntaxon_b   GGGGCCCC\n"),
        ("clustal", "CLUSTAL W\n\ntaxon_a ACGT\ntaxon_b GGGG\n        *\n\ntaxon_a TTTT 8\ntaxon_b CCCC 8\n"),
        ("stockholm", "# STOCKHOLM 1.0\ntaxon_a ACGT\ntaxon_b GGGG\n#=GC x\ntaxon_a TTTT\ntaxon_b CCCC\n//\nrest\n"),
        ("emboss", "# x\n\ntaxon_a 1 ACGT 4\n        ||\ntaxon_b 1 GGGG 4\n\ntaxon_a 5 TTTT 8\ntaxon_b 5 CCCC 8\n"),
        ("fasta", ">taxon_a d\nACGT\nTTTT\n>taxon_b\nGGGGCCCC\n"),
    ],
)
def test_formats(spark, tmp_path, fmt, text):
    assert alignment.PARSERS[fmt](text) == [("taxon_a", "ACGTTTTT"), ("taxon_b", "GGGGCCCC")]
    (tmp_path / f"uce-1.x.{alignment.EXTENSIONS[fmt][0]}").write_text(text)
    rows = sources.read_alignments(spark, str(tmp_path), fmt).orderBy("row_ord").collect()
    assert [(r.locus, r.row_ord, r.taxon, r.seq) for r in rows] == [("uce-1", 0, "taxon_a", "ACGTTTTT"), ("uce-1", 1, "taxon_b", "GGGGCCCC")]


def test_invalid_alignments(spark, tmp_path):
    for rows in ([("", "A")], [("a", "A"), ("a", "C")], [("a", "A"), ("b", "AC")]):
        with pytest.raises(ValueError):
            alignment.check_rows(rows)
    assert alignment.check_rows([("a", "A"), ("a", "C")], keep_first=True) == [("a", "A")]
    with pytest.raises(ValueError):
        alignment.parse_phylip("2 3\na ACG\nb AC\n")
    with pytest.raises(ValueError):
        sources.read_alignments(spark, str(tmp_path), "word")


def test_charsets_and_partitions():
    text = "begin sets;\ncharset 'uce-1.nex' = 1-4;\ncharset b = 5 - 9;\ncharset zero = 0-3;\ncharpartition x = a:b;\nend;"
    assert alignment.parse_charsets(text) == [("uce-1.nex", 0, 4), ("b", 4, 9)]
    assert config.parse_partitions("DNA, p1 = 1-3, 8-9\nDNA, p2 = 4\n", 9) == [("p1", [(1, 3), (8, 9)]), ("p2", [(4, 4)])]
    with pytest.raises(ValueError):
        config.parse_partitions("DNA, p = 1-10", 9)


def test_config(spark):
    conf = config.parse_config("# c\n[all]\nhomo-sapiens\ngallus_gallus\n; x\n[Excludes]\ngallus-gallus\n[names]\na:b=c\nd = e:f\n")
    assert conf["names"] == [("a", "b=c"), ("d", "e:f")] and config.taxa_of(conf, "all") == ["homo_sapiens"]
    with pytest.raises(KeyError):
        config.taxa_of(conf, "nobody")
    assert config.config_table(spark, conf).count() == 5
    assert config.resolve("$CONDA/bin/x", {"CONDA": "/opt"}) == "/opt/bin/x"


def test_twobit(spark, tmp_path):
    genome = {"chr1": "acgtACGTNNACGTACGTAC", "chr2": "T" * 33 + "nnACG", "empty": ""}
    path = tmp_path / "g.2bit"
    path.write_bytes(sources.write_twobit_bytes(genome))
    import random

    rng = random.Random(1)
    with twobit._open(str(path)) as f:
        tb = twobit.TwoBit(f)
        upper_n = {k: v.replace("n", "N") for k, v in genome.items()}
        assert {n: tb.slice(n) for n in genome} == upper_n
        for _ in range(100):
            n, a, b = rng.choice(list(genome)), rng.randint(-5, 40), rng.randint(-5, 60)
            assert tb.slice(n, a, b) == upper_n[n][max(0, a) : max(0, b)]
        with pytest.raises(KeyError):
            tb.slice("x")
    index = sources.twobit_index(spark, str(path))
    assert [tuple(r) for r in index.collect()] == [("chr1", 20), ("chr2", 38), ("empty", 0)]
    whole = sources.read_twobit(twobit.whole_genome(index), str(path)).collect()
    assert {r.chromo: r.sequence for r in whole} == upper_n


def test_beds_and_names(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track name=x\nchr1\t1\t5\tuce-1_p1\t0\nchr2\t3\t4\n")
    rows = sources.read_bed(spark, str(tmp_path / "x.bed")).collect()
    assert [tuple(r) for r in rows] == [("chr1", 1, 5, "uce-1_p1"), ("chr2", 3, 4, None)]
    assert sinks.safe_name("a.b") == "a.b"
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            sinks.safe_name(bad)
    files = spark.createDataFrame([("/x/a.nex",), ("/y/a.fasta",), ("/x/b.nex",)], "file string")
    assert [r.stem for r in sinks.repeated_stems(files).collect()] == ["a"]
    records = spark.createDataFrame([("l1", "a", "ACGT"), ("l2", "b", "AC")], "locus string, id string, sequence string")
    sinks.explode_to(records, str(tmp_path / "parts"), "locus")
    assert sorted(p.name for p in (tmp_path / "parts").glob("locus=*")) == ["locus=l1", "locus=l2"]
    with pytest.raises(Exception, match="bad name"):
        sinks.explode_to(records.withColumn("locus", F.lit("a/b")), str(tmp_path / "bad"), "locus")


def test_external(spark):
    records = spark.createDataFrame([("uce-1_phased_phased", f"t{k}", "ACGT"[: k + 1]) for k in range(4)] + [("uce-2", "t0", "AC"), ("uce-1_phased", "t9", "ANC")], "locus string, taxon string, sequence string")
    rows = external.group_and_align(records, 4, external.pad_rows).orderBy("row_ord").collect()
    assert [(r.locus, r.seq) for r in rows] == [("uce-1", "A---"), ("uce-1", "AC--"), ("uce-1", "ACG-"), ("uce-1", "ACGT")]
    probes = spark.createDataFrame([("uce-1_p1", "ACGT"), ("uce-1_p2", "ACGT"), ("uce-1_p3", "ACCT"), ("uce-2_p1", "GG")], "id string, sequence string")
    assert {tuple(r) for r in external.reconstruct_loci(probes, external.pad_rows).collect()} == {("uce-1", "ACXT"), ("uce-2", "GG")}
    command = external.hit_search_command("t.2bit", "q.fa", "out", min_match=None)
    assert "--coverage=83" in command and "--identity=92.5" in command and not command[-1].endswith("coverage")
    assert "--matchcount=40" in external.hit_search_command("t", "q", "o", min_match=40)
    assert external.hit_search_command("t", "q", "o", with_coverage=True)[-1].endswith("continuity,coverage")
    assert [c[1] for c in external.mapping_commands("s", "a", ["g"], "p", ["r"], "o")] == ["build-genome", "build-hash", "map"]
    assert len(external.mapping_commands("s", "a", ["g"], "p", ["r", "q"], "o", fresh=True)) == 1 and not external.index_is_fresh("/nowhere", [])
    assert external.block_options(10)[1:3] == ("-b1=6", "-b2=9") and external.block_options(2, b2=0.1)[2] == "-b2=2"
    assert external.CommandAligner(("cat",))([("a", "AC"), ("b", "AG")]) == [("a", "AC"), ("b", "AG")]
    with pytest.raises(RuntimeError):
        external.CommandAligner(("false",))([("a", "A")])


def test_reads(spark):
    df = spark.createDataFrame([("x/1",), ("x/2",), ("y/1",), ("z",)], "id string")
    assert {r.id: r.kind for r in reads.unmix_reads(df).collect()} == {"x/1": "r1", "x/2": "r2", "y/1": "singleton", "z": "singleton"}
    new = spark.createDataFrame([("x 1:N:0",), ("x 2:N:0",)], "id string")
    assert {r.kind for r in reads.unmix_reads(new, new_style=True).collect()} == {"r1", "r2"}
    records = spark.createDataFrame([("f", k, f"read{n}/{k[1]}") for n in range(400) for k in ("r1", "r2")], "folder string, kind string, id string")
    plan = reads.sample_plan(records.groupBy("folder", "kind").count().withColumnRenamed("count", "reads"), 400)
    kept = reads.sample_reads(records, plan, 3).groupBy("kind").count().collect()
    assert len({r["count"] for r in kept}) == 1 and 120 < kept[0]["count"] < 280
