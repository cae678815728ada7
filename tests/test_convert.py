import gzip

import pytest

from locusframe.operators import convert, reads
from locusframe.session import register_functions
from locusframe.sources import datasource, sinks, write_twobit_bytes


def test_assembler_contigs(spark):
    df = spark.createDataFrame([("7 120 3", "ACRY" * 30), ("8 4 1", "ACGT"), ("9", "A" * 200)], "description string, sequence string")
    (row,) = convert.assembler_contigs(df).collect()
    assert (row.id, row.sequence) == ("NODE_7_length_120_cov_3", "ACNN" * 30)


def test_join_members(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for lane in (2, 1):
        with gzip.open(tmp_path / "in" / f"x_R1_00{lane}.fastq.gz", "wt") as f:
            f.write(f"@{lane}\n")
    files = spark.createDataFrame([("s", "x_R1_002.fastq.gz"), ("s", "x_R1_001.fastq.gz"), ("s", "notes.txt")], "sample string, name string")
    (row,) = convert.join_members(reads.merge_plan(files), str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert (row.target, row.files) == ("s-R1.fastq.gz", 2)
    with gzip.open(tmp_path / "out" / row.target, "rt") as f:
        assert f.read() == "@1\n@2\n"


def test_convert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "uce-1.phylip").write_text("2 4\na ACGT\nb AC-T\n")
    convert.convert_alignments(spark, str(tmp_path / "in"), "phylip-relaxed", "nexus", str(tmp_path / "nex"))
    (part,) = (tmp_path / "nex" / "locus=uce-1").glob("part-*")
    assert part.read_text().startswith("#NEXUS\nbegin data;\ndimensions ntax=2 nchar=4;")
    convert.convert_alignments(spark, str(tmp_path / "in"), "phylip-relaxed", "fasta", str(tmp_path / "fa"))
    with pytest.raises(ValueError):
        convert.convert_alignments(spark, str(tmp_path / "in"), "phylip-relaxed", "word", str(tmp_path / "w"))


def test_texts():
    assert convert.number_text(3.0) == "3.0" and convert.number_text(1234567.5, grouped=True) == "1,234,567.5" and convert.number_text(float("nan")) == "nan"
    assert convert.report_line("x", {"reads": 0}) == "x,0,Div/0,Div/0,Div/0,Div/0,0"
    assert convert.report_line("x", {"reads": 2, "total": 6, "mean": 3.0}) == "x,2,6,3.0"
    assert [c[0] for c in convert.assembly_command("velvet", "o", "1", "2")] == ["velveth", "velvetg"]
    assert "--pe1-s" in convert.assembly_command("spades", "o", "1", "2", "3")[0] and convert.assembly_command("abyss", "o", "1", "2")[0][0] == "abyss-pe"
    with pytest.raises(ValueError):
        convert.assembly_command("other", "o", "1", "2")


def test_data_sources_and_functions(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "g.2bit").write_bytes(write_twobit_bytes({"c": "ACGTN" * 5}))
    rows = spark.read.format("twobit").option("path", str(tmp_path / "g.2bit")).option("chunk", "10").load().orderBy("start").collect()
    assert [r.sequence for r in rows] == ["ACGTNACGTN", "ACGTNACGTN", "ACGTN"]
    (tmp_path / "uce-1.nex").write_text(sinks.nexus_text([("a", "AC"), ("b", "GT")]))
    assert [r.seq for r in spark.read.format("alignment").option("path", str(tmp_path)).load().orderBy("row_ord").collect()] == ["AC", "GT"]
    register_functions(spark)
    row = spark.sql("SELECT tree_topology('((a,b),c,d);', 'd') AS k, tree_reroot('((a,b),c);', 'a') AS r, tree_leaves('(b,a);') AS l").first()
    assert (row.k, row.r, row.l) == ("a|b|c|d//a,b", "(a,b,c);", ["a", "b"])
    assert [r.start for r in spark.sql("SELECT * FROM flush_tiles(100, 40, 40)").collect()] == [0, 40, 80]
    assert spark.sql("SELECT * FROM charsets('charset x = 1-4;')").first().stop == 4


def test_match_store(spark, tmp_path):
    m = spark.createDataFrame([("uce-1", "t", "NODE_1", "+"), ("uce-1", "u", "NODE_2", "-")], "uce string, taxon string, contig string, strand string")
    sinks.write_matches(m, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).where("taxon = 'u'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(taxon" in back._jdf.queryExecution().executedPlan().toString()
