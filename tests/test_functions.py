import pytest
from pyspark.sql import functions as F

from locusframe import functions as fn


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (fn.clean_sequence, "acgNACnG,Tacg", "ACGT"),
        (fn.reverse_complement, "ACGTMRWSN", "NSWYKACGT"),
        (fn.reverse_complement, "acgtx-", "-xacgt"),
        (fn.reverse_complement_plain, "ACgtN-", "-NacGT"),
        (fn.reverse_complement_upper, "acgtn", "NACGT"),
        (fn.ry_recode, "AGRCTYSWnN-?agr", "RRRYYY??nN-?rrr"),
        (fn.ry_binary, "AGRCTYSWnN-?", "111000????-?"),
        (fn.degenerate_to_n, "ACGTRYxkN-", "ACGTNNNNN-"),
        (fn.end_gaps_to_missing, "--A-C-", "??A-C?"),
        (fn.end_gaps_to_missing, "---", "???"),
        (fn.end_gaps_to_missing, "", ""),
        (fn.ungap, "-A?C", "AC"),
        (fn.taxon_from_file, "/x/homo-sapiens.contigs.fasta", "homo_sapiens"),
        (fn.key_locus, "uce-1_gallus_gallus", "uce-1"),
        (fn.key_taxon, "uce-1_gallus_gallus", "gallus-gallus"),
        (fn.nexus_name, "uce-1_a", "'uce-1_a'"),
        (fn.nexus_name, "it's", "'it''s'"),
        (fn.nexus_name, "plain_1", "plain_1"),
        (fn.capitalise_first, "gallus GALLUS", "Gallus gallus"),
        (fn.strip_reverse_marker, "_R_taxon_R", "taxon_R"),
        (fn.contig_name, "NODE_3_length_528_cov_3.19", "NODE_3"),
        (fn.contig_name, "k41_77 flag=1", "k41_77"),
        (fn.contig_name, "scaffold12", None),
        (fn.contig_name_lenient, "scaffold12 x", "scaffold12"),
        (fn.locus_name, "uce-12_p3 |x", "uce-12"),
        (fn.locus_name, "UCE-12_p3", None),
    ],
)
def test_texts(spark, function, text, expected):
    assert value(spark, function(F.col("a")), a=text) == expected


def test_strict_names(spark):
    with pytest.raises(Exception, match="no match"):
        value(spark, fn.locus_name(F.col("a"), strict=True), a="nothing")


def test_numbers(spark):
    assert value(spark, fn.masked_fraction(F.col("a")), a="aCgT") == 0.5
    assert value(spark, fn.masked_fraction(F.col("a")), a="") is None
    assert value(spark, fn.gc_fraction(F.col("a")), a="aCgT") == 0.5
    assert value(spark, fn.n_count(F.col("a")), a="aNnT") == 2
    assert value(spark, fn.leading_gaps(F.col("a")), a="--A-") == 2
    assert value(spark, fn.is_all_gaps(F.col("a")), a="--") is True
    assert value(spark, fn.is_all_gaps(F.col("a")), a="") is False


def test_pairs(spark):
    assert value(spark, fn.strip_locus_prefix(F.col("a"), F.col("b")), a="_R__R_uce-1_tax_a", b="uce-1_phased") == "tax_a"
    assert value(spark, fn.wrap_sequence(F.col("a"), 3), a="ACGTAC") == "ACG\nTAC"
    assert value(spark, fn.header_field(F.col("a"), "k"), a="x |j:1,k:2") == "2"
    assert value(spark, fn.header_field(F.col("a"), "no"), a="x |j:1,k:2") is None
