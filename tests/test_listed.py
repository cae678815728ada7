from locusframe.operators import probes


def test_only_listed_loci_are_tiled_in_the_lists_order(spark):
    loci = spark.createDataFrame([(k, 0, "taxon_0", "chr1", 1000 * k, "ACGT" * 25) for k in (1, 2, 3)], "locus long, taxon_ord int, taxon string, chromo string, chromo_start long, sequence string")
    listed = spark.createDataFrame([(3, 0), (1, 1)], "locus long, ord int")
    out = probes.listed_tiles(loci, listed, probes.Tiling(length=40, density=2.0, mask=0.5, remove_ambiguous=True)).collect()
    assert {(r.ord, r.id.split("_")[0]) for r in out} == {(0, "3"), (1, "1")}
