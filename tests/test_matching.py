import pytest

from locusframe.operators import matching, matrix, optimise


def hits(spark, rows):
    return spark.createDataFrame(rows, "taxon string, name1 string, name2 string, strand2 string")


def test_one_to_one(spark):
    rows = [
        ("t", "node_1 x", "uce-1_p1", "+"),
        ("t", "node_1 x", "uce-1_p2", "-"),  # both strands: the smaller sign
        ("t", "NODE_2_length_9", "uce-2_p1", "-"),
        ("t", "node_3", "uce-3_p1", "+"),  # node_3 hits two loci
        ("t", "node_3", "uce-4_p1", "+"),
        ("t", "node_5", "uce-5_p1", "+"),  # uce-5 is hit by two contigs
        ("t", "node_6", "uce-5_p2", "+"),
        ("t", "scaffold7 a", "uce-7_p1", "+"),
        ("u", "node_3", "uce-3_p1", "+"),
    ]
    h = hits(spark, rows)
    got = {tuple(r) for r in matching.match_map(h).collect()}
    assert got == {("uce-1", "t", "node_1", "+"), ("uce-2", "t", "NODE_2", "-"), ("uce-7", "t", "scaffold7", "+"), ("uce-3", "u", "node_3", "+")}
    totals = spark.createDataFrame([("t", 9), ("u", 1), ("v", 4)], "taxon string, total_contigs long")
    dupes = spark.createDataFrame([("uce-2",)], "locus string")
    summary = {r.taxon: tuple(r)[1:] for r in matching.match_summary(h, totals, dupes).collect()}
    assert summary == {"t": (2, 9, 1, 1, 1), "u": (1, 1, 0, 0, 0), "v": (0, 4, 0, 0, 0)}
    assert {r.contig for r in matching.match_map(h, keep_shared=True).collect()} >= {"node_5", "node_6"}


def test_self_hits(spark):
    """Several hits flag the others and the target, one foreign hit only the target; names are compared in their own case."""
    rows = [("uce-1_p1", "uce-1_p1"), ("uce-1_p1", "uce-2_p1"), ("uce-3_p1", "uce-3_p1"), ("uce-4_p1", "uce-5_p1"), ("uce-6_p1", "uce-6_p2"), ("uce-6_p2", "uce-6_p1")]
    df = spark.createDataFrame(rows, "name1 string, name2 string")
    assert {r.locus for r in matching.probe_self_dupes(df).collect()} == {"uce-1", "uce-2", "uce-4"}


SETS = {"a": {1, 2, 3, 4}, "b": {1, 2, 3}, "c": {1, 5}}


def by_taxon(spark, sets=SETS):
    return spark.createDataFrame([(t, f"uce-{k}") for t, ks in sets.items() for k in ks], "taxon string, uce string")


def test_matrices(spark):
    b = by_taxon(spark)
    loci = spark.createDataFrame([(f"uce-{k}",) for k in range(1, 7)], "uce string")
    assert [r.uce for r in matrix.complete_matrix(b, 3).collect()] == ["uce-1"]
    assert {r.uce for r in matrix.incomplete_matrix(b, loci).collect()} == {f"uce-{k}" for k in range(1, 6)}
    assert {tuple(r) for r in matrix.locus_losses(b, loci).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    missing = {tuple(r) for r in matrix.missing_report(b, loci).collect()}
    assert missing == {(t, f"uce-{k}") for t in SETS for k in set(range(1, 7)) - SETS[t]}


def test_optimise(spark):
    best = {r["size"]: (r.organisms, r.loci) for r in optimise.optimise_exhaustive(by_taxon(spark), ["a", "b", "c"]).collect()}
    assert best[1][0] == ["a"] and len(best[1][1]) == 4
    assert best[2] == (["a", "b"], ["uce-1", "uce-2", "uce-3"]) and best[3] == (["a", "b", "c"], ["uce-1"])
    drawn = optimise.optimise_random(by_taxon(spark), ["a", "b", "c"], samples=4, sample_size=2, seed=9).collect()
    assert len(drawn) == 4 and all(r.organisms in (["a", "b"], ["b", "a"]) and r.n_loci == 3 for r in drawn)
    with pytest.raises(ValueError):
        optimise.optimise_random(by_taxon(spark), ["a", "b"], sample_size=2)


def test_best_group_is_the_first_best():
    from itertools import combinations
    from random import Random

    rng = Random(4)
    for _ in range(60):
        bits = [rng.randrange(1 << 8) for _ in range(7)]
        for size in range(1, 8):
            groups = [(g, optimise_and(bits, g)) for g in combinations(range(7), size)]
            most = max(s.bit_count() for _, s in groups)
            assert optimise.best_group(bits, size, 255) == next(x for x in groups if x[1].bit_count() == most)


def optimise_and(bits, group):
    out = 255
    for k in group:
        out &= bits[k]
    return out


def test_generator():
    rng = optimise.SplitMix64(0)
    assert [rng.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    assert sorted(optimise.draw(5, 5, rng)) == list(range(5))


def test_estimates_wrap(spark):
    flags = spark.createDataFrame([(0, 0, None), (1, 1, 1), (1, 0, 0)], "x int, y int, z int")
    rows = {(round(r.fraction, 2), r.cut): r.loci for r in matrix.incomplete_matrix_estimates(flags, ["x", "y", "z"], 0.4, 1.0, 0.3).collect()}
    # cuts 1 and 2: none of three is below the first cut and three of three below none, so both are in the last class
    assert rows == {(0.7, 2): 2, (0.4, 1): 1}


def test_strict_extraction(spark):
    m = spark.createDataFrame([("uce-1", "t", "NODE_1", "-")], "uce string, taxon string, contig string, strand string")
    loci = spark.createDataFrame([("uce-1",)], "uce string")
    contigs = spark.createDataFrame([("t", "node_1", "acNACGTKt", 1), ("t", "node_1", "later", 2)], "taxon string, contig string, sequence string, ord int")
    (row,) = matrix.locus_extraction(m, loci, contigs).collect()
    assert (row.header, row.sequence) == ("uce-1_t |uce-1", "MACGT")
    with pytest.raises(Exception, match="no contig"):
        matrix.locus_extraction(m, loci, contigs.limit(0), strict=True).collect()
