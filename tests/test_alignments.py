import random

import numpy as np
import pytest

from locusframe.operators import alignments, concat, sites, trim


def aln(spark, **loci):
    rows = [(locus, k, f"t{k}", s) for locus, seqs in loci.items() for k, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "locus string, row_ord int, taxon string, seq string")


def test_site_statistics(spark):
    a = aln(spark, two=["AA", "AA", "CC", "CC"], one=["A", "A", "A", "C"], none=["a?-", "ANN"], mixed=["Xn", "XA"])
    expected = {"two": (2, 2, 2, 2), "one": (1, 0, 1, 1), "none": (3, 0, 0, 1), "mixed": (2, 0, 0, 0)}
    for f in (sites.site_statistics, sites.site_statistics_kernel):
        assert {r.locus: tuple(r)[1:] for r in f(a).collect()} == expected
    totals = {r.ch: r.n for r in sites.character_totals(aln(spark, x=["a?-", "ANN"])).collect()}
    assert totals == {"A": 2, "N": 2, "?": 1, "-": 1}


def test_kernel_is_the_cell_form(spark):
    rng = random.Random(2)
    loci = {f"l{k}": ["".join(rng.choice("ACGTNX-?acg") for _ in range(20 + k)) for _ in range(rng.randint(1, 7))] for k in range(15)}
    a = aln(spark, **loci)
    assert sorted(map(tuple, sites.site_statistics(a).collect())) == sorted(map(tuple, sites.site_statistics_kernel(a).collect()))


def test_intervals_of_means(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "x double")
    assert abs(df.agg(sites.confidence_95("x")).first()[0] - 11.316065) < 1e-5
    assert np.isnan(df.limit(1).agg(sites.confidence_95("x")).first()[0])


def test_consensus(spark):
    assert sites.consensus_threshold(aln(spark, x=["AAC", "ACC", "-GC", "AT."])).first().consensus == "AXC"
    assert sites.consensus_majority(aln(spark, x=["A-C", "c-G", "C-T", "CAA"])).first().consensus == "C-N"
    assert sites.consensus_majority(aln(spark, x=["A", "C"])).first().consensus == "A"


def test_alleles(spark):
    a = aln(spark, x=["AA-ANA", "ACTA-A", "AC-ATA", "GC-AT-"])
    typed = {(r.taxon, r.pos): r.type for r in sites.alleles(a).collect()}
    assert typed[("t3", 0)] == "substitution" and typed[("t1", 2)] == "insertion" and typed[("t1", 4)] == "deletion"
    assert typed[("t0", 4)] is None and typed[("t3", 5)] is None and typed[("t0", 3)] == "majallele"


def naive_edges(good, window, threshold):
    start = 0
    for i in range(len(good)):
        start = i
        w = good[i : i + window]
        if good[i] and sum(w) / len(w) > threshold:
            break
    back, end = good[::-1], 0
    for i in range(len(back)):
        end = i
        w = back[i : i + window]
        if back[i] and sum(w) / len(w) >= threshold:
            end = len(back) - i
            break
    return start, end


def test_block_edges():
    rng = random.Random(5)
    for _ in range(300):
        good = [rng.random() < rng.choice([0.1, 0.6, 0.9]) for _ in range(rng.randint(1, 40))]
        assert trim._edges(np.array(good), 5, 0.65) == naive_edges(good, 5, 0.65)


def test_trim(spark):
    rng = random.Random(6)
    core = "".join(rng.choice("ACGT") for _ in range(150))
    ragged = ["".join(rng.choice("ACGT") for _ in range(20)) + core + "".join(rng.choice("ACGT") for _ in range(20)) for _ in range(6)]
    ragged[0] = "-" * 30 + ragged[0][30:]
    a = aln(spark, good=ragged, short=["ACGT"] * 4, gappy=ragged[1:4] + ["-" * 190])
    out = {}
    for r in trim.trim_alignments(a).orderBy("locus", "row_ord").collect():
        out.setdefault(r.locus, []).append(r.seq)
    assert set(out) == {"good"}
    assert len({len(s) for s in out["good"]}) == 1 and 150 <= len(out["good"][0]) <= 160
    assert out["good"][0].startswith("?") and core[40:140] in out["good"][1]
    with pytest.raises(ValueError):
        trim.TrimOptions(window=0)


def test_filters(spark):
    a = aln(spark, x=["AC", "--", "??"], y=["?-", "AN", "CX"], z=["", "A", "A"])
    loci = lambda df: {r.locus for r in df.collect()}
    assert loci(alignments.filter_alignments(a, ["t1", "t2"])) == {"y", "z"}  # any of them
    assert loci(alignments.filter_alignments(a, min_taxa=2)) == {"y", "z"}
    assert loci(alignments.filter_alignments(a, min_length=2)) == {"x", "y"}
    assert alignments.remove_empty_taxa(a).count() == 6  # a mix of gaps and ? stays
    assert loci(alignments.screen_problems(a)) == {"x", "z"}
    assert loci(alignments.screen_problems(a, screen_x=False)) == {"x", "z"} and loci(alignments.screen_problems(a, False, False)) == {"x", "y", "z"}
    with pytest.raises(ValueError):
        alignments.extract_taxa(a)
    assert {r.problem for r in alignments.violations(a.withColumn("taxon", a["locus"])).collect()} >= {"repeated taxon x", "unequal lengths"}


def test_concatenation(spark):
    a = spark.createDataFrame([("b", 0, "z", "GG"), ("a", 0, "z", "AAAA"), ("a", 1, "y", "CCCC"), ("b", 1, "x", "TT")], "locus string, row_ord int, taxon string, seq string")
    rows = {r.taxon: (r.ord, r.seq) for r in concat.concat_matrix(a).collect()}
    assert rows == {"z": (0, "AAAAGG"), "y": (1, "CCCC??"), "x": (2, "????TT")}
    lines = [r.line for r in concat.charset_text(concat.charsets(a)).orderBy("ord").collect()]
    assert lines == ["begin sets;", "charset 'a' = 1-4;", "charset 'b' = 5-6;", "charpartition combined = a:a, b:b;\nend;"]
    back = concat.split_concat(concat.concat_matrix(a), concat.charsets(a))
    assert {(r.locus, r.taxon, r.seq) for r in back.collect()} == {("a", "z", "AAAA"), ("a", "y", "CCCC"), ("b", "z", "GG"), ("b", "x", "TT")}
    assert [r.line for r in concat.phylip_text(concat.concat_matrix(a)).orderBy("ord").collect()] == ["3 6", "z AAAAGG", "y CCCC??", "x ????TT"]
    slices = concat.partition_slices(concat.concat_matrix(a), [("p", [(1, 2), (5, 6)])])
    assert {(r.taxon, r.seq) for r in slices.collect()} == {("z", "AAGG"), ("y", "CC??"), ("x", "??TT")}
    assert {r.line for r in concat.paml_text(slices).collect()} == {"3 4", "x  ??TT", "y  CC??", "z  AAGG"}
    assert concat.sample_concat(a, 1, 2, seed=1).count() == 6
    padded = alignments.missing_data_rows(a, ["z", "q", "r"], min_taxa=2).where("locus = 'a'").orderBy("row_ord").collect()
    assert [(r.taxon, r.seq) for r in padded] == [("z", "AAAA"), ("y", "CCCC"), ("q", "????"), ("r", "????")]
