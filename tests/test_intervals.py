import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals, probes


def test_clusters(spark):
    p = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 5000, 5100), (3, "c", 90_000, 90_100), (3, "c", 90_050, 90_150), (4, "d", 0, 10)], "locus long, chromo string, start long, end long")
    rows = {tuple(r.loci) for r in intervals.proximity_clusters(p).collect()}
    assert rows == {(1, 2), (3,)}  # positions count before loci do
    assert {r.locus for r in intervals.screened_loci(p).collect()} == {1, 3, 4}


def test_fold():
    rows = [(0, 10, "a"), (20, 30, "a"), (5, 25, "b"), (10, 20, "c"), (9000, 9001, "d"), (0, 10_000, "e")]
    assert intervals.fold_intervals(rows) == [(0, 10, ["a", "b", "e"]), (20, 30, ["a", "b", "e"]), (10, 20, ["c", "e"]), (9000, 9001, ["d", "e"])]


def test_slices(spark):
    def hit(locus, contig, s, e, strand="+"):
        return (contig, s, e, f"uce-{locus}_p1", "+", strand)

    rows = [hit(1, "c", 10, 20), hit(2, "c", 3, 9), hit(2, "d", 3, 9), hit(3, "c", 1, 2), hit(3, "c", 1, 2, "-"), hit(4, "c", 0, 5), hit(4, "c", 600, 610), hit(5, "c", 12, 30, "-"), hit(5, "c", 10, 35, "-")]
    h = spark.createDataFrame(rows, "name1 string, zstart1 long, end1 long, name2 string, strand1 string, strand2 string")
    plan = {r.uce: r for r in intervals.slice_plan(h).collect()}
    assert {u: r.dropped for u, r in plan.items()} == {"uce-1": None, "uce-2": "duplicate", "uce-3": "orientation", "uce-4": "length", "uce-5": None}
    assert (plan["uce-5"]["min"], plan["uce-5"]["max"]) == (10, 30)  # the end of the last hit by start
    contigs = spark.createDataFrame([("c", "NNAAACCCCCGGGGGTTTTTacgtACGTACGTACGTACGT")], "contig string, sequence string")
    lengths = contigs.select("contig", F.length("sequence").alias("contig_length"))
    flank = {r.uce: r for r in intervals.slice_sequences(intervals.slice_bounds(intervals.slice_plan(h), lengths, flank=5), contigs).collect()}
    assert flank["uce-1"].header == "Node_0_length_20_cov_1000|contig:c|slice:5-25|uce:uce-1|match:10-20|orient:+|probes:1"
    width = {r.uce: r for r in intervals.slice_sequences(intervals.slice_bounds(intervals.slice_plan(h), lengths, width=31), contigs, width=31).collect()}
    assert set(width) == {"uce-1", "uce-5"}
    assert "slice:0-31" in width["uce-1"].header and "orient:revcomp" in width["uce-5"].header


def test_beds(spark):
    rows = [("c", 1, 5, "uce-1_p1 |x", 95.0, 80.0), ("c", 2, 9, "uce-1_p2 |x", 95.0, 95.0), ("c", 2000, 2009, "uce-1_p3 |x", 95.0, 95.0)]
    h = spark.createDataFrame(rows, "name1 string, zstart1 long, end1 long, name2 string, percent_identity double, percent_continuity double")
    assert intervals.bed_from_hits(h).count() == 2
    assert intervals.bed_from_hits(h, names=spark.createDataFrame([], "name string")).count() == 0
    (row,) = intervals.locus_bed(h).collect()
    assert (row.start, row["end"], row.hits, row.wide) == (1, 2009, 3, True)
    assert [(r.start, r["end"]) for r in intervals.widen(spark.createDataFrame([("c", 10, 20), ("c", 0, 99)], "chromo string, start long, end long"), 15).collect()] == [(7, 23), (0, 99)]
    assert list(intervals.pack_units([("a", 6), ("b", 5), ("c", 1)], 10)) == [["a", "b"], ["c"]]


def test_tiles(spark):
    loci = spark.createDataFrame([(1, "chr1", 100, "ACGT" * 50)], "locus long, chromo string, chromo_start long, sequence string")
    t = probes.Tiling(length=40, density=2.0)
    got = [(r.k, r.start, r["end"]) for r in probes.tiles(loci, t).collect()]
    assert got == [(k + 1, 10 + 20 * k, 50 + 20 * k) for k in range(8)]
    made = probes.tiled_probes(loci, t).orderBy("k").collect()
    assert made[0].id == "uce-1_p1" and made[0].header.startswith("uce-1_p1 |design:design,designer:designer,probes-locus:1,probes-probe:1,probes-global-chromo:chr1,probes-global-start:110")
    two = probes.tiles(loci, probes.Tiling(length=40, two_probes=True)).collect()
    assert [r.start for r in two] == [70, 90]
    with pytest.raises(ValueError):
        probes.Tiling(length=0)
    with pytest.raises(ValueError):
        probes.Tiling(density=121)


def fragment(name, start, seq, offset=1000):
    meta = f"design:d,designer:x,probes-locus:uce-1,probes-source:t,probes-global-chromo:c,probes-global-start:{start + offset},probes-global-end:{start + offset + len(seq)},probes-local-start:{start},probes-local-end:{start + len(seq)}"
    return (name, f"{name} |{meta}", seq)


def test_full_probes(spark):
    full = "A" * 40 + "C" * 80 + "G" * 40
    frame = lambda rows: spark.createDataFrame(rows, "id string, header string, sequence string")
    (row,) = probes.full_probes(frame([fragment("p1", 10, full[:120]), fragment("p2", 50, full[40:]), fragment("p3", 500, "T" * 120)])).collect()
    assert (row.local_start, row.local_end, row.global_start, row.sequence) == (10, 170, 1010, full)
    # a conflict drops the longest island for the next one
    (row,) = probes.full_probes(frame([fragment("p1", 0, "A" * 30), fragment("p2", 20, "C" * 30), fragment("p3", 500, "T" * 20)])).collect()
    assert row.sequence == "T" * 20
    for bad in ([fragment("p1", 0, "A" * 30), fragment("p2", 20, "C" * 30)], [fragment("p1", 0, "A" * 30), fragment("p2", 20, "A" * 30, 999)], [fragment("p1", 0, "AN")]):
        with pytest.raises(Exception, match="conflicting|bad coordinates"):
            probes.full_probes(frame(bad)).collect()


def test_overlaps_meet_as_distinct_intervals(spark, monkeypatch):
    rows = [("c", 5 * (k % 4), 5 * (k % 4) + 7, None if k % 9 == 0 else f"n{k % 13}") for k in range(60)] + [("d", 0, 30, "x"), ("c", 4, 4, "empty"), (None, 0, 9, "y"), ("c", None, 9, "z")]
    a = spark.createDataFrame(rows, "chromo string, start long, end long, name string")
    b = a.where("name is null or name <> 'n3'")
    real = [r for r in rows if None not in r[:3] and r[1] < r[2]]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((c, s, e, n, s2, e2, n2) for c, s, e, n in real for c2, s2, e2, n2 in real if n2 != "n3" and c == c2 and s < e2 and s2 < e), key=key)
    assert intervals.gathered(a.where("start < end and chromo is not null")).count() == 5  # not a row a name
    for most in (4096, 2):
        monkeypatch.setattr(intervals, "NAMES", most)
        for size in (3, 10, 10_000):
            assert sorted((tuple(r) for r in intervals.overlaps(a, b, size).collect()), key=key) == want
    assert intervals.gathered(a.where("start < end")).selectExpr("max(size(names))").first()[0] == 2


def test_overlaps_hold_the_pairs_of_one_name_at_a_time(spark):
    rows = [("c", 0, 9, f"n{k}") for k in range(40)] + [("c", 5, 12, None), ("c", 20, 30, "far")]
    a = spark.createDataFrame(rows, "chromo string, start long, end long, name string")
    found = intervals.overlaps(a, a, 10)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (join,) = [k for k, x in enumerate(lines) if "Join Inner" in x]
    # what one row of the join's left side gives stays in memory until its last pair, so only one list may be expanded above it
    assert [x for x in lines[:join] if "Generate explode" in x and "a_name" in x.split("explode(")[1].split(")")[0]] == []
    assert len([x for x in lines[:join] if "Generate explode" in x]) == 1
    assert found.count() == 41 * 41 + 1
