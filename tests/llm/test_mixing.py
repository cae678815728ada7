import math
import re

import pytest

from locusframe.llm import mixing as M

from conftest_llm import prose


def test_share_out():
    assert M.share_out([100, 100], [1, 1], 150, [200, 200]) == [75, 75]
    out = M.share_out([10, 100, 100], [5, 2, 1], 315, [20, 200, 200])
    assert out[0] == 20 and math.isclose(sum(out), 315) and math.isclose(out[1] - 2 * out[2] if out[1] < 200 else 0, 0, abs_tol=1e-9)


@pytest.mark.parametrize("knots", [(1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.0, 2.0), (1.0, 0.0, 0.0, 1.0)])
def test_positions_invert_the_integral(spark, knots):
    from pyspark.sql import functions as F

    m = len(knots) - 1

    def integral(t):
        steps = 4000
        total = 0.0
        for k in range(steps):
            u = (k + 0.5) / steps * t
            j = min(int(u * m), m - 1)
            total += (knots[j] + (knots[j + 1] - knots[j]) * (u * m - j)) * t / steps
        return total

    rows = spark.range(0, 21).select((F.col("id") / 20.0).alias("y")).select("y", M.position(F.col("y"), knots).alias("t")).collect()
    whole = integral(1.0)
    for r in rows:
        assert 0 <= r.t <= 1 + 1e-12 and abs(integral(r.t) / whole - r.y) < 2e-3


def test_assignment(spark, documents, rng):
    rows = [(k, prose(rng, rng.randint(1, 60)), "en", ["s1", "s2", "s10", None, "hot"][min(k % 9, 4)]) for k in range(600)]
    rows += [(1000, None, "en", "s1"), (1001, " \n\t ", "en", "s2"), (None, "a b c", "en", "s1"), (None, "a b c", "en", "s1"), (5, rows[5][1], "en", rows[5][3])]
    docs = documents(rows)
    got = M.assign(docs, keep=("doc_id", "text", "source")).collect()
    again = M.assign(docs.repartition(7), keep=("doc_id", "text", "source")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.text or "", r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    targets = dict(zip(names, M.share_out([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), [2 * sizes[s] for s in names])))
    for r in sorted(got, key=key):
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(r.words) and len(r.words) == len(r.positions)
    for s in names:  # only one copy of a source is taken in part
        assert sum(r.taken for r in got if r.source == s) == math.floor(targets[s] + M.ROUNDING)
        assert sum(n < r.size for r in got if r.source == s for n in r.words) <= 1
    stream = M.stream(M.assign(docs))
    assert stream.agg({"words": "sum"}).first()[0] == sum(r.taken for r in got)
    parts = [p for p in stream.rdd.glom().map(lambda rs: [r.position for r in rs]).collect() if p]
    flat = [x for p in parts for x in p]
    assert flat == sorted(flat) and len(flat) == sum(len(r.positions) for r in got)


def test_empty(documents):
    out = M.assign(documents([]), keep=("doc_id",))
    assert out.count() == 0 and out.columns[-6:] == ["size", "source_size", "target", "taken", "positions", "words"]


def test_sources_of_one_long_document(spark, documents):
    """Targets below half of a source's only document, and between one and two times it, are met by parts."""
    docs = documents([(1, "a " * 1000, "en", "s1"), (2, "b " * 5000, "en", "s2"), (3, "c " * 100, "en", "s3")])
    for r in M.assign(docs, weights=(1.0, 1.0, 1.0)).collect():
        assert r.taken == math.floor(r.target + M.ROUNDING)
    text = spark.createDataFrame([(" one  two\nthree four ", k) for k in range(5)], "text string, n int")
    from pyspark.sql import functions as F

    assert [r[0] for r in text.select(M.first_words("text", F.col("n"))).collect()] == ["", "one  ", "one  two\n", "one  two\nthree ", "one  two\nthree four "]
