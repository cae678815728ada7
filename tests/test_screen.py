import os

import pytest

from locusframe import plans
from locusframe.plans.proxies import Proxy

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")


def test_all_rows_are_screened_and_returned(spark):
    rows = [tuple(r) for r in Proxy(spark, SF).screen_aln.collect()]
    bad = {locus for locus, _, _, seq in rows if set(seq) & set("NnXx")}
    early = {locus for locus, k, _, seq in rows if k < 2 and set(seq) & set("NnXx")}
    assert bad - early and {r[0] for r in rows} - bad  # some loci fail by later rows only, some pass
    got = [tuple(r) for r in plans.queries()["screen_nx"](spark, SF).select("locus", "row_ord", "taxon", "seq").collect()]
    assert sorted(got) == sorted(r for r in rows if r[0] not in bad)
