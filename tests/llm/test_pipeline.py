import pytest

from conftest_llm import prose

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path, rng):
    import corpus_pipeline as P

    good = [prose(rng, rng.randint(60, 150)) + "." for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(60)]
    passage = prose(rng, 60)
    near = good[0].replace(good[0].split()[10], "changed", 1)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good + bad)]
    rows += [(1000, good[5], "en", "s0", 1), (1001, near, "en", "s1", 1), (1002, passage, "en", "s2", 1), (1003, prose(rng, 70) + " " + passage, "en", "s2", 1), (1004, "", "en", None, 0), (1005, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert not ids("quality") & set(range(120, 180)) and set(range(120)) <= ids("quality")
    assert {1000, 1001} & ids("near_dedup") == set() and set(range(120)) <= ids("near_dedup")
    texts = {r.doc_id: r for r in seen["passage_dedup"]}
    assert passage[:50] not in texts[1003].text and texts[1003].n_chars == len(texts[1003].text) and texts[1002].text == passage
    final = P.run(spark, str(tmp_path))
    assert final.count() == len(seen["mixing"]) and final.where("n_tokens <> size(token_ids)").count() == 0
