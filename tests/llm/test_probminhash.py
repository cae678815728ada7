import collections

import numpy as np

from locusframe.llm import probminhash as M

from conftest_llm import prose


def weights(text):
    w = text.split()
    shingles = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    return {s: 1 + np.log(n) for s, n in collections.Counter(shingles).items()}


def exact(a, b):
    x, y = weights(a), weights(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def near(rng, text, share):
    w = text.split()
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = prose(rng, 1)
    return " ".join(w)


def test_exact_similarity(rng):
    for _ in range(40):
        a = prose(rng, rng.randint(1, 60)) + " same line here now again" * rng.randint(0, 4)
        b = near(rng, a, 0.1)
        assert abs(M.probability_jaccard(a, b) - exact(a, b)) < 1e-9
    assert M.probability_jaccard("", "a") == 0 and M.probability_jaccard("a b", "a b") == 1


def test_signatures_estimate_it(rng):
    errors = []
    for _ in range(30):
        a = prose(rng, 200)
        b = near(rng, a, rng.choice([0.01, 0.05]))
        text, shingle, count = M.weighted_shingles([a, b])
        s = M.signatures(2, text, shingle, count, 600)
        errors.append((s[0] == s[1]).mean() - exact(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.1
    # a document's signature does not depend on its company
    text, shingle, count = M.weighted_shingles([a, b, "x", None, ""])
    assert (M.signatures(5, text, shingle, count, 600)[:2] == s).all()


def _classes(rows):
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if a and b and exact(a, b) >= 0.8 - 1e-9:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[find(t or "")].append(i)
    return {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}, find


def test_classes(spark, documents, rng):
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    texts = base + [near(rng, t, 0.02) for t in base for _ in range(2)]
    hot = prose(rng, 90)  # a chain of ever farther near copies, and many copies
    chain = [hot]
    for _ in range(30):
        chain.append(near(rng, chain[-1], 0.015))
    texts += chain + [near(rng, hot, 0.03) for _ in range(40)] + [hot] * 20
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "two words"), (9003, "two words"), (None, base[0]), (0, base[1]), (None, "only null")]
    rng.shuffle(rows)
    got = M.near_duplicates(documents(rows)).collect()
    classes, find = _classes(rows)
    expected = sorted(((i, classes[find(t or "")]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == expected
    kept = M.deduplicate(documents(rows)).collect()
    assert len(kept) == len(classes)
    assert M.near_duplicates(documents([])).count() == 0


def test_large_bands_lose_no_link(monkeypatch, documents, rng):
    monkeypatch.setattr(M, "SMALL_BAND", 4)
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "MOST_EDGES", 0)
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    hot = prose(rng, 60)
    rows = [(k, near(rng, hot, rng.choice([0.01, 0.04, 0.06]))) for k in range(90)]
    classes, find = _classes(rows)
    got = M.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((i, classes[find(t)]) for i, t in rows)


def counted(a, b):
    """The similarity by counts, from its definition."""
    x, y = ({s: round(float(np.exp(v - 1))) for s, v in weights(t).items()} for t in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def test_counts_are_the_weights(documents, rng):
    line, rows = prose(rng, 8), []
    for k in range(6):  # a line 30 times and 80 words, of which 20 side by side differ
        words = prose(rng, 80).split()
        other = [*words[:40], *prose(rng, 20).split(), *words[60:]]
        rows += [(2 * k, " ".join([f"{line} {k}"] * 30 + words)), (2 * k + 1, " ".join([f"{line} {k}"] * 30 + other))]
    rows += [(100 + k, f"{line} x " * 5 + prose(rng, 60)) for k in range(40)]  # the same line, but unlike texts
    for (_, a), (_, b) in zip(rows[:12:2], rows[1:12:2]):
        assert abs(M.probability_jaccard(a, b, weight=np.asarray) - counted(a, b)) < 1e-9
        assert counted(a, b) >= 0.82 and exact(a, b) < 0.79
    got = {r.doc_id: r.class_id for r in M.near_duplicates(documents(rows)).collect()}
    assert got == {k: k - k % 2 if k < 12 else k for k, _ in rows}


def test_sql_weighs_by_counts(spark, tmp_path, rng):
    import duckdb

    from locusframe.llm import queries as Q

    rows = []
    for k in range(8):  # a repeated line and 80 words, of which some side by side differ: 0.8 is passed by counts only, or never
        words = prose(rng, 80).split()
        cut = 40 + 5 * k
        rows += [(2 * k, " ".join([f"same line again {k}"] * 30 + words)), (2 * k + 1, " ".join([f"same line again {k}"] * 30 + words[:40] + prose(rng, cut - 40).split() + words[cut:]))]
    rows += [(100, ""), (101, None), (102, "one two"), (103, "one  two"), (104, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = Q.oracle_sql()["op1_probminhash"]
    got = sorted((r.doc_id, r.class_id, r.class_text) for r in Q.op1_probminhash(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(sql).fetchall())
    damped = sql.replace("CAST(count(*) AS DOUBLE) AS v", "1 + ln(count(*)) AS v")
    assert damped != sql and got != sorted(con.execute(damped).fetchall())
