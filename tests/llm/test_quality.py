import re
import zlib

import numpy as np

from locusframe.llm import quality as Q

from conftest_llm import prose


def test_flat_trees_are_their_rules(rng):
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = Q.fit(x, y, rounds=40)
    p = trees.score(x)
    assert ((p >= 0.5) == y).mean() > 0.97

    def walk(root, row):
        at = root
        for _ in range(trees.depth):
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]

    for k in range(0, 800, 97):
        total = trees.prior + sum(walk(t, x[k]) for t in trees.roots)
        assert abs(p[k] - 1 / (1 + np.exp(-total))) < 1e-12
    assert len(Q.fit(x, np.ones(800)).roots) == 0 and Q.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark, documents, rng):
    good = [prose(rng, rng.randint(20, 200)) + "." for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 60).split()) if k % 2 else (prose(rng, 3).upper() + "!! ") * 40 for k in range(120)]
    texts = good + bad
    docs = documents([(k, t, "en", "src", len(t)) for k, t in enumerate(texts)] + [(10_000, ""), (10_001, None), (None, "x"), (0, texts[0])])
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(420)] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    trees = Q.train(docs, labels, most=300)
    rows = Q.score(docs, trees).withColumn("held_out", Q.held_out()).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [(r.predicted, int(r.doc_id < 300)) for r in rows if r.doc_id is not None and r.doc_id < 420 and r.held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    same = [r.score for r in rows if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]
    kept = Q.score(docs, trees, keep=docs.columns)
    assert kept.where("score is not null").count() == docs.count()


def test_no_labels(spark, documents):
    docs = documents([(1, "a b")])
    trees = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in Q.score(docs, trees).collect()] == [0.5]
    assert Q.score(documents([]), trees).count() == 0


def plain_fit(x, y, rounds, depth, rate=0.1, bins=64, l2=1.0, least_leaf=5):
    """The same boosting over values instead of bins, one split tried at a time; the sum of the trees for each row."""
    n, p = x.shape
    prior = np.log((y.sum() + 1) / (n + 2) / (1 - (y.sum() + 1) / (n + 2)))
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))) for f in range(p)]
    total = np.full(n, prior)

    def grow(rows, g, h, d):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if d < depth and len(rows) >= 2 * least_leaf:
            for f in range(p):
                for e in edges[f]:
                    left = x[rows, f] <= e
                    if min(left.sum(), (~left).sum()) < least_leaf:
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, e)
        if best[1] is None:
            out[rows] = -rate * gs / (hs + l2)
            return
        left = x[rows, best[1]] <= best[2]
        grow(rows[left], g, h, d + 1)
        grow(rows[~left], g, h, d + 1)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        out = np.zeros(n)
        grow(np.arange(n), q - y, q * (1 - q), 0)
        total = total + out
    return 1 / (1 + np.exp(-total))


def test_fit_against_a_plain_version():
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 3))
    x[:, 2] = np.round(x[:, 2], 1)  # ties
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=150) * 0.3) > 0).astype(float)
    got = Q.fit(x, y, rounds=6, depth=3, bins=16).score(x)
    assert np.allclose(got, plain_fit(x, y, 6, 3, bins=16), atol=1e-9)


def plain_statistics(text):
    """The statistics of one text from their meaning, by name."""
    raw = (text or "").encode()
    if not raw:
        return dict.fromkeys(Q.STATISTICS, 0.0)
    n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x]
    out = {name: sum(b in set(chars) for b in raw) / n for name, chars in Q._CLASSES.items()}
    per = lambda k, of: k / len(of) if of else 0.0
    out |= {"log_bytes": np.log(n + 1), "log_words": np.log(len(words) + 1), "log_lines": np.log(len(lines) + 1), "line_bytes": np.log(n / max(1, len(lines)) + 1)}
    out |= {"word_bytes": per(sum(map(len, words)), words), "distinct_words": per(len(set(words)), words), "distinct_lines": per(len(set(lines)), lines)}
    out["top_word"] = per(max((words.count(w) for w in set(words)), default=0), words)
    out["upper_words"] = per(sum(bool(re.search(rb"[A-Z]", w)) and not re.search(rb"[a-z]", w) for w in words), words)
    out["long_words"] = per(sum(len(w) > 20 for w in words), words)
    out["one_byte_words"] = per(sum(len(w) == 1 for w in words), words)
    out["symbol_ends"] = per(sum(bool(re.search(rb"[!$%&*#@^~]\Z", w)) for w in words), words)
    out["squeezed"] = len(zlib.compress(raw, 1)) / n
    out["repeated_marks"] = sum(a == b and 0x20 < a < 0x30 for a, b in zip(raw, raw[1:])) / n
    return out


def test_statistics_against_a_plain_version(rng):
    texts = ["", None, " ", "\n\n", "A", "WORD word $$ !! ..", "日本語 text é", "x" * 5000, "a b\nc\n\na b"]
    texts += ["".join(rng.choice("aB1 \n\t.,!?$%&*#'()/-@é\x01") for _ in range(rng.randint(1, 6000))) for _ in range(30)]
    got = Q.statistics(texts)
    for t, row in zip(texts, got):
        plain = plain_statistics(t)
        assert set(plain) == set(Q.STATISTICS)
        assert np.allclose(row, [plain[name] for name in Q.STATISTICS], atol=1e-12), (t, [(a, b, plain[a]) for a, b in zip(Q.STATISTICS, row) if abs(b - plain[a]) > 1e-12])
