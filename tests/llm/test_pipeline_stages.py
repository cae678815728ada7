"""The pipeline's stages, each against a plain version of itself on the rows that the stage was given."""

import hashlib
import math
import re

import numpy as np
import pytest

from locusframe.llm import mixing, quality

from conftest_llm import prose

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, position int, score string, predicted int, class_id string, node string, key string, `a.b` string, words string"


def rows_of(rng):
    """Clean and bad texts, exact and near copies, shared passages, repeated rows, nulls, empties and one long text."""
    good = [prose(rng, rng.randint(60, 150)) + "." for _ in range(70)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(40)]
    rows = [(k, t, "en", [None, "a", "b", "\U0001f600", "hot", "hot"][k % 6], len(t)) for k, t in enumerate(good + bad)]
    passage = prose(rng, 60)
    for k in range(12):
        words = good[k].split()
        words[10 + k] = "changed"
        rows.append((200 + k, " ".join(words), "en", "a", 7))
    rows += [(300 + k, f"{prose(rng, 60 + k)} {passage} {prose(rng, 60)}", "de", "b", 0) for k in range(8)]
    rows += [(400, good[3], "en", "b", 1), (3, good[3], "en", None, 2), (401, prose(rng, 4000), "en", "hot", 9)]
    rows += [(500, "", "en", "a", 0), (501, None, None, None, None), (None, prose(rng, 90), "en", "a", 1), (502, " \n ", "en", "b", 3)]
    return [(*r, "own", 5, "own", 0, *["own"] * 5) for r in rows]


def judged(docs, trees):
    """Rows whose trees, walked one by one, give a score of 0.3 or more."""

    def value(root, x):
        at = root
        for _ in range(trees.depth):
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]

    out = []
    for r in docs:
        x = quality.statistics([r.text])[0]
        total = trees.prior + sum(value(t, x) for t in trees.roots)
        if 1 / (1 + math.exp(-total)) >= 0.3:
            out.append(tuple(r))
    return out


def shingles(text):
    w = (text or "").split()
    out = {}
    for k in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[k : k + 5])
        out[s] = out.get(s, 0) + 1
    return out


def alike(x, y):
    both = set(x) & set(y)
    if sum(x[d] for d in both) < 0.8 * sum(x.values()):
        return False
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in both) >= 0.8 - 1e-9


def first_of_classes(docs):
    """The smallest identifier (null last) of each class of texts linked by a similarity of 0.8."""
    texts = sorted({r.text or "" for r in docs})
    weights, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if weights[a] and weights[b] and alike(weights[a], weights[b]):
                parent[find(a)] = find(b)
    least = {}
    for r in docs:
        root = find(texts.index(r.text or ""))
        at = (r.doc_id is None, r.doc_id or 0)
        least[root] = min(least.get(root, at), at)
    return sorted(least.values())


def without_repeats(docs):
    """Texts without bytes of a 50-byte string that starts in a document of a smaller identifier (null last)."""
    seen, out = set(), {}
    for r in sorted(docs, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        raw = (r.text or "").encode()
        gone = np.zeros(len(raw), bool)
        strings = [raw[p : p + 50] for p in range(len(raw) - 49)]
        for p, s in enumerate(strings):
            if s in seen:
                gone[p : p + 50] = True
        seen |= set(strings)
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if kept:
            out[r.doc_id] = kept
    return out


def mixed(docs):
    """For each source in code point order, null last, the (identifier, first words) of its copies."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    names = sorted({r.source for r in docs if r.source is not None}) + ([None] if any(r.source is None for r in docs) else [])
    sizes = [sum(len(words(r.text)) for r in docs if r.source == s) for s in names]
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))]
    targets, left, open_ = [0.0] * len(names), 1.5 * sum(sizes), set(range(len(names)))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit > 2 * sizes[k]}
        for k in full or open_:
            targets[k] = 2.0 * sizes[k] if full else weights[k] * unit
            left -= targets[k]
        open_ -= full or set(open_)
    out = []
    for s, size, target in zip(names, sizes, targets):
        own = sorted((r for r in docs if r.source == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest())
        whole, at = math.floor(target + mixing.ROUNDING), 0
        for _ in range(2):
            for r in own:
                if at < whole:
                    out.append((r.doc_id, tuple(words(r.text)[: whole - at])))
                at += len(words(r.text))
    return out


def test_stages_against_plain_versions(spark, tmp_path, rng):
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    folder = str(tmp_path)
    spark.createDataFrame(rows_of(rng), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 70), 0) for k in range(110)] + [(500, 1, 0), (501, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, stages = docs.collect(), dict(P.STAGES)

    def step(name):
        nonlocal docs
        before = docs
        out = stages[name](spark, docs, folder)
        assert out.dtypes == before.dtypes
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        return docs.collect()

    trees = quality.train(docs, labels)
    kept = step("quality")
    assert key(kept) == key(judged(given, trees)) and 0 < len(kept) < len(given)

    apart = step("near_dedup")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in apart) == first_of_classes(kept) and len(apart) < len(kept)
    assert set(map(str, apart)) <= set(map(str, kept))

    cut = step("passage_dedup")
    assert {r.doc_id: r.text for r in cut} == without_repeats(apart) and all(r.n_chars == len(r.text) for r in cut)
    texts = {r.doc_id: r.text for r in apart}
    assert any(r.text != texts[r.doc_id] for r in cut)

    taken = step("mixing")
    assert sorted(map(str, ((r.doc_id, tuple(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in taken))) == sorted(map(str, mixed(cut)))
    assert all(r.n_chars == len(r.text) and tuple(r)[5:] == ("own", 5, "own", 0, *["own"] * 5) for r in taken)

    tokens = stages["tokens"](spark, docs, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expected = []
    for r in taken:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, r.source, len(ids), ids))
    assert key((r.doc_id, r.source, r.n_tokens, list(r.token_ids)) for r in tokens) == key(expected)
    whole = P.run(spark, folder).collect()
    assert key(whole) == key(tokens)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
