import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import lz_fingerprint as L

from conftest_llm import prose


def brute(text: str) -> list[int]:
    seen, start, ends = set(), 0, []
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            ends.append(end)
            start = end
    return ends


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé 日", max_size=80), st.text(alphabet="ab ", max_size=80))
def test_parse_and_edit(text, following):
    assert L.parse(text) == brute(text)
    edited, values = L._Document(1, text, 16).edit(following, 16)
    n = len(text)
    assert edited == text[: n - n // 2] + following[: n // 2]
    assert (values == L.fingerprint(edited, brute(edited), 16)).all()


def test_likeness():
    a, b = np.array([1, 5, 9], np.uint32), np.array([5, 9, 10], np.uint32)
    assert L.likeness(a, b, 3) == 2 / 3 and L.likeness(a, a) == 1 and L.likeness(a[:0], a[:0]) == 1 and L.likeness(a[:0], a) == 0


def test_neighbours(spark, documents, rng):
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(60)]
    rows = [(k * 11 - 200, t) for k, t in enumerate(texts)] + [(5000, ""), (5001, None), (None, "no id"), (None, "a"), (-200, texts[0]), (7, "é日" * 4000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = L.compare_neighbours(documents(shuffled).repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    expected = []
    for k, (doc, _) in enumerate(order):
        t, f = texts[k], texts[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        prints = [L.fingerprint(x, brute(x)) for x in (t, edited, f)]
        expected.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), L.as_hex(prints[0]), L.as_hex(prints[1]), L.likeness(prints[0], prints[1]), L.likeness(prints[0], prints[2])))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_small_tables(documents):
    (row,) = L.compare_neighbours(documents([(3, "abcabc")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert L.compare_neighbours(documents([])).count() == 0
    assert L.compare_neighbours(documents([(None, None), (None, None)])).count() == 2
