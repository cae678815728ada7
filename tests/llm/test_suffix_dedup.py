import hashlib

import numpy as np
import pytest

from locusframe.llm import suffix_dedup as S
from locusframe.llm.common import pack40, unpack40

from conftest_llm import prose


@pytest.mark.parametrize("alphabet", [b"ab", b"abcd", bytes(range(1, 256))])
@pytest.mark.parametrize("block", [16, 1 << 19])
def test_suffix_order(rng, alphabet, block):
    base = bytes(rng.choice(alphabet) for _ in range(200))
    texts = [base[a : a + rng.randint(20, 90)] for a in (rng.randint(0, 100) for _ in range(30))] + [bytes(rng.choice(alphabet) for _ in range(60)) for _ in range(10)]
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 8) - (sizes + 8)
    data = np.frombuffer(b"".join(t + b"\0" * 8 for t in texts) + b"\0" * 8, np.uint8)
    words = S._words(data)
    text = np.repeat(np.arange(len(texts)), sizes + 8)
    ends = np.zeros(len(words), np.int64)
    ends[: len(text)] = (begins + sizes)[text]
    wanted = np.concatenate([b + np.arange(n - 7) for b, n in zip(begins, sizes)])
    order = np.concatenate(list(S.suffix_blocks(words, ends, wanted, block=block)))
    suffixes = [data[p : ends[p]].tobytes() for p in order]
    assert suffixes == sorted(suffixes) and sorted(order) == sorted(wanted)


def test_ranks_are_doubled_among_equals_only(rng, monkeypatch):
    texts = [bytes(rng.randrange(1, 256) for _ in range(60)) for _ in range(200)]
    texts += [texts[0], texts[0][:41], texts[7][20:]]
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 8) - (sizes + 8)
    data = np.frombuffer(b"".join(t + b"\0" * 8 for t in texts) + b"\0" * 8, np.uint8)
    words = S._words(data)
    ends = np.zeros(len(words), np.int64)
    ends[: len(data) - 8] = np.repeat(begins + sizes, sizes + 8)
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorts.append(len(x)) or plain(x, *a, **k))
    rank = S.sample_ranks(words, ends, S.PERIOD, S.COVER)
    sample = np.flatnonzero(rank)
    assert list(sample) == [p for p in range(len(words)) if p % S.PERIOD in S.COVER and p < ends[p]]
    suffixes = [data[p : ends[p]].tobytes() for p in sample]
    place = {x: k for k, x in reversed(list(enumerate(sorted(suffixes))))}
    assert [place[x] + 1 for x in suffixes] == list(rank[sample])
    assert sorts[0] == len(sample) and sum(sorts[1:]) < len(sample) / 4


def test_cover_is_a_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_minimisers_cover_every_start(rng):
    raws = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 9000)]
    number, start, count, hashes = S.minimisers(raws)
    for k, raw in enumerate(raws):
        mine = sorted(zip(start[number == k], count[number == k]))
        covered = [s + j for s, c in mine for j in range(c)]
        assert covered == list(range(max(0, len(raw) - 49)))
    # equal strings have equal minimisers wherever they stand
    a, b = b"x" * 13 + raws[4], raws[4] + b"yz"
    n, s, c, h = S.minimisers([a, b])
    of = lambda k: {int(p) + j: int(v) for m, p, q, v in zip(n, s, c, h) if m == k for j in range(q)}
    first, second = of(0), of(1)
    assert all(first[p + 13] == second[p] for p in range(len(raws[4]) - 49))


def test_minimisers_across_pieces(rng, monkeypatch):
    raws = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (600, 49, 2000, 50, 511, 512, 513)]
    whole, of = S.minimisers(raws), lambda n, s, c, h: {(int(k), int(p) + j): int(v) for k, p, q, v in zip(n, s, c, h) for j in range(q)}
    monkeypatch.setattr(S, "_PIECE", 512)
    cut = S.minimisers(raws)
    assert of(*whole) == of(*cut) and int(cut[2].sum()) == sum(max(0, len(r) - 49) for r in raws)


def brute(rows):
    order = sorted({r[0] if r[0] is not None else S._NULL_ID for r in rows})
    seen: set[bytes] = set()
    out = {}
    for i in order:
        mine = [(k, r) for k, r in enumerate(rows) if (r[0] if r[0] is not None else S._NULL_ID) == i]
        new = set()
        for k, (_, t) in mine:
            raw = (t or "").encode()
            mask = np.zeros(len(raw), bool)
            for p in range(len(raw) - 49):
                if raw[p : p + 50] in seen:
                    mask[p : p + 50] = True
                new.add(raw[p : p + 50])
            kept = bytes(b for b, m in zip(raw, mask) if not m)
            spans = int((np.diff(np.concatenate(([0], mask.view(np.int8), [0]))) == 1).sum())
            out[k] = (rows[k][0], len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
        seen |= new
    return [out[k] for k in range(len(rows))]


def test_whole_tables(spark, documents, rng):
    passage, line = prose(rng, 40), "All rights reserved by nobody in particular, ever since.\n"
    rows = [(k * 2, prose(rng, rng.randint(1, 80))) for k in range(60)]
    rows += [(200 + k, prose(rng, 10) + " " + passage + " " + prose(rng, 10)) for k in range(30)]
    rows += [(300 + k, line * (k % 5) + prose(rng, 15) + line) for k in range(20)]
    rows += [(400 + k, rows[k][1]) for k in range(10)] + [(500, "é日ñ" * 60), (501, "x" + "é日ñ" * 60), (600, ""), (601, None), (602, "z" * 4000), (603, "z" * 300)]
    for extra in ([], [(None, passage), (0, rows[0][1]), (2, "other " + passage), (None, passage + "!")]):
        table = rows + extra
        rng.shuffle(table)
        got = S.span_digests(documents(table)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute(table), key=str)
        # the order of the suffixes alone gives the same, when equal blocks are not put together before
        assert sorted(map(tuple, S.span_digests(documents(table), compress=False).collect()), key=str) == sorted(brute(table), key=str)
        cut = S.remove_repeats(documents(table))
        assert cut.columns == documents([]).columns and cut.count() == len(table)
        assert cut.where("text is null").count() == 1
    lengths = {r.doc_id: len(r.text) for r in S.remove_repeats(documents(rows)).collect() if r.text is not None}
    assert lengths[401] == 0 or len(rows[1][1]) < 50
    assert S.span_digests(documents([])).count() == 0 and S.remove_repeats(documents([])).count() == 0


def test_buckets_are_even():
    """The smallest of many hashes are crowded at the low end; their buckets are not."""
    rng = np.random.default_rng(3)
    least = rng.integers(0, 1 << 63, (40_000, 25), dtype=np.uint64).min(1)
    sizes = np.bincount(S._bucket(least, 100), minlength=100)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()


def test_packing(rng):
    values = np.array([rng.randrange(1 << 40) for _ in range(50)], np.uint64)
    assert (unpack40(pack40(values)) == values).all()
    for ids in ([], [5], [-3, -3, 0, 1 << 62], list(range(300))):
        assert S.unpack_ascending(S.pack_ascending(np.array(ids, np.int64))).tolist() == ids
    assert S.unsqueeze(S.squeeze(b"")) == b"" and S.unsqueeze(S.squeeze(b"abc" * 99)) == b"abc" * 99
