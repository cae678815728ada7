"""Suffix-array dedup: repeated passages by difference-cover blockwise suffix sorting.

All suffixes that share their first ``LENGTH`` bytes must meet in one bucket, and no bucket may need the
whole corpus. A suffix's bucket is given by its minimiser: of the substrings of ``GRAM`` bytes inside its
first ``LENGTH`` bytes, the one with the smallest hash. Neighbouring suffixes mostly have the same one, so
they travel together as one short block of text.

1. Minimisers that only one document has can't stand for a repeat; the others are found first, by hashes
   pre-aggregated over many documents, and only their blocks travel on.
2. Equal blocks are sorted once, for their smallest identifier (``compress``; without it each is sorted on its own,
   and nothing else changes).
3. In a bucket the suffixes of all its blocks are sorted: ranks of a difference-cover sample (positions whose
   residue mod ``PERIOD`` is in the cover) come first, by prefix doubling over the sample alone; then one
   block of suffixes after the other is sorted by its first bytes, and ties by sample ranks: for any two
   positions some shift below ``PERIOD`` takes both into the sample, and the ranks there decide. Runs of
   neighbours with a common prefix of ``LENGTH`` bytes have a smallest identifier, and a start of a document
   with a larger one is a repeat.

Hot passages are pre-aggregated at both exchanges: many documents' rows give one entry for each distinct
hash or block, and those that are decided already go to any bucket, not to the hot one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pack40, parts_for, small_batches, unpack40, utf8

LENGTH = 50
GRAM = 26
#: A difference cover: every difference mod 7 is one of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Suffixes sorted at a time, and bytes of text whose entries are aggregated before they leave a task.
BLOCK, GATHER = 1 << 18, 12 << 20
#: MB of a plan's estimated size for each bucket, and for each task, which sorts one bucket after the other.
BUCKET_MB, TASK_MB = 4.0, 16.0
LEAST_BUCKETS = 64
#: Bytes that are hashed at a time, which fit a core's cache, and what no position's key is.
_PIECE, _NO_KEY = 1 << 16, (1 << 64) - 1
_NULL_ID = (1 << 63) - 1


# -- suffix sorting of one bucket ------------------------------------------------------------------------


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one little-endian number; seven positions at the end have none."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).copy()


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    return _eight(data).byteswap(True)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of its group's first, whether the group has others) of each of the sorted values."""
    new = np.ones(len(ordered) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
    first = np.flatnonzero(new[:-1])
    return np.repeat(first, np.diff(np.append(first, len(ordered)))), ~(new[:-1] & new[1:])


def sample_ranks(words: np.ndarray, ends: np.ndarray, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Ranks of the cover's suffixes (each up to its text's end) at their positions; 0 elsewhere.

    ``ends`` has the end of the text that each position lies in (0 for padding). Ranks of 8 bytes are doubled
    by shifts that are multiples of the period, which stay in the sample, until they cover the longest text.
    A rank is the number of suffixes before its equals, so that only those that still have equals are sorted
    again, among these.
    """
    sampled = np.zeros(len(words), bool)
    for residue in cover:
        sampled[residue::period] = True
    sample = np.flatnonzero(sampled & (ends > np.arange(len(words))))
    rank = np.zeros(len(words) + 1, np.int32)
    if not len(sample):
        return rank
    covered, longest = 8, int((ends[sample] - sample).max())
    keys = words[sample]
    order = np.argsort(keys)
    first, tied = _groups(keys[order])
    at = sample[order]
    rank[at] = first + 1
    at = at[tied]
    while covered < longest and len(at):
        shift = covered // period * period
        ahead = at + shift
        second = np.where(ahead < ends[at], rank[np.minimum(ahead, len(words))], 0)
        keys = rank[at].astype(np.int64) * (len(words) + 2) + second
        order = np.argsort(keys)
        at = at[order]
        first, tied = _groups(keys[order])
        rank[at] += (first - _groups(rank[at])[0]).astype(np.int32)
        at = at[tied]
        covered += shift
    return rank


def _shifts(period: int, cover: tuple[int, ...]) -> np.ndarray:
    """For each pair of residues, the smallest shift that takes both into the cover."""
    inside = np.isin(np.arange(period), cover)
    out = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            out[a, b] = next(d for d in range(period) if inside[(a + d) % period] and inside[(b + d) % period])
    return out


def suffix_blocks(words: np.ndarray, ends: np.ndarray, wanted: np.ndarray, period: int = PERIOD, cover: tuple[int, ...] = COVER, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The positions ``wanted`` in suffix order, one block at a time.

    A wanted suffix has ``period`` bytes at least. Blocks are ranges of the first eight bytes, so that only
    one block's keys are held beside the sample's ranks; equal suffixes stand in any order.
    """
    if not len(wanted):
        return
    rank = sample_ranks(words, ends, period, cover)
    shifts = _shifts(period, cover)
    first = words[wanted]
    parts = -(-len(wanted) // block)
    splitters = np.unique(np.partition(first, [len(first) * k // parts for k in range(1, parts)])[[len(first) * k // parts for k in range(1, parts)]]) if parts > 1 else np.zeros(0, np.uint64)
    which = np.searchsorted(splitters, first, side="right")
    for part in range(len(splitters) + 1):
        at = wanted[which == part] if parts > 1 else wanted
        if not len(at):
            continue
        head = words[at] >> np.uint64(8 * (8 - min(period, 8)))
        order = np.argsort(head)
        at, head = at[order], head[order]
        new = np.ones(len(at), bool)
        new[1:] = head[1:] != head[:-1]
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        less = np.zeros(len(at), np.int64)
        tied = np.flatnonzero(~alone)
        if len(tied):
            top = np.int64(len(words) + 2)
            residue = at[tied] % period
            members = [tied[residue == r] for r in range(period)]
            places = [at[m] for m in members]
            groups = [group[m] * top for m in members]
            for a in range(period):  # count the members of residue a that come before each tied suffix
                if not len(members[a]):
                    continue
                order = np.argsort(groups[a] + rank[places[a] + shifts[a, a]])
                members[a], places[a], groups[a] = members[a][order], places[a][order], groups[a][order]
                for d in np.unique(shifts[a]):
                    keys = groups[a] + rank[places[a] + d]
                    for b in np.flatnonzero(shifts[a] == d):
                        less[members[b]] += np.searchsorted(keys, groups[b] + rank[places[b] + d], side="left")
            at[tied] = at[tied[np.argsort(group[tied] * top + less[tied])]]  # a group's places stay its own
        yield at


def same_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b have the first ``length`` bytes in common (both are that long)."""
    out = words[a] == words[b]
    for o in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        still = np.flatnonzero(out)
        out[still] = words[a[still] + o] == words[b[still] + o]
    return out


def least_owners(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place of each text's first byte, least): for each start of a string of ``length``, the smallest owner of a text with that string.

    Other places have an owner larger than all. The sorted suffixes alone decide.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 8) - (sizes + 8)
    data = np.frombuffer(b"".join([t + b"\0" * 8 for t in texts]) + b"\0" * 8, np.uint8)
    words = _words(data)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 8)
    ends = np.zeros(len(words), np.int32)  # a bucket's blocks are far below 2 GB
    ends[: len(text)] = (begins + sizes)[text]
    starts = np.maximum(sizes - length + 1, 0)
    total = int(starts.sum())
    wanted = np.repeat(begins - (np.cumsum(starts) - starts), starts) + np.arange(total)
    least = np.full(len(words) + 1, _NULL_ID, np.int64)  # a text's last starts have none, so runs don't cross texts
    for at in suffix_blocks(words, ends, wanted):
        new = np.ones(len(at), bool)
        new[1:] = ~same_prefix(words, at[1:], at[:-1], length)
        run = np.flatnonzero(new)
        least[at] = np.repeat(np.minimum.reduceat(owners[text[at]], run), np.diff(np.append(run, len(at))))
    return begins, least


def owned_spans(which: np.ndarray, ids: np.ndarray, sizes: np.ndarray, begins: np.ndarray, least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, begin, end) of the bytes of members (a text each, and an identifier) that repeat a smaller identifier's."""
    starts = np.maximum(sizes - length + 1, 0) + 1  # and one place without a start, between members
    ends = np.cumsum(starts)
    member = np.repeat(np.arange(len(which)), starts)
    offset = np.arange(int(ends[-1]) if len(ends) else 0) - (ends - starts)[member]
    hit = (least[begins[which][member] + offset] < ids[member]) & (offset < starts[member] - 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    return member[first], offset[first], offset[last - 1] + length if len(last) else last


def repeated_spans(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, begin, end) of the bytes that strings of ``length`` cover which also start in a text of a smaller owner."""
    begins, least = least_owners(texts, owners, length)
    return owned_spans(np.arange(len(texts)), owners, np.array([len(t) for t in texts], np.int64), begins, least, length)


# -- minimisers ------------------------------------------------------------------------------------------


def minimisers(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start, number of starts, hash) of the runs of starts with one minimiser.

    A start is a position with ``length`` bytes to go; a run has ``length - gram + 1`` starts at most.
    """
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for k, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), _PIECE - length):  # each start is in one piece
            piece = raw[at : at + _PIECE - 1] if len(raw) >= _PIECE else raw
            if len(piece) < length:
                continue
            if held + len(piece) >= _PIECE:
                out.append(_minimisers(pieces, length, gram))
                pieces, held = [], 0
            pieces.append((k, at, piece))
            held += len(piece)
            if len(raw) < _PIECE:
                break
    if pieces:
        out.append(_minimisers(pieces, length, gram))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _minimisers(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for _, _, p in pieces], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    eight = _eight(np.frombuffer(b"".join([p for _, _, p in pieces]) + b"\0" * 64, np.uint8))
    hashes = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for o in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        hashes ^= eight[o : o + n]
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    hashes = mix64(hashes)
    # the position in the low bits: the leftmost of equal hashes, and the place of the smallest
    key = (hashes & ~np.uint64(_PIECE - 1)) | np.arange(n, dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    none = np.uint64(_NO_KEY)
    for end in ends.tolist():
        key[end - length + 1 : end] = none
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    run = np.flatnonzero(new)
    size, key = np.diff(np.append(run, len(key))), key[run]
    real = key != none
    run, size, place = run[real], size[real], (key[real] & np.uint64(_PIECE - 1)).astype(np.int64)
    piece = np.searchsorted(ends, run, side="right")
    number = np.array([k for k, _, _ in pieces])[piece]
    base = np.array([at for _, at, _ in pieces])[piece]
    return number, run - (ends - sizes)[piece] + base, size, hashes[place]


# -- the distributed operator ----------------------------------------------------------------------------

_LOW = np.uint64((1 << 40) - 1)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By all bits, mixed again: the smallest of several hashes are crowded. Hashes that only look alike cost a comparison, no result."""
    return (mix64(hashes + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _lot(ids: np.ndarray, buckets: int) -> int:
    """A bucket for what is decided already, by the batch's first identifier."""
    return int(_bucket(ids[:1].astype(np.uint64), buckets)[0])


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes after their length: text that is shuffled takes less room than by the shuffle's own codec."""
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else b""


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), asbytes=True) if data else b""


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending int64 as the first and steps of the narrowest type that holds them."""
    if not len(values):
        return b""
    steps = np.diff(values).astype(np.uint64)
    kind = np.min_scalar_type(int(steps.max(initial=0)))
    return bytes((kind.itemsize,)) + values[:1].astype("<i8").tobytes() + steps.astype(kind).tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    steps = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), steps))).astype(np.int64)


def _pack_ts(ts: np.ndarray) -> bytes:
    return ts.tobytes() if ts.any() else b""


def _unpack_ts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64) if data else np.zeros(n, np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int = GATHER) -> Iterator[list[tuple]]:
    """Rows of several batches together, up to about ``most`` bytes of text, in order of id and t; texts as bytes."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            raw = utf8(row[2]) if columns[2] == "text" else unsqueeze(row[2] or b"")
            rows.append((*row[:2], raw, *row[3:]))
            held += len(raw)
            if held >= most:
                yield sorted(rows, key=lambda r: r[:2])
                rows, held = [], 0
    if rows:
        yield sorted(rows, key=lambda r: r[:2])


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of runs of equal values."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(ordered)))


def _parts(bucket: np.ndarray, number: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in row order) of each bucket."""
    order = np.argsort(bucket * rows + number, kind="stable")
    for first, n in zip(*_runs(bucket[order])):
        at = order[first : first + n]
        yield int(bucket[at[0]]), at


def _by_document(ids: np.ndarray, ts: np.ndarray, packed: np.ndarray) -> pd.DataFrame:
    """A row for each document: id, t and its values (rows of a byte matrix), packed."""
    order = np.lexsort((ts, ids)) if ts.any() else np.argsort(ids, kind="stable")
    ids, ts, packed = ids[order], ts[order], packed[order]
    if not len(ids):
        return pd.DataFrame({"id": ids, "t": ts, "found": []})
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1])))
    width, data = packed.shape[1], packed.tobytes()
    return pd.DataFrame({"id": ids[first], "t": ts[first], "found": [data[a * width : b * width] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)])]})


def _concat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


_BINARY = pa.binary()


def _shared_minimisers(texts: DataFrame, buckets: int, parts: int, length: int) -> DataFrame:
    """(id, t, found): the lower bits of each document's minimisers that documents of two identifiers have at least."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, ("id", "t", "text")):
            number, _, _, hashes = minimisers([r[2] for r in rows], length)
            ids, ts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            order = np.argsort(hashes)
            hashes, number = hashes[order], number[order]
            out = []
            if len(hashes):
                first, size = _runs(hashes)
                low, high = np.minimum.reduceat(number, first), np.maximum.reduceat(number, first)
                many = ids[low] != ids[high]
                twins = np.repeat((low != high) & ~many, size)  # rows of one identifier: each asks for itself
                # of a hash that two of these documents share one entry goes on, and they know already
                asks = (np.concatenate((hashes[first], hashes[twins])), np.concatenate((low, number[twins])), np.concatenate((many, np.zeros(int(twins.sum()), bool))))
                know = np.repeat(many, size)
                for known, (h, n, m) in ((False, asks), (True, (hashes[know], number[know], np.zeros(int(know.sum()), bool)))):
                    for bucket, at in _parts(np.full(len(h), _lot(ids, buckets)) if known else _bucket(h, buckets), n, len(rows)):
                        out.append((bucket, known, pack40(h[at]), pack_ascending(ids[n[at]]), _pack_ts(ts[n[at]]), b"" if known else np.packbits(m[at]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), *[_BINARY] * 4))], names=["bucket", "known", "hashes", "ids", "ts", "many"])

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        parts: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
        for known, hashes, ids, ts, many in zip(*(rows[c] for c in ("known", "hashes", "ids", "ts", "many"))):
            h = unpack40(hashes)
            parts[bool(known)].append((h, unpack_ascending(ids), _unpack_ts(ts, len(h)), np.unpackbits(np.frombuffer(many, np.uint8), count=len(h)).astype(bool) if many else np.zeros(len(h), bool)))
        hashes, ids, ts, many = (_concat([p[k] for p in parts[False]], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64, bool)))
        if len(hashes):
            order = np.argsort(hashes)
            hashes, ids, ts, many = hashes[order], ids[order], ts[order], many[order]
            first, size = _runs(hashes)
            shared = np.repeat((np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) | np.logical_or.reduceat(many, first), size) & ~many
            hashes, ids, ts = hashes[shared], ids[shared], ts[shared]
        hashes, ids, ts = (np.concatenate((own, _concat([p[k] for p in parts[True]], own.dtype))) for k, own in enumerate((hashes, ids, ts)))
        return _by_document(ids, ts, np.frombuffer(pack40(hashes), np.uint8).reshape(-1, 5))

    spread = texts.mapInArrow(entries, "bucket long, known boolean, hashes binary, ids binary, ts binary, many binary")
    return spread.repartition(parts, "bucket").groupBy("bucket").applyInPandas(decide, "id long, t long, found binary").groupBy("id", "t").agg(F.collect_list("found").alias("found"))


def _spans(squeezed: DataFrame, shared: DataFrame, buckets: int, parts: int, length: int, compress: bool) -> DataFrame:
    """(id, t, found): pairs of uint32, the byte spans of each document that repeat a smaller identifier's."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, ("id", "t", "z", "found")):
            raws = [r[2] for r in rows]
            number, start, count, hashes = minimisers(raws, length)
            wanted = np.unique(unpack40(b"".join([x for r in rows for x in r[3]])))
            here = np.isin(hashes & _LOW, wanted)
            number, start, size, hashes = number[here], start[here], count[here] + length - 1, hashes[here]
            ids, ts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            owner: dict[bytes, int] = {}
            contents: list[bytes] = []
            first = np.ones(len(number), bool)
            own_ids = ids.tolist()
            # rows are in order of identifiers, so a block's first document has the smallest
            for k, (doc, a, n) in enumerate(zip(number.tolist(), start.tolist(), size.tolist())):
                content = raws[doc][a : a + n]
                if not compress or owner.setdefault(content, own_ids[doc]) == own_ids[doc]:
                    contents.append(content)
                else:
                    first[k] = False
                    contents.append(b"")
            bucket = _bucket(hashes, buckets)
            out = []
            for known in (False, True):
                mine = np.flatnonzero(first != known)
                for b, at in _parts(np.full(len(mine), _lot(ids, buckets)) if known else bucket[mine], number[mine], max(1, len(rows))):
                    at = mine[at]
                    out.append((b, known, squeeze(b"".join([contents[j] for j in at])), size[at].astype("<u2").tobytes(), pack_ascending(ids[number[at]]), _pack_ts(ts[number[at]]), squeeze(start[at].astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), *[_BINARY] * 5))], names=["bucket", "known", "contents", "sizes", "ids", "ts", "starts"])

    def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        parts: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
        joined = b"".join(unsqueeze(c) for c, known in zip(rows["contents"], rows["known"]) if not known)
        for known, sizes, ids, ts, starts in zip(*(rows[c] for c in ("known", "sizes", "ids", "ts", "starts"))):
            n = len(sizes) // 2
            parts[bool(known)].append((np.frombuffer(sizes, "<u2").astype(np.int64), unpack_ascending(ids), _unpack_ts(ts, n), np.frombuffer(unsqueeze(starts), "<u4").astype(np.int64)))
        sizes, ids, ts, starts = (_concat([p[k] for p in parts[False]], np.int64) for k in range(4))
        ends = np.cumsum(sizes)
        index: dict[bytes | int, int] = {}
        which = np.array([index.setdefault(joined[a:b] if compress else a, len(index)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
        contents = list(index) if compress else [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        owner = np.full(len(contents), _NULL_ID, np.int64)
        np.minimum.at(owner, which, ids)
        found = [(i, t, a, a + n) for n, i, t, a in parts[True]]
        if len(contents):
            member, begin, end = owned_spans(which, ids, sizes, *least_owners(contents, owner, length), length)
            found.append((ids[member], ts[member], starts[member] + begin, starts[member] + end))
        ids, ts, begin, end = (np.concatenate(x) for x in zip(*found))
        return _by_document(ids, ts, np.stack((begin, end), 1).astype("<u4").view(np.uint8).reshape(-1, 8))

    candidates = squeezed.join(shared, ["id", "t"])
    spread = candidates.select("id", "t", "z", "found").mapInArrow(blocks, "bucket long, known boolean, contents binary, sizes binary, ids binary, ts binary, starts binary")
    return spread.repartition(parts, "bucket").groupBy("bucket").applyInPandas(sort_bucket, "id long, t long, found binary").groupBy("id", "t").agg(F.collect_list("found").alias("found"))


def merge_spans(found: list[bytes] | None) -> np.ndarray:
    """Disjoint, ascending spans (rows of begin and end) that cover the same bytes."""
    spans = np.frombuffer(b"".join(found or ()), "<u4").astype(np.int64).reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack((spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]), 1)


def with_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", compress: bool = True) -> tuple[DataFrame, bool]:
    """(id, t, z, found): each document's squeezed text (null for a null text) and packed spans of repeated bytes.

    Also whether identifiers repeat: if so, t is the text's hash and tells their rows apart, else it is 0. The
    squeezed texts are dealt by identifier once, and both joins read that exchange.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts_for(docs, BUCKET_MB, least=max(LEAST_BUCKETS, tasks))
    parts = min(buckets, parts_for(docs, TASK_MB, least=max(LEAST_BUCKETS, tasks)))
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    repeated = not docs.groupBy(own_id.alias("id")).count().where("count > 1").isEmpty()
    t = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)) if repeated else F.lit(0).cast("long")
    texts = docs.select(own_id.alias("id"), t.alias("t"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [None if x is None else squeeze(utf8(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(z, _BINARY)], names=["id", "t", "z"])

    # the filter, which holds for all rows, is what the inner join would add: so both joins have one exchange
    squeezed = texts.mapInArrow(pack, "id long, t long, z binary").where("id is not null and t is not null")
    spans = _spans(squeezed, _shared_minimisers(texts, buckets, parts, length), buckets, parts, length, compress)
    return squeezed.join(spans, ["id", "t"], "left"), repeated


def span_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", compress: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    identifier; strings don't cross documents. Null texts are empty; null identifiers are larger than all
    others and equal to each other; rows of one identifier don't remove each other's bytes, and each of them
    counts as that document. Repeated rows stay; an empty table gives no rows. An identifier of 2^63 - 1 counts
    as null.
    """
    rows, _ = with_spans(docs, length, id_col, text_col, compress)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, found in zip(batch.column("z").to_pylist(), batch.column("found").to_pylist()):
                raw, spans = unsqueeze(z or b""), merge_spans(found)
                digest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if i == _NULL_ID else i for i in ids], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),)))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("id", "z", "found").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(raw: bytes, spans: np.ndarray) -> str:
    """A text without spans of bytes; characters that a span covers only in part stay."""
    out, at = [], 0
    for a, b in spans.tolist():
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; their columns and types stay as they are.

    A character goes if all its bytes do. Null texts stay null. Rows whose whole text goes are kept with an
    empty text; a caller may drop them. Rows and their other columns are joined by identifier (and text hash
    where identifiers repeat; equal pairs of both are then the same text, so each row meets its own once).
    """
    rows, repeated = with_spans(docs, length, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if z is None else cut_text(unsqueeze(z), merge_spans(found)) for z, found in zip(batch.column("z").to_pylist(), batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(texts, pa.string())], names=["__id", "__t", "__text"])

    cut = rows.select("id", "t", "z", "found").mapInArrow(work, "__id long, __t long, __text string")
    if repeated:
        cut = cut.dropDuplicates(["__id", "__t"])
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    own_t = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)) if repeated else F.lit(0).cast("long")
    others = docs.select(*[F.col(c) for c in docs.columns if c != text_col], own_id.alias("__id"), own_t.alias("__t"))
    return others.join(cut, ["__id", "__t"]).select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
