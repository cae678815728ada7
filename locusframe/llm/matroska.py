"""Media columns: Matroska files as binary values, read into packet tables.

``mux`` stores bytes losslessly as 8-bit PCM samples in frames of equal length, several frames laced
into each SimpleBlock, blocks in clusters, one cue point for each cluster. ``demux`` parses any
Matroska bytes: variable-length EBML identifiers and sizes (unknown sizes too), Xiph, EBML and
fixed-size lacing, SimpleBlocks and BlockGroups, cues; it returns packets with track, timestamp and
byte range, and never looks at what ``mux`` knew.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

# Element identifiers of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES))

FRAME = 192
RATE = 8000
FRAME_NS = FRAME * 1_000_000_000 // RATE  # 24 ms
LACED = 8
BLOCKS_IN_CLUSTER = 64


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:  # all ones mean an unknown size
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(element: int, body: bytes) -> bytes:
    return _id(element) + _size(len(body)) + body


def _uint(element: int, n: int) -> bytes:
    return _element(element, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(element: int, x: float) -> bytes:
    return _element(element, np.array(x, ">f8").tobytes())


_HEADER = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACK = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1)
        + _uint(TRACK_UID, 1)
        + _uint(TRACK_TYPE, 2)
        + _uint(FLAG_LACING, 1)
        + _uint(DEFAULT_DURATION, FRAME_NS)
        + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track; the payload's length is a multiple of ``FRAME``."""
    if len(payload) % FRAME:
        raise ValueError(f"the payload's length {len(payload)} is no multiple of {FRAME}")
    frames = len(payload) // FRAME
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, frames * FRAME_NS / 1e6) + _element(MUXING_APP, b"locusframe") + _element(WRITING_APP, b"locusframe"))
    parts, at, cues = [info, _TRACK], len(info) + len(_TRACK), []
    per_cluster = LACED * BLOCKS_IN_CLUSTER
    for first in range(0, frames, per_cluster):
        time = first * FRAME_NS // 1_000_000
        body = [_uint(TIMESTAMP, time)]
        for f in range(first, min(frames, first + per_cluster), LACED):
            n = min(LACED, frames - f)
            ahead = (f - first) * FRAME_NS // 1_000_000
            # track 1, relative time, key frame with fixed-size lacing (if any), frames less one
            head = b"\x81" + ahead.to_bytes(2, "big") + (bytes((0x84, n - 1)) if n > 1 else b"\x80")
            size = len(head) + n * FRAME
            body += [b"\xa3", _size(size), head, payload[f * FRAME : (f + n) * FRAME]]
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What ``demux`` found; packets are (track, timestamp in ns, first byte, length, key frame)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0

    def payload(self, data: bytes, track: int) -> bytes:
        return b"".join([data[a : a + n] for t, _, a, n, _ in self.packets if t == track])


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all value bits set) of a variable-length integer."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    first = data[at]
    if first & 0x80 and not keep_marker:  # most sizes have one byte
        return first & 0x7F, at + 1, first == 0xFF
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"the data ends in an integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
    return value, at + width, value == (1 << 7 * width) - 1


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, length) of each frame of a block's content."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block has no frames")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("a block with fixed-size lacing has frames of unequal length")
        return [(at + k * each, each) for k in range(count)]
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            value, after, _ = _vint(data, at)
            width, at = after - at, after
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a block's lace sizes exceed the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def demux(data: bytes) -> Media:
    """Parse Matroska bytes; malformed data raise ValueError."""
    try:
        return _demux(data)
    except IndexError as e:
        raise ValueError("the data end inside an element") from e


def _demux(data: bytes) -> Media:
    media = Media()
    stack: list[tuple[int, int]] = []  # open masters with their ends
    at, cluster_time, entry, cue = 0, 0, {}, [0, 0, 0]
    # a block's frames get their times when its duration or default duration is known
    while at < len(data):
        while stack and at >= stack[-1][1]:
            stack.pop()
        start = at
        element, at, _ = _vint(data, at, keep_marker=True)
        n, at, unknown = _vint(data, at)
        while stack and stack[-1][1] > len(data) and stack[-1][0] == CLUSTER and element in TOP_LEVEL:
            stack.pop()  # a cluster of unknown size ends at the next element of its parent's level
        end = len(data) + 1 if unknown else at + n
        if not unknown and end > len(data):
            raise ValueError(f"the element at byte {start} exceeds the data")
        if element in MASTERS:
            if unknown and element not in (SEGMENT, CLUSTER):
                raise ValueError(f"the element at byte {start} must not have an unknown size")
            stack.append((element, end))
            if element == SEGMENT:
                media.segment = at
            elif element == CLUSTER:
                media.clusters.append(start - media.segment)
            elif element == TRACK_ENTRY:
                entry = {}
            elif element == CUE_POINT:
                cue = [0, 0, 0]
            continue
        if element in (SIMPLE_BLOCK, BLOCK):
            track, body, _ = _vint(data, at)
            if body + 3 > end:
                raise ValueError(f"the block at byte {start} has no time and flags")
            ahead = int.from_bytes(data[body : body + 2], "big", signed=True)
            flags = data[body + 2]
            step = media.tracks.get(track, {}).get("frame_ns", 0)
            time = (cluster_time + ahead) * media.scale
            key = bool(flags & 0x80) or element == BLOCK
            for k, (a, size) in enumerate(_laces(data, body + 3, end, flags >> 1 & 3)):
                media.packets.append((track, time + k * step, a, size, key))
        else:
            body = data[at:end]
            number = lambda body=body: int.from_bytes(body, "big")
            if element == TIMESTAMP:
                cluster_time = number()
            elif element == TIMESTAMP_SCALE:
                media.scale = number()
            elif element == DURATION:
                media.duration = float(np.frombuffer(body, f">f{n}")[0]) if n in (4, 8) else 0.0
            elif element == DOC_TYPE:
                media.doc_type = body.rstrip(b"\0").decode("ascii", "replace")
            elif element == TRACK_NUMBER:
                entry["number"] = number()
                media.tracks[entry["number"]] = entry
            elif element == TRACK_TYPE:
                entry["type"] = number()
            elif element == CODEC_ID:
                entry["codec"] = body.decode("ascii", "replace")
            elif element == DEFAULT_DURATION:
                entry["frame_ns"] = number()
            elif element == SAMPLING_FREQUENCY:
                entry["rate"] = float(np.frombuffer(body, f">f{n}")[0]) if n in (4, 8) else 0.0
            elif element == CHANNELS:
                entry["channels"] = number()
            elif element == BIT_DEPTH:
                entry["bits"] = number()
            elif element == CUE_TIME:
                cue[0] = number()
            elif element == CUE_TRACK:
                cue[1] = number()
            elif element == CUE_CLUSTER_POSITION:
                media.cues.append((cue[0], cue[1], number()))
        at = end
    return media


def seek(media: Media, time_ns: int) -> int | None:
    """The byte position (in the segment) of the cluster at which to start for a time, by the cues."""
    before = [position for t, _, position in media.cues if t * media.scale <= time_ns]
    return before[-1] if before else None


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of ``FRAME`` bytes."""
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME))


def feature(media: Media, samples: bytes) -> str:
    """Packets, clusters, cues, duration in ms, then loudness, zero crossings and peak of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    rms = float(np.sqrt(np.mean(x * x))) if x.size else 0.0
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))) if x.size else 0
    last = media.packets[-1][1] + FRAME_NS if media.packets else 0
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={last // 1_000_000};rms={rms:.3f};crossings={crossings};peak={int(np.abs(x).max()) if x.size else 0}"


def media_column(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and the Matroska file of every text as the binary column media (null text: empty)."""
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [utf8(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(pad(r)) for r in raw], pa.binary())], names=[*batch.schema.names[:-1], "n_bytes", "media"])

    return src.mapInArrow(work, f"{fields}n_bytes long, media binary")


def packet_table(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each packet: ``keep`` columns, packet_no, track, timestamp_ns, first_byte, n_bytes, key_frame.

    Rows with null or empty media give no packets; malformed media raise ValueError.
    """
    small_batches(media.sparkSession)
    src = media.select(*[F.col(c) for c in keep], F.col(media_col).alias("__media"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("__media")[k].as_py()
                packets = demux(data).packets if data else []
                if packets:
                    cols = list(zip(*packets))
                    own = batch.slice(k, 1).to_pylist()[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own[c]] * len(packets), batch.schema.field(c).type) for c in keep] + [pa.array(range(len(packets)), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())))],
                        names=[*keep, "packet_no", "track", "timestamp_ns", "first_byte", "n_bytes", "key_frame"],
                    )

    return src.mapInArrow(work, f"{fields}packet_no long, track long, timestamp_ns long, first_byte long, n_bytes long, key_frame boolean")


def media_digest(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Digests of what is read back from the stored files: the payload of track 1 and its features.

    Equal files give equal values; repeated rows stay; an empty table gives no rows.
    """
    small_batches(media.sparkSession)
    src = media.select(*[F.col(c) for c in keep], F.col(media_col).alias("__media"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])

    def digest(data: bytes) -> tuple:
        found = demux(data)
        payload = found.payload(data, 1)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload)

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(d) for d in batch.column("__media").to_pylist()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*batch.schema.names[:-1], *names])

    return src.mapInArrow(work, f"{fields}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
