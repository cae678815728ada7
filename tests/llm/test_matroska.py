import hashlib
import zlib

import pytest

from locusframe.llm import matroska as K


@pytest.mark.parametrize("n", [1, 7, 8, 9, 512, 513, 1500])
def test_round_trip(rng, n):
    payload = bytes(rng.randrange(256) for _ in range(n * K.FRAME))
    data = K.mux(payload)
    media = K.demux(data)
    assert media.payload(data, 1) == payload
    assert len(media.packets) == n and len(media.clusters) == len(media.cues) == -(-n // 512)
    assert [p[1] for p in media.packets] == [k * K.FRAME_NS for k in range(n)]
    assert [c[2] for c in media.cues] == media.clusters
    assert K.seek(media, media.packets[-1][1]) == media.clusters[-1]
    assert media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8


def _file(body: bytes, unknown: bool = False) -> bytes:
    size = b"\x01" + b"\xff" * 7 if unknown else K._size(len(body))
    return K._HEADER + K._id(K.SEGMENT) + size + body


def test_malformed_data_raise_value_errors(rng):
    data = K.mux(bytes(rng.randrange(256) for _ in range(3 * K.FRAME)))
    for _ in range(400):  # any bytes changed or cut off
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            K.demux(bytes(bad[: rng.randint(0, len(bad))]))
        except ValueError:
            pass
    short = K._id(K.CLUSTER) + K._size(5) + K._id(K.SIMPLE_BLOCK) + K._size(2) + b"\x81\x00"
    laced = K._id(K.CLUSTER) + K._size(8) + K._id(K.SIMPLE_BLOCK) + K._size(5) + b"\x81\x00\x00\x02\x09"
    for body in (short, laced):
        with pytest.raises(ValueError):
            K.demux(_file(body))


def test_packets_of_rows_without_media(spark):
    rows = [(1, None, "x", 5), (2, b"", "y", 6), (3, K.mux(b"a" * K.FRAME), "z", 7)]
    media = spark.createDataFrame(rows, "doc_id long, media binary, feature string, track int")
    assert [(r.doc_id, r.packet_no, r.n_bytes) for r in K.packet_table(media).collect()] == [(3, 0, K.FRAME)]
    assert K.packet_table(media.limit(0)).count() == 0


def test_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 255, b"c" * 10, b"d" * 7]
    xiph = b"\x81\x00\x00" + bytes((0x82, 3)) + b"\xff\x2d" + b"\xff\x00" + b"\x0a" + b"".join(frames)
    # EBML lacing: the first size, then signed differences
    ebml = b"\x81\x00\x01" + bytes((0x86, 3)) + b"\x41\x2c" + (255 - 300 + 8191).to_bytes(2, "big")[:0] + ((255 - 300 + (1 << 13) - 1) | 1 << 14).to_bytes(2, "big") + ((10 - 255 + (1 << 13) - 1) | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    plain = b"\x82\xff\xff\x80" + b"second track"
    group = K._element(K.BLOCK_GROUP, K._element(K.BLOCK, b"\x81\x00\x05\x00" + b"grouped"))
    cluster = K._uint(K.TIMESTAMP, 100) + K._element(K.SIMPLE_BLOCK, xiph) + K._element(K.SIMPLE_BLOCK, ebml) + K._element(K.SIMPLE_BLOCK, plain) + group
    for unknown in (False, True):
        one = K._id(K.CLUSTER) + (b"\xff" if unknown else K._size(len(cluster))) + cluster
        data = _file(K._TRACK + one + one, unknown)
        media = K.demux(data)
        assert media.payload(data, 1) == (b"".join(frames) * 2 + b"grouped") * 2
        assert media.payload(data, 2) == b"second track" * 2
        assert len(media.clusters) == 2
        assert [p[1] for p in media.packets if p[0] == 2] == [99_000_000] * 2
        assert media.packets[1][1] - media.packets[0][1] == K.FRAME_NS


@pytest.mark.parametrize("broken", [lambda d: d[:-3], lambda d: d[:40] + b"\x00" + d[41:], lambda d: b"\x00" + d])
def test_malformed(broken):
    with pytest.raises(ValueError):
        K.demux(broken(K.mux(b"x" * K.FRAME * 3)))


def test_columns(documents):
    texts = ["", None, "aé日", "x" * 192, "y" * 100_000, "aé日"]
    docs = documents([(k if k != 2 else None, t) for k, t in enumerate(texts)])
    media = K.media_column(docs)
    rows = K.media_digest(media).collect()
    assert len(rows) == len(texts)
    for t, r in zip(texts, rows):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = K.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [b - 128 for b in payload]
        n = len(payload) // 192
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        found = dict(part.split("=") for part in r.feature.split(";"))
        assert [int(found[k]) for k in ("packets", "clusters", "cues", "ms", "crossings", "peak")] == [n, -(-n // 512), -(-n // 512), n * K.FRAME_NS // 1_000_000, crossings, max(map(abs, x))]
        assert abs(float(found["rms"]) - (sum(v * v for v in x) / len(x)) ** 0.5) < 2e-3
    assert rows[2].feature == rows[5].feature
    packets = K.packet_table(media).where("doc_id = 4").orderBy("packet_no").collect()
    assert len(packets) == -(-100_000 // 192) and {p.n_bytes for p in packets} == {192}
    assert K.media_digest(K.media_column(documents([]))).count() == 0
