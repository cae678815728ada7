"""Token shards as sorted string tables.

A shard file holds the token ids of documents in ascending key order::

    block*   entries with prefix-compressed keys, restart points, a codec byte and a CRC-32
    filter   a Bloom filter over the shard's document identifiers
    index    sparse: the last key, offset and length of each block
    footer   offsets of filter and index, counts, id width, magic

An entry is ``varint shared | varint own | varint value length | own key bytes | value``; every 16th key
is stored whole, and its offset is a restart point for binary search. A key is one byte 0 for a null
identifier or 1, the identifier with its sign bit flipped (8 bytes, big endian), then the ordinal among
rows of one identifier (4 bytes), so byte order is the identifiers' order. A value is the document's ids
as little-endian unsigned integers of 2 or 4 bytes, by the vocabulary's size. ``Reader.get`` consults the
Bloom filter, then the index and the restart points by binary search.

Tokenizing: texts are cut by the byte-level pattern into the pieces that the tokenizer would itself make,
and each distinct piece is encoded by the tokenizers library's model, once in a while for all. Texts with a
character on which the two libraries' Unicode tables may differ go to the library whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import filesystem, parts_for, shared_dir, small_batches

MAGIC = b"LFSSTAB1"
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2
#: MB of a plan's estimated size in a shard.
SHARD_MB = 16.0
_FOOTER = struct.Struct("<QQQQQQB7x8s")


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" * 9 + ordinal.to_bytes(4, "big")
    return b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big") + ordinal.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_slots(prefix: bytes, bits: int) -> list[int]:
    """Double hashing over the identifier's part of a key."""
    h = zlib.crc32(prefix) | zlib.crc32(prefix, 0x9E3779B9) << 32
    h = (h * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (1 << 64) - 1
    a, b = h >> 32, h & 0xFFFFFFFF | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary file object; keys come in ascending order."""

    def __init__(self, out, id_bytes: int = 4, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.at = self.docs = self.tokens = self.in_block = 0
        self.block = bytearray()
        self.restarts: list[int] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.prefixes: list[bytes] = []
        self.first = self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must come in ascending order")
        if self.in_block % RESTART:
            shared = next((k for k, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        else:
            shared = 0
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first = self.first or key
        self.last = key
        self.in_block += 1
        self.docs += 1
        self.tokens += len(value) // self.id_bytes
        if not self.prefixes or self.prefixes[-1] != key[:9]:
            self.prefixes.append(key[:9])
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts)) + b"\0"
            self.index.append((self.last, *self._put(body + struct.pack("<I", zlib.crc32(body)))))
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.prefixes))
        bloom = bytearray(-(-bits // 8))
        for p in self.prefixes:
            for s in _bloom_slots(p, bits):
                bloom[s >> 3] |= 1 << (s & 7)
        filter_at, _ = self._put(struct.pack("<Q", bits) + bytes(bloom))
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        index_at, index_n = self._put(index)
        self._put(_FOOTER.pack(filter_at, index_at, index_n, len(self.index), self.docs, self.tokens, self.id_bytes, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file object, one block at a time."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        self.filter_at, index_at, index_n, blocks, self.docs, self.tokens, self.id_bytes, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("this is no token shard")
        file.seek(self.filter_at)
        tail = file.read(index_at + index_n - self.filter_at)
        (self.bits,) = struct.unpack_from("<Q", tail)
        self.bloom = tail[8 : index_at - self.filter_at]
        self.index: list[tuple[bytes, int, int]] = []
        at, data = 0, tail[index_at - self.filter_at :]
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            key = data[at : at + n]
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))

    def _block(self, k: int) -> tuple[bytes, int, list[int]]:
        _, at, n = self.index[k]
        self.file.seek(at)
        data = self.file.read(n)
        body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
        if zlib.crc32(body) != crc or body[-1]:
            raise ValueError("a block of a token shard is damaged")
        (count,) = struct.unpack_from("<I", body, len(body) - 5)
        end = len(body) - 5 - 4 * count
        return body, end, list(struct.unpack_from(f"<{count}I", body, end))

    @staticmethod
    def _entries(body: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, body[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All (key, value) in order."""
        for k in range(len(self.index)):
            body, end, _ = self._block(k)
            yield from self._entries(body, 0, end)

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """A document's ids, or None."""
        key = key_of(doc_id, ordinal)
        if any(not self.bloom[s >> 3] >> (s & 7) & 1 for s in _bloom_slots(key[:9], self.bits)):
            return None
        k = bisect_left(self.index, key, key=lambda x: x[0])
        if k == len(self.index):
            return None
        body, end, restarts = self._block(k)
        low, high = 0, len(restarts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if next(self._entries(body, restarts[mid], end))[0] <= key else (low, mid - 1)
        for found, value in self._entries(body, restarts[low], end):
            if found >= key:
                return self.ids(value) if found == key else None
        return None

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}")


class PieceEncoder:
    """A byte-level BPE tokenizer of the tokenizers library with its pieces memoised (bounded in bytes)."""

    MOST = 128 << 20

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.id_bytes = 2 if max(self.tokenizer.get_vocab_size(True) - 1, END_ID) < 1 << 16 else 4
        pre = spec.get("pre_tokenizer") or {}
        # memoised only where the pieces are known: byte level by its own pattern, no normaliser
        known = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.whole = not known or bool(spec["model"].get("ignore_merges")) or bool(spec["model"].get("dropout"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        letters, digits, spaces = (self._class(test) for test in (lambda k: k[0] == "L", lambda k: k[0] == "N", None))
        # fixed values: the byte-level pattern of this tokenizer, its classes spelt out below U+0558
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        self.odd = re.compile(f"[^\0-{chr(self.KNOWN - 1)}]").search
        self.dtype = f"<u{self.id_bytes}"
        self.seen = _Pieces(self.tokenizer.model, "HI"[self.id_bytes // 4])

    #: Code points below this one have the same classes in all Unicode versions concerned.
    KNOWN = 0x558

    @classmethod
    def _class(cls, test) -> str:
        """A character class of the code points whose category passes, or of white space."""
        space = lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f"
        return "".join(rf"\u{c:04x}" for c in range(cls.KNOWN) if (test(unicodedata.category(chr(c))) if test else space(chr(c))))

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Whole texts by the library."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        plain = [not self.whole and not self.odd(t) and not any(a in t for a in self.added) for t in texts]
        get, pieces = self.seen.__getitem__, self.pieces
        rest = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        out = [b"".join(map(get, pieces(t))) if p else next(rest) for t, p in zip(texts, plain)]
        if self.seen.held > self.MOST:
            self.seen.clear()
            self.seen.held = 0
        return out


class _Pieces(dict):
    """piece -> packed ids, by the library's own model, which takes a piece's bytes as their symbols.

    Pieces longer than ``LONGEST`` hardly recur and are not kept.
    """

    LONGEST = 1000

    def __init__(self, model, code: str):
        super().__init__()
        self.tokenize, self.code = model.tokenize, code
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        found = self.tokenize(piece.encode().decode("latin-1").translate(self.symbols))
        packed = array(self.code, [t.id for t in found]).tobytes()
        if len(piece) <= self.LONGEST:
            self[piece] = packed
            self.held += 160 + len(piece) + len(packed)
        return packed


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class Shards:
    """Shard files in key order: (path, documents, tokens) each, in the folder ``uri``."""

    uri: str
    files: tuple[tuple[str, int, int], ...]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Range-partition documents by identifier, encode them, and write one shard file for each partition.

    Runs at once. A null text has only the end id; null identifiers come first; rows of one identifier
    are ordered by text and get ordinals, so repeated rows stay. Each attempt writes a file of its own and
    only the files of successful tasks are listed; the list, one short row a shard, is what the driver gets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    uri = uri or shared_dir(spark, "token-shards")
    n = parts_for(docs, SHARD_MB, least=spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc = encoder(vocabulary)
        tail = np.array([end_id], enc.dtype).tobytes()
        writer = out = None
        last: object = writer
        ordinal = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, folder = filesystem(uri)
                fs.create_dir(folder, recursive=True)
                path = f"{folder}/{uuid.uuid4().hex}.sst"
                out = fs.open_output_stream(path)
                writer, last = Writer(out, enc.id_bytes), object()
            ids = batch.column("id").to_pylist()
            for doc, value in zip(ids, enc.encode(batch.column("text").to_pylist())):
                ordinal = ordinal + 1 if doc == last else 0
                writer.add(key_of(doc, ordinal), value + tail)
                last = doc
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [writer.first], "path": [path], "docs": [writer.docs], "tokens": [writer.tokens]}, pa.schema([("first", pa.binary()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    listed = rows.mapInArrow(work, "first binary, path string, docs long, tokens long").collect()
    return Shards(uri, tuple((r.path, r.docs, r.tokens) for r in sorted(listed, key=lambda r: bytes(r.first))))


def read_shards(spark, shards: Shards) -> DataFrame:
    """Documents of the shard files: doc_id, start (ids before it), n_tokens, ids_crc32 and shard, one task a shard.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    """
    small_batches(spark)
    rows, before = [], 0
    for k, (path, _, tokens) in enumerate(shards.files):
        rows.append((k, path, before))
        before += tokens
    listed = spark.createDataFrame(rows, "shard int, path string, before long")
    uri = shards.uri

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(uri)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    reader, at, out = Reader(f, f.size()), row["before"], []
                    for key, value in reader.scan():
                        ids = reader.ids(value)
                        out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), row["shard"]))
                        at += len(ids)
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return listed.repartition(max(1, len(rows))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def find_document(shards: Shards, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
    """One document's ids by its identifier: shards are in key order, each answers by filter and binary search."""
    fs, _ = filesystem(shards.uri)
    for path, _, _ in shards.files:
        with fs.open_input_file(path) as f:
            if (ids := Reader(f, f.size()).get(doc_id, ordinal)) is not None:
                return ids
    return None
