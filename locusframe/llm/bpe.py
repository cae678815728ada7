"""BPE with word ends as a bounded-lookahead streaming transducer, and an incremental decoder.

How far to the right of a token's end can bytes still change that end? A merge (x, y) across it needs a left
token x that ends there, so a token or a tail of it, and its y may only come about because of what follows y:
an earlier merge whose left token is a tail of y, and so on; ranks fall along such a chain. ``Merges`` finds the
longest chain's bytes for each token from the merge list: the token's sufficient lookahead. Tokens that end a
word need none. ``Transducer`` takes a text's bytes in pieces, words and parts of words alike, holds what is not
yet stable and emits tokens once they are, that is, up to the last token with its lookahead's bytes behind it;
what follows is tokenised as if it began there, since no merge crosses a stable end. So memory doesn't grow
with a text or with a word. At a word's beginning nothing is held, so what a word gave before is remembered
(a table bounded in bytes), as most words recur.

The decoder takes ids and gives text by a byte-to-text state machine, in the form of a tokenizer file without a
decoder (spellings joined by spaces) or readable (the bytes that the tokens stand for).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Characters of a text normalised at once, symbols that are tried at a time, bytes of remembered words and their ids.
CHUNK, STEP, MOST_BYTES = 1 << 16, 512, 48 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by the public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in set(plain):
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Merges:
    """A vocabulary and its merge list, over token ids."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], end: str):
        self.end = end
        self.spelling = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.size = {i: len(t.removesuffix(end)) if end else len(t) for t, i in vocab.items()}
        self.lookahead = self.sufficient_lookahead(merges, vocab)
        self.longest = max(self.lookahead.values(), default=0)

    def sufficient_lookahead(self, merges: Sequence[tuple[str, str]], vocab: dict[str, int]) -> dict[int, int]:
        """For each token, the bytes behind its end that can decide about that end; 0 for those not listed.

        Merges are taken by rank. ``reach[x]`` is the longest chain, in bytes behind x, that begins with an
        earlier merge whose left token is x; a merge's chain goes on with one whose left token is a tail of its
        right token, or that token, as it was built.
        """
        tails: dict[int, set[int]] = {}  # a token and the right parts of the merges that give it and its tails
        reach: dict[int, int] = {}
        for a, b in merges:
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            of = tails.get(v) or {v}
            chain = self.size[v] + max((reach[x] for x in of if x in reach), default=0)
            reach[u] = max(reach.get(u, 0), chain)
            tails[w] = tails.get(w, {w}) | of
        return {t: most for t in self.size if (most := max((reach.get(x, 0) for x in tails.get(t, (t,))), default=0))}

    def tokens(self, symbols: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost first, until none is left."""
        get, n = self.ranks.get, len(symbols)
        heap = [(r[0], k, r[1]) for k, r in enumerate(map(get, zip(symbols, symbols[1:]))) if r]
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        own = symbols + [-1]  # a symbol that went is -1
        while heap:
            rank, k, token = heappop(heap)
            j = after[k]
            pair = get((own[k], own[j])) if j < n and own[k] >= 0 else None
            if pair is None or pair[0] != rank:
                continue  # one of the two has gone into another token
            own[k], own[j] = token, -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if pair := get((token, own[j])):
                    heappush(heap, (pair[0], k, pair[1]))
            if (i := before[k]) >= 0 and (pair := get((own[i], token))):
                heappush(heap, (pair[0], i, pair[1]))
        return [t for t in own if t >= 0]


class Transducer:
    """Bytes of words in, tokens out: those that no later byte can change."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held: list[int] = []  # symbols after the last stable end, all of one word

    def feed(self, raw: bytes, ends: bool) -> list[int]:
        """The tokens that are stable after these bytes of a word, whose last one ends it or not."""
        out: list[int] = []
        inner, last = self.merges.inner, len(raw) - 1
        for at in range(0, len(raw), STEP):
            self.held += [inner[b] for b in raw[at : at + STEP]]
            if ends and at + STEP > last:
                self.held[-1] = self.merges.final[raw[last]]
            out += self._stable()
        return out

    def finish(self) -> list[int]:
        """The rest of a text, in which no word's end is open."""
        if self.held:
            raise ValueError("a text ends inside a word")
        return []

    def _stable(self) -> list[int]:
        m = self.merges
        found = m.tokens(self.held.copy())
        behind, stable = 0, len(found)
        for token in reversed(found):  # to the last token with enough bytes behind it
            if m.lookahead.get(token, 0) <= behind:
                break
            behind += m.size[token]
            stable -= 1
        self.held = self.held[len(self.held) - behind :] if behind else []
        return found[:stable]


class ByteToText:
    """Bytes to text one piece at a time; an unfinished character waits for its other bytes."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self._machine.decode(raw)

    def finish(self) -> str:
        return self._machine.decode(b"", True)


class _Words(dict):
    """What the transducer gave for a word when it held nothing: word -> packed ids. Its bytes are bounded."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        packed = np.array(self.transducer.feed(raw, True), "<u4").tobytes()
        if self.held + 200 + len(raw) + len(packed) > MOST_BYTES:
            self.clear()
            self.held = 0
        self[word] = packed
        self.held += 200 + len(raw) + len(packed)
        return packed


class Decoder:
    """Ids in, text out, piece by piece.

    Spelled, it is the library's decoding where a tokenizer file names no decoder: spellings joined by spaces. Else
    it is the bytes that the tokens stand for, with a space for each word end.
    """

    def __init__(self, tok: Tokenizer, spelled: bool):
        self._of = (tok.spellings if spelled else tok.bytes_of).__getitem__
        self._between = b" " if spelled else b""
        self._begun = False
        self._machine = ByteToText()

    def feed(self, packed: bytes) -> str:
        """The text of these ids, as far as its characters are whole."""
        if not packed:
            return ""
        raw = self._between.join(map(self._of, np.frombuffer(packed, "<u4").tolist()))
        if self._begun:
            raw = self._between + raw
        self._begun = True
        return self._machine.feed(raw)

    def finish(self) -> str:
        return self._machine.finish()


class Tokenizer:
    """The text side: added tokens, normaliser (NFC, runs of white space, lower case), splitter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE with a word-end suffix is supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.path = path
        self.merges = Merges(model["vocab"], merges, end)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.merges.spelling[i] = content
        of = {c: bytes((k,)) for k, c in enumerate(byte_symbols())}
        self.spellings = {i: t.encode() for i, t in self.merges.spelling.items()}
        self.bytes_of = {i: t.encode() if t in self.added else b"".join([of[c] for c in t.removesuffix(end)]) + (b" " if t.endswith(end) else b"") for i, t in self.merges.spelling.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        import regex

        # fixed values: the splitter's pattern of this tokenizer
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.transducer = Transducer(self.merges)
        self.words = _Words(self.transducer)
        self._library = None

    def _is_new(self, text: str) -> bool:
        """Has a character that this Python's Unicode tables don't know: other tables may."""
        return not text.isascii() and any(c > "\u04ff" and unicodedata.category(c) == "Cn" for c in set(text))

    def _library_words(self, section: str) -> list[bytes]:
        """The words of a text with such characters, by the library's normaliser and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_file(self.path)
        byte = {c: k for k, c in enumerate(byte_symbols())}
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(section))
        return [bytes([byte[c] for c in word]) for word, _ in split]

    @staticmethod
    def _cut(text: str, low: int, high: int) -> tuple[int, bool]:
        """(where to cut, whether inside a run): the last place in low..high, else the first after it."""
        if high >= len(text):
            return len(text), False

        def fits(p: int) -> bool | None:
            a, b = text[p - 1], text[p]
            if b in " \n\t\r":
                return False
            if "'" in text[max(0, p - 3) : p + 1]:
                return None
            ends = unicodedata.category(unicodedata.normalize("NFC", a).lower()[-1])  # some letters end in a mark then
            if unicodedata.category(a)[0] == ends[0] == "L" == unicodedata.category(b)[0] and not "\u1100" <= b <= "\u11ff":
                return True
            if a.isascii() and b.isascii() and not a.isalnum() and not b.isalnum() and not a.isspace() and a.isprintable() and b.isprintable():
                return True
            return None

        space = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
        if space > low:
            return space, False
        for p in [*range(high, low, -1), *range(high + 1, len(text))]:
            if (inside := fits(p)) is not None:
                return p, inside
        return len(text), False

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, bool]]:
        """Normalised pieces of a text, and whether the next one goes on with the same run."""
        at = 0
        while at < len(text):
            to, inside = self._cut(text, at + 1, at + size)
            piece, at = text[at:to], to
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3")
            yield piece.lower(), inside

    def encode(self, text: str, size: int = CHUNK) -> Iterator[bytes]:
        """Packed ids, piece by piece; all but those of added tokens leave by the transducer."""
        library = self._is_new(text)
        sections = self.specials.split(text) if self.specials and "<|" in text else (text,)
        words, feed = self.words, self.transducer.feed

        def pack(ids: list[int]) -> bytes:
            return np.array(ids, "<u4").tobytes()

        for section in sections:
            if section in self.added:
                yield self.added[section].to_bytes(4, "little")
                continue
            if library:
                yield from (pack(feed(raw, True)) for raw in self._library_words(section))
                continue
            carried = False  # the last piece ended inside a word, whose bytes are in the transducer
            for piece, inside in self.chunks(section, size):
                found = self.split(piece)
                if carried and found:
                    carried = inside and len(found) == 1
                    yield pack(feed(found.pop(0).encode("utf-8", "surrogatepass"), not carried))
                opened = found.pop() if inside and found else None
                yield b"".join(map(words.__getitem__, found))
                if opened is not None:
                    carried = True
                    yield pack(feed(opened.encode("utf-8", "surrogatepass"), False))
        self.transducer.finish()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode(text)), "<u4")

    def text(self, ids: Sequence[int], spelled: bool = False) -> str:
        """Readable text of ids, or their spellings, by the decoder."""
        decoder = Decoder(self, spelled)
        return decoder.feed(np.asarray(ids, "<u4").tobytes()) + decoder.finish()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def digest(tok: Tokenizer, text: str | None) -> tuple[int, str, str, int]:
    """(tokens, sha256 of the ids, sha256 of the ids' spelled text, characters of their readable text).

    Ids are decoded as they leave the transducer, so memory is bounded in the text's length.
    """
    n, chars, ids_hash, text_hash = 0, 0, hashlib.sha256(), hashlib.sha256()
    spelled, readable = Decoder(tok, True), Decoder(tok, False)
    for packed in tok.encode(text or ""):
        ids_hash.update(packed)
        text_hash.update(spelled.feed(packed).encode())
        chars += len(readable.feed(packed))
        n += len(packed) // 4
    text_hash.update(spelled.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest(), chars + len(readable.finish())


def token_digests(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and readable_chars of every whole text (null: empty).

    The last two are decoded from the ids. Equal texts give equal values; repeated rows stay; an empty table
    gives no rows; columns kept must not have such names.
    """
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "readable_chars": "long"}
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    types = (pa.int64(), pa.string(), pa.string(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            cols = list(zip(*(digest(tok, t) for t in batch.column("__text").to_pylist()))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*batch.schema.names[:-1], *added])

    return src.mapInArrow(work, fields + ", ".join(f"{c} {t}" for c, t in added.items()))


def token_column(docs: DataFrame, vocabulary: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with the column token_ids (array of int; null text: empty array) and, if asked for, decoded_text.

    A column of ``docs`` with such a name is replaced.
    """
    small_batches(docs.sparkSession)
    added = ["token_ids", "decoded_text"][: 1 + decode]
    src = docs.drop(*added)
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_text", T.StringType())]
    schema = T.StructType([*src.schema.fields, *fields[: len(added)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            ids = [tok.ids(t or "") for t in batch.column(text_col).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            values = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            cols = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            if decode:
                cols.append(pa.array([tok.text(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *added])

    return src.mapInArrow(work, schema)
