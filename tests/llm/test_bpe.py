import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from locusframe.llm import bpe

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
OWN, LIBRARY = bpe.Tokenizer(PATH), Library.from_file(PATH)


def check(text: str, size: int = bpe.CHUNK) -> None:
    pieces = list(OWN.encode(text, size))
    ids = np.frombuffer(b"".join(pieces), "<u4").tolist()
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == expected
    spelled = bpe.Decoder(OWN, True)
    assert "".join(map(spelled.feed, pieces)) + spelled.finish() == LIBRARY.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'ll", "I'M", "hello", "Σας", "ÄÖ", "e\u0301", "===", "12"])), max_size=12), st.sampled_from([8, 30, 1 << 16]))
def test_any_text(parts, size):
    check("".join(parts), size)


@pytest.mark.parametrize("text", ["", "   ", "word " * 3000, "a" * 20_000, "ab" * 9000 + "c", "=" * 9000, "日本語" * 3000, "x\u0301" * 3000, "0123456789" * 900, "it's we're I'll " * 400])
@pytest.mark.parametrize("size", [100, 1 << 16])
def test_long_texts(text, size):
    check(text, size)


def _feed(rng, word: bytes, most_bytes: int) -> tuple[list[int], int]:
    """A word's tokens when it comes in pieces, and the most symbols held between them."""
    stream, ids, at, most = bpe.Transducer(OWN.merges), [], 0, 0
    while at < len(word):
        to = min(len(word), at + rng.randint(1, most_bytes))
        ids += stream.feed(word[at:to], to == len(word))
        most, at = max(most, len(stream.held)), to
    return ids + stream.finish(), most


def test_transducer_is_the_whole_word(rng):
    syllables = [s for s in (t.removesuffix("</w>") for t in OWN.merges.spelling.values()) if s.isascii() and s.isalpha() and s.islower()]
    for k in range(60):
        word = "".join(rng.choice(syllables if k % 3 else "aabbcht") for _ in range(rng.choice((3, 50, 400))))
        ids, most = _feed(rng, word.encode(), rng.choice((1, 5, 300)))
        assert ids == LIBRARY.encode(word, add_special_tokens=False).ids, word
        assert most <= OWN.merges.longest + max(OWN.merges.size.values())


def test_all_ids_leave_by_the_transducer(rng):
    """Every id is one that ``feed`` returned; a word's ids are remembered, but come from there too."""
    tok = bpe.Tokenizer(PATH)
    given_out, feed = [], tok.transducer.feed

    def counted(raw, ends):
        ids = feed(raw, ends)
        given_out.append((raw, tuple(ids)))
        return ids

    tok.transducer.feed = counted
    texts = ["Hello world, it's 12 o'clock. hello WORLD!", "x" * 300 + " of the", "\u0378 new letters \u0378", "y<|endoftext|>z"]
    for text in texts:
        ids = np.frombuffer(b"".join(tok.encode(text, 64)), "<u4").tolist()
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    seen = {i for _, ids in given_out for i in ids}
    assert {i for text in texts for i in LIBRARY.encode(text, add_special_tokens=False).ids} <= seen | set(tok.added.values())
    assert all(packed == np.array(dict(given_out)[word.encode()], "<u4").tobytes() for word, packed in tok.words.items())


def test_memory_is_constant_in_a_word():
    """A word of a megabyte leaves while it comes, and little is held."""
    stream, unit, n = bpe.Transducer(OWN.merges), b"theablestion", 0
    piece = unit * (bpe.CHUNK // len(unit))
    for _ in range(16):
        n += len(stream.feed(piece, False))
        assert len(stream.held) <= OWN.merges.longest + max(OWN.merges.size.values())
    assert n > 16 * len(piece) // 20
    tok = bpe.Tokenizer(PATH)
    for k in range(3):  # remembered words are bounded in bytes, whatever their length
        list(tok.encode(" ".join(f"{chr(97 + k)}" * 9000 + f"{j}" for j in range(30))))
    assert tok.words.held <= bpe.MOST_BYTES


def test_decoder():
    machine = bpe.ByteToText()
    raw = "añ日😀".encode()
    assert "".join(machine.feed(raw[k : k + 1]) for k in range(len(raw))) + machine.finish() == "añ日😀"
    assert OWN.text(OWN.ids("Hello, WORLD 12<|endoftext|>日")) == "hello , world 1 2 <|endoftext|>日 "
    ids = OWN.ids("Añ日😀 zürich")
    one = bpe.Decoder(OWN, False)  # a character's bytes may be in several tokens
    text = "".join(one.feed(np.array([i], "<u4").tobytes()) for i in ids)
    assert text + one.finish() == OWN.text(ids) and OWN.text(ids, spelled=True) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_columns(documents):
    texts = ["Hello", None, "", "Hello", "x " * 60_000]
    docs = documents([(k, t) for k, t in enumerate(texts)])
    for r, t in zip(bpe.token_digests(docs, PATH).orderBy("doc_id").collect(), texts, strict=True):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert r.readable_chars == len(OWN.text(ids))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    col = bpe.token_column(docs, PATH, decode=True).orderBy("doc_id").collect()
    assert col[0].token_ids == LIBRARY.encode("Hello", add_special_tokens=False).ids and col[1].token_ids == [] and col[0].decoded_text == "hello "
    assert bpe.token_digests(documents([]), PATH).count() == 0
