import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from locusframe.llm import sstable as S

from conftest_llm import prose

public = pytest.importorskip("public_tokenizers")


def test_format(rng):
    ids = sorted({rng.randrange(-(1 << 60), 1 << 60) for _ in range(2000)} | {-(1 << 63), (1 << 63) - 1, 0})
    values = {d: np.array([rng.randrange(1 << 16) for _ in range(rng.randint(0, 60))], "<u2") for d in ids}
    f = io.BytesIO()
    w = S.Writer(f, 2, block_bytes=2048)
    w.add(S.key_of(None), b"")
    w.add(S.key_of(None, 1), b"\1\0")
    for d in ids:
        w.add(S.key_of(d), values[d].tobytes())
    w.close()
    r = S.Reader(f, f.tell())
    assert len(r.index) > 10 and r.docs == len(ids) + 2
    assert [S.id_of(k) for k, _ in r.scan()] == [None, None, *ids]
    for d in ids[::7]:
        assert (r.get(d) == values[d]).all()
    assert list(r.get(None, 1)) == [1] and r.get(None, 2) is None
    absent = [d for d in (random.Random(3).randrange(-(1 << 60), 1 << 60) for _ in range(500)) if d not in values]
    assert all(r.get(d) is None for d in absent)
    with pytest.raises(ValueError):
        w2 = S.Writer(io.BytesIO(), 2)
        w2.add(S.key_of(5), b"")
        w2.add(S.key_of(5), b"")


def test_damage():
    f = io.BytesIO()
    w = S.Writer(f, 2)
    w.add(S.key_of(1), b"abcd")
    w.close()
    data = bytearray(f.getvalue())
    data[18] ^= 1
    r = S.Reader(io.BytesIO(bytes(data)), len(data))
    with pytest.raises(ValueError):
        list(r.scan())


def test_whole_table(spark, documents, rng):
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [prose(rng, 50) for _ in range(40)] + ["", None, "x<|endoftext|> y", "日本 語 \x1c\x85 ñ  \n\n", "I'll\u2009go 12", "é" * 50_000]
    rows = [(k * 7 - 50, t) for k, t in enumerate(texts)] + [(-50, texts[0]), (None, "null id"), (None, None)]
    rng.shuffle(rows)
    docs = documents(rows)
    shards = S.write_shards(docs, path)
    got = S.read_shards(spark, shards).orderBy("start").collect()
    start = 0
    for (doc, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert list(S.find_document(shards, -50, 1)) == [*library.encode(texts[0], add_special_tokens=False).ids, 2]
    assert S.find_document(shards, 12345) is None
    assert S.read_shards(spark, S.write_shards(documents([]), path)).count() == 0
