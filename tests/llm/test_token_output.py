import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import token_output as T
from marginalia.llm.tokens import tokenizer_path
from tests.llm import edge


def streams():
    r = np.random.default_rng(3)
    yield from (np.zeros(0, np.uint16), np.zeros(5000, np.uint16), np.arange(3000).astype(np.uint16), r.integers(0, 65536, 4000).astype(np.uint16))
    yield np.full(2500, 65535, np.uint16)
    yield np.tile(r.integers(0, 50, 40), 100).astype(np.uint16)
    for _ in range(5):
        yield np.minimum(r.zipf(1.3, r.integers(1, 5000)), 49407).astype(np.uint16)


def test_blocks_round_trip():
    blocks = [s[i : i + T.BLOCK] for s in streams() for i in range(0, len(s), T.BLOCK)]
    packed = T.encode_blocks(blocks)
    for got, want in zip(T.decode_blocks(packed, [len(b) for b in blocks]), blocks, strict=True):
        assert np.array_equal(got, want)
    alone = T.decode_blocks([packed[-1]], [len(blocks[-1])])  # any block can be read alone
    assert np.array_equal(alone[0], blocks[-1])
    regular = [i for i, b in enumerate(blocks) if len(set(b.tolist())) <= 50]
    assert sum(len(packed[i]) for i in regular) < 0.4 * sum(2 * len(blocks[i]) for i in regular)


def test_files_round_trip_and_find_damage():
    ids = [np.append(s, np.uint16(1)) for s in streams()]
    raw = T.file_bytes(list(range(10, 10 + len(ids))), ids)
    docs, back = T.read_file(raw)
    assert docs.tolist() == list(range(10, 10 + len(ids))) and all(np.array_equal(a, b) for a, b in zip(back, ids, strict=True))
    for at in (30, len(raw) - 40):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            T.read_file(bytes(bad))


def test_documents(spark):
    r = random.Random(6)
    seen = dict(reversed(edge.rows()))
    docs = list(seen.items()) + [(900 + 3 * i, " ".join(r.choice(["alpha", "Beta", "γ", "don't", "42"]) for _ in range(r.randint(0, 300)))) for i in range(150)]
    got = sorted((tuple(x) for x in T.token_output(edge.frame(spark, docs)).collect()))
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, at = [], 0
    for d, t in sorted(docs):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    got = T.token_output(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert T.token_output(edge.empty(spark)).collect() == []


def test_store_that_only_spark_can_write(spark, monkeypatch):
    want = sorted(map(tuple, T.token_output(edge.frame(spark)).collect()))
    monkeypatch.setattr(T, "reachable", lambda folder: False)
    assert sorted(map(tuple, T.token_output(edge.frame(spark), "nosuch://bucket/ids").collect())) == want
    monkeypatch.undo()
    assert not T.reachable("s3a://bucket/ids") and T.reachable("file:/tmp/ids")
