import hashlib
import random
import zlib

import numpy as np
import pytest

from marginalia.llm import sentencepiece_ops as S
from marginalia.llm.tokens import tokenizer_path
from tests.llm import edge


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(tokenizer_path(S.PIECES))


def brute(v, text):
    """Best cut of the whole text: a plain dynamic programme over all pieces. Gives the score."""
    s = S.MARK + text.replace(" ", S.MARK)
    table = {p.decode("utf-8", "ignore").replace(" ", S.MARK): sc for p, sc in zip(v.pieces, v.scores, strict=True) if np.isfinite(sc)}
    best = [0.0] + [-1e18] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 40), j):
            if s[i:j] in table:
                best[j] = max(best[j], best[i] + table[s[i:j]])
        if s[j - 1] not in table:
            best[j] = max(best[j], best[j - 1] + v.unknown)
    return best[-1]


def test_double_array_holds_its_keys():
    r = random.Random(2)
    keys = {bytes(r.choice(b"abc\xff\x00") for _ in range(r.randint(1, 9))): i for i in range(2000)}
    trie = S.DoubleArray(keys)

    def get(k):
        node = np.array([0])
        for b in k:
            node = trie.step(node, np.array([b]))
            if node[0] < 0:
                return -1
        return int(trie.value[node[0]])

    assert all(get(k) == i for k, i in keys.items())
    assert all(get(k) == keys.get(k, -1) for k in (bytes(r.choice(b"abc\xff\x00") for _ in range(r.randint(1, 9))) for _ in range(500)))


def test_best_score_and_round_trip(vocabulary):
    r = random.Random(5)
    enc = S.Encoder(vocabulary)
    texts = ["", "hello world", "  two  spaces ", "Ünï 日本 🙂x", "a\nb\n\nc", "\t", "x" * 50] + ["".join(r.choice("the and ing éß日\n") for _ in range(r.randint(1, 40))) for _ in range(60)]
    for t, ids in zip(texts, enc.ids(texts), strict=True):
        assert enc.decode(ids).decode() == t
        if t:
            score, run = 0.0, 0
            is_byte = set(vocabulary.byte_id.tolist())
            raw = b""
            for i in ids.tolist():
                if i in is_byte and not np.isfinite(vocabulary.scores[i]):
                    raw += vocabulary.pieces[i]
                else:
                    score += float(vocabulary.scores[i])
            run = len(raw.decode())
            assert abs(score + run * vocabulary.unknown - brute(vocabulary, t)) < 1e-6, repr(t)


def test_documents(spark):
    docs = edge.rows()
    got = S.encode_documents(edge.frame(spark, docs)).collect()
    assert len(got) == len(docs) and all(r.round_trip for r in got)
    enc = S.Encoder(S.Vocabulary(tokenizer_path(S.PIECES)))
    for r in got:
        t = next(t for d, t in docs if d == r.doc_id)
        ids = enc.ids([t])[0]
        assert (r.n_tokens, r.ids_crc32, r.decoded_sha256) == (len(ids), zlib.crc32(ids.astype("<u4")), hashlib.sha256((t or "").encode()).hexdigest())
    assert S.encode_documents(edge.empty(spark)).collect() == []
