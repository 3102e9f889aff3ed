import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import packing
from marginalia.llm.tokens import tokenizer_path
from tests.llm import edge


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 50, 200])
    lengths = [min(capacity, max(1, int(r.expovariate(1 / (capacity / 3))))) for _ in range(400)]
    hist = Counter(lengths)
    table = packing.plan(hist, capacity)
    used = defaultdict(list)
    ranks = defaultdict(list)
    for n, first, count, seq, off in table:
        for k in range(count):
            used[seq + k].append((off, n))
            ranks[n].append(first + k)
    assert {n: sorted(v) for n, v in ranks.items()} == {n: list(range(c)) for n, c in hist.items()}
    for parts in used.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    assert len(used) == best_fit(lengths, capacity)


def test_pack_documents(spark):
    docs = edge.rows() + [(500 + i, "some words " * (i * 7 % 300)) for i in range(80)]
    got = packing.pack(edge.frame(spark, docs)).collect()
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(seqs) == best_fit([r.length for r in got], 2048)


def test_empty_table(spark):
    assert packing.pack(edge.empty(spark)).collect() == []
