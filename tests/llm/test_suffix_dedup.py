"""Suffix-array dedup against brute force over all window positions."""

import hashlib
import random
from collections import Counter

import pytest

from marginalia.llm import suffix_dedup
from tests.llm import edge


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n=40):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = [text(r.randint(150, 500)) for _ in range(6)]
    docs = [(i, "".join([text(r.randint(0, 200)), *[x for s in r.sample(shared, 2) for x in (s[r.randint(0, 40) :], text(r.randint(0, 60)))]])) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "a" * 1500), (n + 3, docs[0][1]), (n + 4, docs[0][1]), (n + 4, docs[0][1]), (n + 5, "ab" * 400), (n + 6, text(20000) + shared[0] + text(100) + shared[0])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, cls string")
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == brute(docs, suffix_dedup.LENGTH)


def test_hot_anchor_is_split_and_merged(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", 3)
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df).collect()) == brute(docs, suffix_dedup.LENGTH)


def test_many_rows_of_one_hot_run(spark, monkeypatch):
    """A passage in 1,000 texts: most times in equal surroundings, in others in surroundings of its own."""
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", 40)
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage, around = text(170), text(300)
    docs = [(i, text(30) + around + passage + around + text(30)) for i in range(800)]
    docs += [(800 + i, text(r.randint(40, 300)) + around[r.randint(0, 300) :] + passage + around[: r.randint(0, 300)] + text(100)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in suffix_dedup.suffix_dedup(df).collect()) == brute(docs, suffix_dedup.LENGTH)


@pytest.mark.parametrize("rows", [edge.rows(), [(1, "a" * 400), (1, "b" * 400), (1, "a" * 400)]])
def test_edges(spark, rows):
    got = sorted(tuple(x) for x in suffix_dedup.suffix_dedup(edge.frame(spark, rows)).collect())
    assert got == brute(rows, suffix_dedup.LENGTH)


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
