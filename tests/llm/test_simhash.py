import random
import re

import pytest
import xxhash

from marginalia.llm import common, simhash
from tests.llm import edge


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs):
    fp = [(d, fingerprint(t)) for d, t in docs]
    root = {f: f for _, f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, f in fp:
        least[find(f)] = min(least.get(find(f), d), d)
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in fp)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        t = [r.choice(words) for _ in range(r.randint(60, 300))]
        docs.append((1000 + 10 * i, " ".join(t)))
        for k in range(3):
            t = list(t)
            t[r.randrange(len(t))] = r.choice(words)
            docs.append((1000 + 10 * i + k + 1, " ".join(t).upper() if k == 1 else "\n".join(t)))
    return docs + edge.rows() + [(3000 + i, "tiny text") for i in range(20)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    docs = corpus(hot)
    got = sorted(tuple(r) for r in simhash.simhash_dedup(edge.frame(spark, docs)).collect())
    assert got == brute(docs)
    assert len({c for *_, c in got}) < len({f for _, f, _ in got})  # some do link


def test_links_between_planted_fingerprints(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        a = f ^ (1 << r.randrange(64))
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        fps |= {a, b, b ^ (1 << r.randrange(64))}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    got = {r_.doc_id: r_.component_id for r_ in simhash.components(df).collect()}
    fs = sorted(fps)
    root = list(range(len(fs)))
    for i in range(len(fs)):
        for j in range(i):
            if (fs[i] ^ fs[j]).bit_count() <= 2 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    assert got == dict(enumerate(root))


def test_empty_table(spark):
    assert simhash.simhash_dedup(edge.empty(spark)).collect() == []


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else {b""}


def groups_by_hand(docs, similarity=0.8):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(sets))


@pytest.mark.parametrize("hot", [4096, 25, 3])
def test_near_groups_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    r = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    docs, base = [], [r.choice(words) for _ in range(120)]
    for i in range(30):
        t = [r.choice(words) for _ in range(r.randint(10, 150))]
        docs.append((20_000 + i * 10, " ".join(t)))
        for k in range(1, 6):  # fewer and more edits than a similarity of 0.8 allows
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = r.choice(words)
            docs.append((20_000 + i * 10 + k, " ".join(u)))
    for k in range(60):  # a large group of near copies of one text
        u = list(base)
        u[r.randrange(len(u))] = r.choice(words)
        docs.append((5000 + k, " ".join(u)))
    docs += edge.rows() + [(7000, "tiny"), (7001, "TINY"), (7002, " \n ")]
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_groups(edge.frame(spark, docs)).collect())
    assert got == groups_by_hand(docs)


def test_jaccard_of_sketches():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m, shared in ((50, 60, 30), (100, 100, 100), (0, 0, 0), (5000, 4000, 3500), (160, 400, 150)):
        both = r.choice(2**32 - 2, shared + n + m, replace=False).astype("<u4")
        a, b = np.sort(np.concatenate([both[:shared], both[shared : shared + n - shared]])), np.sort(np.concatenate([both[:shared], both[shared + n : shared + n + m - shared]]))
        g = simhash.grid([a[: simhash.SKETCH].tobytes(), b[: simhash.SKETCH].tobytes()])
        got = simhash.jaccard(g[:1], np.array([len(a)]), g[1:], np.array([len(b)]))[0]
        want = shared / max(1, len(a) + len(b) - shared)
        assert abs(got - want) < (1e-9 if max(n, m) <= simhash.SKETCH else 0.12)


def test_near_groups_of_long_texts(spark):
    """Texts of 200 to 2,000 words, longer than a sketch, on both sides of the similarity asked for."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.randint(200, 2000))]
        docs.append((10_000 + i * 10, " ".join(t)))
        for k in range(1, 5):  # an edit touches five shingles, so similarities are 0.75 to 0.85
            u = list(t)
            for at in r.sample(range(len(u)), round(len(u) * r.uniform(0.018, 0.03))):
                u[at] = "new" + r.choice(words)
            docs.append((10_000 + i * 10 + k, " ".join(u)))
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_groups(edge.frame(spark, docs)).collect())
    want = groups_by_hand(docs)
    assert got == want and len(docs) > len({c for _, c in want}) > 60


def test_refuted_links_give_way_to_others(spark, monkeypatch):
    """With a margin that lets every pair through, forests hold many false links, and nothing else may change."""
    monkeypatch.setattr(simhash, "MARGIN", 0.6)
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(400)]
    docs = []
    for i in range(80):
        u = list(base)
        for at in r.sample(range(len(u)), r.randint(2, 14)):
            u[at] = "new" + r.choice(words)
        docs.append((i, " ".join(u)))
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_groups(edge.frame(spark, docs)).collect())
    assert got == groups_by_hand(docs)


def test_keep_distinct(spark):
    """One row of each group stays, of rows that share a doc_id with other texts too; columns are kept."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = lambda: " ".join(r.choice(words) for _ in range(60))
    a, b, c = text(), text(), text()
    docs = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (5, None), (6, ""), (7, "tiny")]
    df = edge.frame(spark, docs)
    got = simhash.keep_distinct(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id, x.text or "") for x in got.collect()) == sorted([(1, a), (1, b), (4, c), (5, ""), (7, "tiny")])
    assert simhash.keep_distinct(edge.empty(spark)).collect() == []


def test_repeated_lines_do_not_part_equal_sets(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(120):
        t = " ".join(r.choice(words) for _ in range(r.randint(150, 400)))
        line = " ".join(r.choice(words) for _ in range(6))
        docs += [(1000 + 2 * i, f"{t} {line}"), (1001 + 2 * i, f"{t} " + " ".join([line] * 1000))]
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_groups(edge.frame(spark, docs)).collect())
    assert got == [(d, d - d % 2) for d, _ in docs]


def test_texts_of_a_common_line_meet_in_few_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 30)
    monkeypatch.setattr(simhash, "COMMON", 10)
    r = random.Random(8)
    line = "all rights reserved by the house that made this text for its many readers"
    docs = [(i, line + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(12))) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(20)]
    met, by_key = [], simhash.by_key
    monkeypatch.setattr(simhash, "by_key", lambda rows, *rest: met.append(rows.count()) or by_key(rows, *rest))
    got = simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: d % 1000 for d, _ in docs}
    assert met[0] < 10 * len(docs)


@pytest.mark.parametrize("few", [common.FEW_EDGES, 0])
def test_components_of_few_edges_take_few_jobs(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(-5, 700), (700, 700)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup(f"components-{few}", "components")
    found = common.connected_components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{few}"))
    spark.sparkContext.setJobGroup("", "")
    found = {x.node: x.root for x in found.collect()}
    assert {n: found.get(n, n) for n in root} == root
    assert (jobs <= 6) == (few > 0)
    assert common.connected_components(edges.where("a > 1000")).collect() == []
