import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from marginalia.llm import fingerprints
from tests.llm import edge


def unique_docs():
    seen = {}
    for d, t in edge.rows():
        seen.setdefault(d, t)
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    return sorted(seen.items()) + [(5000 + 37 * i, " ".join(r.choice(words) for _ in range(r.randint(0, 900)))) for i in range(60)]


def test_edits_and_columns(spark):
    docs = unique_docs()
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(edge.frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + u[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), d
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = [got[2].fingerprint, got[3].fingerprint]
    assert same[0] == same[1]
    assert got[0].fingerprint == got[1].fingerprint  # null and empty
    assert got[2].near_next == 1.0


def test_likeness_and_containment_estimate_the_truth(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(4000)]
    part = base[:1000]
    half = base[:2000] + [f"v{i}" for i in range(2000)]
    df = spark.createDataFrame([(" ".join(base), " ".join(half), " ".join(part))], "a string, b string, c string")
    s = lambda c: fingerprints.sketch(F.col(c))
    like, inside, merged = df.select(fingerprints.likeness(s("a"), s("b")), fingerprints.containment(s("c"), s("a")), F.size(fingerprints.merge(s("a"), s("c"))) == F.size(s("a")["kept"])).first()
    assert abs(like - 1 / 3) < 0.08 and inside == 1.0 and merged


def test_repeated_rows_and_empty_table(spark):
    got = fingerprints.fingerprint_documents(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    assert fingerprints.fingerprint_documents(edge.empty(spark)).collect() == []


def chained(values):
    """Spark's xxhash64 of several longs: each is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), h)
    return h


def plain(text):
    """Fingerprint, kept hashes and mark of a text, word by word."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t\n\r\f\x0b]+", text) if w]
    every = [chained(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chained(words)] if words else []
    kept = {h >> 32 for h in every if h >> (64 - fingerprints.SHIFT) == 0}
    kept = sorted(kept)
    return ("".join(f"{h:08X}".lower() for h in kept) if kept else f"={chained(words):016x}"), set(kept), chained(words)


def alike(a, b):
    return float(a[2] == b[2]) if not a[1] | b[1] else len(a[1] & b[1]) / len(a[1] | b[1])


def test_against_brute_force(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice(["ab", "cd\n", "é", "🙂x", "longer"]) for _ in range(r.randint(0, 90))) for _ in range(60)] + ["", None, "one two", "a  b\tc d e f g h"]
    texts += [texts[0], texts[5] + " x"]
    docs = [(7 * i + (i % 3) * 1000, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in fingerprints.fingerprint_documents(edge.frame(spark, docs)).collect()}
    docs.sort()
    for (d, t), (_, n) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = plain(t), plain(edited), plain(n)
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (a[0], b[0]), (t, x.fingerprint, a[0])
        assert abs(x.near_edited - alike(a, b)) < 1e-12 and abs(x.near_next - alike(a, c)) < 1e-12
