import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from marginalia.llm import toxicity
from tests.llm import edge

BAD = ["grobian", "stinker", "dullard", "wretch"]


def corpus(n=900, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "lo", "mi", "ta", "sen"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = int(r.random() < 0.2)
        if toxic:
            for _ in range(r.randint(2, 5)):
                t[r.randrange(len(t))] = r.choice(BAD) + r.choice(["", "s", "ly"])
        docs.append((i, " ".join(t)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(edge.frame(spark, docs), lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(200)
    flip = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(edge.frame(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flip))
    assert a == b


def test_sample_is_bounded_and_distinct(spark):
    docs = [(i, f"text {i % 7}") for i in range(300)]
    labels = [(i, i % 2) for i in range(300)]
    rows = toxicity.sample(edge.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), max_rows=5).collect()
    texts, ys = [r.text for r in rows], [r.toxic for r in rows]
    assert len(texts) == 10 and sum(ys) == 5 and len(set(zip(texts, ys, strict=True))) == 10


def test_edges(spark):
    docs, labels = corpus(120)
    lab = spark.createDataFrame([*labels, (0, None), (1, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score(edge.frame(spark, edge.rows() + docs), lab).collect()
    assert len(got) == len(edge.rows() + docs)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(edge.frame(spark, docs[:5]), none).collect()} == {0.0}
    assert toxicity.score(edge.empty(spark), lab).collect() == []


def plain_ratio(counts, word):
    """Kneser-Ney by dictionaries, gram by gram."""
    grams = lambda w, n: [w[max(0, i - n) : i] if i >= n else None for i in range(1, len(w) + 1)]
    raw = lambda w: b"\1" + w.strip(toxicity.EDGE).encode() + b"\2"
    num = {(n, y): Counter() for n in range(1, toxicity.ORDER + 1) for y in (0, 1)}
    for y in (0, 1):
        for w, c in counts[y].items():
            for n in range(1, toxicity.ORDER + 1):
                for g in filter(None, grams(raw(w), n)):
                    num[n, y][g] += c if n == toxicity.ORDER else 1
    shared = num[1, 0] + num[1, 1]
    shared.pop(b"\1")
    seq, out = raw(word), 0.0
    for i in range(1, len(seq)):
        p = [0.0, 0.0]
        for y in (0, 1):
            p[y] = (shared[seq[i : i + 1]] + 0.1) / (sum(shared.values()) + 25.6)
            for n in range(2, min(i + 1, toxicity.ORDER) + 1):
                context, gram = seq[i - n + 1 : i], seq[i - n + 1 : i + 1]
                after = [c for g, c in num[n, y].items() if g[:-1] == context]
                if after:
                    down = toxicity.DISCOUNT * len(after) + toxicity.STRENGTH
                    p[y] = (max(num[n, y][gram] - toxicity.DISCOUNT, 0) + down * p[y]) / (sum(after) + toxicity.STRENGTH)
        out += math.log(max(p[1], 1e-9)) - math.log(max(p[0], 1e-9))
    return out


def test_ratios_against_plain_kneser_ney():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 14)))
    counts = {y: Counter({word(): r.randint(1, 5) for _ in range(60)}) for y in (0, 1)}
    asked = [*list(counts[0])[:15], *list(counts[1])[:15], *[word() for _ in range(20)], "zz", "(ab)"]
    got = toxicity.Model(counts).ratios(asked)
    for w, x in zip(asked, got, strict=True):
        assert abs(x - plain_ratio(counts, w)) < 1e-3, w


def test_filter_keeps_columns_of_any_name(spark):
    docs, labels = corpus(200)
    df = edge.frame(spark, edge.rows() + docs).withColumn("big", F.when(F.col("doc_id") % 2 == 0, F.lit(2**53 + 1))).withColumn("predicted", F.lit(7))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.ordinary(df, lab)
    assert got.schema == df.schema
    scored = Counter((r.doc_id, r.predicted) for r in toxicity.score(df, lab).collect())
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: n for (d, p), n in scored.items() if not p})
    assert {r.big for r in got.collect()} == {None, 2**53 + 1} and {r.predicted for r in got.collect()} == {7}


def test_parts_of_long_runs_cover_them():
    for n in (1, 39, 40, 41, 59, 60, 61, 80, 81, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.words("ab " + run + " cd")[1:-1]
        assert max(map(len, parts)) <= 40 and set("".join(parts)) == set(run)
        assert all(any(run[i : i + 20] in p for p in parts) for i in range(n))


def test_expression_late_in_a_long_run():
    docs, labels = corpus()
    scorer = toxicity.train([t for _, t in docs], [y for _, y in labels])
    clean = [t.split() for (_, t), (_, y) in zip(docs, labels, strict=True) if not y and len(t) > 600][:20]
    for glue in ("_", ","):
        runs = [glue.join(t) for t in clean]
        bad = [glue.join([*t, "grobian", "stinkers", "dullard", *t[:2]]) for t in clean]
        low, high = scorer.scores(runs), scorer.scores(bad)
        assert (high > low).all() and high.mean() > 0.5 > low.mean()


def test_text_without_spaces(spark):
    r = random.Random(7)
    signs, bad = [chr(0x4E00 + i) for i in range(300)], ["\u9b31\u9b32\u9b33", "\u9e1f\u9e20\u9e21\u9e22"]
    docs, labels = [], []
    for i in range(400):
        t = [r.choice(signs) for _ in range(r.randint(100, 300))]
        toxic = int(i % 3 == 0)
        if toxic:
            t[r.randrange(60, len(t))] = r.choice(bad)
        docs.append((i, "".join(t)))
        labels.append((i, toxic))
    got = toxicity.score(edge.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = dict(labels)
    held = [x.predicted == want[x.doc_id] for x in got if x.held_out]
    assert sum(held) / len(held) > 0.95
