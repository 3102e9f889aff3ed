import hashlib
from collections import Counter, defaultdict

from marginalia.llm import exact_dedup
from tests.llm import edge


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return Counter((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


def test_against_brute_force(spark):
    docs = edge.rows() + [(200 + i, f"t{i % 40}") for i in range(300)]
    assert Counter(map(tuple, exact_dedup.exact_dedup(edge.frame(spark, docs)).collect())) == brute(docs)


def test_index_over_batches(spark):
    """Keep ids and group sizes are right after each batch, in whatever order batches come; only new digests are fresh."""
    batch = lambda rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    name = "digest_index_test"
    exact_dedup.DigestIndex(spark, name).drop()
    index = exact_dedup.DigestIndex(spark, name, 4)
    parts = [[(i, "same") for i in range(10)] + [(50, None)], [(i, "same") for i in range(10, 30)] + [(40, "")], [], [(5, "same"), (31, "other"), (3, "other")]]
    seen = []
    for rows in parts:
        texts = {t or "" for _, t in seen}
        fresh = index.add(batch(rows)).collect()
        assert len(fresh) == len({t or "" for _, t in rows} - texts)
        seen += rows
        again = exact_dedup.DigestIndex(spark, name, 4)  # found by its name
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.doc_id == r.keep_id, r.digest.hex()) for r in again.match(batch(seen)).collect())
        assert got == Counter((d, k, n, kept, hashlib.sha256(t.encode()).hexdigest()) for (d, k, n, kept, _), t in [(x, y) for x, y in zip(rows_of(seen), [t or "" for _, t in seen], strict=True)])
    plan = index.fresh(batch(parts[0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    index.drop()
    assert not index.exists()


def rows_of(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return [(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), t) for d, t in docs]


def test_hot_digests_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    docs = [(i, "hot" if i % 2 else f"t{i % 30}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.exact_dedup(df).collect())) == brute(docs)


def test_keep_distinct_keeps_columns(spark):
    df = edge.frame(spark)
    got = exact_dedup.keep_distinct(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len({t or "" for _, t in edge.rows()})
    best = defaultdict(int)
    for d, t in edge.rows():
        best[t or ""] = max(best[t or ""], d)
    assert {(d, t or "") for d, t in kept} == {(d, t) for t, d in best.items()}


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(edge.empty(spark)).collect() == []
    assert exact_dedup.keep_distinct(edge.empty(spark)).collect() == []
