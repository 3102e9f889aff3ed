"""The pipeline against its stages done by hand, and each registered query on the smallest tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import queries, secrets, toxicity
from tests import oracle
from tests.llm import edge, test_packing, test_simhash
from tests.llm.test_toxicity import corpus

SF = "/root/testdata/sf0.001"


def test_pipeline_by_hand(spark, tmp_path):
    docs, labels = corpus(300, seed=4)
    r = random.Random(2)
    docs += [(1000 + i, docs[i][1]) for i in range(40)]
    for i in range(40, 60):
        t = docs[i][1].split() * 4
        docs.append((2000 + i, " ".join(t)))
        t[r.randrange(len(t))] = "changed"
        docs.append((2100 + i, " ".join(t)))
    docs += [(3000, None), (3001, ""), (3002, 'the password = "h7Gk29sLqPzX81vB" of ' + " ".join(docs[5][1].split()[::-1]))]
    df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = {x.doc_id: x.predicted for x in toxicity.score(stored, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [(d, t) for d, t in docs if not scored[d]]
    assert 0 < len(left) < len(docs)
    last = {}
    for d, t in left:
        last[t or ""] = max(last.get(t or "", -1), d)
    left = [(d, t) for d, t in left if last[t or ""] == d]
    kept = {c for _, c in test_simhash.groups_by_hand(left)}
    assert len(kept) < len(left)
    clean = {d: t for d, t in left if d in kept}
    assert {x.doc_id for x in got} == kept
    masked = {d: t for d, t in clean.items() if t}
    found = secrets.findings(list(masked.values()), secrets.forest())
    for (d, t), spans in zip(list(masked.items()), found, strict=True):
        for s, e, p in reversed(spans):
            if p >= 0.5:
                t = t[:s] + secrets.MASK + t[e:]
        masked[d] = t
    assert any(secrets.MASK in t for t in masked.values())
    from tokenizers import Tokenizer

    from marginalia.llm.tokens import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {d: len(lib.encode(masked.get(d, ""), add_special_tokens=False).ids) + 1 for d in kept}
    have = {}
    for x in got:
        have[x.doc_id] = have.get(x.doc_id, 0) + x.length
    assert have == want
    assert len({x.sequence_id for x in got}) == test_packing.best_fit([x.length for x in got], 2048)


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_other_columns_alone(spark, tmp_path, name, stage):
    docs, labels = corpus(150, seed=4)
    docs = edge.rows() + docs + [(5000, 'the password = "h7Gk29sLqPzX81vB" here')]
    df = edge.frame(spark, docs)
    for c in ("_sha", "_keep", "row", "id", "sign", "mark", "redacted", "th", "n", "k", "keys", "digest", "copies", "predicted", "result"):
        df = df.withColumn(c, F.when(F.col("doc_id") % 3 > 0, F.lit(2**53 + 1) + F.col("doc_id")))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, df, str(tmp_path))
    assert got.columns == df.columns
    changed = {"text", "n_chars"} if name == "secrets" else set()
    same = [c for c in df.columns if c not in changed]
    before, after = (Counter(tuple(r[c] for c in same) for r in x.collect()) for x in (df, got))
    assert after and not after - before
    if name == "secrets":
        assert after == before


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        oracle.compare(got, oracle.expected(queries.ORACLES[name], SF))
    elif not name.startswith(("op6", "op7")):
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
