"""Steps that must not grow faster than their input: what their plans hold, and the same rows as the plain forms."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import spans, tagging, tokens
from marginalia.plans import registry

SF = "/root/testdata/sf0.001"
ODD = ["Dr. A. x", "\U0001d400Dr. No", "a \U0001d400. B", "\U0001f600Dr. x", "..... x", "a.... b", "", "   ", "\n\n\n", "a\n\nb\n\n\n c", "AB. c", "e.g. x", "! ? .", "É. B", "1Dr. x", "a! b. ", "A.  b", None, "\tx. ", "x \n"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("lines", [False, True])
def test_sentence_texts(spark, lines):
    d = docs(spark, *ODD)
    same(tokens.sentence_texts(d, lines).select("doc_id", "sent_no", "start", "stop", "string"), tokens.sentences(tokens.tokenize(d), lines).select("doc_id", "sent_no", "start", "stop", "string"))


def test_words(spark):
    d = docs(spark, *ODD)
    same(tokens.words(d).drop("tok_no"), tokens.visible(tokens.tokenize(d)).drop("tok_no"))


def test_parts_follow_the_texts(spark):
    """Texts are dealt into parts of bounded size, however few partitions the session has."""
    assert tokens.tokenize(docs(spark, *["word " * 200_000] * 12)).rdd.getNumPartitions() == 6


def test_near_tokens(spark):
    t = tokens.words(docs(spark, "no a no b c d e not", "a b no"))
    spots = t.where("string in ('no', 'not')").withColumn("ann_id", F.col("tok_no"))
    cols = ["doc_id", "ann_id", "tok_no", "string"]
    same(spans.near_tokens(t, F.col("string").isin("no", "not"), 2).select(cols), spans.context_tokens(spots, t, 2).select(cols))


def test_overlap_sums(spark):
    e = spark.range(400).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("ann_id"), (F.col("id") * 37 % 101 - 20).alias("start"), (F.col("id") % 2).alias("side"), (F.col("id") * 13 % 9).alias("size")).withColumn("stop", F.col("start") + F.col("size"))
    a, b = e.where("side = 0").drop("side", "size"), e.where("side = 1").drop("side", "size")
    pairs = a.alias("a").join(b.alias("b"), F.expr("a.doc_id = b.doc_id and a.start < b.stop and b.start < a.stop"))
    for bucket in (7, 4096):
        same(spans.overlap_sums(a, b, bucket=bucket), pairs.groupBy("a.doc_id", "a.ann_id").agg(F.count("*"), F.sum("b.ann_id")))
    got = registry.QUERIES["interval_overlap_bucketed"](spark, SF)
    assert "b_start" not in plan(got)


def test_marked(spark):
    s = spark.createDataFrame([(1, 0, 5, 7), (1, 6, 9, 8), (2, 3, 4, 9)], "doc_id long, start int, stop int, k int")
    a = spark.createDataFrame([(1, 0, 5), (1, 4, 7), (1, 6, 6), (2, 0, 1), (3, 0, 1)], "doc_id long, start int, stop int")
    assert {(r.doc_id, r.start, r.b_k) for r in spans.marked(a, s).collect()} == {(1, 0, 7), (1, 4, None), (1, 6, 8), (2, 0, None), (3, 0, None)}


def test_chunks_of_documents_in_pieces(spark):
    """A document that comes in several batches is chunked as a whole."""
    t = spark.range(50).select((F.col("id") / 20).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("sent_no"), F.col("id").cast("int").alias("tok_no"), F.lit("x").alias("string"), F.when(F.col("id") % 2 == 0, "DT").otherwise("NN").alias("tag"))
    whole = tagging.chunk_nouns(t, ["I B T=I:-1 P=DT"]).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tagging.chunk_nouns(t, ["I B T=I:-1 P=DT"]).collect()) == sorted(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.chunk == "B" for r in whole) == 25 - 3


@pytest.mark.parametrize("name", ["entity_cascade", "name_variants", "name_grammar", "pair_related_filter"])
def test_no_broadcast_by_estimate(spark, name):
    """Rows that are derived from a table are not broadcast because its file is small."""
    text = plan(registry.QUERIES[name](spark, SF))
    first = [next(y for y in x.splitlines()[1:] if "Scan" in y) for x in text.split("BroadcastExchange")[1:]]
    assert "SortMergeJoin" in text and all("LocalTableScan" in y for y in first)


@pytest.mark.parametrize("name", ["noun_context", "context_window_tokens", "stop_word_filter"])
def test_tokens_stay(spark, name):
    """Texts are dealt once: no join or window shuffles their tokens."""
    text = plan(registry.QUERIES[name](spark, SF))
    assert "Exchange hashpartitioning(doc_id" in text and "tok_no" not in "".join(x for x in text.splitlines() if "Exchange" in x)
