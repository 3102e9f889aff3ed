"""Likeness of contexts and candidate texts: term vectors, tf/df over a candidate list, names against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import case_of, cosine, name_match, strip_accents

# A short list of words without content.
STOP_WORDS = """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does
down during each few for from further had has have he her here him his how i if in into is it its just me more most my no nor not of off on once only or
other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your""".split()
# End of fixed values.


def term_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, term, tf of the column's lower-cased letter and digit runs."""
    terms = F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tf_idf(df: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """key, term, weight: (tf / length of the text in terms) * ln(texts / texts with the term)."""
    counts = term_counts(df, column, key)
    length = Window.partitionBy(key)
    counts = counts.withColumn("len", F.sum("tf").over(length))
    n = df.select(key).distinct().count()  # one number
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(seen, "term").select(key, "term", (F.col("tf") / F.col("len") * F.log(n / F.col("df"))).alias("weight"))


def _cosine(a: DataFrame, b: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """a (keys, term, x), b (keys, extra, term, y) -> keys, extra, cosine."""
    dot = b.join(a, [*keys, "term"]).groupBy(*keys, *extra).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na = a.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na"))
    nb = b.groupBy(*keys, *extra).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"))
    j = nb.join(na, keys).join(dot, [*keys, *extra], "left")
    return j.select(*keys, *extra, F.round(F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def tf_icf(contexts: DataFrame, cands: DataFrame, space_term: bool = False) -> DataFrame:
    """Cosine of an entity's context and each of its candidates, terms weighed by tf / df over that entity's list.

    contexts (entity_id, text), cands (entity_id, inst, text). space_term: every text also has one term in common, so
    that no cosine is 0.
    """
    c, t = term_counts(contexts, "text", "entity_id"), term_counts(cands, "text", "entity_id", "inst")
    if space_term:
        c = c.unionByName(contexts.select("entity_id", F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")).distinct())
        t = t.unionByName(cands.select("entity_id", "inst", F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")).distinct())
    df = t.groupBy("entity_id", "term").agg(F.count("*").alias("df"))
    x = c.join(df, ["entity_id", "term"], "left").select("entity_id", "term", (F.col("tf") / F.coalesce("df", F.lit(1))).alias("x"))
    y = t.join(df, ["entity_id", "term"]).select("entity_id", "inst", "term", (F.col("tf") / F.col("df")).alias("y"))
    return _cosine(x, y, ["entity_id"], ["inst"])


def text_vectors(df: DataFrame, column: str, term_vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, vec: the sum of the vectors of a text's terms (term_vectors: term, vec); texts without a known term are left out."""
    counts = term_counts(df, column, *keys).where(~F.col("term").isin(STOP_WORDS))
    parts = counts.join(term_vectors, "term").select(*keys, "tf", F.posexplode("vec").alias("dim", "v"))
    sums = parts.groupBy(*keys, "dim").agg(F.sum(F.col("tf") * F.col("v")).alias("v"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vec"))


def vector_similarities(contexts: DataFrame, cands: DataFrame, texts: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """entity_id, inst, source, cosine: a context's vector against those of what each source says of a candidate.

    contexts (entity_id, text), cands (entity_id, inst), texts (inst, source, text): say, what an inst's own facts, those
    of its neighbours and its abstract say. A candidate or context without a known term has no row for that source.
    """
    x = text_vectors(contexts, "text", term_vectors, "entity_id").withColumnRenamed("vec", "x")
    y = text_vectors(texts, "text", term_vectors, "inst", "source").withColumnRenamed("vec", "y")
    j = cands.select("entity_id", "inst").distinct().join(x, "entity_id").join(y, "inst")
    return j.select("entity_id", "inst", "source", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def label_similarity(mention: Column, labels: Column, sentence_case: Column | None = None, wrong_case: float = 0.9) -> Column:
    """Best likeness of a mention's text to any label; times wrong_case where just one of both is in capitals and the sentence is not."""

    def one(label: Column) -> Column:
        score = name_match(strip_accents(F.lower(mention)), strip_accents(F.lower(label)))
        odd = (case_of(mention) == "UPPER") != (case_of(label) == "UPPER")
        if sentence_case is not None:
            odd = odd & sentence_case.isin("title", "sentence")
        return F.when(odd, score * wrong_case).otherwise(score)

    return F.array_max(F.transform(labels, one))
