"""Negation, time and experiencer of concepts, from trigger terms in their sentence.

A trigger's scope goes from its start to the first termination term after it, or to the end of the sentence. A concept
within the scope of a negation trigger is Negated unless a pseudo trigger stands in that scope; it takes the value of
the first temporality trigger whose scope holds it; and Other as experiencer if an experiencer trigger's scope does.
Without triggers it is Affirmed, Recent and about the Patient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scopes(triggers: DataFrame, terminations: DataFrame, sentences: DataFrame) -> DataFrame:
    """triggers (doc_id, sent_no, start, stop, kind, value, pseudo) with scope_stop, found in one pass over each sentence.

    Terminations and triggers are sorted together; the next termination is a running minimum from behind.
    """
    both = triggers.withColumn("_end", F.lit(None).cast("int")).unionByName(terminations.select("doc_id", "sent_no", "start", "stop", F.col("start").alias("_end")), allowMissingColumns=True)
    w = Window.partitionBy("doc_id", "sent_no").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    nearest = both.withColumn("_next", F.min("_end").over(w)).where("kind is not null").drop("_end")
    ends = sentences.select("doc_id", "sent_no", F.col("stop").alias("_stop"))
    return nearest.join(ends, ["doc_id", "sent_no"]).withColumn("scope_stop", F.coalesce("_next", "_stop")).drop("_next", "_stop")


def tag(concepts: DataFrame, triggers: DataFrame, terminations: DataFrame, sentences: DataFrame) -> DataFrame:
    """concepts (doc_id, sent_no, ann_id, start, stop) with negation, temporality, experiencer."""
    s = scopes(triggers, terminations, sentences)
    pseudo = s.where("pseudo").select("doc_id", "sent_no", F.col("start").alias("p"), F.col("kind").alias("k"))
    real = s.where("not pseudo")
    hid = real.join(pseudo, ["doc_id", "sent_no"]).where("k = kind and p >= start and p < scope_stop").select("doc_id", "sent_no", "start", "kind").distinct()
    real = real.join(hid, ["doc_id", "sent_no", "start", "kind"], "left_anti").select("doc_id", "sent_no", F.col("start").alias("t"), "scope_stop", "kind", "value")
    hits = concepts.join(real, ["doc_id", "sent_no"]).where("start >= t and stop <= scope_stop")
    first = F.min(F.when(F.col("kind") == "temporality", F.struct("t", "value")))
    got = hits.groupBy("doc_id", "sent_no", "ann_id").agg(F.max(F.col("kind") == "negation").alias("neg"), first.alias("tmp"), F.max(F.col("kind") == "experiencer").alias("exp"))
    j = concepts.join(got, ["doc_id", "sent_no", "ann_id"], "left")
    return j.select(*concepts.columns, F.when(F.col("neg"), "Negated").otherwise("Affirmed").alias("negation"), F.coalesce(F.col("tmp.value"), F.lit("Recent")).alias("temporality"), F.when(F.col("exp"), "Other").otherwise("Patient").alias("experiencer"))
