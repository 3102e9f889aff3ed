"""Comparison of annotations with a gold standard: pairs, precision, recall and F, best possible recall, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.spans import span_join


def pair_up(keys: DataFrame, responses: DataFrame) -> DataFrame:
    """doc_id, key_id, response_id, outcome: correct, partial, incorrect, missing or spurious.

    Both sides: doc_id, ann_id, start, stop, inst (and type, if both have one: types must agree). Pairs are made one to
    one: of overlapping ones the best kind first (same extent and inst, same extent, same inst, any), then the earlier;
    a pair counts if each is the other's best.
    """
    typed = "type" in keys.columns and "type" in responses.columns
    p = span_join(keys, responses, "overlap")
    p = p.where("type = b_type") if typed else p
    exact, same = (F.col("start") == F.col("b_start")) & (F.col("stop") == F.col("b_stop")), F.col("inst").eqNullSafe(F.col("b_inst"))
    grade = F.when(exact & same, 0).when(same, 1).when(exact, 2).otherwise(3)
    p = p.withColumn("grade", grade)
    k = Window.partitionBy("doc_id", "ann_id").orderBy("grade", "b_start", "b_ann_id")
    r = Window.partitionBy("doc_id", "b_ann_id").orderBy("grade", "start", "ann_id")
    best = p.withColumns({"_k": F.row_number().over(k), "_r": F.row_number().over(r)}).where("_k = 1 and _r = 1")
    outcome = F.when(F.col("grade") == 0, "correct").when(F.col("grade") == 1, "partial").otherwise("incorrect")
    pairs = best.select("doc_id", F.col("ann_id").alias("key_id"), F.col("b_ann_id").alias("response_id"), outcome.alias("outcome"), *(["type"] if typed else []))
    missing = keys.join(pairs.select("doc_id", F.col("key_id").alias("ann_id")), ["doc_id", "ann_id"], "left_anti")
    spurious = responses.join(pairs.select("doc_id", F.col("response_id").alias("ann_id")), ["doc_id", "ann_id"], "left_anti")
    none = F.lit(None).cast("long")
    more = missing.select("doc_id", F.col("ann_id").alias("key_id"), none.alias("response_id"), F.lit("missing").alias("outcome"), *(["type"] if typed else []))
    return pairs.unionByName(more).unionByName(spurious.select("doc_id", none.alias("key_id"), F.col("ann_id").alias("response_id"), F.lit("spurious").alias("outcome"), *(["type"] if typed else [])))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    return F.round(F.when(p + r > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0), 6)


def scores(outcomes: DataFrame, *by: str, beta: float = 1.0) -> DataFrame:
    """Counts, strict and lenient precision, recall and F, for each group and all groups together (rollup: null group)."""
    n = lambda *o: F.sum(F.col("outcome").isin(*o).cast("long"))
    g = outcomes.rollup(*by) if by else outcomes.groupBy()
    t = g.agg(n("correct").alias("correct"), n("partial").alias("partial"), n("incorrect").alias("incorrect"), n("missing").alias("missing"), n("spurious").alias("spurious"))
    c, p = F.col("correct"), F.col("partial")
    resp, key = F.expr("correct + partial + incorrect + spurious"), F.expr("correct + partial + incorrect + missing")
    t = t.withColumns({"p_strict": _ratio(c, resp), "r_strict": _ratio(c, key), "p_lenient": _ratio(c + p, resp), "r_lenient": _ratio(c + p, key)})
    return t.withColumns({"f_strict": f_measure(F.col("p_strict"), F.col("r_strict"), beta), "f_lenient": f_measure(F.col("p_lenient"), F.col("r_lenient"), beta)})


def average(p_strict: Column, p_lenient: Column) -> Column:
    return F.round((p_strict + p_lenient) / 2, 6)


def macro(per_group: DataFrame) -> DataFrame:
    """Mean of each ratio over the groups."""
    return per_group.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_strict", "r_strict", "f_strict", "p_lenient", "r_lenient", "f_lenient")])


def max_recall(keys: DataFrame, mentions: DataFrame, cands: DataFrame) -> DataFrame:
    """found: whether a gold mention's inst is among the candidates of any mention that overlaps it."""
    lists = mentions.select("doc_id", "mention_id", "start", "stop")
    at = span_join(keys, lists, "overlap").select("doc_id", "ann_id", "inst", F.col("b_mention_id").alias("mention_id"))
    hit = at.join(cands.select("doc_id", "mention_id", "inst").distinct(), ["doc_id", "mention_id", "inst"], "left_semi").select("doc_id", "ann_id").distinct().withColumn("found", F.lit(True))
    return keys.join(hit, ["doc_id", "ann_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def differences(reference: DataFrame, response: DataFrame) -> DataFrame:
    """Rows that only one side has, with their number: side is reference or response."""
    cols = reference.columns
    signed = reference.select(*cols, F.lit(1).alias("d")).unionByName(response.select(*cols, F.lit(-1).alias("d")))
    j = signed.groupBy(*cols).agg(F.sum("d").alias("d"))
    return j.where("d <> 0").select(*cols, F.when(F.col("d") > 0, "reference").otherwise("response").alias("side"), F.abs("d").alias("n"))
