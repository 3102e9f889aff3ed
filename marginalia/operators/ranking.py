"""Ranks of candidate features and the choice of one candidate for each mention.

Every choice gives one row for each mention: inst (null for none), score and is_nil. Ties go to the smaller inst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "mention_id"]
# Thresholds of the choices.
NIL_SCORE = 0.05
MIX_SCORE = 0.4
COMMONNESS = 451
# End of fixed values.


def rank_name(feature: str) -> str:
    """scStringLength -> rnStringLengthRank."""
    return f"rn{feature[2:]}Rank" if feature.startswith("sc") else f"rn{feature}Rank"


def add_ranks(cands: DataFrame, *features: str) -> DataFrame:
    """rn...Rank of each feature within its mention: 1 for the largest, equal values share a rank, nulls last."""
    w = lambda f: Window.partitionBy(*KEY).orderBy(F.col(f).desc_nulls_last())
    return cands.withColumns({rank_name(f): F.rank().over(w(f)) for f in features})


def _first(cands: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(*order, F.asc("inst"))
    return cands.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_by(cands: DataFrame, feature: str, least: float = NIL_SCORE) -> DataFrame:
    """The candidate with the largest value (missing: 0); none where that is below `least`."""
    s = cands.withColumn("score", F.coalesce(F.col(feature).try_cast("double"), F.lit(0.0)))
    return _choice(_first(s, F.desc("score")), F.col("score") >= least)


def best_by_sum(cands: DataFrame, weights: dict[str, float], least: float = NIL_SCORE) -> DataFrame:
    """The candidate with the largest weighted sum of its numeric features."""
    total = F.lit(0.0)
    for f, w in weights.items():
        total = total + F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) * w
    return _choice(_first(cands.withColumn("score", total), F.desc("score")), F.col("score") >= least)


def best_by_mix(cands: DataFrame, features: list[str], popularity: str, least: float = MIX_SCORE) -> DataFrame:
    """The largest sum of rank features (of equals the more popular) if it is over `least`, else the most popular candidate."""
    total = F.lit(0.0)
    for f in features:
        total = total + F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    s = cands.withColumns({"score": total, "_pop": F.coalesce(F.col(popularity).cast("double"), F.lit(0.0))})
    w = Window.partitionBy(*KEY)
    s = s.withColumn("_best", F.max("score").over(w))
    order = F.when(F.col("_best") > least, F.col("score")).otherwise(F.col("_pop"))
    return _choice(_first(s.withColumn("_o", order), F.desc("_o"), F.desc("_pop")), F.lit(True))


def best_by_popularity(cands: DataFrame, popularity: str, least: float = NIL_SCORE) -> DataFrame:
    s = cands.withColumn("score", F.coalesce(F.col(popularity).cast("double"), F.lit(0.0)))
    return _choice(_first(s, F.desc("score")), F.col("score") > least)


def best_by_model(cands: DataFrame, confidence: float = 0.0, commonness: float = COMMONNESS, freq: str = "freq") -> DataFrame:
    """By a classifier's signed confidence (class 'false' counts against, a missing one as -1) if over `confidence`; else the most frequent candidate if over `commonness`; else none."""
    signed = F.when(F.col("class") == "false", -F.col("confidence")).otherwise(F.col("confidence"))
    s = cands.withColumns({"score": F.coalesce(signed, F.lit(-1.0)), "_f": F.coalesce(F.col(freq).cast("double"), F.lit(0.0))})
    w = Window.partitionBy(*KEY)
    s = s.withColumns({"_bs": F.max("score").over(w), "_bf": F.max("_f").over(w)})
    order = F.when(F.col("_bs") > confidence, F.col("score")).otherwise(F.col("_f"))
    return _choice(_first(s.withColumn("_o", order), F.desc("_o")), (F.col("_bs") > confidence) | (F.col("_bf") > commonness))


def _choice(best: DataFrame, accept: Column) -> DataFrame:
    return best.select(*KEY, F.when(accept, F.col("inst")).alias("inst"), F.round("score", 6).alias("score"), (~accept).alias("is_nil"))
