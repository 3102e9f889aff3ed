"""Training and application of a candidate classifier with pyspark.ml; features are found by their names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_names(columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, nominal): sc..., rn...Rank and sc_... are numbers, nm... and nm_... are classes."""
    numeric = [c for c in columns if re.match(r"(?:sc[A-Z_]|rn[A-Z_]\w*Rank$)", c)]
    return numeric, [c for c in columns if re.match(r"nm[A-Z_]", c)]


def discover(annotations: DataFrame) -> DataFrame:
    """Names of the features that annotations carry, with the number of annotations."""
    return annotations.select(F.explode(F.map_keys("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def fit(instances: DataFrame, label: str = "class", regularisation: float = 1e-3, rounds: int = 50):
    """A pipeline model that turns instances into a class and a probability; instances with a null feature count it as 0 or 'none'."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    numeric, nominal = feature_names(instances.columns)
    data = prepare(instances, numeric, nominal).withColumn("label", (F.col(label) == "true").cast("double"))
    stages = []
    if nominal:
        stages += [StringIndexer(inputCols=nominal, outputCols=[f"{c}_i" for c in nominal], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in nominal], outputCols=[f"{c}_v" for c in nominal])]
    stages += [VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in nominal]], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features"), LogisticRegression(regParam=regularisation, maxIter=rounds)]
    return Pipeline(stages=stages).fit(data)


def prepare(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in nominal}})


def apply(model, cands: DataFrame) -> DataFrame:
    """class ('true' or 'false') and confidence of each candidate."""
    from pyspark.ml.functions import vector_to_array

    numeric, nominal = feature_names(cands.columns)
    out = model.transform(prepare(cands, numeric, nominal))
    return out.select(*cands.columns, F.when(F.col("prediction") == 1, "true").otherwise("false").alias("class"), F.array_max(vector_to_array("probability")).alias("confidence"))
