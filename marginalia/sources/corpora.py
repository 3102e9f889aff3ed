"""Corpora: files of a directory, a JDBC table, subsets, and saving back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def directory(spark: SparkSession, path: str, extensions: list[str] | None = None, recurse: bool = False) -> DataFrame:
    """name, text of the files of a directory with one of the extensions. Executors read the files; nothing is listed into the driver's memory but paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    return reader.load(path).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("text"))


def jdbc(spark: SparkSession, url: str, table: str, name: str = "name", content: str = "content", query: str | None = None, partitions: int = 1, bounds: tuple[str, int, int] | None = None, **options: str) -> DataFrame:
    """name, text of a JDBC table (or of a query); bounds (numeric column, low, high) let `partitions` tasks read side by side."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if bounds:
        reader = reader.options(partitionColumn=bounds[0], lowerBound=bounds[1], upperBound=bounds[2], numPartitions=partitions)
    reader = reader.option("dbtable", f"({query}) q" if query else table)
    return reader.load().select(F.col(name).alias("name"), F.col(content).alias("text"))


def save_jdbc(docs: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    docs.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def subset(docs: DataFrame, chosen: DataFrame | Column, key: str = "name") -> DataFrame:
    """The documents named in a table, or those for which a condition holds."""
    return docs.where(chosen) if isinstance(chosen, Column) else docs.join(chosen.select(key).distinct(), key, "left_semi")


def save(docs: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    docs.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def save_files(docs: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Write each document's text, and a line end, as the one text file of a folder `name=...` under path; `directory` reads them
    back with recurse, and `document_name` gives the names."""
    docs.select(F.col(name).alias("name"), F.col(text).alias("value")).repartition("name").write.mode("append").partitionBy("name").text(path)


def document_name(path: Column) -> Column:
    """The name in the path of a file that `save_files` wrote."""
    return F.regexp_extract(path, "/name=([^/]*)/[^/]*$", 1)
