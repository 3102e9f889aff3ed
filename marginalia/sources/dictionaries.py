"""Dictionary files: definitions (list:major:minor:language:type), lists (entry and tab-separated feature=value), YAML definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TYPE = "Lookup"


def parse_definitions(lines: DataFrame) -> DataFrame:
    """lines (value) -> list_file, major, minor, language, ann_type; blank lines are left out."""
    p = F.split(F.trim("value"), ":")
    part = lambda i: F.nullif(F.trim(F.get(p, F.lit(i))), F.lit(""))
    return lines.where(F.trim("value") != "").select(part(0).alias("list_file"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("language"), F.coalesce(part(4), F.lit(DEFAULT_TYPE)).alias("ann_type"))


def parse_list(lines: DataFrame) -> DataFrame:
    """lines (value, ...) -> entry, features and the other columns; a feature that is no key=value raises an error."""
    p = F.split("value", "\t")
    pairs = F.transform(F.filter(F.slice(p, 2, 200), lambda x: x != ""), lambda x: F.when(F.instr(x, "=") > 1, F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v"))).otherwise(F.raise_error(F.concat(F.lit("no feature=value: "), x)).cast("struct<k:string,v:string>")))
    last_wins = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    return lines.where(F.trim("value") != "").select(*[c for c in lines.columns if c != "value"], F.get(p, F.lit(0)).alias("entry"), last_wins.alias("features"))


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return parse_definitions(spark.read.text(path))


def read_lists(spark: SparkSession, definition: str) -> DataFrame:
    """All lists of a definition file, with the definition's columns: list files lie beside it, plain or compressed."""
    folder = definition.rsplit("/", 1)[0]
    defs = read_definitions(spark, definition)
    names = [r.list_file for r in defs.select("list_file").distinct().collect()]  # the lines of one definition file
    lines = spark.read.text([f"{folder}/{n}" for n in names]).withColumn("list_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return parse_list(lines).join(defs, "list_file")


def parse_yaml(text: str) -> list[dict[str, str]]:
    """Lists of a YAML definition: items of `- key: value` lines."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        item = bare.lstrip()
        if item.startswith("- "):
            out.append({})
            item = item[2:]
        if out and ":" in item:
            k, v = item.split(":", 1)
            out[-1][k.strip()] = v.strip().strip("\"'")
    return out


def read_delimited_index(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows of a delimited file with the right number of fields; lines that begin with # or // are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|//)"))
    p = F.split("value", "\\Q" + sep + "\\E", -1)
    return lines.where(F.size(p) == len(columns)).select(*[p[i].alias(c) for i, c in enumerate(columns)])
