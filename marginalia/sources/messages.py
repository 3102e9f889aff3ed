"""Short messages in JSON: reading, paths, entities, unescaping, and messages put together to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "array<struct<indices:array<int>,text:string,screen_name:string,expanded_url:string>>"
MESSAGE = f"id_str string, text string, created_at string, lang string, `user` struct<name:string,screen_name:string,location:string>, entities map<string,{ENTITY}>"
DOCUMENT_GAP = "\n\n"


def read(spark: SparkSession, path: str, shape: str = "lines") -> DataFrame:
    """Messages of files, also compressed ones. shape: lines (one object a line), array, or search ({statuses: [...]})."""
    if shape == "search":
        return spark.read.schema(f"statuses array<struct<{MESSAGE.replace(' string', ':string').replace('`user` ', '`user`:').replace('entities ', 'entities:')}>>").option("multiLine", "true").json(path).select(F.explode("statuses").alias("m")).select("m.*")
    return spark.read.schema(MESSAGE).option("multiLine", str(shape == "array").lower()).json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE).json(path)


def split_text(text: Column) -> Column:
    """JSON objects (as strings) of a text: the elements of an array, or its lines."""
    lines = F.filter(F.split(text, "[\n\r]+"), lambda x: F.trim(x) != "")
    return F.when(F.ltrim(text).startswith("["), F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))).otherwise(lines)


def dig(js: Column, path: str) -> Column:
    """The value at a path such as user:screen_name, or null."""
    return F.get_json_object(js, "$." + path.replace(":", "."))


def unescape(text: Column) -> Column:
    for code, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def moved_offset(text: Column, offset: Column) -> Column:
    """Where an offset into the escaped text lies in the unescaped one."""
    before = F.substr(text, F.lit(1), offset)
    lost = F.aggregate(F.regexp_extract_all(before, F.lit("(&(?:amp|lt|gt);)"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x) - 1)
    return offset - lost


def entities(messages: DataFrame, key: str = "id_str") -> DataFrame:
    """key, type (also set:type), start, stop of every entity with two numbers as indices, moved as unescaping does."""
    e = messages.select(key, "text", F.explode("entities").alias("type", "list")).select(key, "text", "type", F.explode("list").alias("e"))
    e = e.where("size(e.indices) = 2")
    name = F.split("type", ":", 2)
    return e.select(key, F.when(F.size(name) > 1, name[0]).otherwise(F.lit("")).alias("aset"), F.element_at(name, -1).alias("type"), moved_offset(F.col("text"), F.col("e.indices")[0]).alias("start"), moved_offset(F.col("text"), F.col("e.indices")[1]).alias("stop"))


def content(js: Column, keys: list[str]) -> tuple[Column, Column]:
    """Text of a message (each content key's value and a line end) and the spans of the values (key, start, stop)."""
    values = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), unescape(dig(js, k)).alias("v")) for k in keys]), lambda x: x["v"].isNotNull())
    text = F.array_join(F.transform(values, lambda x: F.concat(x["v"], F.lit("\n"))), "")
    start = lambda i: F.aggregate(F.slice(values, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x["v"]) + 1)
    spans = F.transform(values, lambda x, i: F.struct(x["key"].alias("key"), start(i).alias("start"), (start(i) + F.length(x["v"])).alias("stop")))
    return text, spans


def join_messages(messages: DataFrame, doc: str, order: str, text: str = "text", gap: str = DOCUMENT_GAP) -> DataFrame:
    """start and stop of each message in the text of its document, where messages follow each other with a gap between them."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + len(gap)).over(w), F.lit(0))
    return messages.withColumn("start", start.cast("long")).withColumn("stop", F.col("start") + F.length(text))


def documents_of(messages: DataFrame, per_doc: int, name: str, order: str, text: str = "text", part: str | None = None, first_short: bool = True) -> DataFrame:
    """doc_name, text, n of documents of per_doc messages each (the first holds one less), joined by line ends.

    part: a column that keeps numbering apart (a file, say), so that no window holds all messages.
    """
    w = Window.partitionBy(part if part else F.lit(0)).orderBy(order)
    n = F.row_number().over(w) - (0 if first_short else 1)
    m = messages.withColumn("_d", F.floor(n / per_doc).cast("long"))
    keys = [part] if part else []
    out = m.groupBy(*keys, "_d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("n"))
    return out.select(*keys, F.concat(F.lit(f"{name}_"), F.lpad(F.col("_d").cast("string"), 6, "0")).alias("doc_name"), "text", "n")
