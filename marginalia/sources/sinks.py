"""Writers: JSON and inline XML of annotated documents, evaluation tables, difference pages, training instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XML_CODES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def document_json(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, json: {"text": ..., "entities": {type: [{"indices": [start, stop], ...}]}}; spans need type, start, stop (and features, if any)."""
    extra = ["features"] if "features" in spans.columns else []
    one = F.struct(F.array("start", "stop").alias("indices"), *extra)
    lists = spans.groupBy("doc_id", "type").agg(F.array_sort(F.collect_list(one)).alias("list"))
    maps = lists.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "list")))).alias("entities"))
    return docs.join(maps, "doc_id", "left").select("doc_id", F.to_json(F.struct("text", "entities")).alias("json"))


def covered_json(spans: DataFrame, units: DataFrame, docs: DataFrame) -> DataFrame:
    """The same for each unit (ann_id, start, stop: a message in a document), offsets counted from its start."""
    from marginalia.operators.spans import span_join

    inside = span_join(units.select("doc_id", "ann_id", "start", "stop"), spans.select("doc_id", "start", "stop", "type"), "covers")
    key = F.concat_ws(":", "doc_id", "ann_id")
    rows = inside.select(key.alias("doc_id"), F.col("b_type").alias("type"), (F.col("b_start") - F.col("start")).alias("start"), (F.col("b_stop") - F.col("start")).alias("stop"))
    texts = units.join(docs.select("doc_id", "text"), "doc_id").select(key.alias("doc_id"), F.expr("substring(text, start + 1, stop - start)").alias("text"))
    return document_json(texts, rows)


def escape_xml(c: Column) -> Column:
    for a, b in XML_CODES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline_xml(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, xml: the text with <Mention inst="..."> around mentions; one that overlaps an earlier one kept is left out.

    Texts are cut at the kept mentions, so each character is copied once.
    """
    lists = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("n"), "stop", "inst"))).alias("m"))
    empty = F.struct(F.lit(0).alias("e"), F.array().cast("array<struct<start:int,stop:int,inst:string>>").alias("k"))
    item = lambda x: F.struct(x["start"].cast("int").alias("start"), x["stop"].cast("int").alias("stop"), x["inst"].alias("inst"))
    kept = F.aggregate("m", empty, lambda a, x: F.when(x["start"] >= a["e"], F.struct(x["stop"].cast("int").alias("e"), F.concat(a["k"], F.array(item(x))).alias("k"))).otherwise(a), lambda a: a["k"])
    j = docs.join(lists, "doc_id", "left").withColumn("k", F.coalesce(kept, F.array().cast("array<struct<start:int,stop:int,inst:string>>")))
    before = lambda i: F.when(i == 0, 0).otherwise(F.element_at("k", F.greatest(i, F.lit(1)))["stop"])
    cut = lambda a, b: escape_xml(F.substr("text", a + 1, b - a))
    body = F.array_join(F.transform("k", lambda x, i: F.concat(cut(before(i), x["start"]), F.lit('<Mention inst="'), escape_xml(F.coalesce(x["inst"], F.lit(""))), F.lit('">'), cut(x["start"], x["stop"]), F.lit("</Mention>"))), "")
    tail = cut(F.when(F.size("k") > 0, F.element_at("k", -1)["stop"]).otherwise(0), F.length("text"))
    return j.withColumn("_n", F.size("k")).select("doc_id", F.concat(F.when(F.col("_n") > 0, body).otherwise(""), F.when(F.col("_n") > 0, tail).otherwise(escape_xml(F.col("text")))).alias("xml"), F.col("_n").cast("long").alias("n_mentions"))


def response_xml(xml: DataFrame, message: str = "", status: str = "ok") -> DataFrame:
    return xml.select("doc_id", F.concat(F.lit("<response><text>"), "xml", F.lit(f"</text><msg>{message}</msg><status>{status}</status></response>")).alias("xml"))


def difference_html(outcomes: DataFrame) -> DataFrame:
    """type, html: a table row for each outcome of a type, and its counts."""
    row = F.concat(F.lit("<tr><td>"), F.coalesce(F.col("key_id").cast("string"), F.lit("")), F.lit("</td><td>"), F.coalesce(F.col("response_id").cast("string"), F.lit("")), F.lit("</td><td>"), "outcome", F.lit("</td></tr>"))
    by_doc = outcomes.withColumn("r", row).groupBy("type", "doc_id").agg(F.array_join(F.array_sort(F.collect_list("r")), "").alias("rows"))
    return by_doc.select("type", "doc_id", F.concat(F.lit("<table><caption>"), escape_xml(F.col("type")), F.lit("</caption>"), "rows", F.lit("</table>")).alias("html"))


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def arff_header(relation: str, numeric: list[str], nominal: dict[str, list[str]]) -> list[str]:
    return [f"@relation {relation}", *[f"@attribute {n} numeric" for n in numeric], *[f"@attribute {n} {{{','.join(v)}}}" for n, v in nominal.items()], "@data"]


def arff_rows(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """value: one instance a line, ? for missing ones."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in [*numeric, *nominal]]).alias("value"))


def slowest_lines(lines: DataFrame, n: int, pattern: str = r"^(.*?)\btook (\d+(?:[.]\d+)?) ?ms\b") -> DataFrame:
    """The n log lines (value) with the longest times: what, ms, value. Lines without a time are left out; ties by the line."""
    t = lines.select(F.trim(F.regexp_extract("value", pattern, 1)).alias("what"), F.regexp_extract("value", pattern, 2).alias("ms"), "value").where("ms <> ''")
    return t.withColumn("ms", F.col("ms").cast("double")).orderBy(F.desc("ms"), "value").limit(n)
