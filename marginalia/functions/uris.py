"""Column functions over identifiers of the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name spaces of short identifiers.
BASE = "http://dbpedia.org/resource/"
PAGE = "http://dbpedia.org/page/"
#: Resources of the knowledge base, those of its language hosts too.
RESOURCE = r"^http://([a-z]+\.)?dbpedia\.org/resource/"
NAMESPACES = {
    "dbpo:": "http://dbpedia.org/ontology/",
    "owl:": "http://www.w3.org/2002/07/owl#",
    "dbpp:": "http://dbpedia.org/property/",
    "foaf:": "http://xmlns.com/foaf/0.1/",
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "skos:": "http://www.w3.org/2004/02/skos/core#",
    "yago:": "http://mpii.de/yago/resource/",
}
# End of fixed values.


def expand(c: Column, base: str = BASE) -> Column:
    """Full form of a short identifier; null, empty and full ones stay."""
    out = F.when(c.isNull() | (c == "") | c.rlike("^https?://"), c)
    for prefix, uri in NAMESPACES.items():
        out = out.when(c.startswith(prefix), F.concat(F.lit(uri), F.substring(c, len(prefix) + 1, 2**30)))
    return out.otherwise(F.concat(F.lit(base), c))


def shorten(c: Column, base: str = BASE) -> Column:
    """An identifier without the base."""
    return F.when(c.startswith(base), F.substring(c, len(base) + 1, 2**30)).otherwise(c)


def mention_uri(c: Column, base: str = BASE) -> Column:
    """Identifier of a mention: blank or missing ones give '', full ones stay."""
    return F.when(c.isNull() | (F.trim(c) == ""), "").when(c.startswith("http://"), c).otherwise(F.concat(F.lit(base), c))


def recode(c: Column) -> Column:
    """Percent codes of the characters that the knowledge base keeps as they are."""
    for code, char in (("%28", "("), ("%29", ")"), ("%2C", ","), ("%27", "'"), ("%21", "!"), ("%2A", "*"), ("%3A", ":"), ("%20", "_")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def encode(c: Column) -> Column:
    """Characters outside ASCII and blanks as percent codes, the rest untouched."""
    pieces = F.split(c, "")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^[\x21-\x7e]$") | (x == ""), x).when(x == " ", "%20").otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))), "")


def fix(df: DataFrame, redirects: DataFrame, column: str = "uri") -> DataFrame:
    """Addresses of pages become resources, what is no resource goes, percent codes undone, one redirect followed (redirects: fromuri, touri).

    Null and empty identifiers stay as they are.
    """
    c = F.col(column)
    df = df.withColumn(column, F.when(c.startswith(PAGE), F.concat(F.lit(BASE), F.substring(c, len(PAGE) + 1, 2**30))).otherwise(c))
    df = df.where(c.isNull() | (c == "") | c.rlike(RESOURCE)).withColumn(column, recode(c))
    to = redirects.groupBy(F.col("fromuri").alias(column)).agg(F.min("touri").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
