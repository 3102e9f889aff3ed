"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction (1 / 2**`SHIFT`) of the hash range, so sketches of
parts merge by union, and likeness and containment can be estimated between documents of very unequal length.
Words are what stands between ASCII white space, unchanged; a text of one to four words is one shingle. A text with
no hash under the threshold has an empty sketch: its fingerprint is then "=" and the hash of all its words, and two
such texts are alike (1.0) only if that is equal.

Null texts are empty. Rows that share a doc_id follow each other in the order of their texts' hashes; the last row is
followed by the first (a single row by itself). An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SHIFT = 2
#: Rows of 2**BUCKET consecutive doc_ids find their successor in one window; LEVEL does the same for the buckets.
BUCKET, LEVEL = 6, 12


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """Hashes of the words between ASCII white space."""
    return F.transform(F.array_remove(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), ""), lambda w: F.xxhash64(w))


def shingle_hashes(h: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of `shingle` words, by the words' hashes; of fewer words all together; of none none."""
    rolled = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, shingle)]))
    return F.when(F.size(h) >= shingle, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, shingle: int = SHINGLE, shift: int = SHIFT) -> Column:
    """struct(kept array<int> sorted, mark long) of a text column."""

    def of(h: Column) -> Column:
        every = shingle_hashes(h, shingle)
        kept = F.transform(F.filter(every, lambda x: F.shiftrightunsigned(x, 64 - shift) == 0), lambda x: F.shiftrightunsigned(x, 32).cast("int"))
        return F.struct(F.sort_array(F.array_distinct(kept)).alias("kept"), F.xxhash64(h).alias("mark"))

    return let(word_hashes(text), of)


def fingerprint(s: Column) -> Column:
    """A sketch as a string: 8 hex digits to a hash, ascending."""
    whole = F.concat(F.lit("="), F.lpad(F.lower(F.hex(s["mark"])), 16, "0"))
    return F.when(F.size(s["kept"]) == 0, whole).otherwise(F.lower(F.array_join(F.transform(s["kept"], lambda x: F.lpad(F.hex(x), 8, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either == 0, (a["mark"] == b["mark"]).cast("double")).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; null if a's sketch is empty."""
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))


def merge(a: Column, b: Column) -> Column:
    """Kept hashes of two parts together."""
    return F.sort_array(F.array_union(a["kept"], b["kept"]))


def successor(ids: DataFrame) -> DataFrame:
    """ids (id long, distinct) -> (id, next): the next larger id, for the largest the smallest.

    Ids are grouped by their upper bits; a window orders one group (2**LEVEL ids at most), and the groups find their
    own successors in the same way, level by level.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ids.withColumn("next", F.col("id"))

    def level(rows: DataFrame, lo: int, hi: int) -> DataFrame:
        if hi - lo < 1 << LEVEL:
            return rows.withColumn("next", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id")))
        g = rows.withColumn("g", F.shiftright("id", LEVEL))
        heads = g.groupBy("g").agg(F.min("id").alias("head"))
        after = level(heads.select(F.col("g").alias("id")), lo >> LEVEL, hi >> LEVEL).select(F.col("id").alias("g"), F.col("next").alias("ng"))
        heads = after.join(heads.select(F.col("g").alias("ng"), "head"), "ng").select("g", "head")
        inside = g.withColumn("next", F.lead("id").over(Window.partitionBy("g").orderBy("id")))
        return inside.join(heads, "g", "left").select("id", F.coalesce("next", "head").alias("next"))

    return level(ids, low, high).withColumn("next", F.coalesce("next", F.lit(low)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, body, s (its sketch), next (struct of the next document's body and sketch); one shuffle of the texts."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.shiftright(F.col("doc_id").cast("long"), BUCKET).alias("bucket"))
    heads = base.groupBy("bucket").agg(F.min(F.struct("doc_id", F.xxhash64("body").alias("tie"), "body")).alias("m")).select("bucket", F.col("m.body").alias("body"))
    after = successor(base.select(F.col("bucket").alias("id")).distinct()).select(F.col("id").alias("of"), F.col("next").alias("bucket"))
    tails = heads.join(after, "bucket").select("of", F.struct("body", sketch(F.col("body")).alias("s")).alias("first"))
    w = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    rows = base.select("doc_id", "bucket", F.xxhash64("body").alias("tie"), "body", sketch(F.col("body")).alias("s"))
    rows = rows.withColumn("next", F.lead(F.struct("body", "s")).over(w))
    return rows.join(tails, (F.col("bucket") == F.col("of")) & F.col("next").isNull(), "left").select("doc_id", "body", "s", F.coalesce("next", "first").alias("next"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("body").cast("long"))
    edited = F.concat(F.expr("left(body, cast(n_chars - n_chars div 2 as int))"), F.expr("left(next.body, cast(n_chars div 2 as int))"))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "s", F.col("next.s").alias("t"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "s", "t", sketch(F.col("edited")).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("t")).alias("near_next"))
