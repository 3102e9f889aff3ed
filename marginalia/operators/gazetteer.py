"""Dictionary matching: token n-grams joined with a dictionary, feature look-up, exact and scored term search.

A dictionary is a table (norm, n_tokens, ...): `norm` is an entry with single spaces between its tokens, upper case
unless case counts. It may be of any size: the join is an equi-join, which Spark broadcasts only if the dictionary is
small enough and otherwise shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import dictionary_entry
from marginalia.operators.tokens import visible


def ngrams(tokens: DataFrame, longest: int, case_sensitive: bool = False, chunk: str | None = None, shortest: int = 1) -> DataFrame:
    """doc_id, start, stop, n_tokens, norm of every run of `shortest` to `longest` tokens with white space between them.

    chunk: a column of tokens (a sentence number, say) that no run may cross.
    """
    seen = visible(tokens)
    w = Window.partitionBy("doc_id", *([chunk] if chunk else [])).orderBy("tok_no")
    word = F.col("string") if case_sensitive else F.upper("string")
    seen = seen.select("doc_id", *([chunk] if chunk else []), "tok_no", "start", "stop", word.alias("w")).withColumn("apart", (F.lead("start").over(w) > F.col("stop")).cast("int"))
    ahead = {f"w{k}": F.lead("w", k).over(w) for k in range(1, longest)} | {f"e{k}": F.lead("stop", k).over(w) for k in range(1, longest)} | {f"a{k}": F.lead("apart", k).over(w) for k in range(1, longest - 1)}
    seen = seen.withColumns(ahead)
    runs: list[Column] = []
    fine = F.lit(True)
    for n in range(1, longest + 1):
        if n > 1:
            fine = fine & (F.col("apart" if n == 2 else f"a{n - 2}") == 1)
        if n < shortest:
            continue
        stop = F.col("stop" if n == 1 else f"e{n - 1}")
        text = F.concat_ws(" ", "w", *[f"w{k}" for k in range(1, n)])
        runs.append(F.when(fine, F.struct(stop.alias("stop"), F.lit(n).alias("n_tokens"), text.alias("norm"))))
    return seen.select("doc_id", "start", F.explode(F.array(*runs)).alias("r")).where("r is not null").select("doc_id", "start", "r.stop", "r.n_tokens", "r.norm")


def match(tokens: DataFrame, dictionary: DataFrame, longest: int, longest_only: bool = True, case_sensitive: bool = False, chunk: str | None = None, shortest: int = 1) -> DataFrame:
    """Spans of dictionary entries, with the dictionary's columns; longest_only: the longest of those with one start. Entries have
    `shortest` to `longest` tokens: runs of other lengths are not built.

    Matches that begin at different tokens may overlap.
    """
    found = ngrams(tokens, longest, case_sensitive, chunk, shortest).drop("n_tokens").join(dictionary, "norm")
    if longest_only:
        found = found.withColumn("_m", F.max("stop").over(Window.partitionBy("doc_id", "start"))).where("stop = _m").drop("_m")
    return found


def match_in(words: DataFrame, dictionary: DataFrame, longest: int, feature: str = "string", within: DataFrame | str | None = None, splits: DataFrame | None = None, longest_only: bool = True, case_sensitive: bool = False) -> DataFrame:
    """`match` over a feature of the words (a root, say) in place of their strings, whatever white space lies between them.

    within: only words inside one of these spans count, and no match leaves its span (or the words' column that numbers their spans, where
    these do not overlap: nothing is joined then); splits: places (start) that no match crosses.
    """
    from marginalia.operators.spans import span_join

    w = words.withColumn("string", F.coalesce(feature, "string")) if feature != "string" else words
    chunk = []
    if isinstance(within, str):
        w = w.withColumn("_in", F.col(within)).where("_in is not null")
        chunk.append("_in")
    elif within is not None:
        spans = within.select("doc_id", "start", "stop").distinct().withColumn("_in", F.col("start"))
        w = span_join(w, spans, "within").withColumnRenamed("b__in", "_in").drop("b_start", "b_stop")
        chunk.append("_in")
    if splits is not None:
        marks = splits.select("doc_id", "start", F.lit(1).alias("_s")).distinct()
        every = w.withColumn("_s", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        line = Window.partitionBy("doc_id").orderBy("start", F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
        w = every.withColumn("_part", F.sum("_s").over(line)).where("_s = 0").drop("_s")
        chunk.append("_part")
    if not chunk:
        return match(w, dictionary, longest, longest_only, case_sensitive)
    return match(w.withColumn("_chunk", F.struct(*chunk)).drop(*chunk), dictionary, longest, longest_only, case_sensitive, chunk="_chunk")


def save_dictionary(dictionary: DataFrame, table: str, path: str, buckets: int = 32) -> None:
    """Keep a compiled dictionary (norm, ...) as a table in buckets by entry, sorted: joins with it shuffle one side only."""
    out = dictionary.repartition(buckets, "norm")
    out.write.bucketBy(buckets, "norm").sortBy("norm").format("parquet").mode("overwrite").option("path", path).saveAsTable(table)


#: Marks of the beginning and end of a field in the index.
FIELD_BEGIN, FIELD_END = "__S__", "__E__"


def field_index(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, field, place, term of every field's lower-cased words, with a mark before the first and after the last, so that whole
    fields can be searched as well as parts of them."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.concat(F.array(F.lit(FIELD_BEGIN)), F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), "[ \\t\\n\\r\\f]+"), lambda w: w != ""), F.array(F.lit(FIELD_END))).alias("words"))
    each = rows.select(key, F.explode(F.array(*[one(f) for f in fields])).alias("f")).where(F.size("f.words") > 2)
    return each.select(key, "f.field", F.posexplode("f.words").alias("place", "term"))


def phrase_search(index: DataFrame, queries: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """query_id, key, field of the fields that hold a query's words (query_id, text) one after the other; whole: and nothing else."""
    words = F.filter(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    words = F.concat(F.array(F.lit(FIELD_BEGIN)), words, F.array(F.lit(FIELD_END))) if whole else words
    q = queries.select("query_id", F.size(words).alias("n"), F.posexplode(words).alias("i", "term"))
    hits = q.join(index, "term").groupBy("query_id", "n", key, "field", (F.col("place") - F.col("i")).alias("at")).agg(F.count("*").alias("m"))
    return hits.where("m = n").select("query_id", key, "field").distinct()


def match_anywhere(docs: DataFrame, dictionary: list[str], longest_only: bool = True, most: int = 2_000_000) -> DataFrame:
    """Matches that need not begin or end at a word: an automaton over the whole text. The dictionary is given by value, at most `most` entries."""
    if len(dictionary) > most:
        raise ValueError(f"{len(dictionary)} entries are too many for an automaton in each task; the limit is {most}")
    shared = docs.sparkSession.sparkContext.broadcast([e.upper() for e in dictionary])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for e in shared.value:
            auto.add_word(e, e)
        auto.make_automaton()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                best: dict[int, list[str]] = {}
                upper = "".join(u if len(u := c.upper()) == 1 else c for c in text or "")
                for end, e in auto.iter(upper) if shared.value else ():
                    best.setdefault(end - len(e) + 1, []).append(e)
                rows += [(doc, s, s + len(e), e) for s, es in sorted(best.items()) for e in ([max(es, key=len)] if longest_only else sorted(es))]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "norm"])

    return docs.select("doc_id", "text").mapInPandas(run, docs.select("doc_id").schema.add("start", "integer").add("stop", "integer").add("norm", "string"))


def entries(lines: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """lines (entry, features map) -> dictionary (norm, n_tokens, entry, features); blank entries are left out."""
    norm = dictionary_entry(F.col("entry"), case_sensitive)
    return lines.withColumn("norm", norm).where("norm <> ''").withColumn("n_tokens", F.size(F.split("norm", " ")))


def by_feature(spans: DataFrame, dictionary: DataFrame, feature: str, mode: str = "AddFeatures", prefix: str = "", at_start: bool = True, at_end: bool = True) -> DataFrame:
    """Look the values of a feature up in dictionary (norm, value).

    Modes: AddFeatures (`value` where the span has none), OverwriteFeatures, KeepAnnotation, RemoveAnnotation,
    AddNewAnnotation (the matches alone). With at_start or at_end off, a value matches an entry inside it.
    """
    d = dictionary.groupBy("norm").agg(F.min("value").alias("_value"))
    spans = spans.withColumn("_v", F.coalesce(F.upper(feature), F.lit("")))
    if at_start and at_end:
        d = d.withColumnRenamed("norm", "_v")
    else:
        # distinct values meet entries on their pieces of the lengths that entries have, so no value is compared with a whole dictionary
        lengths = [r.n for r in d.select(F.length("norm").alias("n")).distinct().collect()]  # as many as the longest entry has characters
        size, fits = F.length("_v"), lambda k, pieces: F.when(F.length("_v") >= k, pieces).otherwise(F.array().cast("array<string>"))
        if at_start or at_end:
            piece = lambda k: F.array(F.substring("_v", 1, k) if at_start else F.expr(f"right(_v, {k})"))
        else:
            piece = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substr("_v", i, F.lit(k)))
        pieces = F.array_distinct(F.flatten(F.array(*[fits(k, piece(k)) for k in lengths]))) if lengths else F.array().cast("array<string>")
        d = spans.select("_v").distinct().select("_v", F.explode(pieces).alias("norm")).join(d, "norm").select("_v", "_value")
    if mode in ("KeepAnnotation", "RemoveAnnotation"):
        return spans.join(d, "_v", "left_semi" if mode == "KeepAnnotation" else "left_anti").drop("_v")
    if mode == "AddNewAnnotation":
        return spans.join(d, "_v").withColumn(f"{prefix}value", F.col("_value")).drop("_v", "_value")
    name = f"{prefix}value"
    old = F.col(name) if name in spans.columns else F.lit(None).cast("string")
    new = F.coalesce(old, F.col("_value")) if mode == "AddFeatures" else F.coalesce(F.col("_value"), old)
    return spans.join(d, "_v", "left").withColumn(name, new).drop("_v", "_value")


def term_search(queries: DataFrame, docs_terms: DataFrame, n_docs: int, top: int) -> DataFrame:
    """The `top` documents of each query by the sum of tf * ln(N / df) of its terms.

    queries (query_id, term), docs_terms (doc_id, term, tf). Ties go to the smaller doc_id. A term of all documents weighs
    nothing: its postings are left out, and a document with no other term is no hit. Each task passes on `top` hits of a query.
    """
    df = docs_terms.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") < n_docs)
    weighted = queries.distinct().join(df, "term").join(docs_terms, "term")
    scored = weighted.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("tf") * F.log(n_docs / F.col("df"))), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rank_score(rank: Column, size: Column) -> Column:
    """1 for the first hit (rank 0) down to nearly 0 for the last."""
    return 1 - rank / size + 0.001


def exact_levels(names: DataFrame, index: DataFrame, min_word: int = 3) -> DataFrame:
    """Search names (doc_id, ann_id, string, type) in index (norm, inst, type) whole, then by ordered pairs of words, then by single words.

    Each inst comes once for a span, at the first level that finds it; types must agree (Place counts as Location);
    names with a colon are skipped.
    """
    idx = index.withColumn("type", F.when(F.col("type") == "Place", "Location").otherwise(F.col("type")))
    q = names.where(~F.col("string").contains(":")).withColumn("_w", F.filter(F.split(F.upper("string"), "[ \\t\\n\\r\\f]+"), lambda x: x != ""))
    pairs = F.flatten(F.transform("_w", lambda a, i: F.transform(F.filter(F.transform("_w", lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: x["j"] != i), lambda x: F.concat(a, F.lit(" "), x["b"]))))
    singles = F.filter("_w", lambda x: F.length(x) >= min_word)
    level = lambda k, col: F.transform(col, lambda x: F.struct(F.lit(k).alias("level"), x.alias("norm")))
    grams = F.concat(level(0, F.array(F.array_join("_w", " "))), level(1, pairs), level(2, singles))
    hits = q.select("doc_id", "ann_id", "type", F.explode(grams).alias("g")).select("doc_id", "ann_id", "type", "g.level", "g.norm").join(idx, ["norm", "type"])
    return hits.groupBy("doc_id", "ann_id", "inst").agg(F.min("level").alias("level"))


def update_feature(spans: DataFrame, found: DataFrame, feature: str, policy: str) -> DataFrame:
    """found (value of the feature as `key`, new): REPLACE, APPEND (|-joined) or IGNORE (only where the span has none)."""
    new = found.groupBy(F.col("key").alias(feature)).agg(F.min("new").alias("_new"))
    j = spans.join(new, feature, "left")
    old = F.col("existing")
    value = {"REPLACE": F.coalesce("_new", old), "APPEND": F.concat_ws("|", old, "_new"), "IGNORE": F.coalesce(old, "_new")}[policy]
    return j.withColumn("existing", value).drop("_new")


def super_class(spans: DataFrame, classes: DataFrame) -> DataFrame:
    """super_class by table (cls, super_class); unknown classes keep their own name."""
    one = classes.groupBy("cls").agg(F.min("super_class").alias("super_class"))
    return spans.join(one, "cls", "left").withColumn("super_class", F.coalesce("super_class", "cls"))


def rotations(words: Column, r: int) -> Column:
    """All rotations of all choices of r words, which keep their order: with r words chosen, r arrays."""
    places = F.transform(words, lambda w, i: F.array(i))
    for _ in range(r - 1):
        longer = lambda p: F.transform(F.filter(F.transform(words, lambda w, j: j), lambda j: j > F.element_at(p, -1)), lambda j: F.concat(p, F.array(j)))
        places = F.flatten(F.transform(places, longer))
    chosen = F.transform(places, lambda p: F.transform(p, lambda j: F.get(words, j)))
    turned = lambda c, k: F.concat(F.slice(c, k + 1, r - k), F.slice(c, 1, k)) if k else c
    return F.flatten(F.transform(chosen, lambda c: F.array(*[turned(c, k) for k in range(r)])))
