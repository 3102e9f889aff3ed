"""Interval joins between spans of a document, and the filters built of them.

A join is cut into pieces of `bucket` characters: both sides are laid over the pieces they touch and meet on
(doc_id, piece), and a pair counts only in the piece of the later start. So a very long document (or one that holds
a third of all spans) is spread over many tasks, each span meets its neighbours only, and no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def predicate(kind: str, s: Column, e: Column, bs: Column, be: Column) -> Column:
    """How span (s, e) lies to span (bs, be)."""
    return {
        "overlap": (s < be) & (bs < e),
        "touch": (s <= be) & (bs <= e),
        "within": (s >= bs) & (e <= be),
        "covers": (s <= bs) & (e >= be),
        "coextensive": (s == bs) & (e == be),
    }[kind]


def _pieces(df: DataFrame, bucket: int) -> DataFrame:
    return df.withColumn("_piece", F.explode(F.expr(f"sequence(start div {bucket}, stop div {bucket})")))


def span_join(a: DataFrame, b: DataFrame, kind: str = "overlap", how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Pairs of a's and b's spans; b's columns but doc_id get the prefix b_. how: inner or left."""
    b = b.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "doc_id"])
    if kind == "coextensive":
        return a.join(b.withColumns({"start": F.col("b_start"), "stop": F.col("b_stop")}), ["doc_id", "start", "stop"], how).select(*a.columns, *b.columns[1:])
    spread = b.withColumns({"start": F.col("b_start"), "stop": F.col("b_stop")})
    right = _pieces(spread, bucket).drop("start", "stop")
    pairs = _pieces(a, bucket).join(right, ["doc_id", "_piece"])
    pairs = pairs.where(predicate(kind, F.col("start"), F.col("stop"), F.col("b_start"), F.col("b_stop")) & (F.col("_piece") == F.expr(f"greatest(start, b_start) div {bucket}")))
    pairs = pairs.select(*a.columns, *b.columns[1:])
    if how == "inner":
        return pairs
    return pairs.unionByName(matched(a, b.select("doc_id", F.col("b_start").alias("start"), F.col("b_stop").alias("stop")), kind, keep=False, bucket=bucket), allowMissingColumns=True)


def matched(a: DataFrame, b: DataFrame, kind: str = "overlap", keep: bool = True, bucket: int = BUCKET, extra: Column | None = None) -> DataFrame:
    """a's spans that lie so to some span of b (keep) or to none (not keep). extra: a further condition on a pair (b's columns as b_...)."""
    cols = [c for c in b.columns if c != "doc_id"]
    if extra is None:
        b, cols = b.select("doc_id", "start", "stop").distinct(), ["start", "stop"]
    key = [c for c in ("doc_id", "aset", "ann_id") if c in a.columns] if "ann_id" in a.columns else list(a.columns)
    pairs = span_join(a, b.select("doc_id", *cols), kind, bucket=bucket)
    hits = (pairs if extra is None else pairs.where(extra)).select(*key).distinct()
    on = [a[c].eqNullSafe(hits[c]) if c not in ("doc_id", "ann_id", "aset") else a[c] == hits[c] for c in key]
    return a.join(hits, on, "left_semi" if keep else "left_anti")


def marked(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's spans, each once, with the columns (b_...) of the span of b that holds it, or nulls. b's spans (sentences, say) do not overlap
    each other.

    One pass over both in the order of their starts, without pairs: only the last of b's spans that begins no later can hold one of a's.
    """
    cols = [c for c in b.columns if c != "doc_id"]
    own = b.select("doc_id", F.col("start").alias("_at"), F.struct(*[F.col(c).alias(f"b_{c}") for c in cols]).alias("_b"), F.lit(None).cast(a.schema).alias("_a"))
    both = own.unionByName(a.select("doc_id", F.col("start").alias("_at"), F.struct(*a.columns).alias("_a")), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("_at", F.col("_a").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_b", F.last("_b", ignorenulls=True).over(w)).where("_a is not null")
    inside = F.col("_a.stop") <= F.col("_b.b_stop")
    return found.select("_a.*", *[F.when(inside, F.col("_b")[f"b_{c}"]).alias(f"b_{c}") for c in cols])


def mark(a: DataFrame, rejected: DataFrame, reason: str) -> DataFrame:
    """a with deleted_because set on the rejected spans that have no reason yet: the audit trail of a filter."""
    if "deleted_because" not in a.columns:
        a = a.withColumn("deleted_because", F.lit(None).cast("string"))
    gone = rejected.select("doc_id", "ann_id").distinct().withColumn("_gone", F.lit(reason))
    return a.join(gone, ["doc_id", "ann_id"], "left").withColumn("deleted_because", F.coalesce("deleted_because", "_gone")).drop("_gone")


def overlap_sums(a: DataFrame, b: DataFrame, value: str = "ann_id", bucket: int = BUCKET) -> DataFrame:
    """doc_id, ann_id, n, total: how many of b's spans overlap each of a's, and the sum of their values; spans of a that none overlaps are left out.

    No pair is built: what begins before a span's stop less what ends by its start, as running sums over the places of all spans. They
    are summed up inside pieces of the text, and each piece adds what the pieces before it hold, so one long document is spread over many tasks.
    """
    v, none, zero = F.col(value).cast("long"), F.lit(None), F.col("start") == F.col("stop")
    row = lambda df, at, order, ann, sign, n, total: df.select("doc_id", F.col(at).cast("long").alias("at"), order.alias("o"), ann.alias("ann_id"), F.lit(sign).alias("sign"), *[x.cast("long").alias(c) for x, c in ((n, "n"), (total, "total"))])
    # at one place: stops asked for, starts, stops, starts asked for; spans of no length at one place do not overlap
    of = lambda sign: (F.lit(1), v) if sign else (F.lit(0), F.lit(0))
    places = row(a, "stop", F.lit(0), F.col("ann_id"), 1, *of(0)).unionByName(row(a, "start", F.when(zero, 3).otherwise(5), F.col("ann_id"), -1, *of(0)))
    kind = a.schema["ann_id"].dataType
    places = places.unionByName(row(b, "start", F.lit(1), none.cast(kind), 1, *of(1))).unionByName(row(b, "stop", F.when(zero, 4).otherwise(2), none.cast(kind), -1, *of(1)))
    places = places.withColumn("_piece", F.floor(F.col("at") / bucket))
    before = Window.partitionBy("doc_id", "sign").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    held = places.groupBy("doc_id", "sign", "_piece").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    held = held.select("doc_id", "sign", "_piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "total")])
    here = Window.partitionBy("doc_id", "sign", "_piece").orderBy("at", "o")
    run = places.select("doc_id", "sign", "_piece", "ann_id", *[F.sum(c).over(here).alias(c) for c in ("n", "total")]).where("ann_id is not null")
    run = run.join(held, ["doc_id", "sign", "_piece"])
    sums = [F.sum(F.col("sign") * (F.col(c) + F.col(f"_{c}"))).cast("long").alias(c) for c in ("n", "total")]
    return run.groupBy("doc_id", "ann_id").agg(*sums).where("n > 0")


def contained_or_covering(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs where b lies within a or covers it; equal spans once."""
    return span_join(a, b, "covers").unionByName(span_join(a, b, "within")).distinct()


# ---- filters ----------------------------------------------------------------------------------------------------


def longer_than(spans: DataFrame, n: int = 1) -> DataFrame:
    return spans.where(F.col("stop") - F.col("start") > n)


def one_per_extent(spans: DataFrame, *order: str) -> DataFrame:
    """Of coextensive spans the first by the order (then by number)."""
    w = Window.partitionBy("doc_id", "start", "stop").orderBy(*order, "ann_id")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_contained(spans: DataFrame) -> DataFrame:
    """Longest match wins: spans within another one go; of equal ones the first stays."""
    shorter = (F.col("b_stop") - F.col("b_start") > F.col("stop") - F.col("start")) | (F.col("b_ann_id") < F.col("ann_id"))
    return matched(spans, spans, "within", keep=False, extra=shorter)


def with_proper_noun(spans: DataFrame, tokens: DataFrame, proper: Column) -> DataFrame:
    """Spans that hold a token for which `proper` is true: of those that begin no earlier one ends no later. One pass, without pairs."""
    those = tokens.where(proper).select("doc_id", F.col("start").cast("long").alias("_at"), F.col("stop").cast("long").alias("_end"), F.lit(None).cast(spans.schema).alias("_a"))
    both = those.unionByName(spans.select("doc_id", F.col("start").cast("long").alias("_at"), F.struct(*spans.columns).alias("_a")), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy(F.desc("_at"), F.col("_a").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_end", F.min("_end").over(w)).where("_a is not null and _end <= _a.stop").select("_a.*")


def drop_common_words(lookups: DataFrame, tokens: DataFrame, off: DataFrame | None = None, entities: DataFrame | None = None, major: str = "dbpedia", exempt: tuple[str, ...] = ("demonym", "adjectival")) -> DataFrame:
    """Look-ups (with major and minor types) of the major type stay only if a token inside is tagged as a proper noun (NNP...), or,
    where entities are given, if an entity has just their extent. Those of other major or exempt minor types stay, and so do
    all in the documents of off (doc_id)."""
    free = F.coalesce(F.col("major") != major, F.lit(True)) | F.coalesce(F.col("minor").isin(*exempt), F.lit(False))
    asked = lookups.where(~free)
    kept = lookups.where(free)
    if off is not None:
        kept = kept.unionByName(asked.join(off.select("doc_id").distinct(), "doc_id", "left_semi").select(*lookups.columns))
        asked = asked.join(off.select("doc_id").distinct(), "doc_id", "left_anti")
    good = matched(asked, entities, "coextensive") if entities is not None else with_proper_noun(asked, tokens, F.col("tag").startswith("NNP"))
    return kept.unionByName(good.select(*lookups.columns))


def drop_stop_words(spans: DataFrame, stop_words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans that are exactly a stop word or a number go."""
    bad = stop_words.select("doc_id", "start", "stop").unionByName(tokens.where("kind = 'number'").select("doc_id", "start", "stop"))
    return matched(spans, bad, "coextensive", keep=False)


def with_entity_type(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Spans that overlap an entity, with the type of the first such entity."""
    return span_join(spans, entities.select("doc_id", "start", "stop", "type"), "overlap").groupBy(*spans.columns).agg(F.min(F.struct("b_start", "b_type"))["b_type"].alias("entity_type"))


def drop_parts_of_persons(mentions: DataFrame, persons: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions of fewer than two words strictly inside a person of two or more words go."""
    words = tokens.where("kind = 'word'").select("doc_id", "start", "stop")
    count = lambda df: span_join(df, words, "covers").groupBy("doc_id", "ann_id").agg(F.count("*").alias("n_words"))
    long = persons.join(count(persons).where("n_words >= 2"), ["doc_id", "ann_id"])
    short = mentions.join(count(mentions), ["doc_id", "ann_id"], "left").where("coalesce(n_words, 0) < 2").select(*mentions.columns)
    inside = matched(short, long, "within", extra=F.col("b_stop") - F.col("b_start") > F.col("stop") - F.col("start"))
    return mentions.join(inside.select("doc_id", "ann_id"), ["doc_id", "ann_id"], "left_anti")


def resolve_overlaps(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Strictly contained mentions go; of two that overlap in part the later goes, unless only an article stands between their starts: then the earlier."""
    m = mentions.select("doc_id", "ann_id", "start", "stop")
    pairs = span_join(m, m, "overlap").where("start < b_start or (start = b_start and stop > b_stop) or stop > b_stop and start < b_start")
    inner = pairs.where("stop >= b_stop").select("doc_id", F.col("b_ann_id").alias("ann_id"))
    partial = pairs.where("start < b_start and stop < b_stop")
    with_text = partial.join(docs.select("doc_id", "text"), "doc_id")
    between = F.lower(F.regexp_replace(F.expr("substring(text, start + 1, b_start - start)"), r"^\s+|\s+$", ""))
    loser = F.when(between.isin("", "the", "a", "an"), F.col("ann_id")).otherwise(F.col("b_ann_id"))
    gone = inner.unionByName(with_text.select("doc_id", loser.alias("ann_id"))).distinct()
    return mentions.join(gone, ["doc_id", "ann_id"], "left_anti")


def drop_unknown(entities: DataFrame) -> DataFrame:
    """Persons, locations and organizations that only the rule for unknown names found go."""
    return entities.where(~(F.col("type").isin("Organization", "Person", "Location") & F.coalesce(F.col("rule") == "Unknown", F.lit(False))))


# ---- context ----------------------------------------------------------------------------------------------------


def context_tokens(spans: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """Pairs of a span and the tokens at most `window` before its first or after its last token, those of the span left out."""
    inside = span_join(spans.select("doc_id", "ann_id", "start", "stop"), tokens.select("doc_id", "start", "stop", "tok_no"), "overlap")
    at = inside.groupBy("doc_id", "ann_id").agg(F.min("b_tok_no").alias("first"), F.max("b_tok_no").alias("last"))
    near = at.withColumn("tok_no", F.explode(F.expr(f"sequence(first - {window}, last + {window})"))).where("tok_no < first or tok_no > last")
    return near.join(tokens, ["doc_id", "tok_no"]).select("doc_id", "ann_id", "tok_no", "string", "start", "stop")


def near_tokens(tokens: DataFrame, spot: Column, window: int) -> DataFrame:
    """context_tokens for spans that are single tokens, those for which `spot` is true: doc_id, ann_id (number of the spot), tok_no, string, ...

    Each token looks for spots among its neighbours in order; tokens meet in no join. tokens are numbered without gaps.
    """
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    t = tokens.withColumn("_spot", F.when(spot, F.col("tok_no")))
    t = t.withColumns({f"_{k}": F.lag("_spot", k).over(w) if k > 0 else F.lead("_spot", -k).over(w) for k in range(-window, window + 1) if k})
    around = F.filter(F.array(*[f"_{k}" for k in range(-window, window + 1) if k]), lambda x: x.isNotNull())
    return t.where(F.size(around) > 0).select(F.explode(around).alias("ann_id"), *tokens.columns)


def context_words(spans: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """words: the distinct words of `length` characters (and two more) on either side of each span, cut ones left out."""
    # a document's spans are gathered first, so that its text is in one row only
    rest = [c for c in spans.columns if c != "doc_id"]
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("_spans"))
    j = lists.join(docs.select("doc_id", "text"), "doc_id").withColumn("_n", F.length("text"))

    def cut(x: Column) -> Column:
        lo, hi = F.greatest(x["start"] - (length + 2), F.lit(0)), F.least(x["stop"] + (length + 2), F.col("_n"))
        words = F.split(F.substr("text", lo + 1, hi - lo), "[ \\t\\n\\r\\f]+")
        return F.struct(x.alias("x"), words.alias("w"), (lo > 0).alias("cut_first"), (hi < F.col("_n")).alias("cut_last"))

    j = j.select("doc_id", F.explode(F.transform("_spans", cut)).alias("s"))
    first, last = F.when(F.col("s.cut_first"), 2).otherwise(1), F.when(F.col("s.cut_last"), 1).otherwise(0)
    kept = F.slice(F.col("s.w"), first, F.greatest(F.size("s.w") - (first - 1) - last, F.lit(0)))
    words = F.array_sort(F.array_distinct(F.filter(kept, lambda x: x != "")))
    return j.select("doc_id", *[F.col("s.x")[c].alias(c) for c in rest], words.alias("words"))


def previous_tokens(tokens: DataFrame, k: int = 5) -> DataFrame:
    """prev1 to prevk: the strings of the tokens before, within the document; also prevtag1 to prevtagk if tokens have tags."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    kinds = {"prev": "string"} | ({"prevtag": "tag"} if "tag" in tokens.columns else {})
    return tokens.withColumns({f"{name}{i}": F.lag(c, i).over(w) for name, c in kinds.items() for i in range(1, k + 1)})


def context_entities(entities: DataFrame, window: int) -> DataFrame:
    """around: numbers (ann_id) of the entities at most `window` places before or after each, in the order of the text."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop", "ann_id")
    before, after = (F.collect_list("ann_id").over(w.rowsBetween(*r)) for r in ((-window, -1), (1, window)))
    return entities.withColumn("around", F.concat(before, after))


def with_value(spans: DataFrame, feature: str, *values: str) -> DataFrame:
    """Spans whose feature has one of the values; those without the feature go."""
    return spans.where(F.coalesce(F.col(feature).isin(*values), F.lit(False)))


def context_nouns(spans: DataFrame, tokens: DataFrame, glosses: str | None = None, apart: bool = False) -> DataFrame:
    """nouns: the distinct strings of the tokens inside each span whose tag begins with NN, and the parts of its glosses (a column, ;-joined).

    apart: the spans do not overlap each other, so each token looks for its span in one pass, without pairs.
    """
    mine, those = spans.select("doc_id", "ann_id", "start", "stop"), tokens.where(F.col("tag").startswith("NN")).select("doc_id", "start", "stop", "string")
    if apart:
        inside = marked(those, mine).where("b_ann_id is not null").select("doc_id", F.col("b_ann_id").alias("ann_id"), F.col("string").alias("b_string")).distinct()
    else:
        inside = span_join(mine, those, "covers")
    words = inside.groupBy("doc_id", "ann_id").agg(F.collect_set("b_string").alias("nouns"))
    none = F.array().cast("array<string>")
    more = F.filter(F.transform(F.split(F.coalesce(F.col(glosses), F.lit("")), ";"), F.trim), lambda x: x != "") if glosses else none
    return spans.join(words, ["doc_id", "ann_id"], "left").withColumn("nouns", F.array_sort(F.array_distinct(F.concat(F.coalesce("nouns", none), more))))


def removal_counts(marked: DataFrame) -> DataFrame:
    """doc_id, reason, removed: how many spans each filter took from a document (spans marked by `mark`)."""
    return marked.where("deleted_because is not null").groupBy("doc_id", F.col("deleted_because").alias("reason")).agg(F.count("*").alias("removed"))
