"""Tokens and sentences.

The text is tiled by one expression, so the tiles put together are the text and offsets are a running sum of lengths.
Texts are dealt by doc_id once, before they are cut: all windows and joins on doc_id that follow find that in place
and shuffle no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import token_kind, token_orth

TILE = r"(?s)\p{L}+|\p{N}+|[ \t\n\r\f]|."
#: Tokens of short messages come before the plain ones.
MESSAGE_TILE = r"(?s)https?://[^ \t\n\r\f]+|#[\p{L}\p{N}_]+|@[A-Za-z0-9_]+|[:;=][-']?[()DPpO/|]|" + TILE[4:]
#: A lower-case word and a number that touch are one token of a message (gr8, 2day).
RECOMBINED = r"\p{Ll}+\p{N}+|\p{N}+\p{Ll}+(?!\p{L})"
RECOMBINING_TILE = MESSAGE_TILE.replace(TILE[4:], f"{RECOMBINED}|{TILE[4:]}")
# What is joined to an apostrophe, and words after which a full stop ends nothing.
AFTER_APOSTROPHE = "30s 40s 50s 60s 70s 80s 90s Cause cause Em em N S s T d ll m re til ve".split()
ABBREVIATIONS = "Adm Brig CO CORP Capt Cmdr Co Col Comdr DR Dr Fig GMBH Gen Gov INC LTD Lt Ltd MP Maj Mr Mrs Ms NA NV Oy PLC Prof Rep SA SIR SR Sen Sgt St VP ad al ed eds eg et etc fig ie op pp vol".split()
# End of fixed values.


#: Characters of text in one part. A token takes some hundred bytes of memory while its part is sorted: a part of this size never spills.
PART = 2_000_000


def deal(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt by doc_id into parts of some PART characters of text, whatever the session's number of partitions.

    The texts are measured, as sizes of files or plans tell little about them. Each part is sorted, so that its tokens come in order.
    """
    n = 1 if docs.isStreaming else docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return docs.repartition(-(-n // PART) or 1, "doc_id").sortWithinPartitions("doc_id")


def _cut(docs: DataFrame, parts: Column, number: str, part: str) -> DataFrame:
    """The parts of each text with their numbers. The outer form of explode spares the test for empty lists that the optimizer puts
    before the plain one, which would cut each text twice more."""
    out = deal(docs.select("doc_id", "text")).select("doc_id", F.posexplode_outer(parts).alias(number, part))
    return out.where(F.col(number).isNotNull())


def tiles(docs: DataFrame, pattern: str = TILE) -> DataFrame:
    """doc_id, tok_no (from 0), start, stop, string of every tile. Null and empty texts have none."""
    out = _cut(docs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "tok_no", "string")
    stop = F.sum(F.length("string")).over(Window.partitionBy("doc_id").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return out.withColumn("stop", stop).select("doc_id", "tok_no", (F.col("stop") - F.length("string")).alias("start"), "stop", "string")


def strings(docs: DataFrame, pattern: str = TILE) -> DataFrame:
    """doc_id, string, kind, orth of every tile, without its place: texts are cut where they lie, nothing is shuffled."""
    out = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("string"))
    return out.withColumns({"kind": token_kind(F.col("string")), "orth": token_orth(F.col("string"))})


def line_ends(docs: DataFrame) -> DataFrame:
    """doc_id, splits: how many line ends a text has, where it has any."""
    return docs.select("doc_id", F.regexp_count("text", F.lit("\n")).cast("long").alias("splits")).where("splits > 0")


def tokenize(docs: DataFrame, pattern: str = TILE) -> DataFrame:
    """tiles() with kind and orth."""
    return tiles(docs, pattern).withColumns({"kind": token_kind(F.col("string")), "orth": token_orth(F.col("string"))})


def visible(tokens: DataFrame) -> DataFrame:
    """Tokens without white space."""
    return tokens.where(~F.col("string").isin(*" \t\n\r\f"))


def words(docs: DataFrame) -> DataFrame:
    """visible(tokenize(docs)) with tok_no anew from 0: white space is cut together with the token after it, so it makes no rows."""
    pattern = r"(?s)[ \t\n\r\f]*(?:\p{L}+|\p{N}+|.)"
    cut = _cut(docs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "tok_no", "_raw")
    stop = F.sum(F.length("_raw")).over(Window.partitionBy("doc_id").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    out = cut.withColumn("stop", stop).withColumn("string", F.ltrim("_raw", F.lit(" \t\n\r\f"))).where("string <> ''")
    out = out.select("doc_id", "tok_no", (F.col("stop") - F.length("string")).alias("start"), "stop", "string")
    return out.withColumns({"kind": token_kind(F.col("string")), "orth": token_orth(F.col("string"))})


def message_kind(c: Column) -> Column:
    """Kind of a token of a short message."""
    return F.when(c.rlike("^https?://."), "url").when(c.rlike(r"^#[\p{L}\p{N}_]"), "hashtag").when(c.rlike("^@[A-Za-z0-9_]"), "user").when(c.rlike(r"^[:;=][-']?[()DPpO/|]$"), "emoticon").otherwise(token_kind(c))


def is_retweet(text: Column) -> Column:
    return text.rlike(r'(^|[^\p{L}\p{N}])[RM]T @[A-Za-z0-9_]') | text.rlike(r'" via @[A-Za-z0-9_]')


def _runs(tokens: DataFrame, starts: Column) -> DataFrame:
    """Put runs of tokens together: a token for which `starts` is true begins a new one."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    g = tokens.withColumn("_run", F.sum(starts.cast("int")).over(w))
    merged = g.groupBy("doc_id", "_run").agg(F.min("tok_no").alias("tok_no"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "string"))), lambda x: x["string"]), "").alias("string"), F.first("kind").alias("kind"), F.first("orth").alias("orth"))
    return merged


def join_apostrophes(tokens: DataFrame) -> DataFrame:
    """Join 's, 'll, 'n', c'mon, o'clock, ma'am and ordinals (1st) into one word each."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    s = F.col("string")
    at = lambda k: F.lag("string", k).over(w) if k > 0 else F.lead("string", -k).over(w)
    n = F.lower(s)
    suffix = (at(1) == "'") & s.isin(AFTER_APOSTROPHE)
    n_of_n = (s == "n") & (at(1) == "'") & (at(-1) == "'")
    close_n = (s == "'") & (at(1) == "n") & (at(2) == "'")
    pair = lambda a, b: (s == b) & (at(1) == "'") & F.lower(at(2)).isin(a)
    middle = lambda a, b: (s == "'") & F.lower(at(1)).isin(a) & (at(-1) == b)
    ordinal = at(1).rlike("^[0-9]+$") & n.isin("st", "nd", "rd", "th")
    joins = [suffix, n_of_n, close_n, ordinal] + [f(a, b) for a, b in (("c", "mon"), ("o", "clock"), ("ma", "am")) for f in (pair, middle)]
    glued = F.lit(False)
    for j in joins:
        glued = glued | F.coalesce(j, F.lit(False))
    out = _runs(tokens.withColumn("_glued", glued), ~F.col("_glued"))
    changed = F.col("_n") > 1
    return out.withColumns({"kind": F.when(changed, "word").otherwise(F.col("kind")), "orth": F.when(changed & F.col("string").contains("'"), "apostrophe").when(changed, "ordinal").otherwise(F.col("orth"))}).drop("_run", "_n")


def sentence_numbers(tokens: DataFrame, newline_splits: bool = False) -> DataFrame:
    """sent_no of every token, from 0.

    A run of . ! ? followed by white space or the end of the text closes a sentence, unless it is one full stop after
    an abbreviation or an initial or it is five dots and more; an empty line closes one too (with newline_splits any line end).
    """
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    s = F.col("string")
    nxt, prev = F.lead("string", 1).over(w), F.lag("string", 1).over(w)
    mark = s.isin(".", "!", "?") & (nxt.isNull() | nxt.rlike(r"^[ \t\n\r\f]$"))
    dots = F.concat(s, *[F.lag("string", k).over(w) for k in range(1, 5)]) == "....."
    mark = mark & ~F.coalesce((s == ".") & (prev.isin(ABBREVIATIONS) | prev.rlike(r"^\p{Lu}$")), F.lit(False)) & ~F.coalesce(dots, F.lit(False))
    blank = (s == "\n") & (F.lit(True) if newline_splits else F.coalesce(prev == "\n", F.lit(False)))
    closes = tokens.withColumn("_closes", (mark | blank).cast("int"))
    return closes.withColumn("sent_no", F.coalesce(F.sum("_closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_closes")


def sentences(tokens: DataFrame, newline_splits: bool = False) -> DataFrame:
    """doc_id, sent_no, start, stop, string: from the first visible token of a sentence to its last one."""
    seen = ~F.col("string").rlike(r"^[ \t\n\r\f]$")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "string"))), lambda x: x["string"]), "")
    out = sentence_numbers(tokens, newline_splits).groupBy("doc_id", "sent_no").agg(F.min(F.when(seen, F.col("start"))).alias("start"), F.max(F.when(seen, F.col("stop"))).alias("stop"), text.alias("string"))
    return out.where("start is not null").withColumn("string", F.regexp_replace("string", r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""))


#: A token of letters that is not a part of a longer one begins here. Java looks back by chars: `(?:(?!)x)?`, which never matches,
#: makes it look back far enough for a letter of two chars.
_TWO = "(?:(?!)x)?"
_NO_LETTER = rf"(?<!\p{{L}}{_TWO})"
#: The characters with which sentence_numbers() ends a sentence.
_MARK = rf"[.!?](?=[ \t\n\r\f]|\z)(?<!{_NO_LETTER}(?:{'|'.join(ABBREVIATIONS)})[.])(?<!{_NO_LETTER}\p{{Lu}}{_TWO}[.])(?<![.]{{5}})"


def sentence_texts(docs: DataFrame, newline_splits: bool = False) -> DataFrame:
    """doc_id, sent_no, first, last, start, stop, string: the sentences of sentences(), cut out of the texts without building a token.

    first and last are the ends with the white space around. Sentences of white space are left out.
    """
    pattern = _MARK + ("|\n" if newline_splits else "|\n(?<=\n\n)")
    ends = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    raw = F.zip_with(F.split("text", pattern, -1), ends, lambda piece, end: F.concat(piece, F.coalesce(end, F.lit(""))))
    cut = _cut(docs, raw, "sent_no", "_raw")
    last = F.sum(F.length("_raw")).over(Window.partitionBy("doc_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    space = F.lit(" \t\n\r\f")
    out = cut.withColumn("last", last).withColumn("first", F.col("last") - F.length("_raw")).withColumn("_left", F.ltrim("_raw", space))
    bare = F.reverse(F.ltrim(F.reverse("_left"), space))  # rtrim() walks through the whole string with a search for each char
    out = out.withColumns({"start": F.col("last") - F.length("_left"), "string": bare}).where("_left <> ''")
    return out.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "first", "last", "start", (F.col("start") + F.length("string")).alias("stop"), "string")


def label_runs(tokens: DataFrame, label: str = "label", outside: str = "O") -> DataFrame:
    """Spans from sequence labels: neighbours of one label are one span (B- starts anew, I- goes on)."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    bare = F.regexp_replace(label, "^[BI]-", "")
    t = tokens.withColumn("_type", bare)
    new = (F.coalesce(F.lag("_type").over(w) != F.col("_type"), F.lit(True)) | F.col(label).startswith("B-")).cast("int")
    t = t.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return t.where(F.col("_type") != outside).groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("_type").alias("type"), F.count("*").alias("n_tokens")).drop("_run")


# What ends a sentence and belongs to it, what ends one and does not, and what only looks like an end.
INTERNAL_SPLITS = "[.]{1,3}\"?|[!?]{1,4}\"?"
EXTERNAL_SPLITS = "[ \\t]*\\n(?:[ \\t]*\\n)+"
NO_SPLITS = r"\b(?:" + "|".join(ABBREVIATIONS) + r")[.]|\b\p{Lu}[.]|\b[\p{L}\p{N}]+(?:[.][\p{L}\p{N}]+)+"
# End of fixed values.


def regex_sentences(docs: DataFrame, internal: str = INTERNAL_SPLITS, external: str = EXTERNAL_SPLITS, none: str = NO_SPLITS) -> DataFrame:
    """doc_id, start, stop of the sentences between splits, white space at their ends left out.

    A match of internal ends a sentence and belongs to it, one of external lies between two; matches that overlap one of
    `none` count for nothing. Of a document's splits each begins after the one before has ended. Texts of white space have none.
    """
    from marginalia.operators.rules import find_spans
    from marginalia.operators.spans import matched

    d = docs.select("doc_id", "text")
    at = lambda p, inside: find_spans(d, "text", p).select("doc_id", "start", "stop", F.lit(inside).alias("inside"))
    splits = at(internal, True).unionByName(at(external, False))
    splits = matched(splits, at(none, False).select("doc_id", "start", "stop"), "overlap", keep=False)
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "inside")
    ends = splits.unionByName(d.select("doc_id", F.length("text").alias("start"), F.length("text").alias("stop"), F.lit(False).alias("inside")))
    ends = ends.withColumn("from", F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("to", F.when(F.col("inside"), F.col("stop")).otherwise(F.col("start")))
    pieces = ends.where("`to` > `from`").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("p")).join(d, "doc_id")
    piece = pieces.select("doc_id", F.explode(F.transform("p", lambda x: F.struct(x["from"].alias("a"), F.substr("text", x["from"] + 1, x["to"] - x["from"]).alias("s")))).alias("x")).select("doc_id", "x.a", "x.s")
    bare = F.regexp_replace("s", r"^\s+", "")
    start = F.col("a") + F.length("s") - F.length(bare)
    return piece.select("doc_id", start.alias("start"), (start + F.length(F.regexp_replace(bare, r"\s+$", ""))).alias("stop")).where("stop > start")
