"""Queries over texts: tokens, sentences, dictionaries, expressions, entities, tags, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.model import cut_lineage
from marginalia.operators import gazetteer, grammar, negation, rules, spans, tagging, tokens
from marginalia.plans.registry import example, inline, query, table

# SQL of the plain tokens, for the queries below.
TOKENS = r"""
t0 AS (SELECT doc_id, regexp_extract_all(text, '(?s)\p{L}+|\p{N}+|[ \t\n\r\f]|.') AS r FROM documents),
t1 AS (SELECT doc_id, unnest(r) AS string, generate_subscripts(r, 1) - 1 AS tok_no FROM t0),
t2 AS (SELECT *, sum(length(string)) OVER (PARTITION BY doc_id ORDER BY tok_no) AS stop FROM t1),
tok AS (SELECT doc_id, tok_no, string, CAST(stop - length(string) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
  CASE WHEN regexp_matches(string, '^\p{L}') THEN 'word' WHEN regexp_matches(string, '^\p{N}') THEN 'number' WHEN string = ' ' THEN 'space'
    WHEN regexp_matches(string, '^[\t\n\r\f]') THEN 'control' WHEN regexp_matches(string, '^\p{P}') THEN 'punctuation' ELSE 'symbol' END AS kind,
  CASE WHEN regexp_matches(string, '^\p{Lu}\p{Ll}*$') THEN 'upperInitial' WHEN regexp_matches(string, '^\p{Lu}+$') THEN 'allCaps'
    WHEN regexp_matches(string, '^\p{Ll}+$') THEN 'lowercase' WHEN regexp_matches(string, '^\p{L}+$') THEN 'mixedCaps' END AS orth FROM t2),
seen AS (SELECT *, lead(start) OVER d > stop AS apart FROM tok WHERE kind NOT IN ('space', 'control') WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no))
"""
BENCH = TOKENS.replace("documents", "benchmark").replace("doc_id", "item_id").replace("t0 AS", "b0 AS").replace("t1 AS", "b1 AS").replace("t2 AS", "b2 AS").replace("tok AS", "btok AS").replace("seen AS", "bseen AS").replace("FROM t0", "FROM b0").replace("FROM t1", "FROM b1").replace("FROM t2", "FROM b2").replace("FROM tok", "FROM btok")
GRAMS = """
g AS (SELECT doc_id, start, stop AS e1, replace(upper(string), 'ẞ', 'SS') AS w1, apart AS a1, lead(replace(upper(string), 'ẞ', 'SS')) OVER d AS w2, lead(stop) OVER d AS e2, lead(apart) OVER d AS a2,
  lead(replace(upper(string), 'ẞ', 'SS'), 2) OVER d AS w3, lead(stop, 2) OVER d AS e3 FROM seen WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no)),
grams AS (SELECT doc_id, start, e1 AS stop, 1 AS n_tokens, w1 AS norm FROM g UNION ALL SELECT doc_id, start, e2, 2, w1 || ' ' || w2 FROM g WHERE a1 UNION ALL
  SELECT doc_id, start, e3, 3, w1 || ' ' || w2 || ' ' || w3 FROM g WHERE a1 AND a2)
"""
BGRAMS = GRAMS.replace("doc_id", "item_id").replace("g AS (", "bg AS (", 1).replace("grams AS (", "bgrams AS (").replace("FROM seen", "FROM bseen").replace("FROM g", "FROM bg")
DICTIONARY = "dict AS (SELECT norm, min(item_id) AS item_id FROM bgrams WHERE n_tokens >= 2 GROUP BY norm)"
MATCHES = f"WITH {TOKENS}, {BENCH}, {GRAMS}, {BGRAMS}, {DICTIONARY}, m AS (SELECT g.doc_id, g.start, g.stop, norm, d.item_id FROM grams g JOIN dict d USING (norm))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or three words of the benchmark texts, with the first item that has them."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    grams = gazetteer.ngrams(tokens.tokenize(items), 3, shortest=2)
    return grams.groupBy("norm").agg(F.min("doc_id").alias("item_id"))


def mentions(spark: SparkSession, sf_dir: str, longest_only: bool = True) -> DataFrame:
    return gazetteer.match(tokens.words(documents(spark, sf_dir)), dictionary(spark, sf_dir), 3, longest_only, shortest=2)


@query(f"""{MATCHES}, best AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, start) AS m FROM m), l AS (SELECT * FROM best WHERE stop = m),
  c AS (SELECT doc_id, norm, count(*) AS n, min(start) AS first_start, min(item_id) AS item_id FROM l GROUP BY ALL)
  SELECT doc_id, norm, CAST(n AS BIGINT) AS n, CAST(first_start AS BIGINT) AS first_start, item_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, norm) AS BIGINT) AS rank FROM c""")
def linked_mentions(spark, sf_dir):
    """Documents, tokens, dictionary matches, candidates: the longest matches of each document, counted and ranked."""
    m = mentions(spark, sf_dir).groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"), F.min("item_id").alias("item_id"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "norm")
    return m.withColumn("rank", F.row_number().over(w).cast("long"))


@query(f"WITH {TOKENS} SELECT doc_id, kind, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(length(string)) AS BIGINT) AS chars, CAST(sum(start * (tok_no % 97)) AS BIGINT) AS mixed FROM tok GROUP BY ALL")
def tokenize_tiling(spark, sf_dir):
    t = tokens.tokenize(documents(spark, sf_dir))
    return t.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum(F.length("string")).alias("chars"), F.sum(F.col("start").cast("long") * (F.col("tok_no") % 97)).alias("mixed"))


@query(f"WITH {TOKENS} SELECT kind, coalesce(orth, '') AS orth, count(*) AS n, count(DISTINCT string) AS strings FROM tok GROUP BY ALL")
def token_kind_counts(spark, sf_dir):
    t = tokens.strings(documents(spark, sf_dir)).groupBy("kind", "orth", "string").agg(F.count("*").alias("n"))
    return t.groupBy("kind", F.coalesce("orth", F.lit("")).alias("orth")).agg(F.sum("n").alias("n"), F.count("*").alias("strings"))


CONTRACTED = "(VALUES (1, 'It''s nine o''clock, ma''am; we''ll see.'), (2, 'Rock ''n'' roll on the 22nd and 3rd, c''mon.'), (3, 'the 90s and the ''90s'), (4, 'no joins here')) AS t(doc_id, text)"


@example("""SELECT * FROM (VALUES (1, 'It''s'), (1, 'o''clock'), (1, 'ma''am'), (1, 'we''ll'), (2, '''n'''), (2, '22nd'), (2, '3rd'), (2, 'c''mon')) AS t(doc_id, joined)
  WHERE joined NOT IN ('It''s', 'we''ll') UNION ALL SELECT * FROM (VALUES (1, '''s'), (1, '''ll')) AS t(doc_id, joined)""")
def token_post_process(spark, sf_dir):
    t = tokens.join_apostrophes(tokens.tokenize(inline(spark, CONTRACTED)))
    return t.where("orth in ('apostrophe', 'ordinal')").select("doc_id", F.col("string").alias("joined"))


MESSAGES = "(VALUES (1, 'RT @anna: see https://example.org/a?b=1 #BigNews :-)'), (2, 'plain words, nothing else'), (3, '@bob #one #two_3 ;D MT @c'), (4, 'he said \"x\" via @dora')) AS t(doc_id, text)"


@example(r"""WITH m AS (SELECT * FROM MESSAGES), x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)https?://[^ \t\n\r\f]+|#[\p{L}\p{N}_]+|@[A-Za-z0-9_]+|[:;=][-'']?[()DPpO/|]|\p{L}+|\p{N}+|[ \t\n\r\f]|.')) AS s FROM m),
  k AS (SELECT doc_id, s, CASE WHEN s LIKE 'http%//%' THEN 'url' WHEN regexp_matches(s, '^#[\p{L}\p{N}_]') THEN 'hashtag' WHEN regexp_matches(s, '^@[A-Za-z0-9_]') THEN 'user' WHEN regexp_matches(s, '^[:;=][-'']?[()DPpO/|]$') THEN 'emoticon' END AS kind FROM x)
  SELECT doc_id, kind, s AS string, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""".replace("MESSAGES", MESSAGES))
def message_tokens(spark, sf_dir):
    t = tokens.tiles(inline(spark, MESSAGES), tokens.MESSAGE_TILE).withColumn("kind", tokens.message_kind(F.col("string")))
    return t.where("kind in ('url', 'hashtag', 'user', 'emoticon')").groupBy("doc_id", "kind", "string").agg(F.count("*").alias("n"))


@example(f"SELECT doc_id, text LIKE 'RT @%' OR text LIKE '% RT @%' OR text LIKE '% MT @%' OR text LIKE '%\" via @%' AS retweet FROM {MESSAGES}")
def retweet_detect(spark, sf_dir):
    return inline(spark, MESSAGES).select("doc_id", tokens.is_retweet(F.col("text")).alias("retweet"))


ABBREVIATIONS = ", ".join(f"'{a}'" for a in tokens.ABBREVIATIONS)
SENTENCES = rf"""
s0 AS (SELECT *, lead(string) OVER d AS nxt, lag(string) OVER d AS prev, lag(string, 2) OVER d AS p2, lag(string, 3) OVER d AS p3, lag(string, 4) OVER d AS p4 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no)),
s1 AS (SELECT *, CASE WHEN (string IN ('.', '!', '?') AND (nxt IS NULL OR regexp_matches(nxt, '^[ \t\n\r\f]$')) AND NOT coalesce(string = '.' AND (prev IN ({ABBREVIATIONS}) OR regexp_matches(prev, '^\p{{Lu}}$')), false)
  AND NOT coalesce(string || prev || p2 || p3 || p4 = '.....', false)) OR (string = chr(10) AND coalesce(prev = chr(10), false)) THEN 1 ELSE 0 END AS closes FROM s0),
s2 AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_no FROM s1),
sent AS (SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, min(start) FILTER (kind NOT IN ('space', 'control')) AS start, max(stop) FILTER (kind NOT IN ('space', 'control')) AS stop,
  trim(string_agg(string, '' ORDER BY tok_no), chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS string FROM s2 GROUP BY doc_id, sent_no HAVING start IS NOT NULL)
"""


@query(f"WITH {TOKENS}, {SENTENCES} SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops, CAST(sum(length(string)) AS BIGINT) AS chars FROM sent GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    s = tokens.sentence_texts(documents(spark, sf_dir))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"), F.sum(F.length("string")).alias("chars"))


@query(rf"""WITH {TOKENS}, {SENTENCES}, c AS (SELECT string, 0.001 + length(regexp_replace(string, '[^\p{{Lu}}]', '', 'g')) AS up, 0.001 + length(regexp_replace(string, '[^\p{{Ll}}]', '', 'g')) AS low,
  0.001 + len(list_filter(string_split_regex(string, '[_ [:punct:]]+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) AS ups, 0.001 + len(list_filter(string_split_regex(string, '[_ [:punct:]]+'), lambda w: regexp_matches(w, '^\p{{Ll}}'))) AS lows FROM sent)
  SELECT CASE WHEN up / low > 5 THEN 'upper' WHEN regexp_matches(string, '^\p{{Lu}}') THEN CASE WHEN ups / lows > 1 THEN 'title' ELSE 'sentence' END
    WHEN regexp_matches(string, '^\p{{Ll}}') THEN CASE WHEN low / up > 5 THEN 'lower' ELSE 'anomalous' END ELSE 'none' END AS "case", count(*) AS n, CAST(sum(length(string)) AS BIGINT) AS chars FROM c GROUP BY ALL""")
def sentence_case(spark, sf_dir):
    s = tokens.sentence_texts(documents(spark, sf_dir))
    return s.groupBy(F.coalesce(X.sentence_case(F.col("string")), F.lit("none")).alias("case")).agg(F.count("*").alias("n"), F.sum(F.length("string")).alias("chars"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS splits FROM documents WHERE contains(text, chr(10))")
def newline_split(spark, sf_dir):
    return tokens.line_ends(documents(spark, sf_dir))


@query(f"{MATCHES} SELECT doc_id, count(*) AS n, count(DISTINCT norm) AS norms, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops FROM m GROUP BY doc_id")
def gazetteer_match_all(spark, sf_dir):
    m = mentions(spark, sf_dir, longest_only=False)
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("norms"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))


@query(f"{MATCHES}, b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, start) AS mx FROM m) SELECT doc_id, start, stop, norm, item_id FROM b WHERE stop = mx")
def gazetteer_match_longest(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "norm", "item_id")


TAB = "chr(9)"
LIST_LINES = f"(SELECT concat(a, {TAB}, b, {TAB}, c) AS value FROM (VALUES ('New  York', 'inst=ny', 'kind=city'), ('text', 'inst=i2', 'inst=i3'), ('the word', 'x=1', 'y=a=b')) AS v(a, b, c)) AS t"


@example("SELECT * FROM (VALUES ('NEW YORK', CAST(2 AS BIGINT), 'ny', 'city', ''), ('TEXT', 1, 'i3', '', ''), ('THE WORD', 2, '', '', 'a=b')) AS t(norm, n_tokens, inst, kind, y)")
def gazetteer_list_parse(spark, sf_dir):
    from marginalia.sources.dictionaries import parse_list

    e = gazetteer.entries(parse_list(inline(spark, LIST_LINES)))
    value = lambda k: F.coalesce(F.col("features")[k], F.lit("")).alias(k)
    return e.select("norm", F.col("n_tokens").cast("long").alias("n_tokens"), value("inst"), value("kind"), value("y"))


@example("SELECT * FROM (VALUES ('a.lst', 'loc', 'city', 'en', 'Place'), ('b.lst', 'per', '', '', 'Lookup')) AS t(list_file, major, minor, language, ann_type)")
def gazetteer_definition_parse(spark, sf_dir):
    from marginalia.sources.dictionaries import parse_definitions

    d = parse_definitions(inline(spark, "(VALUES ('a.lst:loc:city:en:Place'), ('b.lst:per'), ('  ')) AS t(value)"))
    return d.select("list_file", "major", F.coalesce("minor", F.lit("")).alias("minor"), F.coalesce("language", F.lit("")).alias("language"), "ann_type")


WORDS_DICT = "(VALUES ('RING', 'jewel'), ('WIDGET', 'tool'), ('SMALL RING', 'small jewel')) AS t(norm, value)"


@query(f"""WITH d AS (SELECT * FROM {WORDS_DICT}), k AS (SELECT p_partkey, upper(p_name) AS v FROM part)
  SELECT 'add' AS mode, value, count(*) AS n FROM k LEFT JOIN d ON v = norm GROUP BY ALL UNION ALL
  SELECT 'keep', NULL, count(*) FROM k WHERE EXISTS (SELECT 1 FROM d WHERE v LIKE '%' || norm) UNION ALL
  SELECT 'remove', NULL, count(*) FROM k WHERE NOT EXISTS (SELECT 1 FROM d WHERE v LIKE '%' || norm) UNION ALL
  SELECT 'new', value, count(*) FROM k JOIN d ON v LIKE '%' || norm || '%' GROUP BY ALL""")
def feature_gazetteer_modes(spark, sf_dir):
    part, d = table(spark, sf_dir, "part").select("p_partkey", "p_name"), inline(spark, WORDS_DICT)
    count = lambda df, mode, keyed: df.groupBy(F.lit(mode).alias("mode"), (F.col("value") if keyed else F.lit(None).cast("string")).alias("value")).agg(F.count("*").alias("n"))
    look = lambda mode, **k: gazetteer.by_feature(part, d, "p_name", mode, **k)
    out = count(look("AddFeatures"), "add", True).unionByName(count(look("KeepAnnotation", at_start=False), "keep", False))
    return out.unionByName(count(look("RemoveAnnotation", at_start=False), "remove", False)).unionByName(count(look("AddNewAnnotation", at_start=False, at_end=False), "new", True))


DEMONYMS = "(VALUES ('BELGIAN', 'Belgium'), ('FRENCH', 'France'), ('DUTCH', 'Netherlands')) AS t(norm, query)"
PRESS = "(VALUES (1, 'The Belgian and  French papers'), (2, 'a dutch uncle'), (3, 'nobody')) AS t(doc_id, text)"


@example("SELECT * FROM (VALUES (1, 'Belgian', 'Belgium'), (1, 'French', 'France'), (2, 'dutch', 'Netherlands')) AS t(doc_id, string, query)")
def demonym_query(spark, sf_dir):
    docs = inline(spark, PRESS)
    m = gazetteer.match(tokens.tokenize(docs), inline(spark, DEMONYMS), 1).join(docs, "doc_id")
    clean = X.clean(F.expr("substring(text, start + 1, stop - start)"))
    return m.select("doc_id", clean.alias("string"), F.coalesce("query", F.lower(clean)).alias("query"))


NAMES = "(VALUES (1, 1, 'Jane Anne Doe', 'Person'), (1, 2, 'Lake Town', 'Location'), (2, 1, 'a:b', 'Person'), (2, 2, 'Town Lake', 'Place')) AS t(doc_id, ann_id, string, type)"
NAME_INDEX = "(VALUES ('JANE ANNE DOE', 'jad', 'Person'), ('DOE JANE', 'dj', 'Person'), ('ANNE', 'an', 'Person'), ('LAKE TOWN', 'lt', 'Place'), ('LAKE', 'l', 'Location'), ('A:B', 'ab', 'Person')) AS t(norm, inst, type)"


@example("SELECT * FROM (VALUES (1, 1, 'jad', CAST(0 AS BIGINT)), (1, 1, 'dj', 1), (1, 1, 'an', 2), (1, 2, 'lt', 0), (1, 2, 'l', 2)) AS t(doc_id, ann_id, inst, level)")
def name_index_levels(spark, sf_dir):
    return gazetteer.exact_levels(inline(spark, NAMES), inline(spark, NAME_INDEX)).withColumn("level", F.col("level").cast("long"))


@query("""SELECT p_type, policy, count(*) AS n, min(v) AS least, max(v) AS most FROM (SELECT p_type, 'REPLACE' AS policy, coalesce(nw, existing) AS v FROM x UNION ALL
  SELECT p_type, 'APPEND', CASE WHEN nw IS NULL THEN existing ELSE existing || '|' || nw END FROM x UNION ALL SELECT p_type, 'IGNORE', existing FROM x) GROUP BY ALL""".replace("FROM x", "FROM (SELECT p_type, p_brand AS existing, CASE p_type WHEN 'PROMO' THEN 'sale' WHEN 'LARGE' THEN 'big' END AS nw FROM part) q"))
def feature_update_policies(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type", F.col("p_brand").alias("existing"))
    found = inline(spark, "(VALUES ('PROMO', 'sale'), ('LARGE', 'big')) AS t(key, new)")
    out = [gazetteer.update_feature(part, found, "p_type", p).withColumn("policy", F.lit(p)) for p in ("REPLACE", "APPEND", "IGNORE")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("p_type", "policy").agg(F.count("*").alias("n"), F.min("existing").alias("least"), F.max("existing").alias("most"))


TERM_SQL = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents"


@query(rf"""WITH dt AS (SELECT doc_id, term, count(*) AS tf FROM ({TERM_SQL}) GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
  df AS (SELECT term, count(*) AS df FROM dt GROUP BY term), sc AS (SELECT query_id, doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM q JOIN df USING (term) JOIN dt USING (term) WHERE df < (SELECT count(*) FROM documents) GROUP BY ALL)
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM sc QUALIFY rank <= 3""")
def term_search(spark, sf_dir):
    from marginalia.operators.similarity import term_counts

    docs = documents(spark, sf_dir)
    q = term_counts(table(spark, sf_dir, "benchmark"), "text", "item_id").select(F.col("item_id").alias("query_id"), "term")
    counts = cut_lineage(term_counts(docs, "text", "doc_id"))  # read twice: texts are cut once
    out = gazetteer.term_search(q, counts, docs.count(), 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _per_doc(found: DataFrame, type_: str) -> DataFrame:
    return found.groupBy("doc_id").agg(F.lit(type_).alias("type"), F.count("*").alias("n"), F.min("string").alias("least"), F.max("string").alias("most"))


def _per_doc_sql(source: str, key: str, column: str, pairs: list[tuple[str, str]]) -> str:
    quote = lambda p: p.replace("'", "''")
    return " UNION ALL ".join(f"SELECT {key} AS doc_id, '{t}' AS type, count(*) AS n, min(s) AS least, max(s) AS most FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{quote(p)}')) AS s FROM {source}) GROUP BY {key}" for t, p in pairs)


@query(_per_doc_sql("documents", "doc_id", "text", [("Digits", "[0-9]+")]))
def regex_single_rule(spark, sf_dir):
    return _per_doc(rules.find_all(documents(spark, sf_dir), "text", "[0-9]+"), "Digits")


@query(_per_doc_sql("documents", "doc_id", "text", [(t, rules.ENTITIES[t]) for t in ("Email", "Ip", "Phone", "Identifier")]))
def extract_email_ip_phone(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = [_per_doc(rules.find_all(docs, "text", rules.ENTITIES[t]), t) for t in ("Email", "Ip", "Phone", "Identifier")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_per_doc_sql("pages", "page_id", "url || ' ' || html", [("Url", rules.ENTITIES["Url"])]).replace("AS doc_id", "AS doc_id"))
def extract_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"))
    return _per_doc(rules.find_all(pages, "text", rules.ENTITIES["Url"]), "Url")


FACTS = "(VALUES (1, 'It cost $1,200.50 or 30 million euros, up 4.5% on 12 May 2019 and 2020-01-31.'), (2, 'At 10:30 pm she paid £20 (5 per cent) on March 3rd, 2001'), (3, 'nothing'), (4, '12 High Street SW1A 2AA at 5 o''clock')) AS t(doc_id, text)"
FACT_TYPES = ["Money", "Percent", "Date", "Time", "Postcode", "Street"]


@example(" UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, unnest(regexp_extract_all(text, '{rules.ENTITIES[t].replace(chr(39), chr(39) * 2)}')) AS string FROM {FACTS}" for t in FACT_TYPES))
def extract_money_percent_date(spark, sf_dir):
    docs = inline(spark, FACTS)
    out = [rules.find_all(docs, "text", rules.ENTITIES[t]).select("doc_id", F.lit(t).alias("type"), "string") for t in FACT_TYPES]
    for o in out[1:]:
        out[0] = out[0].unionByName(o)
    return out[0]


PEOPLE = "(VALUES (1, 'Mr. J. Smith met Dr Anna Bell at Green Valley Ltd near Mount Etna.'), (2, 'The University of York and the chairman of Old Town Bank'), (3, 'Paul Brown, 46, swam in Loch Lake')) AS t(doc_id, text)"
FRENCH = "(VALUES (1, 'Mme Curie a payé 20 euros le 3 mars 1911 à la Banque de France.'), (2, 'Rue de Rivoli, 12,5 % des Parisiens')) AS t(doc_id, text)"


def _names_sql(source: str, names: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS string FROM {source}" for t, p in names)


@example(_names_sql(PEOPLE, rules.NAME_RULES))
def named_entities(spark, sf_dir):
    return rules.named_entities(inline(spark, PEOPLE)).select("doc_id", "type", "string")


@example(_names_sql(FRENCH, rules.FRENCH_RULES))
def named_entities_french(spark, sf_dir):
    return rules.named_entities(inline(spark, FRENCH), rules.FRENCH_RULES).select("doc_id", "type", "string")


TAGGED = "(VALUES (1, 'He/PRP has/VBZ never/RB been/VBN seen/VBN'), (2, 'She/PRP will/MD not/RB go/VB and/CC sings/VBZ'), (3, 'Dogs/NNS'), (4, 'It/PRP was/VBD being/VBG built/VBN to/TO last/VB'), (5, 'They/PRP did/VBD not/RB try/VB seeing/VBG'), (6, 'It/PRP might/MD have/VB been/VBN working/VBG')) AS t(doc_id, tagged)"


@example("""SELECT * FROM (VALUES (1, 'has never been seen', 'finite', 'PerPre', 'passive', true), (2, 'will not go', 'finite', 'SimFut', 'active', true), (2, 'sings', 'finite', 'SimPre', 'active', false),
  (4, 'was being built', 'finite', 'ConPas', 'passive', false), (4, 'to last', 'infinitive', 'SimInf', 'active', false), (5, 'did not try', 'finite', 'SimPas', 'active', true), (5, 'seeing', 'participle', 'Pre', 'active', false),
  (6, 'might have been working', 'modal', 'PerConModal', 'active', false)) AS t(doc_id, words, kind, tense, voice, negated)""")
def verb_groups(spark, sf_dir):
    """Rules over sequences of word classes."""
    t = inline(spark, TAGGED).select("doc_id", F.posexplode(F.split("tagged", " ")).alias("tok_no", "w"))
    t = t.select("doc_id", F.lit(0).alias("sent_no"), "tok_no", F.col("tok_no").alias("start"), (F.col("tok_no") + 1).alias("stop"), F.substring_index("w", "/", 1).alias("string"), F.substring_index("w", "/", -1).alias("tag"))
    g = grammar.verb_groups(t).select("doc_id", "first", F.explode(F.sequence("first", "last")).alias("tok_no"), "kind", "tense", "voice", "negated")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "string"))), lambda x: x["string"]), " ")
    return g.join(t, ["doc_id", "tok_no"]).groupBy("doc_id", "first", "kind", "tense", "voice", "negated").agg(words.alias("words")).select("doc_id", "words", "kind", "tense", "voice", "negated")


REPORTS = "(VALUES (1, 'Mr. J. Smith met Anna Bell, director of Green & Old Valley Ltd, near Mount Etna.'), (2, 'The University of York hired Kolb, 46, in Quern.'), (3, 'said Zorn. Paris is big'), (4, 'chairman Brack')) AS t(doc_id, text)"
KNOWN_NAMES = "(VALUES ('ANNA', 'first_name'), ('PARIS', 'location'), ('PARIS', 'first_name'), ('YORK', 'location')) AS t(norm, kind)"


@example("""SELECT * FROM (VALUES (1, 'Mr. J. Smith', 'Person', 'PersonTitle'), (1, 'Anna Bell', 'Person', 'PersonFull'), (1, 'director', 'JobTitle', 'JobTitle'), (1, 'Green & Old Valley Ltd', 'Organization', 'CompanyEnding'), (1, 'Mount Etna', 'Location', 'LocationKey'),
  (2, 'University of York', 'Organization', 'KeyOf'), (2, 'Kolb', 'Person', 'PersonContext'), (2, 'Quern', 'Location', 'LocationContext'), (3, 'Zorn', 'Person', 'SaysPerson'), (3, 'Paris', 'Person', 'FirstName'), (4, 'chairman', 'JobTitle', 'JobTitle'), (4, 'Brack', 'Person', 'JobTitlePerson')) AS t(doc_id, string, type, rule)""")
def name_grammar(spark, sf_dir):
    """Phases of rules over coded tokens: titles, endings, keys and dictionaries, then what stands next to unknown names."""
    docs = inline(spark, REPORTS)
    t = tokens.sentence_numbers(tokens.tokenize(docs))
    look = gazetteer.match(t, inline(spark, KNOWN_NAMES), 2)
    n = grammar.find_names(grammar.numbered(t), look).join(docs, "doc_id")
    return n.select("doc_id", F.expr("substring(text, start + 1, stop - start)").alias("string"), "type", "rule").where("type <> 'Unknown' and string <> 'The'")


@query(rf"WITH {TOKENS}, {SENTENCES}, c AS (SELECT doc_id, sent_no, string_agg(CASE WHEN regexp_matches(string, '^\p{{Lu}}$') THEN 'I' WHEN orth = 'upperInitial' THEN 'U' WHEN orth = 'allCaps' THEN 'A' ELSE 'o' END, '' ORDER BY tok_no) AS codes FROM s2 WHERE kind NOT IN ('space', 'control') GROUP BY ALL), m AS (SELECT doc_id, unnest(regexp_extract_all(codes, '[UA]+o?[UA]')) AS m FROM c) SELECT doc_id, count(*) AS n, CAST(sum(length(m)) AS BIGINT) AS length FROM m GROUP BY doc_id")
def sequence_rules(spark, sf_dir):
    """One rule over the coded tokens of every sentence of the corpus."""
    t = grammar.numbered(tokens.sentence_numbers(tokens.tokenize(documents(spark, sf_dir))))
    code = grammar.code_of([(F.col("string").rlike(r"^\p{Lu}$"), "I"), (F.col("orth") == "upperInitial", "U"), (F.col("orth") == "allCaps", "A")])
    m = grammar.match_sequences(t.withColumn("code", code), [grammar.SequenceRule("[UA]+o?[UA]", "Name")], style="all")
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("codes")).alias("length"))


LEXICON = "(VALUES ('the', 'DT'), ('of', 'IN'), ('and', 'CC'), ('is', 'VBZ'), ('it', 'PRP'), ('to', 'TO'), ('in', 'IN'), ('on', 'IN')) AS t(word, tag)"


@query(rf"""WITH {TOKENS}, lex AS (SELECT * FROM {LEXICON}), g AS (SELECT tok.doc_id, tok_no, string, coalesce(a.tag, b.tag, CASE WHEN kind = 'number' THEN 'CD' WHEN kind IN ('punctuation', 'symbol') THEN string WHEN regexp_matches(string, '^\p{{Lu}}') THEN 'NNP'
  {' '.join(f"WHEN string LIKE '%{e}' THEN '{t}'" for e, t in tagging.SUFFIXES)} ELSE 'NN' END) AS tag FROM tok LEFT JOIN lex a ON a.word = string LEFT JOIN lex b ON b.word = lower(string) WHERE kind NOT IN ('space', 'control')),
  p AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY tok_no), '') AS prev FROM g)
  SELECT CASE WHEN prev IN ('TO', 'MD') AND tag IN ('NN', 'VBP') THEN 'VB' WHEN prev = 'DT' AND tag IN ('VB', 'VBP', 'VBD') THEN 'NN' ELSE tag END AS tag, count(*) AS n, count(DISTINCT string) AS strings FROM p GROUP BY ALL""")
def lexicon_tags(spark, sf_dir):
    t = tagging.tag_words(tokens.words(documents(spark, sf_dir)), inline(spark, LEXICON))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("string").alias("strings"))


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS tok_no, o_orderstatus AS label FROM orders), f AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no)),
  r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY tok_no) AS run FROM f) SELECT doc_id, CAST(min(tok_no) AS BIGINT) AS start, CAST(max(tok_no) + 1 AS BIGINT) AS stop, min(label) AS type, count(*) AS n_tokens FROM r WHERE label <> 'O' GROUP BY doc_id, run""")
def label_runs(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("tok_no"), F.col("o_orderstatus").alias("label"))
    t = t.withColumns({"start": F.col("tok_no"), "stop": F.col("tok_no") + 1})
    return tokens.label_runs(t)


CHAIN_NAMES = "(VALUES (1, 1, 'Mr John Smith'), (1, 2, 'Smith'), (1, 3, 'United Nations'), (1, 4, 'UN'), (1, 5, 'Ångström'), (1, 6, 'Angstrom'), (2, 1, 'Smith'), (2, 2, 'Jones')) AS t(doc_id, ann_id, string)"


@example("SELECT * FROM (VALUES (1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (1, 5, 5), (1, 6, 6), (2, 1, 1), (2, 2, 2)) AS t(doc_id, ann_id, chain_id)")
def name_variants(spark, sf_dir):
    return tagging.name_variants(inline(spark, CHAIN_NAMES)).select("doc_id", "ann_id", "chain_id")


ROOTS = "(VALUES ('is', 'be'), ('are', 'be'), ('was', 'be'), ('thes', 'the'), ('ands', 'and')) AS t(form, root)"


@query(f"WITH {TOKENS} SELECT root, count(*) AS n FROM (SELECT coalesce(r.root, lower(string)) AS root FROM tok LEFT JOIN {ROOTS.replace('AS t(', 'AS r(')} ON r.form = lower(string) WHERE kind = 'word') GROUP BY root")
def lemma_counts(spark, sf_dir):
    words = tokens.strings(documents(spark, sf_dir)).where("kind = 'word'").groupBy("string").agg(F.count("*").alias("n"))
    return tagging.lemmas(words, inline(spark, ROOTS)).groupBy("root").agg(F.sum("n").alias("n"))


CAMEL = "(VALUES (1, 'SaveTheWhales'), (2, 'NASALaunch'), (3, 'iPhone'), (4, 'plain'), (5, 'ABCd')) AS t(id, s)"


@example(f"SELECT id, regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{{2}})([a-z])', '\\1 \\2', 'g') AS parts FROM {CAMEL}")
def camel_split(spark, sf_dir):
    return inline(spark, CAMEL).select("id", F.array_join(X.camel_split(F.col("s")), " ").alias("parts"))


NOTES = "(VALUES (1, 'No sign of fever but Cough persists.'), (2, 'Mother had Asthma.'), (3, 'Patient denies Pain. Pain later.'), (4, 'Not only Cough.'), (5, 'History of Stroke.')) AS t(doc_id, text)"
TRIGGERS = "(VALUES ('NO SIGN OF', 'negation', 'Negated', false), ('DENIES', 'negation', 'Negated', false), ('NOT', 'negation', 'Negated', false), ('NOT ONLY', 'negation', 'Negated', true), ('HISTORY OF', 'temporality', 'historical', false), ('MOTHER', 'experiencer', 'Other', false)) AS t(norm, kind, value, pseudo)"
CONCEPTS = "(VALUES ('FEVER'), ('COUGH'), ('ASTHMA'), ('PAIN'), ('STROKE')) AS t(norm)"


@example("""SELECT * FROM (VALUES (1, 'FEVER', 'Negated', 'Recent', 'Patient'), (1, 'COUGH', 'Affirmed', 'Recent', 'Patient'), (2, 'ASTHMA', 'Affirmed', 'Recent', 'Other'), (3, 'PAIN', 'Negated', 'Recent', 'Patient'), (3, 'PAIN', 'Affirmed', 'Recent', 'Patient'),
  (4, 'COUGH', 'Affirmed', 'Recent', 'Patient'), (5, 'STROKE', 'Affirmed', 'historical', 'Patient')) AS t(doc_id, norm, negation, temporality, experiencer)""")
def context_negation(spark, sf_dir):
    con = tag_context(spark, inline(spark, NOTES), inline(spark, TRIGGERS), inline(spark, CONCEPTS), 1)
    return con.select("doc_id", "norm", "negation", "temporality", "experiencer")


def tag_context(spark, docs, triggers, concepts, longest):
    """Triggers, words that end their scopes and concepts are looked for in one pass over the tokens."""
    of = lambda df, role: df.withColumn("role", F.lit(role))
    words = of(triggers, "trigger").unionByName(of(inline(spark, "(VALUES ('BUT'), ('HOWEVER')) AS t(norm)"), "end"), allowMissingColumns=True).unionByName(of(concepts, "concept"), allowMissingColumns=True)
    s = cut_lineage(tokens.sentence_texts(docs).select("doc_id", "sent_no", F.col("first").alias("start"), F.col("last").alias("stop")))
    found = gazetteer.match(tokens.words(docs), words, max(3, longest), longest_only=False)
    # a concept has `longest` words at most, and of those with one start the longest counts
    n_words = F.size(F.split("norm", " "))
    found = found.where((F.col("role") == "trigger") | (n_words <= F.when(F.col("role") == "end", 1).otherwise(longest)))
    most = F.max(F.when(F.col("role") == "concept", F.col("stop"))).over(Window.partitionBy("doc_id", "start"))
    found = found.withColumn("_m", most).where("role <> 'concept' or stop = _m").drop("_m")
    found = cut_lineage(spans.marked(found, s).withColumnRenamed("b_sent_no", "sent_no").drop("b_start", "b_stop").where("sent_no is not null"))
    trig, ends = (found.where(F.col("role") == r).drop("norm", "role") for r in ("trigger", "end"))
    con = found.where("role = 'concept'").select("doc_id", "start", "stop", *concepts.columns, "sent_no").withColumn("ann_id", F.col("start"))
    return negation.tag(con, trig, ends.select("doc_id", "start", "stop", "sent_no"), s.select("doc_id", "sent_no", "stop"))


NEGATIONS = "(VALUES ('NO', 'negation', 'Negated', false), ('NOT', 'negation', 'Negated', false), ('WITHOUT', 'negation', 'Negated', false), ('NEVER', 'negation', 'Negated', false)) AS t(norm, kind, value, pseudo)"


@query()
def context_negation_documents(spark, sf_dir):
    """Dictionary matches of the documents after no, not, without and never; no SQL, tested against a scan by hand."""
    norms = dictionary(spark, sf_dir).select("norm").distinct()
    con = tag_context(spark, documents(spark, sf_dir), inline(spark, NEGATIONS), norms, 3)
    return con.groupBy("doc_id", "negation").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query(f"""WITH {TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_no) AS i FROM seen), f AS (SELECT doc_id, i, string FROM n WHERE lower(string) IN ('no', 'not', 'nicht', 'sans')),
  c AS (SELECT f.doc_id, f.i AS spot, n.string FROM f JOIN n ON n.doc_id = f.doc_id AND n.i BETWEEN f.i - 3 AND f.i + 3 AND n.i <> f.i)
  SELECT doc_id, count(*) AS n, count(DISTINCT spot) AS spots, count(DISTINCT string) AS strings FROM c GROUP BY doc_id""")
def context_window_tokens(spark, sf_dir):
    seen = tokens.words(documents(spark, sf_dir))
    c = spans.near_tokens(seen, F.lower("string").isin("no", "not", "nicht", "sans"), 3)
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("ann_id").alias("spots"), F.countDistinct("string").alias("strings"))


@query(rf"""{MATCHES}, b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, start) AS mx FROM m), l AS (SELECT b.doc_id, b.start, b.stop, greatest(b.start - 22, 0) AS lo, least(b.stop + 22, length(d.text)) AS hi, length(d.text) AS n, d.text FROM b JOIN documents d USING (doc_id) WHERE stop = mx),
  w AS (SELECT doc_id, start, stop, lo, hi, n, string_split_regex(substr(text, lo + 1, hi - lo), '[ \t\n\r\f]+') AS w FROM l),
  k AS (SELECT doc_id, start, stop, list_sort(list_distinct(list_filter(w[(CASE WHEN lo > 0 THEN 2 ELSE 1 END):(len(w) - CASE WHEN hi < n THEN 1 ELSE 0 END)], lambda x: x <> ''))) AS k FROM w)
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(len(k) AS BIGINT) AS n_words, array_to_string(k, ' ') AS words FROM k""")
def context_window_chars(spark, sf_dir):
    c = spans.context_words(mentions(spark, sf_dir), documents(spark, sf_dir), 20)
    return c.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(f"WITH {TOKENS}, p AS (SELECT string, lag(string) OVER d AS p1, lag(string, 5) OVER d AS p5 FROM seen WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no)) SELECT coalesce(p1, '') AS prev1, count(*) AS n, count(p5) AS with_five, count(DISTINCT p5) AS fifths FROM p WHERE string = '.' GROUP BY ALL")
def positional_lag(spark, sf_dir):
    t = spans.previous_tokens(tokens.words(documents(spark, sf_dir))).where("string = '.'")
    return t.groupBy(F.coalesce("prev1", F.lit("")).alias("prev1")).agg(F.count("*").alias("n"), F.count("prev5").alias("with_five"), F.countDistinct("prev5").alias("fifths"))


RULE_FILE = """
digits=[0-9]+
|(<<digits>>)
1 => Number kind="int",value=$1
|(<<digits>>)[/.](<<digits>>)
0 => Fraction upper=$1,lower=$2
|([A-Z][a-z]+)
1 => Upper
|word
0 => Word
"""



CHUNK_RULES = ["I O P=PRP", "O I P=VBG P=NN:1", "I B T=I:-1 P=DT"]



@query(f"""{MATCHES}, {SENTENCES}, b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, start) AS mx FROM m), l AS (SELECT DISTINCT doc_id, start, stop FROM b WHERE stop = mx)
  SELECT doc_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM sent s WHERE s.doc_id = l.doc_id AND l.start >= s.start AND l.stop <= s.stop)) AS inside FROM l GROUP BY doc_id""")
def in_sentence_filter(spark, sf_dir):
    """Dictionary matches that lie within one sentence, and all of them."""
    t = tokens.words(documents(spark, sf_dir))
    m = gazetteer.match(t, dictionary(spark, sf_dir), 3).select("doc_id", "start", "stop").distinct()
    s = tokens.sentence_texts(documents(spark, sf_dir)).select("doc_id", "start", "stop")
    return spans.marked(m, s).groupBy("doc_id").agg(F.count("*").alias("n"), F.count("b_stop").alias("inside"))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n FROM seen WHERE NOT (kind = 'number' OR lower(string) IN ('the', 'of', 'and', 'der', 'die', 'le', 'la', 'de')) GROUP BY doc_id")
def stop_word_filter(spark, sf_dir):
    """Spans that are exactly a stop word or a number go."""
    t = tokens.words(documents(spark, sf_dir)).withColumn("ann_id", F.col("tok_no"))
    stops = t.where(F.lower("string").isin("the", "of", "and", "der", "die", "le", "la", "de"))
    return spans.drop_stop_words(t.select("doc_id", "ann_id", "start", "stop"), stops, t).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_no) AS i FROM seen), f AS (SELECT doc_id, i FROM w WHERE orth = 'allCaps' AND length(string) > 3)
  SELECT f.doc_id, count(DISTINCT f.i) AS spots, count(DISTINCT w.string) AS nouns FROM f JOIN w ON w.doc_id = f.doc_id AND w.i BETWEEN f.i - 4 AND f.i + 4 AND w.i <> f.i WHERE w.orth = 'upperInitial' GROUP BY f.doc_id""")
def noun_context(spark, sf_dir):
    """Names near a mention, as its context."""
    seen = tokens.words(documents(spark, sf_dir))
    near = spans.near_tokens(seen, F.expr("orth = 'allCaps' and length(string) > 3"), 4).where("orth = 'upperInitial'")
    return near.groupBy("doc_id").agg(F.countDistinct("ann_id").alias("spots"), F.countDistinct("string").alias("nouns"))


@query(f"SELECT coalesce(value, 'none') AS value, count(*) AS n FROM (SELECT p_partkey, coalesce(CASE WHEN lower(p_name) = 'small ring' THEN 'small jewel' END, CASE WHEN p_size > 25 THEN 'old' END) AS value FROM part) GROUP BY ALL")
def feature_overwrite(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "old").alias("value"))
    out = gazetteer.by_feature(p, inline(spark, WORDS_DICT), "p_name", "OverwriteFeatures")
    return out.groupBy(F.coalesce("value", F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS f, string_split_regex(text, '[0-9]+') AS g FROM documents), e AS (SELECT doc_id, unnest(f) AS s, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM m),
  p AS (SELECT doc_id, i, s, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM e) SELECT doc_id, CAST(i - 1 AS BIGINT) AS match_no, CAST(stop - length(s) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, s AS string FROM p""")
def regex_spans(spark, sf_dir):
    """Matches of one expression with their places."""
    f = rules.find_spans(documents(spark, sf_dir), "text", "[0-9]+")
    return f.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("match_no", "start", "stop")], "string")
