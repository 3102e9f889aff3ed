"""Queries of operators over texts and rows that are put together from the driver's tables, one for each row of a table.

Each source is SQL that both engines read alike; what must come out of it is worked out in SQL from the same columns. The
same operators on small fixed cases are the examples beside the other queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import concepts, uris
from marginalia.functions import text as X
from marginalia.operators import candidates as C
from marginalia.operators import entities, gazetteer, grammar, rules, similarity, spans, tagging, tokens
from marginalia.plans.registry import derived, inline, query, table
from marginalia.plans.text_queries import FACT_TYPES, KNOWN_NAMES, TOKENS, tag_context
from marginalia.sources import dictionaries, messages, sinks

W1, W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
CAP1, CAP2 = (f"upper(substr({w}, 1, 1)) || substr({w}, 2)" for w in (W1, W2))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).hint("shuffle_merge")  # as derived()


# ---- tokens ------------------------------------------------------------------------------------------------------

CONTRACTED = "SELECT p_partkey AS doc_id, 'The ' || p_name || '''s ' || p_size || 'th o''clock, we''ll see the ''' || p_size || 's' AS text FROM part"


@query("SELECT p_partkey AS doc_id, unnest(['''s', p_size || 'th', 'o''clock', '''ll']) AS joined FROM part")
def token_post_process(spark, sf_dir):
    t = tokens.join_apostrophes(tokens.tokenize(derived(spark, sf_dir, CONTRACTED)))
    return t.where("orth in ('apostrophe', 'ordinal')").select("doc_id", F.col("string").alias("joined"))


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)https?://[^ \t\n\r\f]+|#[\p{L}\p{N}_]+|@[A-Za-z0-9_]+|[:;=][-'']?[()DPpO/|]|\p{L}+|\p{N}+|[ \t\n\r\f]|.')) AS s FROM documents),
  k AS (SELECT doc_id, s, CASE WHEN s LIKE 'http%//%' THEN 'url' WHEN regexp_matches(s, '^#[\p{L}\p{N}_]') THEN 'hashtag' WHEN regexp_matches(s, '^@[A-Za-z0-9_]') THEN 'user' WHEN regexp_matches(s, '^[:;=][-'']?[()DPpO/|]$') THEN 'emoticon' END AS kind FROM x)
  SELECT doc_id, kind, s AS string, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def message_tokens(spark, sf_dir):
    t = tokens.tiles(table(spark, sf_dir, "documents"), tokens.MESSAGE_TILE).withColumn("kind", tokens.message_kind(F.col("string")))
    return t.where("kind in ('url', 'hashtag', 'user', 'emoticon')").groupBy("doc_id", "kind", "string").agg(F.count("*").alias("n"))


SHARED = "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'RT @u: ' || text WHEN 1 THEN text || ' MT @c' WHEN 2 THEN text WHEN 3 THEN 'he said \"x\" via @d' || text ELSE 'RT: ' || text END AS text FROM conversations"


@query(f"SELECT conv_id, turn, text LIKE 'RT @%' OR text LIKE '% RT @%' OR text LIKE '% MT @%' OR text LIKE '%\" via @%' AS retweet FROM ({SHARED})")
def retweet_detect(spark, sf_dir):
    return derived(spark, sf_dir, SHARED).select("conv_id", "turn", tokens.is_retweet(F.col("text")).alias("retweet"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{{2}})([a-z])', '\\1 \\2', 'g') AS parts FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN {CAP1} || {CAP2} WHEN 1 THEN upper({W1}) || {CAP2} ELSE {W1} || {CAP2} END AS s FROM part)")
def camel_split(spark, sf_dir):
    d = derived(spark, sf_dir, f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN {CAP1} || {CAP2} WHEN 1 THEN upper({W1}) || {CAP2} ELSE {W1} || {CAP2} END AS s FROM part")
    return d.select("p_partkey", F.array_join(X.camel_split(F.col("s")), " ").alias("parts"))


# ---- dictionaries ------------------------------------------------------------------------------------------------

LIST_LINES = f"SELECT p_partkey, {W1} || '  ' || {W2} || chr(9) || 'inst=' || p_partkey || chr(9) || 'kind=' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(9) || 'inst=x=' || p_size ELSE '' END AS value FROM part"


@query("SELECT p_partkey, upper(p_name) AS norm, CAST(2 AS BIGINT) AS n_tokens, CASE WHEN p_size % 2 = 0 THEN 'x=' || p_size ELSE CAST(p_partkey AS VARCHAR) END AS inst, p_type AS kind FROM part")
def gazetteer_list_parse(spark, sf_dir):
    e = gazetteer.entries(dictionaries.parse_list(derived(spark, sf_dir, LIST_LINES)))
    return e.select("p_partkey", "norm", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("features")["inst"].alias("inst"), F.col("features")["kind"].alias("kind"))


DEFINITIONS = "SELECT 'f' || p_partkey || '.lst' || CASE p_size % 4 WHEN 0 THEN ':' || p_type WHEN 1 THEN ':' || p_type || ':' || p_brand WHEN 2 THEN ':' || p_type || '::en:' || p_brand ELSE '' END AS value FROM part"


@query("SELECT 'f' || p_partkey || '.lst' AS list_file, CASE WHEN p_size % 4 < 3 THEN p_type END AS major, CASE WHEN p_size % 4 = 1 THEN p_brand END AS minor, CASE WHEN p_size % 4 = 2 THEN 'en' END AS language, CASE WHEN p_size % 4 = 2 THEN p_brand ELSE 'Lookup' END AS ann_type FROM part")
def gazetteer_definition_parse(spark, sf_dir):
    return dictionaries.parse_definitions(derived(spark, sf_dir, DEFINITIONS))


PEOPLES = "(VALUES ('THE', 'Britain'), ('DER', 'Germany'), ('QUE', 'Spain')) AS t(norm, query)"


@query(f"WITH {TOKENS} SELECT doc_id, string, coalesce(query, lower(string)) AS query, count(*) AS n FROM seen JOIN {PEOPLES} ON upper(string) = norm GROUP BY ALL")
def demonym_query(spark, sf_dir):
    """Dictionary words of every document with the query that their entry gives."""
    docs = table(spark, sf_dir, "documents")
    m = gazetteer.match(tokens.words(docs), inline(spark, PEOPLES), 1).join(docs.select("doc_id", "text"), "doc_id")
    clean = X.clean(F.expr("substring(text, start + 1, stop - start)"))
    return m.groupBy("doc_id", clean.alias("string"), F.coalesce("query", F.lower(clean)).alias("query")).agg(F.count("*").alias("n"))


INDEX = f"""SELECT upper(p_name) AS norm, 'whole ' || p_name AS inst, 'Person' AS type FROM part WHERE p_size < 20 UNION SELECT upper({W2} || ' ' || {W1}), 'turned ' || p_name, 'Person' FROM part WHERE p_size > 40
  UNION SELECT upper({W2}), 'word ' || {W2}, 'Place' FROM part WHERE p_size % 10 = 1 UNION SELECT upper({W1}), 'word ' || {W1}, 'Person' FROM part WHERE p_size % 10 = 2"""
NAMES = "SELECT p_partkey AS doc_id, 1 AS ann_id, CASE WHEN p_size % 7 = 0 THEN p_name || ':' ELSE p_name END AS string, CASE WHEN p_size % 3 = 0 THEN 'Location' ELSE 'Person' END AS type FROM part"


@query(f"""WITH i AS ({INDEX}), idx AS (SELECT norm, inst, CASE type WHEN 'Place' THEN 'Location' ELSE type END AS type FROM i), q AS (SELECT * FROM ({NAMES}) WHERE NOT contains(string, ':')),
  g AS (SELECT doc_id, type, 0 AS level, upper(string) AS norm FROM q UNION ALL SELECT doc_id, type, 1, upper(string) FROM q UNION ALL SELECT doc_id, type, 1, upper(split_part(string, ' ', 2) || ' ' || split_part(string, ' ', 1)) FROM q
    UNION ALL SELECT doc_id, type, 2, upper(w) FROM (SELECT doc_id, type, unnest(string_split(string, ' ')) AS w FROM q) WHERE length(w) >= 3)
  SELECT doc_id, inst, CAST(min(level) AS BIGINT) AS level FROM g JOIN idx USING (norm, type) GROUP BY doc_id, inst""")
def name_index_levels(spark, sf_dir):
    return gazetteer.exact_levels(derived(spark, sf_dir, NAMES), _index(spark, sf_dir)).select("doc_id", "inst", F.col("level").cast("long").alias("level"))


def _index(spark, sf_dir):
    first, *others = [derived(spark, sf_dir, " ".join(s.split())) for s in INDEX.split("UNION")]
    for o in others:
        first = first.union(o)
    return first.distinct()


# ---- expressions and rules ---------------------------------------------------------------------------------------

FACTS = """SELECT o_orderkey AS doc_id, 'It cost $' || CAST(floor(o_totalprice) AS BIGINT) || ' or ' || o_custkey || ' million euros, up ' || o_custkey % 100 || '.5% since ' || CAST(o_orderdate AS DATE) || ' or 3 May ' || (1900 + o_custkey % 100)
  || '; at ' || o_custkey % 12 || ':30 pm we left ' || o_custkey || ' High Street SW1A 2AA' AS text FROM orders"""


def _all(sql: str, patterns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS string FROM ({sql})" for t, p in patterns)


@query(_all(FACTS, [(t, rules.ENTITIES[t]) for t in FACT_TYPES]))
def extract_money_percent_date(spark, sf_dir):
    docs = derived(spark, sf_dir, " ".join(FACTS.split()))
    return _union([rules.find_all(docs, "text", rules.ENTITIES[t]).select("doc_id", F.lit(t).alias("type"), "string") for t in FACT_TYPES])


PEOPLE = f"SELECT p_partkey AS doc_id, 'Mr. J. ' || {CAP1} || ' met Dr Anna ' || {CAP2} || ' at Green ' || {CAP2} || ' Ltd near Mount ' || {CAP1} || '. The University of ' || {CAP2} || ' and the chairman of ' || {CAP1} || ' Bank; Paul ' || {CAP2} || ', ' || p_size || ', swam in Loch Lake' AS text FROM part"


@query(_all(PEOPLE, rules.NAME_RULES))
def named_entities(spark, sf_dir):
    return rules.named_entities(derived(spark, sf_dir, PEOPLE)).select("doc_id", "type", "string")


FRENCH = f"SELECT p_partkey AS doc_id, 'Mme ' || {CAP1} || ' a payé ' || p_size || ' euros le 3 mars 19' || (10 + p_size % 80) || ' à la Banque de ' || {CAP2} || '. Rue de ' || {CAP1} || ', ' || p_size || ',5 % des ' || {CAP2} AS text FROM part"


@query(_all(FRENCH, rules.FRENCH_RULES))
def named_entities_french(spark, sf_dir):
    return rules.named_entities(derived(spark, sf_dir, FRENCH), rules.FRENCH_RULES).select("doc_id", "type", "string")


TAGGED = f"""SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN 'He/PRP has/VBZ never/RB been/VBN ' || {W1} || '/VBN' WHEN 1 THEN 'She/PRP will/MD not/RB ' || {W1} || '/VB and/CC' WHEN 2 THEN 'It/PRP was/VBD being/VBG ' || {W2} || '/VBN'
  WHEN 3 THEN 'It/PRP wants/VBZ to/TO ' || {W2} || '/VB' WHEN 4 THEN 'They/PRP did/VBD not/RB ' || {W1} || '/VB ' || {W2} || '/VBG' ELSE 'It/PRP might/MD have/VB been/VBN ' || {W1} || '/VBG' END AS tagged FROM part"""


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 6 AS k, {W1} AS a, {W2} AS b FROM part), g AS (
  SELECT doc_id, 'has never been ' || a AS words, 'finite' AS kind, 'PerPre' AS tense, 'passive' AS voice, true AS negated FROM p WHERE k = 0 UNION ALL
  SELECT doc_id, 'will not ' || a, 'finite', 'SimFut', 'active', true FROM p WHERE k = 1 UNION ALL SELECT doc_id, 'was being ' || b, 'finite', 'ConPas', 'passive', false FROM p WHERE k = 2 UNION ALL
  SELECT doc_id, 'wants', 'finite', 'SimPre', 'active', false FROM p WHERE k = 3 UNION ALL SELECT doc_id, 'to ' || b, 'infinitive', 'SimInf', 'active', false FROM p WHERE k = 3 UNION ALL
  SELECT doc_id, 'did not ' || a, 'finite', 'SimPas', 'active', true FROM p WHERE k = 4 UNION ALL SELECT doc_id, b, 'participle', 'Pre', 'active', false FROM p WHERE k = 4 UNION ALL
  SELECT doc_id, 'might have been ' || a, 'modal', 'PerConModal', 'active', false FROM p WHERE k = 5) SELECT * FROM g""")
def verb_groups(spark, sf_dir):
    """Rules over sequences of word classes, one sentence for each part."""
    t = derived(spark, sf_dir, " ".join(TAGGED.split())).select("doc_id", F.posexplode(F.split("tagged", " ")).alias("tok_no", "w"))
    t = t.select("doc_id", F.lit(0).alias("sent_no"), "tok_no", F.col("tok_no").alias("start"), (F.col("tok_no") + 1).alias("stop"), F.substring_index("w", "/", 1).alias("string"), F.substring_index("w", "/", -1).alias("tag"))
    g = grammar.verb_groups(t).select("doc_id", "first", F.explode(F.sequence("first", "last")).alias("tok_no"), "kind", "tense", "voice", "negated")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "string"))), lambda x: x["string"]), " ")
    return g.join(t, ["doc_id", "tok_no"]).groupBy("doc_id", "first", "kind", "tense", "voice", "negated").agg(words.alias("words")).select("doc_id", "words", "kind", "tense", "voice", "negated")


REPORTS = f"SELECT p_partkey AS doc_id, 'Mr. J. Sm' || {W1} || ' met Anna B' || {W2} || ', director of Green & Old V' || {W1} || ' Ltd, near Mount Et' || {W2} || '.' AS text FROM part"


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, {W1} AS a, {W2} AS b FROM part) SELECT doc_id, 'Mr. J. Sm' || a AS string, 'Person' AS type, 'PersonTitle' AS rule FROM p UNION ALL SELECT doc_id, 'Anna B' || b, 'Person', 'PersonFull' FROM p UNION ALL
  SELECT doc_id, 'director', 'JobTitle', 'JobTitle' FROM p UNION ALL SELECT doc_id, 'Green & Old V' || a || ' Ltd', 'Organization', 'CompanyEnding' FROM p UNION ALL SELECT doc_id, 'Mount Et' || b, 'Location', 'LocationKey' FROM p""")
def name_grammar(spark, sf_dir):
    """Phases of rules over coded tokens: titles, endings, keys and dictionaries, then what stands next to unknown names."""
    docs = derived(spark, sf_dir, REPORTS)
    t = tokens.sentence_numbers(tokens.tokenize(docs))
    look = gazetteer.match(t, inline(spark, KNOWN_NAMES), 2)
    n = grammar.find_names(grammar.numbered(t), look).join(docs, "doc_id")
    return n.select("doc_id", F.expr("substring(text, start + 1, stop - start)").alias("string"), "type", "rule").where("type <> 'Unknown'")


CHAINS = f"SELECT p_partkey AS doc_id, k AS ann_id, CASE k WHEN 1 THEN 'Mr John ' || {CAP1} WHEN 2 THEN {CAP1} WHEN 3 THEN {CAP1} || ' ' || {CAP2} || ' Nations' WHEN 4 THEN upper(substr({W1}, 1, 1) || substr({W2}, 1, 1)) || 'N' WHEN 5 THEN 'Ör' || {W2} WHEN 6 THEN 'Or' || {W2} ELSE 'oer' || upper({W2}) END AS string FROM part LATERAL VIEW explode(sequence(1, 7)) AS k"


@query("SELECT p_partkey AS doc_id, k AS ann_id, CASE k WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 7 THEN 5 ELSE k END AS chain_id FROM part, (SELECT unnest(range(1, 8))::INTEGER AS k)")
def name_variants(spark, sf_dir):
    return tagging.name_variants(derived(spark, sf_dir, CHAINS)).select("doc_id", "ann_id", "chain_id")


NOTES = f"SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'No sign of ' || {W1} || ' but ' || {W2} || ' persists.' WHEN 1 THEN 'Mother had ' || {W1} || '.' WHEN 2 THEN 'Patient denies ' || {W2} || '. History of ' || {W1} || '.' ELSE 'Not only ' || {W2} || '.' END AS text FROM part"
TRIGGERS = "(VALUES ('NO SIGN OF', 'negation', 'Negated', false), ('DENIES', 'negation', 'Negated', false), ('NOT', 'negation', 'Negated', false), ('NOT ONLY', 'negation', 'Negated', true), ('HISTORY OF', 'temporality', 'historical', false), ('MOTHER', 'experiencer', 'Other', false)) AS t(norm, kind, value, pseudo)"


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 4 AS k, upper({W1}) AS a, upper({W2}) AS b FROM part) SELECT doc_id, a AS norm, 'Negated' AS negation, 'Recent' AS temporality, 'Patient' AS experiencer FROM p WHERE k = 0 UNION ALL
  SELECT doc_id, b, 'Affirmed', 'Recent', 'Patient' FROM p WHERE k IN (0, 3) UNION ALL SELECT doc_id, a, 'Affirmed', 'Recent', 'Other' FROM p WHERE k = 1 UNION ALL
  SELECT doc_id, b, 'Negated', 'Recent', 'Patient' FROM p WHERE k = 2 UNION ALL SELECT doc_id, a, 'Affirmed', 'historical', 'Patient' FROM p WHERE k = 2""")
def context_negation(spark, sf_dir):
    concepts_ = derived(spark, sf_dir, f"SELECT DISTINCT upper({W1}) AS norm FROM part").union(derived(spark, sf_dir, f"SELECT DISTINCT upper({W2}) AS norm FROM part"))
    con = tag_context(spark, derived(spark, sf_dir, NOTES), inline(spark, TRIGGERS), concepts_.distinct(), 1)
    return con.select("doc_id", "norm", "negation", "temporality", "experiencer")


# ---- strings and identifiers -------------------------------------------------------------------------------------

TYPOS = f"SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN substr({W1}, 1, 1) || substr({W1}, 3) WHEN 1 THEN 'x' || substr({W2}, 2) WHEN 2 THEN upper({W1}) ELSE {W2} || 'qq' END AS word FROM part"


@query(f"""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS norm FROM part), t AS ({TYPOS}), f AS (SELECT 'bg' AS low, 'large' AS by_table),
  n AS (SELECT word, (SELECT min((levenshtein(lower(word), norm), norm)) FROM d WHERE levenshtein(lower(word), norm) <= 1) AS best FROM t)
  SELECT t.word, coalesce(by_table, CASE WHEN lower(t.word) IN (SELECT norm FROM d) THEN t.word END, best[2], t.word) AS norm FROM t LEFT JOIN f ON low = lower(t.word) JOIN n ON n.word = t.word""")
def levenshtein_normalise(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return tagging.correct_spelling(derived(spark, sf_dir, TYPOS), known, inline(spark, "(VALUES ('bg', 'large')) AS t(form, norm)"))


ENTRIES = f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '  ' || {W1} || '   ' || {W2} || ' ' WHEN 1 THEN 'zür' || chr(9) || {W2} ELSE '   ' END AS entry FROM part"


@query(f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'ZÜR ' || upper({W2}) ELSE '' END AS norm FROM part")
def entry_normalise(spark, sf_dir):
    return derived(spark, sf_dir, ENTRIES).select("p_partkey", X.dictionary_entry(F.col("entry")).alias("norm"))


@query(f"""WITH w AS (SELECT p_partkey, [{W1}, {W2}, lower(p_type), lower(p_brand)] AS w FROM part), i AS (SELECT unnest(range(1, 5)) AS i), p AS (SELECT p_partkey, w, a.i AS x, b.i AS y, c.i AS z FROM w, i a, i b, i c)
  SELECT p_partkey, CAST(3 AS BIGINT) AS r, w[x] || ' ' || w[y] || ' ' || w[z] AS run FROM p WHERE (x < y AND y < z) OR (y < z AND z < x) OR (z < x AND x < y) UNION ALL
  SELECT p_partkey, 2, w[x] || ' ' || w[y] FROM p WHERE z = 1 AND x <> y""")
def word_rotations(spark, sf_dir):
    """All rotations of all choices of two and of three of the four words of a part."""
    d = derived(spark, sf_dir, "SELECT p_partkey, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS s FROM part")
    return _union([d.select("p_partkey", F.lit(r).cast("long").alias("r"), F.explode(gazetteer.rotations(F.split("s", " "), r)).alias("p")).select("p_partkey", "r", F.array_join("p", " ").alias("run")) for r in (2, 3)])


SHORT_URIS = f"SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN {CAP1} WHEN 1 THEN 'dbpo:' || {CAP1} WHEN 2 THEN 'http://x.org/' || {W2} WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'foaf:' || {W2} ELSE 'skos:' || {W1} END AS u FROM part"


@query(f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'http://dbpedia.org/resource/' || u WHEN 1 THEN 'http://dbpedia.org/ontology/' || substr(u, 6) WHEN 5 THEN 'http://xmlns.com/foaf/0.1/' || substr(u, 6)
  WHEN 6 THEN 'http://www.w3.org/2004/02/skos/core#' || substr(u, 6) ELSE u END AS full_uri FROM ({SHORT_URIS})""")
def expand_uri(spark, sf_dir):
    return derived(spark, sf_dir, SHORT_URIS).select("p_partkey", uris.expand(F.col("u")).alias("full_uri"))


@query(f"SELECT p_partkey, CASE WHEN u IS NULL OR u = '' THEN '' WHEN u LIKE 'http://%' THEN u ELSE 'http://dbpedia.org/resource/' || u END AS uri FROM ({SHORT_URIS})")
def mention_uri(spark, sf_dir):
    return derived(spark, sf_dir, SHORT_URIS).select("p_partkey", uris.mention_uri(F.col("u")).alias("uri"))


LONG_URIS = f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'http://dbpedia.org/page/' || {CAP1} WHEN 1 THEN 'http://dbpedia.org/resource/' || {CAP2} || '%28' || {W1} || '%29' WHEN 2 THEN 'http://other.org/' || {W1}
  WHEN 3 THEN 'http://fr.dbpedia.org/resource/' || {CAP2} WHEN 4 THEN 'http://other.org/page/' || {W2} ELSE 'http://dbpedia.org/resource/' || {CAP2} END AS uri FROM part"""


@query(f"""WITH r AS (SELECT 'http://dbpedia.org/resource/' || w AS f, 'http://dbpedia.org/resource/New_' || w AS t FROM (SELECT DISTINCT {CAP1} AS w FROM part) WHERE length(w) = 4)
  SELECT p_partkey, coalesce(t, u) AS uri FROM (SELECT p_partkey, replace(replace(replace(uri, 'dbpedia.org/page/', 'dbpedia.org/resource/'), '%28', '('), '%29', ')') AS u FROM ({LONG_URIS}) WHERE uri NOT LIKE 'http://other.org%') LEFT JOIN r ON f = u""")
def redirect_uri(spark, sf_dir):
    """Pages become resources, resources of language hosts stay, others go, redirects are followed."""
    r = derived(spark, sf_dir, f"SELECT DISTINCT 'http://dbpedia.org/resource/' || {CAP1} AS fromuri, 'http://dbpedia.org/resource/New_' || {CAP1} AS touri FROM part WHERE length({W1}) = 4")
    return uris.fix(derived(spark, sf_dir, " ".join(LONG_URIS.split())), r).select("p_partkey", "uri")


@query(r"""SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '^[\x21-\x7e]$') THEN c WHEN c = ' ' THEN '%20' ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS uri FROM benchmark""")
def normalize_uri(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", uris.encode(F.col("text")).alias("uri"))


PAIRS = f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(substr({W1}, 1, 1) || substr({W2}, 1, 1)) WHEN 1 THEN {CAP1} WHEN 2 THEN {CAP2} || ', ' || {CAP1} ELSE {CAP1} || ' ' || {CAP2} || 's' END AS a, {CAP1} || ' ' || {CAP2} AS b FROM part"


@query(f"""WITH p AS (SELECT p_partkey, p_size % 4 AS k, {W1} AS x, {W2} AS y FROM part) SELECT p_partkey, round(CASE k WHEN 0 THEN 2 / (2 + 2)
  WHEN 1 THEN 1 / (1 + len(list_distinct([substr(x, 1, 4), substr(y, 1, 4)]))) WHEN 2 THEN 0.5
  ELSE len(list_intersect(list_distinct([substr(x, 1, 4), substr(y, 1, 4)]), list_distinct([substr(x, 1, 4), substr(y || 's', 1, 4)]))) / (len(list_distinct([substr(x, 1, 4), substr(y, 1, 4)])) + len(list_distinct([substr(x, 1, 4), substr(y || 's', 1, 4)]))) END, 6) AS score FROM p""")
def string_sim(spark, sf_dir):
    return derived(spark, sf_dir, PAIRS).select("p_partkey", F.round(X.name_match(X.normalise(F.col("a")), X.normalise(F.col("b"))), 6).alias("score"))


# ---- concepts ----------------------------------------------------------------------------------------------------

STY = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'C' || p_partkey END AS inst, CASE p_size % 6 WHEN 0 THEN 'Tissue' WHEN 1 THEN 'Finding' WHEN 2 THEN 'Geographic Area' WHEN 3 THEN 'Body Part, Organ, or Organ Component' WHEN 4 THEN 'Antibiotic' END AS sty FROM part"


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no inst' WHEN p_size % 6 IN (2, 5) THEN 'type' ELSE 'kept' END AS why,
  CASE p_size % 6 WHEN 0 THEN 'Anatomy' WHEN 1 THEN 'Observation' WHEN 3 THEN 'Anatomy' WHEN 4 THEN 'Drug' ELSE 'none' END AS grp FROM part""")
def tidy_types(spark, sf_dir):
    t = concepts.tidy(derived(spark, sf_dir, STY))
    return t.select("p_partkey", F.coalesce("deleted_because", F.lit("kept")).alias("why"), F.coalesce(concepts.group_of(F.col("sty")), F.lit("none")).alias("grp"))


@query("SELECT p_partkey, unnest(list_distinct([p_type || '_x', replace(p_name, ' ', '_')])) AS type FROM part")
def concept_types(spark, sf_dir):
    d = derived(spark, sf_dir, "SELECT p_partkey, p_type || ' x,' || p_name || ',' || p_name AS sty FROM part")
    return d.select("p_partkey", F.explode(concepts.type_names(F.col("sty"))).alias("type"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size / 4 END AS n FROM part")
def correct_null_features(spark, sf_dir):
    d = derived(spark, sf_dir, "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size / 4 AS STRING) WHEN 1 THEN 'null' END AS s FROM part")
    return d.select("p_partkey", concepts.number_or_null(F.col("s")).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) END AS ms, CASE WHEN event_id % 10 > 0 THEN CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) END AS hour FROM events")
def created_at(spark, sf_dir):
    """Times written as messages have them; a tenth is no time."""
    e = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_id") % 10 > 0, F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")).otherwise("yesterday"))
    ts = concepts.created_at(F.col("s"))
    return e.select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyyMMddHH").cast("long").alias("hour"))


# ---- messages ----------------------------------------------------------------------------------------------------


def tweets(spark, sf_dir) -> DataFrame:
    """A message for each turn: its text escaped as messages are, with an entity for its first word and one for what follows."""
    c = table(spark, sf_dir, "conversations").withColumn("plain", F.concat(F.lit("a & <b> "), "text"))
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = lambda n: F.length(esc(F.substring("plain", 1, n)))  # noqa: E731  where a place lies in the escaped text
    one = lambda a, b: F.array(F.struct(F.array(at(a), at(b)).alias("indices")))
    js = F.to_json(F.struct(F.concat_ws("/", "conv_id", "turn").alias("id_str"), esc(F.col("plain")).alias("text"), F.struct(F.col("role").alias("screen_name"), F.concat(F.lit("The "), "role").alias("name")).alias("user"), F.create_map(F.lit("hashtags"), one(2, 7), F.lit("set:urls"), one(8, 12)).alias("entities")))
    return c.select("conv_id", "turn", js.alias("js"))


@query("SELECT conv_id, turn, role AS screen_name, 'The ' || role AS name, md5(replace(replace(replace('a & <b> ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM conversations")
def tweet_paths(spark, sf_dir):
    dig = lambda p: messages.dig(F.col("js"), p)
    return tweets(spark, sf_dir).select("conv_id", "turn", dig("user:screen_name").alias("screen_name"), dig("user:name").alias("name"), F.md5(dig("text")).alias("digest"))


@query("SELECT conv_id || '/' || turn AS id_str, aset, type, start, stop FROM conversations, (VALUES ('', 'hashtags', 2, 7), ('set', 'urls', 8, 12)) AS e(aset, type, start, stop)")
def tweet_entities(spark, sf_dir):
    """Places of entities, moved as unescaping moves them."""
    m = tweets(spark, sf_dir).select(F.from_json("js", messages.MESSAGE).alias("m")).select("m.*")
    return messages.entities(m)


@query("SELECT conv_id, turn, md5('a & <b> ' || text) AS digest FROM conversations")
def tweet_unescape(spark, sf_dir):
    return tweets(spark, sf_dir).select("conv_id", "turn", F.md5(messages.unescape(messages.dig(F.col("js"), "text"))).alias("digest"))


@query("SELECT conv_id, turn, 'text' AS key, 0 AS start, CAST(length(text) + 8 AS INTEGER) AS stop FROM conversations UNION ALL SELECT conv_id, turn, 'user:name', CAST(length(text) + 9 AS INTEGER), CAST(length(text) + 13 + length(role) AS INTEGER) FROM conversations")
def tweet_content(spark, sf_dir):
    found = messages.content(F.col("js"), ["text", "user:name", "user:location"])[1]
    return tweets(spark, sf_dir).select("conv_id", "turn", F.explode(found).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT conv_id, count(*) AS lines, count(*) AS elements FROM conversations GROUP BY conv_id")
def read_messages(spark, sf_dir):
    """The turns of a conversation as lines of objects and as one array of them."""
    t = tweets(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("js").alias("j"))
    size = lambda s: F.size(messages.split_text(s)).cast("long")
    return t.select("conv_id", size(F.array_join("j", "\n\n")).alias("lines"), size(F.concat(F.lit(" ["), F.array_join("j", ","), F.lit("]"))).alias("elements"))


# ---- sinks -------------------------------------------------------------------------------------------------------

MARKED = f"SELECT p_partkey AS doc_id, {CAP1} || ' & <' || {CAP2} || '> in May' AS text FROM part"
SPAN_PARTS = [f"SELECT p_partkey AS doc_id, {a} AS start, {b} AS stop, {c} AS inst FROM part" for a, b, c in (("0", f"length({W1})", f"'a\"' || {W1}"), (f"length({W1}) + 4", f"length({W1}) + 4 + length({W2})", W2), (f"length({W1}) + 5", f"length({W1}) + 8", "'lost'"))]


def marked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A text for each part and three mentions in it, the last of which overlaps the second."""
    return derived(spark, sf_dir, MARKED), _union([derived(spark, sf_dir, s) for s in SPAN_PARTS])


@query(f"SELECT p_partkey AS doc_id, '<Mention inst=\"a&quot;' || {W1} || '\">' || {CAP1} || '</Mention> &amp; &lt;<Mention inst=\"' || {W2} || '\">' || {CAP2} || '</Mention>&gt; in May' AS xml, CAST(2 AS BIGINT) AS n_mentions FROM part")
def export_inline_xml(spark, sf_dir):
    return sinks.inline_xml(*marked(spark, sf_dir))


@query(f"""SELECT p_partkey AS doc_id, '{{"text":"' || {CAP1} || ' & <' || {CAP2} || '> in May","entities":{{"M":[{{"indices":[0,' || length({W1}) || ']}},{{"indices":[' || length({W1}) + 4 || ',' || length({W1}) + 4 + length({W2}) || ']}},{{"indices":[' || length({W1}) + 5 || ',' || length({W1}) + 8 || ']}}]}}}}' AS json FROM part""")
def export_json(spark, sf_dir):
    docs, mentions = marked(spark, sf_dir)
    return sinks.document_json(docs, mentions.drop("inst").withColumn("type", F.lit("M")))


@query("""WITH r AS (SELECT p_type, p_brand, '<tr><td>' || p_partkey || '</td><td>' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || '</td><td>' || CASE WHEN p_size % 2 = 0 THEN 'correct' ELSE 'missing' END || '</td></tr>' AS r FROM part)
  SELECT p_type AS type, p_brand AS doc_id, '<table><caption>' || p_type || '</caption>' || string_agg(r, '' ORDER BY r) || '</table>' AS html FROM r GROUP BY p_type, p_brand""")
def export_difference_html(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    return sinks.difference_html(p.select(F.col("p_type").alias("type"), F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("key_id"), F.when(even, F.col("p_size")).alias("response_id"), F.when(even, "correct").otherwise("missing").alias("outcome")))


# ---- candidates --------------------------------------------------------------------------------------------------

PLACES = f"SELECT p_partkey AS doc_id, {CAP1} || ', ' || {CAP2} || ' is not ' || {CAP2} || ' ' || {CAP1} AS text FROM part"
PLACE_MENTIONS = [
    f"SELECT p_partkey AS doc_id, 1 AS mention_id, 0 AS start, length({W1}) AS stop, {CAP1} AS string FROM part",
    f"SELECT p_partkey AS doc_id, 2 AS mention_id, length({W1}) + 2 AS start, length(p_name) + 1 AS stop, {CAP2} AS string FROM part",
    f"SELECT p_partkey AS doc_id, 3 AS mention_id, length(p_name) + 9 AS start, length(p_name) + 9 + length({W2}) AS stop, {CAP2} AS string FROM part",
]
TWO = "SELECT p_partkey AS doc_id, m AS mention_id, CASE m WHEN 1 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END || k AS inst, 'l' AS label"
PLACE_CANDS = f"{TWO} FROM part LATERAL VIEW explode(array(1, 2, 3)) AS m LATERAL VIEW explode(array('_a', '_b')) AS k"
NEAR = f"SELECT DISTINCT {W1} || '_a' AS src, {W2} || '_b' AS dst FROM part WHERE p_size % 4 = 1"


@query(f"""WITH c AS ({TWO} FROM part, (VALUES (1), (2), (3)) AS x(m), (VALUES ('_a'), ('_b')) AS y(k)), e AS ({NEAR}), l AS (SELECT p_partkey AS doc_id FROM part JOIN e ON src = {W1} || '_a' AND dst = {W2} || '_b')
  SELECT * FROM c WHERE mention_id = 3 OR doc_id NOT IN (SELECT doc_id FROM l) OR inst LIKE CASE mention_id WHEN 1 THEN '%~_a' ELSE '%~_b' END ESCAPE '~'""")
def pair_related_filter(spark, sf_dir):
    """'A, B': candidates of the two that have a link to one of the other; of a pair without links all stay."""
    m = _union([derived(spark, sf_dir, x) for x in PLACE_MENTIONS])
    pairs = C.comma_pairs(m, tokens.tokenize(derived(spark, sf_dir, PLACES)))
    return C.related_pairs(pairs, derived(spark, sf_dir, PLACE_CANDS), derived(spark, sf_dir, NEAR))


def _initials(*words: str) -> str:
    return "upper(" + " || ".join(f"substr({w}, 1, 1)" for w in words) + ")"


SHORT = f"SELECT p_partkey AS doc_id, 'The ' || {CAP1} || ' of the ' || {CAP2} || ' Union (' || {_initials(W1, W2)} || CASE WHEN p_size % 3 = 0 THEN 'X' ELSE 'U' END || ') and the (YZ), later ' || {_initials(W1, W2)} || 'U' AS text FROM part"


@query(f"SELECT p_partkey AS doc_id, {CAP1} || ' of the ' || {CAP2} || ' Union' AS definition, {_initials(W1, W2)} || 'U' AS abbreviation FROM part WHERE p_size % 3 > 0")
def abbreviation_match(spark, sf_dir):
    return C.abbreviation_pairs(derived(spark, sf_dir, SHORT))


SHORT_MENTIONS = f"SELECT p_partkey AS doc_id, m AS mention_id, CASE m WHEN 1 THEN {CAP1} || ' of the ' || {CAP2} || ' Union' WHEN 4 THEN {CAP2} ELSE {_initials(W1, W2)} || 'U' END AS string FROM part LATERAL VIEW explode(array(1, 2, 3, 4)) AS m"
FEW = "SELECT p_partkey AS doc_id, m AS mention_id, k AS inst, 'l' AS label"
FEW_WHERE = "(m = 1 AND k IN ('who', 'org')) OR (m = 2 AND k IN ('who', 'band')) OR (m = 3 AND (k = 'band' OR p_size % 2 = 0 AND k = 'who')) OR (m = 4 AND k = 'org')"


def short_cands(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, f"{FEW} FROM part LATERAL VIEW explode(array(1, 2, 3, 4)) AS m LATERAL VIEW explode(array('who', 'org', 'band')) AS k WHERE {FEW_WHERE}")


FEW_SQL = f"c AS ({FEW}, p_size FROM part, (VALUES (1), (2), (3), (4)) AS x(m), (VALUES ('who'), ('org'), ('band')) AS y(k) WHERE {FEW_WHERE})"


@query(f"WITH {FEW_SQL} SELECT doc_id, mention_id, inst, label FROM c WHERE p_size % 3 = 0 OR mention_id = 4 OR inst = 'who'")
def abbreviation_filter(spark, sf_dir):
    """Lists of a definition and of its abbreviation's mentions are reduced to what both have."""
    pairs = C.abbreviation_pairs(derived(spark, sf_dir, SHORT))
    return C.meet_abbreviations(short_cands(spark, sf_dir), derived(spark, sf_dir, SHORT_MENTIONS), pairs)


@query(f"WITH {FEW_SQL} SELECT doc_id, mention_id, inst, label FROM c WHERE mention_id <> 2 OR inst = 'band' OR p_size % 2 = 0")
def propagate_by_string(spark, sf_dir):
    """The list of the third mention rules that of the second, which has the same string."""
    changed = derived(spark, sf_dir, "SELECT p_partkey AS doc_id, 3 AS mention_id FROM part")
    return C.propagate_by_string(short_cands(spark, sf_dir), derived(spark, sf_dir, SHORT_MENTIONS), changed)


THE_MENTIONS = [f"SELECT p_partkey AS doc_id, 1 AS mention_id, 0 AS start, length({W1}) + 4 AS stop, 'the ' || {CAP1} AS string FROM part", f"SELECT p_partkey AS doc_id, 2 AS mention_id, 4 AS start, length({W1}) + 4 AS stop, {CAP1} AS string FROM part"]
THE_CANDS = ["SELECT p_partkey AS doc_id, 1 AS mention_id, p_type AS inst FROM part", "SELECT p_partkey AS doc_id, 1 AS mention_id, 'band' AS inst FROM part", "SELECT p_partkey AS doc_id, 2 AS mention_id, 'font' AS inst FROM part", "SELECT p_partkey AS doc_id, 2 AS mention_id, p_type AS inst FROM part WHERE p_size % 2 = 0"]


@query("""SELECT p_partkey AS doc_id, 2 AS mention_id, p_type AS inst FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 2 = 1 UNION ALL
  SELECT p_partkey, 1, 'band' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 2, 'font' FROM part WHERE p_size % 2 = 1""")
def prefix_the_reduce(spark, sf_dir):
    m = _union([derived(spark, sf_dir, x) for x in THE_MENTIONS])
    return C.reduce_the(_union([derived(spark, sf_dir, x) for x in THE_CANDS]), C.the_prefixed(m))


OWNERS = [
    f"SELECT p_partkey AS doc_id, 1 AS mention_id, 0 AS start, length({W1}) + 2 AS stop, {CAP1} || '''s' AS string FROM part",
    f"SELECT p_partkey AS doc_id, 2 AS mention_id, 0 AS start, length({W1}) AS stop, {CAP1} AS string FROM part",
    f"SELECT p_partkey AS doc_id, 3 AS mention_id, length({W1}) + 3 AS start, length(p_name) + 3 AS stop, {CAP2} AS string FROM part",
]


@query("SELECT p_partkey AS doc_id, 1 AS mention_id, i AS inst FROM part, (VALUES ('x'), ('y')) AS v(i) UNION ALL SELECT p_partkey, 3, 'y' FROM part")
def possessive_merge(spark, sf_dir):
    """The candidates of X go to X's."""
    m = _union([derived(spark, sf_dir, x) for x in OWNERS])
    cands = _union([derived(spark, sf_dir, f"SELECT p_partkey AS doc_id, {i} AS mention_id, '{x}' AS inst FROM part") for i, x in ((1, "x"), (2, "x"), (2, "y"), (3, "y"))])
    return C.merge_lists(cands, C.possessives(m), "inst").select("doc_id", "mention_id", "inst")


USERS = ["SELECT p_partkey AS doc_id, 10 AS ann_id, 0 AS start, 5 AS stop FROM part", "SELECT p_partkey AS doc_id, 11 AS ann_id, 10 AS start, 15 AS stop FROM part WHERE p_size % 2 = 0"]
USER_NAMES = ["SELECT p_partkey AS doc_id, 10 AS user_ann_id, 100 AS start, 101 + length(p_name) AS stop FROM part", "SELECT p_partkey AS doc_id, 11 AS user_ann_id, 100 AS start, 101 + length(p_name) AS stop FROM part WHERE p_size % 2 = 0"]
USER_MENTIONS = [f"SELECT p_partkey AS doc_id, 1 AS mention_id, 100 AS start, 100 + length({W1}) AS stop FROM part", f"SELECT p_partkey AS doc_id, 2 AS mention_id, 101 + length({W1}) AS start, 100 + length(p_name) AS stop FROM part", "SELECT p_partkey AS doc_id, 3 AS mention_id, 10 AS start, 15 AS stop FROM part WHERE p_size % 4 = 0"]


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_size, CASE WHEN length({W1}) >= length({W2}) THEN 1 ELSE 2 END AS mention_id FROM part) SELECT doc_id, mention_id, 10 AS clone_id FROM p UNION ALL
  SELECT doc_id, mention_id, 11 FROM p WHERE p_size % 2 = 0 AND p_size % 4 > 0""")
def user_id_projection(spark, sf_dir):
    """A user id without a mention takes the longest mention of its name."""
    return C.project_user_ids(*[_union([derived(spark, sf_dir, x) for x in part]) for part in (USERS, USER_NAMES, USER_MENTIONS)])


LABELLED = f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN {_initials(W1, W2)} WHEN 1 THEN upper({W1}) ELSE {CAP1} END AS mention, CASE p_size % 4 WHEN 0 THEN {CAP1} || ' ' || {CAP2} || '|x' WHEN 3 THEN 'Zz|' || {CAP1} || ' ' || {CAP2} ELSE {CAP1} END AS labels, CASE p_size % 4 WHEN 2 THEN 'upper' WHEN 1 THEN 'sentence' ELSE 'title' END AS case_ FROM part"


@query("SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.45 WHEN 2 THEN 0.5 ELSE 1 / 3 END, 6) AS score FROM part")
def label_similarity(spark, sf_dir):
    p = derived(spark, sf_dir, LABELLED)
    return p.select("p_partkey", F.round(similarity.label_similarity(F.col("mention"), X.pipe_values(F.col("labels")), F.col("case_")), 6).alias("score"))


# ---- entities ----------------------------------------------------------------------------------------------------

CHAINED = "SELECT o_custkey AS doc_id, o_orderkey AS mention_id, CAST(floor(o_totalprice) AS BIGINT) % 500 * 10 AS start, CAST(floor(o_totalprice) AS BIGINT) % 500 * 10 + 5 AS stop FROM orders"


@query(f"""WITH m AS ({CHAINED}), u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, start, stop) AS n FROM m)
  SELECT doc_id, mention_id, CAST(CASE WHEN n = 1 AND mention_id % 3 = 0 THEN doc_id * 10 + 1 ELSE -mention_id END AS BIGINT) AS entity_id FROM u""")
def entity_building(spark, sf_dir):
    """Orders as mentions of a customer; every third one is in a chain."""
    m = derived(spark, sf_dir, CHAINED)
    chains = m.where("mention_id % 3 = 0").select("doc_id", (F.col("doc_id") * 10 + 1).alias("chain_id"), "start", "stop")
    return entities.build(m, chains).select("doc_id", "mention_id", F.col("entity_id").cast("long").alias("entity_id"))


EXPANDED = ["SELECT p_partkey AS doc_id, 4 AS start, 20 AS stop, 'user' AS kind, p_brand AS text FROM part WHERE p_size % 3 < 2", "SELECT p_partkey AS doc_id, 4 AS start, 20 AS stop, 'hashtag' AS kind, p_name AS text FROM part WHERE p_size % 2 = 0", "SELECT p_partkey AS doc_id, 4 AS start, 20 AS stop, 'url' AS kind, p_type AS text FROM part WHERE p_size % 3 = 0"]


@query("""SELECT p_partkey AS doc_id, 1 AS mention_id, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 < 2 THEN p_brand END AS expansion FROM part UNION ALL SELECT p_partkey, 2, NULL FROM part""")
def expansion_context(spark, sf_dir):
    m = _union([derived(spark, sf_dir, f"SELECT p_partkey AS doc_id, {i} AS mention_id, {i} AS ann_id, {a} AS start, {b} AS stop FROM part") for i, a, b in ((1, 5, 9), (2, 15, 25))])
    return entities.expansion_of(m, _union([derived(spark, sf_dir, x) for x in EXPANDED])).select("doc_id", "mention_id", "expansion")


GAP = "CASE p_size % 4 WHEN 0 THEN 'the ' WHEN 1 THEN 'a' || repeat(' ', 90) WHEN 2 THEN 'see ' ELSE '' END"
CROSSING = f"SELECT p_partkey AS doc_id, 'xx ' || {GAP} || {CAP1} || ' ' || {CAP2} || ' yy' AS text FROM part"
CROSSED = [
    f"SELECT p_partkey AS doc_id, 1 AS ann_id, 3 AS start, 3 + length({GAP}) + length({W1}) AS stop FROM part WHERE p_size % 4 < 3",
    f"SELECT p_partkey AS doc_id, 2 AS ann_id, 3 + length({GAP}) AS start, 4 + length({GAP}) + length(p_name) AS stop FROM part",
    f"SELECT p_partkey AS doc_id, 3 AS ann_id, 4 + length({GAP}) + length({W1}) AS start, 3 + length({GAP}) + length(p_name) AS stop FROM part",
]


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 2 END AS ann_id FROM part")
def filter_overlapping(spark, sf_dir):
    """Contained spans go; of partly overlapping ones the later, or the earlier if only an article, however far, leads to the later."""
    return spans.resolve_overlaps(_union([derived(spark, sf_dir, x) for x in CROSSED]), derived(spark, sf_dir, CROSSING)).select("doc_id", "ann_id")
