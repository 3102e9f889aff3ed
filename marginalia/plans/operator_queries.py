"""Queries of pairs, contexts, indexes, round trips through sources and sinks, and control of plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia import model
from marginalia.functions import concepts
from marginalia.operators import candidates as C
from marginalia.operators import entities, gazetteer, grammar, graph, rules, similarity, spans, tagging, tokens
from marginalia.plans.pipeline import Plan, Step, read_config
from marginalia.plans.registry import derived, inline, query, table
from marginalia.plans.table_queries import CAP1, CAP2, W1, W2, _union
from marginalia.plans.text_queries import BENCH, BGRAMS, CHUNK_RULES, DICTIONARY, GRAMS, LEXICON, MATCHES, SENTENCES, TERM_SQL, TOKENS, dictionary, documents, mentions
from marginalia.sources import corpora, dictionaries, sinks
from marginalia.streaming import documents as streams


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share; a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        base = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, unnest([p_type, lower(p_brand), 'UMLS']) AS vocab FROM part")
def concept_vocabularies(spark, sf_dir):
    d = derived(spark, sf_dir, "SELECT p_partkey, p_type || ',' || lower(p_brand) || ',UMLS,,' AS vocabs FROM part")
    return d.select("p_partkey", F.explode(concepts.vocabularies(F.col("vocabs"))).alias("vocab"))


# ---- candidates --------------------------------------------------------------------------------------------------

LOCATIONS = [
    f"SELECT p_partkey AS doc_id, 1 AS mention_id, 0 AS start, length({W1}) AS stop, {CAP1} AS string FROM part",
    f"SELECT p_partkey AS doc_id, 2 AS mention_id, length({W1}) + 2 AS start, length(p_name) + 1 AS stop, {CAP2} AS string FROM part",
    f"SELECT p_partkey AS doc_id, 3 AS mention_id, 0 AS start, length(p_name) + 1 AS stop, {CAP1} || ', ' || {CAP2} AS string FROM part WHERE p_size % 3 = 0",
    f"SELECT p_partkey AS doc_id, 4 AS mention_id, 50 AS start, 50 + length({W1}) AS stop, {CAP1} AS string FROM part",
]
LISTS = {1: ("a", "b", "c"), 2: ("a", "b"), 3: ("a", "z"), 4: ("a", "d")}
LINKED = f"SELECT DISTINCT {W1} || '_a' AS src, {W2} || '_b' AS dst FROM part WHERE p_size % 4 = 1"


def location_cands(spark, sf_dir) -> DataFrame:
    of = lambda m, k: derived(spark, sf_dir, f"SELECT p_partkey AS doc_id, {m} AS mention_id, {W2 if m == 2 else W1} || '_{k}' AS inst FROM part" + (" WHERE p_size % 3 = 0" if m == 3 else ""))
    c = _union([of(m, k) for m, ks in LISTS.items() for k in ks])
    kind = F.when(F.col("inst").endswith("_b") & (F.col("mention_id") == 1), "dbpo:Person").otherwise("dbpo:PopulatedPlace|dbpo:Place")
    return c.withColumns({"label": F.lit("l"), "airp_interesting": kind, "dbp_interesting": F.lit(None).cast("string")})


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_size, {W1} AS w1, {W2} AS w2 FROM part), e AS ({LINKED}), l AS (SELECT doc_id, p_size, w1, w2, EXISTS (SELECT 1 FROM e WHERE src = w1 || '_a' AND dst = w2 || '_b') AS linked FROM p),
  k AS (SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (1, 'c'), (2, 'a'), (2, 'b'), (3, 'a'), (3, 'z'), (4, 'a'), (4, 'd')) AS v(mention_id, k))
  SELECT doc_id, mention_id, CASE mention_id WHEN 2 THEN w2 ELSE w1 END || '_' || k AS inst FROM l, k WHERE CASE WHEN mention_id = 3 THEN false
    WHEN mention_id = 2 THEN NOT linked OR k = 'b' ELSE NOT (linked OR p_size % 3 = 0) OR k = 'a' END""")
def location_pairs(spark, sf_dir):
    """'A, B': places of both that have links; with a mention of the whole, its places; and other mentions of the same string."""
    m = _union([derived(spark, sf_dir, x) for x in LOCATIONS])
    pairs = derived(spark, sf_dir, "SELECT p_partkey AS doc_id, 1 AS first_id, 2 AS second_id FROM part")
    return C.location_pairs(m, pairs, location_cands(spark, sf_dir), derived(spark, sf_dir, LINKED))[0].select("doc_id", "mention_id", "inst")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 8 IN (0, 1, 2)")
def candidate_blocked_default(spark, sf_dir):
    """The classes that are blocked unless others are named: some of those kept sound like them."""
    kinds = ["dbpo:Agent|dbpo:Person", "dbpo:Building|dbpo:Place", "dbpo:Work", "dbpo:Animal", "dbpo:Place|dbpo:Road", "dbpo:Species", "dbpo:Year", "dbpo:Language|dbpo:Work"]
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(F.lit(kinds), (F.col("p_size") % 8 + 1).cast("int")).alias("airp_specific"))
    return C.drop_blocked(p).select("p_partkey", "p_size")


GONE = "SELECT p_partkey AS mention_id FROM part WHERE p_size < 10"
CANDS = "cands AS (SELECT l_returnflag AS doc_id, l_partkey AS mention_id, l_suppkey AS inst, count(*) AS freq FROM lineitem GROUP BY ALL)"


def cands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("doc_id"), F.col("l_partkey").alias("mention_id"), F.col("l_suppkey").alias("inst")).agg(F.count("*").alias("freq"))


@query(f"WITH {CANDS}, g AS ({GONE}) SELECT doc_id, count(*) AS removed, (SELECT count(*) FROM cands c WHERE c.doc_id = k.doc_id AND mention_id NOT IN (SELECT mention_id FROM g)) AS kept FROM cands k WHERE mention_id IN (SELECT mention_id FROM g) GROUP BY doc_id")
def candidate_remove_lists(spark, sf_dir):
    c = cands(spark, sf_dir)
    mentions = c.select("doc_id", "mention_id").distinct()
    gone = mentions.join(derived(spark, sf_dir, GONE), "mention_id").select("doc_id", "mention_id")
    _, rest, taken = C.remove_lists(mentions, c, gone)
    return taken.join(rest.groupBy("doc_id").agg(F.count("*").alias("kept")), "doc_id").select("doc_id", "removed", "kept")


@query(f"WITH {CANDS} SELECT doc_id, mention_id, inst FROM cands WHERE inst % 3 > 0")
def candidate_remove(spark, sf_dir):
    c = cands(spark, sf_dir)
    return C.remove_candidates(c, c.where("inst % 3 = 0")).select("doc_id", "mention_id", "inst")


@query(f"WITH {CANDS} SELECT doc_id, mention_id, string_agg(inst || '{{freq=' || freq || CASE WHEN inst % 2 = 0 THEN ', even=yes' ELSE '' END || '}}', '; ' ORDER BY CAST(inst AS VARCHAR) || '{{') AS line FROM cands GROUP BY doc_id, mention_id")
def candidate_describe(spark, sf_dir):
    c = cands(spark, sf_dir).withColumn("even", F.when(F.col("inst") % 2 == 0, "yes")).withColumn("inst", F.col("inst").cast("string"))
    return C.describe(c, "freq", "even")


@query(f"WITH {CANDS} SELECT doc_id, mention_id, inst, f FROM (SELECT doc_id, mention_id, inst, CASE WHEN freq > 1 THEN freq END AS f FROM cands) QUALIFY row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY f DESC NULLS LAST, inst) <= 4")
def candidate_top_nulls(spark, sf_dir):
    """The first four of a list, those without a value last."""
    c = cands(spark, sf_dir).withColumn("f", F.when(F.col("freq") > 1, F.col("freq"))).drop("freq")
    return C.top(c, "f", 4, keep_null=True)


@query(f"WITH {CANDS} SELECT p_partkey AS mention_id, doc_id, count(inst) AS n, min(inst) AS least FROM part JOIN cands ON mention_id = p_partkey GROUP BY ALL")
def candidate_lists(spark, sf_dir):
    """The list of each mention, from JSON in a table of labels; dangling entries never come up."""
    info = cands(spark, sf_dir).groupBy("doc_id", "mention_id").agg(F.to_json(F.collect_list(F.struct("inst"))).alias("info"))
    labels = info.select(F.concat_ws("/", "doc_id", "mention_id").alias("label"), "info")
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention_id"), F.explode(F.array(*map(F.lit, "ANR"))).alias("doc_id")).withColumn("label", F.concat_ws("/", "doc_id", "mention_id"))
    return C.from_label_info(m, labels, "inst:bigint").groupBy("mention_id", "doc_id").agg(F.count("inst").alias("n"), F.min("inst").alias("least"))


# ---- spans and contexts ------------------------------------------------------------------------------------------

NUMBERED = "n AS (SELECT o_custkey AS doc_id, o_orderkey AS ann_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)"


@query(f"WITH {NUMBERED} SELECT a.doc_id, a.ann_id, CAST(coalesce(sum(b.ann_id), 0) AS BIGINT) AS around, count(b.ann_id) AS n FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r - 2 AND a.r + 2 AND b.r <> a.r GROUP BY ALL")
def entity_context(spark, sf_dir):
    """The entities two places before and after each, in the order of the text."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ann_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("start"), F.col("o_orderkey").alias("stop"))
    c = spans.context_entities(e, 2)
    return c.select("doc_id", "ann_id", F.aggregate("around", F.lit(0).cast("long"), lambda s, x: s + x).alias("around"), F.size("around").cast("long").alias("n"))


@query("SELECT p_partkey, b FROM (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_type END AS b FROM part) WHERE b IN ('PROMO', 'SMALL')")
def span_value_filter(spark, sf_dir):
    p = derived(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_type END AS b FROM part")
    return spans.with_value(p, "b", "PROMO", "SMALL")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, o) AS BIGINT) AS ann_id, start, stop, o FROM (SELECT o_custkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) % 100 AS start, 100 + o_orderkey % 5 AS stop, o_orderkey AS o FROM orders)")
def document_order(spark, sf_dir):
    """Numbers of spans in the order of the text, longer ones first."""
    return model.number(derived(spark, sf_dir, "SELECT o_custkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) % 100 AS start, 100 + o_orderkey % 5 AS stop, o_orderkey AS o FROM orders"), "o")


ANNOTATED = "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Key' ELSE 'Work' END AS aset, o_orderkey AS ann_id, o_orderstatus AS type, o_orderkey % 50 AS start, o_orderkey % 50 + 5 AS stop FROM orders"


@query(f"WITH a AS ({ANNOTATED}) SELECT 'set' AS reset, aset, type, count(*) AS n FROM a WHERE aset <> 'Work' GROUP BY ALL UNION ALL SELECT 'type', aset, type, count(*) FROM a WHERE NOT (aset = 'Work' AND type = 'F') GROUP BY ALL")
def annotation_reset(spark, sf_dir):
    """A set emptied, and of a set one type."""
    a = derived(spark, sf_dir, ANNOTATED)
    count = lambda df, name: df.groupBy(F.lit(name).alias("reset"), "aset", "type").agg(F.count("*").alias("n"))
    return count(model.reset(a, "Work"), "set").unionByName(count(model.reset(a, "Work", types=("F",)), "type"))


@query(f"""WITH a AS ({ANNOTATED}), tag AS (SELECT DISTINCT doc_id FROM a WHERE type = 'P'), moved AS (SELECT doc_id, CASE WHEN aset = 'Work' AND type = 'F' THEN 'Out' ELSE aset END AS aset, ann_id FROM a)
  SELECT aset, count(*) AS n, CAST(sum(ann_id) AS BIGINT) AS ids FROM moved GROUP BY aset""")
def set_move(spark, sf_dir):
    """Annotations of one type moved to another set; where a document has none of it, all of the set's would stay."""
    m = model.transfer(derived(spark, sf_dir, ANNOTATED), "Work", "Out", "F", move=True)
    return m.groupBy("aset").agg(F.count("*").alias("n"), F.sum("ann_id").alias("ids"))


@query(f"""WITH a AS ({ANNOTATED}), tag AS (SELECT DISTINCT doc_id FROM a WHERE aset = 'Work' AND type = 'P'), c AS (SELECT * FROM a UNION ALL
  SELECT doc_id, 'Out', ann_id, type, start, stop FROM a WHERE aset = 'Work' AND (doc_id NOT IN (SELECT doc_id FROM tag) OR EXISTS (SELECT 1 FROM a t WHERE t.doc_id = a.doc_id AND t.aset = 'Work' AND t.type = 'P' AND t.start <= a.start AND t.stop >= a.stop)))
  SELECT aset, count(*) AS n, CAST(sum(ann_id) AS BIGINT) AS ids FROM c GROUP BY aset""")
def set_transfer_unless_found(spark, sf_dir):
    """What lies inside a tag is copied; of documents without the tag everything is."""
    a = derived(spark, sf_dir, ANNOTATED)
    m = model.transfer(a, "Work", "Out", inside=a.where("aset = 'Work' and type = 'P'"), all_unless_found=True)
    return m.groupBy("aset").agg(F.count("*").alias("n"), F.sum("ann_id").alias("ids"))


@query("""WITH k AS (SELECT l_orderkey AS doc_id, min(l_quantity) OVER w < 10 AS few, max(l_discount) OVER w > 0.08 AS dear FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
  SELECT doc_id, CASE WHEN few THEN 'few' ELSE 'dear' END AS reason, count(*) AS removed FROM k WHERE few OR dear GROUP BY ALL""")
def removal_reasons(spark, sf_dir):
    """How many spans each of two filters took from a document, by their marks."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ann_id"), "l_quantity", "l_discount")
    s = spans.mark(s, s.where("l_quantity < 10"), "few")
    return spans.removal_counts(spans.mark(s, s.where("l_discount > 0.08"), "dear"))


TAGS = rf"""lex AS (SELECT * FROM {LEXICON}), g AS (SELECT tok.doc_id, tok_no, start, stop, string, coalesce(a.tag, b.tag, CASE WHEN kind = 'number' THEN 'CD' WHEN kind IN ('punctuation', 'symbol') THEN string WHEN regexp_matches(string, '^\p{{Lu}}') THEN 'NNP'
  {' '.join(f"WHEN string LIKE '%{e}' THEN '{t}'" for e, t in tagging.SUFFIXES)} ELSE 'NN' END) AS tag FROM tok LEFT JOIN lex a ON a.word = string LEFT JOIN lex b ON b.word = lower(string) WHERE kind NOT IN ('space', 'control')),
  pt AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY tok_no), '') AS prev FROM g),
  tagged AS (SELECT doc_id, tok_no, start, stop, string, CASE WHEN prev IN ('TO', 'MD') AND tag IN ('NN', 'VBP') THEN 'VB' WHEN prev = 'DT' AND tag IN ('VB', 'VBP', 'VBD') THEN 'NN' ELSE tag END AS tag FROM pt)"""


def tagged(spark, sf_dir) -> DataFrame:
    return tagging.tag_words(tokens.words(documents(spark, sf_dir)), inline(spark, LEXICON))


@query(f"WITH {TOKENS}, {TAGS}, p AS (SELECT string, lag(tag) OVER w AS t1, lag(tag, 3) OVER w AS t3, lag(tag, 5) OVER w AS t5 FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no)) SELECT coalesce(t1, '') AS prevtag1, coalesce(t3, '') AS prevtag3, count(*) AS n, count(t5) AS with_five FROM p GROUP BY ALL")
def positional_tags(spark, sf_dir):
    """Word classes of the tokens before each token."""
    t = spans.previous_tokens(tagged(spark, sf_dir))
    return t.groupBy(F.coalesce("prevtag1", F.lit("")).alias("prevtag1"), F.coalesce("prevtag3", F.lit("")).alias("prevtag3")).agg(F.count("*").alias("n"), F.count("prevtag5").alias("with_five"))


@query(f"WITH {TOKENS}, {TAGS}, {SENTENCES} SELECT s.doc_id, sent_no, CAST(count(DISTINCT t.string) + 2 AS BIGINT) AS nouns FROM sent s LEFT JOIN tagged t ON t.doc_id = s.doc_id AND t.start >= s.start AND t.stop <= s.stop AND tag LIKE 'NN%' GROUP BY ALL")
def sentence_nouns(spark, sf_dir):
    """Nouns inside each sentence, and two glosses."""
    t = tagged(spark, sf_dir)
    s = tokens.sentence_texts(documents(spark, sf_dir)).withColumns({"ann_id": F.col("sent_no"), "english": F.lit("a gloss; the other one;")})
    return spans.context_nouns(s, t, "english", apart=True).select("doc_id", "sent_no", F.size("nouns").cast("long").alias("nouns"))


@query(r"""WITH f AS (SELECT doc_id, text, regexp_extract_all(text, '(?:Mr|Dr)[.]|[.!?]+|\n+') AS f, string_split_regex(text, '(?:Mr|Dr)[.]|[.!?]+|\n+') AS g FROM documents),
  e AS (SELECT doc_id, unnest(g) AS gap, unnest(list_append(f, '')) AS s, generate_subscripts(g, 1) AS i FROM f), c AS (SELECT doc_id, i, gap, s, s NOT IN ('Mr.', 'Dr.') AS ends FROM e),
  n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
  p AS (SELECT doc_id, k, trim(string_agg(gap || CASE WHEN s[1] = chr(10) THEN '' ELSE s END, '' ORDER BY i), chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS s FROM n GROUP BY ALL)
  SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM p WHERE s <> '' GROUP BY doc_id""")
def regex_sentence_split(spark, sf_dir):
    """Sentences between matches of expressions: some belong to the sentence, some lie between two, some only look like ends."""
    s = tokens.regex_sentences(documents(spark, sf_dir), "[.!?]+", "\n+", "(?:Mr|Dr)[.]")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("chars"))


STATEMENTS = f"""SELECT p_partkey AS doc_id, 'Mr. J. ' || {CAP1} || ' paid $' || p_size || ',500 (' || p_size || '.5%) for ' || {CAP2} || ' Ltd on 3 May ' || (1950 + p_size) || ' at ' || p_size % 12 || ':30 pm, two weeks ago; see https://x.org/' || {W1} || ' or mail ' || {W2} || '@y.org about AB' || p_size || '7 near Mount ' || {CAP1} || '.' AS text FROM part"""


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_size AS k, {W1} AS a, {W2} AS b, {CAP1} AS ca, {CAP2} AS cb FROM part) SELECT doc_id, 'Person' AS type, 'Mr. J. ' || ca AS string FROM p UNION ALL SELECT doc_id, 'Money', '$' || k || ',500' FROM p UNION ALL SELECT doc_id, 'Percent', k || '.5%' FROM p UNION ALL
  SELECT doc_id, 'Organization', cb || ' Ltd' FROM p UNION ALL SELECT doc_id, 'Date', '3 May ' || (1950 + k) FROM p UNION ALL SELECT doc_id, 'Time', k % 12 || ':30 pm' FROM p UNION ALL SELECT doc_id, 'Date', 'two weeks ago' FROM p UNION ALL
  SELECT doc_id, 'Url', 'https://x.org/' || a FROM p UNION ALL SELECT doc_id, 'Email', b || '@y.org' FROM p UNION ALL SELECT doc_id, 'Identifier', 'AB' || k || '7' FROM p UNION ALL SELECT doc_id, 'Location', 'Mount ' || ca FROM p""")
def entity_cascade(spark, sf_dir):
    """All phases over a statement for each part: what an earlier phase takes, a later one does not."""
    docs = derived(spark, sf_dir, STATEMENTS)
    e = grammar.entity_cascade(docs).join(docs, "doc_id")
    return e.select("doc_id", "type", F.expr("substring(text, start + 1, stop - start)").alias("string"))


@query(f"SELECT p_partkey AS doc_id, unnest([{W1} || p_size, p_size || {W2}, {CAP1}, CAST(p_size AS VARCHAR), '#' || {W1} || '7']) AS string FROM part")
def message_recombine(spark, sf_dir):
    """Words and numbers that touch in messages; capitals keep them apart."""
    d = derived(spark, sf_dir, f"SELECT p_partkey AS doc_id, {W1} || p_size || ' ' || p_size || {W2} || ' ' || {CAP1} || p_size || ' #' || {W1} || '7' AS text FROM part")
    return tokens.visible(tokens.tiles(d, tokens.RECOMBINING_TILE)).select("doc_id", "string")


@query(f"""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS norm FROM part), t AS (SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'x' || substr({W1}, 2) ELSE 'X' || substr({W2}, 2) END AS word FROM part)
  SELECT word, coalesce(CASE WHEN word[1] = 'x' THEN (SELECT min((levenshtein(word, norm), norm)) FROM d WHERE levenshtein(word, norm) <= 1)[2] END, word) AS norm FROM t""")
def normalise_words(spark, sf_dir):
    """Spelling is corrected but for words with a capital first letter, which may be names."""
    from marginalia.functions.text import token_orth

    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    words = derived(spark, sf_dir, f"SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'x' || substr({W1}, 2) ELSE 'X' || substr({W2}, 2) END AS word FROM part")
    return tagging.correct_spelling(words.withColumn("orth", token_orth(F.col("word"))), known, inline(spark, "(VALUES ('zz', 'yy')) AS t(form, norm)"))


LOOKUP_TAGS = TAGS.replace("g AS (SELECT tok", "gt AS (SELECT tok").replace("FROM g)", "FROM gt)")


@query(rf"""{MATCHES}, {LOOKUP_TAGS}, l AS (SELECT DISTINCT doc_id, start, stop, CASE WHEN item_id % 4 = 0 THEN 'other' ELSE 'dbpedia' END AS major, CASE WHEN item_id % 4 = 1 THEN 'demonym' END AS minor FROM m)
  SELECT doc_id, major, coalesce(minor, '') AS minor, count(*) AS n FROM l WHERE major = 'other' OR minor = 'demonym' OR doc_id % 10 = 0 OR EXISTS (SELECT 1 FROM tagged t WHERE t.doc_id = l.doc_id AND t.start >= l.start AND t.stop <= l.stop AND tag LIKE 'NNP%') GROUP BY ALL""")
def pos_filter_gated(spark, sf_dir):
    """Look-ups without a proper noun go, but for exempt kinds and documents that ask for no filter."""
    m = mentions(spark, sf_dir, longest_only=False)
    kind = F.col("item_id") % 4
    look = m.select("doc_id", "start", "stop", F.when(kind == 0, "other").otherwise("dbpedia").alias("major"), F.when(kind == 1, "demonym").alias("minor")).distinct()
    look = model.cut_lineage(look.withColumn("ann_id", F.xxhash64("start", "stop", "major", "minor")))  # read several times: texts are cut once
    off = documents(spark, sf_dir).where("doc_id % 10 = 0")
    return spans.drop_common_words(look, tagged(spark, sf_dir), off).groupBy("doc_id", "major", F.coalesce("minor", F.lit("")).alias("minor")).agg(F.count("*").alias("n"))


@query(rf"""WITH dt AS (SELECT doc_id, term, count(*) AS tf FROM ({TERM_SQL}) GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
  df AS (SELECT term, count(*) AS df FROM dt GROUP BY term), sc AS (SELECT query_id, doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM q JOIN df USING (term) JOIN dt USING (term) WHERE df < (SELECT count(*) FROM documents) GROUP BY ALL),
  r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 500) SELECT query_id, doc_id, round(1 - (rank - 1) / count(*) OVER (PARTITION BY query_id) + 0.001, 6) AS rank_score FROM r""")
def search_rank_scores(spark, sf_dir):
    """The first 500 hits of each context, scored by their places."""
    counts = model.cut_lineage(similarity.term_counts(documents(spark, sf_dir), "text", "doc_id"))
    q = similarity.term_counts(table(spark, sf_dir, "benchmark"), "text", "item_id").select(F.col("item_id").alias("query_id"), "term")
    hits = gazetteer.term_search(q, counts, documents(spark, sf_dir).count(), 500)
    size = F.count("*").over(Window.partitionBy("query_id"))
    return hits.select("query_id", "doc_id", F.round(gazetteer.rank_score(F.col("rank") - 1, size), 6).alias("rank_score"))


# ---- dictionaries and indexes ------------------------------------------------------------------------------------


@query(f"""WITH {TOKENS}, {SENTENCES}, r AS (SELECT doc_id, tok_no, start, stop, sent_no, replace(upper(CASE WHEN string IN ('is', 'are', 'was') THEN 'be' ELSE string END), 'ẞ', 'SS') AS w FROM s2 WHERE kind NOT IN ('space', 'control')),
  g AS (SELECT doc_id, sent_no, start, w, lead(w) OVER d AS w2, lead(start) OVER d > stop AS apart FROM r WINDOW d AS (PARTITION BY doc_id, sent_no ORDER BY tok_no))
  SELECT doc_id, norm, count(*) AS n FROM (SELECT doc_id, w || ' ' || w2 AS norm FROM g WHERE apart) WHERE norm IN ('BE THE', 'IT BE', 'OF THE') GROUP BY ALL""")
def gazetteer_by_root(spark, sf_dir):
    """Entries that match the roots of words, inside sentences only."""
    t = tokens.tokenize(documents(spark, sf_dir)).withColumn("root", F.when(F.col("string").isin("is", "are", "was"), "be"))
    d = inline(spark, "(VALUES ('BE THE'), ('IT BE'), ('OF THE')) AS t(norm)")
    return gazetteer.match_in(tokens.sentence_numbers(t), d, 2, feature="root", within="sent_no").groupBy("doc_id", "norm").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS}, {BENCH}, {GRAMS}, {BGRAMS}, {DICTIONARY} SELECT doc_id, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS items FROM grams JOIN dict USING (norm) GROUP BY doc_id")
def dictionary_kept(spark, sf_dir):
    """A compiled dictionary kept as a table in buckets, and matches by it."""
    name = f"dictionary_{uuid.uuid4().hex}"
    gazetteer.save_dictionary(dictionary(spark, sf_dir), name, folder(spark, name), 8)
    m = gazetteer.match(tokens.words(documents(spark, sf_dir)), spark.table(name), 3, longest_only=False)
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("item_id").alias("items"))


@query(f"""WITH f AS (SELECT p_partkey, 'name' AS field, p_name AS v FROM part UNION ALL SELECT p_partkey, 'both', lower(p_type) || ' ' || p_name FROM part) SELECT 'part' AS kind, q.query_id, p_partkey, field FROM f JOIN (VALUES (1, 'small'), (2, 'red ring'), (3, 'promo hot')) AS q(query_id, text) ON ' ' || v || ' ' LIKE '% ' || text || ' %'
  UNION ALL SELECT 'whole', q.query_id, p_partkey, field FROM f JOIN (VALUES (1, 'small'), (2, 'red ring'), (3, 'promo hot')) AS q(query_id, text) ON v = text""")
def field_phrases(spark, sf_dir):
    """An index of fields with marks at their ends: phrases inside them, and whole fields."""
    index = gazetteer.field_index(derived(spark, sf_dir, "SELECT p_partkey, p_name AS name, lower(p_type) || ' ' || p_name AS both FROM part"), "p_partkey", "name", "both")
    q = inline(spark, "(VALUES (1, 'small'), (2, 'red ring'), (3, 'promo hot')) AS t(query_id, text)")
    find = lambda whole: gazetteer.phrase_search(index, q, "p_partkey", whole).withColumn("kind", F.lit("whole" if whole else "part"))
    return find(False).unionByName(find(True))


@query("""WITH e AS (SELECT unnest(['THE', 'THEOU', 'TION', 'MENT DAN', 'RD AN']) AS e), s AS (SELECT doc_id, e, string_split(upper(text), e) AS g FROM documents, e), p AS (SELECT doc_id, e, unnest(g[1:len(g) - 1]) AS gap, generate_subscripts(g[1:len(g) - 1], 1) AS i FROM s WHERE len(g) > 1),
  q AS (SELECT doc_id, e, sum(length(gap) + length(e)) OVER (PARTITION BY doc_id, e ORDER BY i) - length(e) AS start FROM p), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY length(e) DESC) = 1)
  SELECT doc_id, e AS norm, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM b GROUP BY ALL""")
def gazetteer_anywhere(spark, sf_dir):
    """Matches inside words, by an automaton."""
    found = gazetteer.match_anywhere(documents(spark, sf_dir), ["the", "theou", "tion", "ment dan", "rd an"])
    return found.groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+[/.][0-9]+|[0-9]+|[A-Z][a-z]+|word') AS f, string_split_regex(text, '[0-9]+[/.][0-9]+|[0-9]+|[A-Z][a-z]+|word') AS g FROM documents), e AS (SELECT doc_id, unnest(f) AS s, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM m),
  p AS (SELECT doc_id, s, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM e), k AS (SELECT doc_id, stop, stop - length(s) AS start, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN 'Number' WHEN regexp_matches(s, '^[0-9]') THEN 'Fraction' WHEN s = 'word' THEN 'Word' ELSE 'Upper' END AS type FROM p)
  SELECT doc_id, type, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops FROM k GROUP BY ALL""")
def regex_rule_file(spark, sf_dir):
    """Several rules in one scan, longest match and last rule first."""
    from marginalia.plans.text_queries import RULE_FILE

    found = rules.annotate(documents(spark, sf_dir), rules.parse_rules(RULE_FILE))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))


HASHTAGS = f"SELECT p_partkey, '#' || CASE p_size % 4 WHEN 0 THEN {W1} || {W2} WHEN 1 THEN upper({W1}) || {CAP2} WHEN 2 THEN 'Zq' || {CAP2} || 'Xk' ELSE {W1} || substr({W1}, length({W1})) || '12' || {W2} END AS tag FROM part"


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN {W1} || ' ' || {W2} WHEN 1 THEN upper({W1}) || ' ' || {CAP2} WHEN 2 THEN 'Zq ' || {CAP2} || ' Xk' WHEN 3 THEN CASE WHEN {W1} = 'small' THEN {W1} || 'l12' || {W2} ELSE {W1} || substr({W1}, length({W1})) || ' 12 ' || {W2} END END AS parts FROM part")
def hashtag_segments(spark, sf_dir):
    """Fewest dictionary words of a tag, numbers and drawn-out words too; parts of unknown ones by their capitals."""
    words = "blue cold hot large new old red small anvil bolt gear gizmo plate ring rod widget".split()
    return tagging.split_hashtags(derived(spark, sf_dir, HASHTAGS), words).select("p_partkey", F.array_join("parts", " ").alias("parts"))


@query(f"""WITH {TOKENS}, {TAGS}, {SENTENCES}, t AS (SELECT tagged.doc_id, sent_no, tagged.tok_no, tagged.tag FROM tagged JOIN s2 USING (doc_id, tok_no)), c0 AS (SELECT *, CASE WHEN substr(tag, 1, 2) IN ('NN', 'DT', 'JJ', 'PR', 'CD') THEN 'I' ELSE 'O' END AS c, lead(tag) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
  c1 AS (SELECT * REPLACE (CASE WHEN c = 'I' AND tag = 'PRP' THEN 'O' ELSE c END AS c) FROM c0), c2 AS (SELECT * REPLACE (CASE WHEN c = 'O' AND tag = 'VBG' AND nxt = 'NN' THEN 'I' ELSE c END AS c) FROM c1),
  c3 AS (SELECT *, lag(c) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS before FROM c2) SELECT doc_id, CASE WHEN c = 'I' AND tag = 'DT' AND before = 'I' THEN 'B' ELSE c END AS chunk, count(*) AS n FROM c3 GROUP BY ALL""")
def noun_chunks(spark, sf_dir):
    """Transformation rules in order over each sentence of every document."""
    t = tagging.tag_words(tokens.visible(tokens.sentence_numbers(tokens.tokenize(documents(spark, sf_dir)))), inline(spark, LEXICON))
    return tagging.chunk_nouns(t, CHUNK_RULES).groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))


# ---- entities and likeness ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'hot'])) > 0 AS shared FROM part WHERE p_size % 5 > 0 UNION ALL SELECT p_partkey, false FROM part WHERE p_size % 5 = 0")
def share_inst(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("w", F.when(F.col("p_size") % 5 > 0, F.split("p_name", " ")))
    return p.select("p_partkey", entities.share_inst(F.col("w"), F.lit(["red", "ring", "hot"])).alias("shared"))


CHAIN_SPANS = [f"SELECT p_partkey AS doc_id, {e} AS entity_id, {a} AS start, {b} AS stop, {i} AS i FROM part" for e, a, b, i in ((1, 0, 10, f"{W1} || '|x'"), (2, 5, 12, "CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'y|z|q' END"), (3, 11, 20, "'w'"), (4, 30, 40, "p_type"))]


@query("""SELECT p_partkey AS doc_id, CAST(e AS BIGINT) AS entity_id, CAST(CASE e WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 1 END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END WHEN 3 THEN NULL ELSE 4 END AS BIGINT) AS final_id FROM part, (VALUES (1), (2), (3), (4)) AS v(e)
  WHERE p_size % 2 = 1 OR e IN (1, 4) UNION ALL SELECT p_partkey, 2, NULL FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 3, 3 FROM part WHERE p_size % 2 = 0""")
def coref_overlap_resolution(spark, sf_dir):
    """Overlapping spans of two chains in order: with an inst in common they merge, else the one with fewer goes."""
    s = _union([derived(spark, sf_dir, x) for x in CHAIN_SPANS])
    s = s.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("entity_id").cast("long").alias("entity_id"), "start", "stop", F.split("i", "[|]").alias("insts"))
    return entities.resolve_chains(s).select("doc_id", "entity_id", "final_id")


@query("SELECT o_custkey AS doc_id, count(*) AS n FROM orders o WHERE o_custkey % 2 = 1 OR EXISTS (SELECT 1 FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_orderpriority = '1-URGENT' AND k.o_orderkey % 40 < o.o_orderkey % 40 + 5 AND o.o_orderkey % 40 < k.o_orderkey % 40 + 5) GROUP BY o_custkey")
def key_overlap_switch(spark, sf_dir):
    """In half of the documents only entities that overlap a gold mention stay."""
    e = derived(spark, sf_dir, "SELECT o_custkey AS doc_id, o_orderkey AS ann_id, o_orderkey % 40 AS start, o_orderkey % 40 + 5 AS stop, o_orderpriority FROM orders")
    return entities.of_keys_only(e, e.where("o_orderpriority = '1-URGENT'"), e.where("doc_id % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT p_partkey AS doc_id, p_name AS text, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type || ' of ' || p_brand END AS a, CASE WHEN p_size % 2 = 0 THEN p_brand END AS b FROM part), t AS (SELECT *, text || coalesce(chr(10) || a, '') || coalesce(chr(10) || b, '') AS full_text FROM m)
  SELECT doc_id, 1 AS mention_id, full_text AS text, a AS expansion FROM t WHERE a IS NOT NULL UNION ALL SELECT doc_id, 2, full_text, b FROM t WHERE b IS NOT NULL""")
def append_expansions(spark, sf_dir):
    """What is known of a message's tag and user after its text, and where it stands."""
    docs = derived(spark, sf_dir, "SELECT p_partkey AS doc_id, p_name AS text FROM part")
    m = _union([derived(spark, sf_dir, f"SELECT p_partkey AS doc_id, {i} AS mention_id, {i} AS start, '{k}' AS kind, 'k' || p_partkey AS key FROM part") for i, k in ((2, "user"), (1, "hashtag"))])
    cache = derived(spark, sf_dir, "SELECT 'hashtag' AS kind, 'k' || p_partkey AS key, p_type || ' of ' || p_brand AS text FROM part WHERE p_size % 3 > 0").unionByName(derived(spark, sf_dir, "SELECT 'user' AS kind, 'k' || p_partkey AS key, p_brand AS text FROM part WHERE p_size % 2 = 0"))
    longer, places = entities.append_expansions(docs, m, cache)
    return places.join(longer, "doc_id").select("doc_id", "mention_id", "text", F.expr("substring(text, start + 1, stop - start)").alias("expansion"))


VECTORS = "(VALUES ('red', 1.0, 0.0, 0.5), ('hot', 0.5, 1.0, 0.0), ('ring', 0.0, 0.5, 1.0), ('rod', 0.2, 0.0, 1.0), ('promo', 1.0, 1.0, 0.0), ('small', 0.0, 1.0, 1.0)) AS t(term, a, b, c)"
KB_TEXTS = [f"SELECT 'i' || p_partkey AS inst, '{s}' AS source, {t} AS text FROM part" for s, t in (("direct", "lower(p_type)"), ("indirect", f"{W2} || ' ' || lower(p_type) || ' ' || {W2}"), ("abstract", "p_name"))]


@query(f"""WITH v AS (SELECT * FROM {VECTORS}), k AS ({' UNION ALL '.join(KB_TEXTS)}), s AS (SELECT inst, source, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT inst, source, unnest(string_split(text, ' ')) AS term FROM k) JOIN v USING (term) GROUP BY ALL),
  x AS (SELECT p_partkey AS entity_id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) JOIN v USING (term) GROUP BY ALL)
  SELECT entity_id, s.inst, source, round((x.a * s.a + x.b * s.b + x.c * s.c) / (sqrt(x.a * x.a + x.b * x.b + x.c * x.c) * sqrt(s.a * s.a + s.b * s.b + s.c * s.c)), 6) AS cosine
  FROM x JOIN part ON p_partkey = entity_id JOIN s ON s.inst = 'i' || (p_partkey // 2) OR s.inst = 'i' || p_partkey""")
def vector_similarities(spark, sf_dir):
    """A context against what three sources say of each candidate."""
    vec = inline(spark, VECTORS).select("term", F.array(*[F.col(c).cast("double") for c in "abc"]).alias("vec"))
    contexts = derived(spark, sf_dir, "SELECT p_partkey AS entity_id, p_name AS text FROM part")
    lists = contexts.select("entity_id", F.explode(F.array(F.concat(F.lit("i"), F.expr("entity_id div 2")), F.concat(F.lit("i"), "entity_id"))).alias("inst"))
    return similarity.vector_similarities(contexts, lists, _union([derived(spark, sf_dir, t) for t in KB_TEXTS]), vec)


# ---- sources, sinks, streams and control -------------------------------------------------------------------------


@query("SELECT replace(p_brand, '#', '') AS name, string_agg(DISTINCT p_name, chr(10) ORDER BY p_name) || chr(10) AS text FROM part GROUP BY p_brand")
def corpus_directory(spark, sf_dir):
    """A corpus written as one file for each document and read by extension; files of other kinds beside them stay unread."""
    path = folder(spark, "corpus")
    docs = table(spark, sf_dir, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("")).alias("name")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), "\n").alias("text"))
    corpora.save_files(docs, path)
    docs.write.mode("append").partitionBy("name").csv(path)
    return corpora.directory(spark, path, ["txt"], recurse=True).select(corpora.document_name(F.col("name")).alias("name"), "text")


@query("SELECT p_type, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY p_type")
def corpus_saved(spark, sf_dir):
    """A corpus saved by a feature and read back."""
    path = folder(spark, "saved")
    corpora.save(table(spark, sf_dir, "part"), path, ["p_type"])
    return spark.read.parquet(path).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS cnt FROM lineitem GROUP BY ALL")
def graph_file(spark, sf_dir):
    """Edges from tab-separated files; counts of repeated ones are summed up."""
    path = folder(spark, "edges")
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").cast("int").alias("cnt"))
    e.write.option("sep", "\t").option("compression", "gzip").csv(path)
    return graph.load(spark, path)


@query("SELECT DISTINCT p_type AS list_file, lower(p_type) AS major, p_brand AS minor FROM part WHERE p_size = 7")
def gazetteer_yaml(spark, sf_dir):
    """Definitions in YAML: one item for each list."""
    rows = table(spark, sf_dir, "part").where("p_size = 7").select("p_type", "p_brand").distinct()
    text = rows.agg(F.array_join(F.collect_list(F.concat(F.lit("- list_file: "), "p_type", F.lit("\n  major: '"), F.lower("p_type"), F.lit("'  \n  minor: \""), "p_brand", F.lit('"'))), "\n")).first()[0]  # the text of one definition file
    items = [(d["list_file"], d["major"], d["minor"]) for d in dictionaries.parse_yaml(text.replace("Brand#", "Brand~"))]
    return spark.createDataFrame(items, "list_file string, major string, minor string").withColumn("minor", F.replace("minor", F.lit("~"), F.lit("#")))


@query("SELECT p_type AS annotationType, count(*) AS n, round(avg(p_size), 6) AS f FROM part GROUP BY p_type")
def evaluation_table(spark, sf_dir):
    """A table of figures as tab-separated text, read back."""
    path = folder(spark, "evaluation")
    sinks.write_tsv(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("annotationType")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("f")), path)
    return spark.read.csv(path, sep="\t", header=True, schema="annotationType string, n long, f double")


@query("SELECT 'query ' || event_id AS what, value AS ms FROM events WHERE event_type <> 'click' ORDER BY value DESC, 'query ' || event_id || ' took ' || value || ' ms' LIMIT 10")
def slowest_log_lines(spark, sf_dir):
    """A top-k report over log lines; lines of another form are left out."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("query "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", " came in").otherwise(F.concat(F.lit(" took "), F.col("value").cast("string"), F.lit(" ms"))))
    return sinks.slowest_lines(e.select(line.alias("value")), 10).select("what", "ms")


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM tok WHERE kind = 'word' GROUP BY doc_id")
def stream_annotation(spark, sf_dir):
    """Documents as a stream, cut into words micro-batch by micro-batch."""
    source, out = folder(spark, "stream-in"), folder(spark, "stream-out")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.annotate_stream(stream, lambda batch: tokens.tokenize(batch).where("kind = 'word'"), out, folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


PLAN = """
# how a corpus is run
prrun:
  broken: always
  urgent: o_orderpriority=1-URGENT
  off: never
prinit:
  least.n: 3
prparm:
  least.n: 5
  mark.value: "{who} was here"
propset:
  who: nobody
docfeature:
  kind: order
"""


@query("SELECT kind, mark, hot, count(*) AS n FROM (SELECT 'order' AS kind, 'nobody was here' AS mark, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS hot FROM orders WHERE o_custkey >= 5) GROUP BY ALL")
def configured_plan(spark, sf_dir):
    """A plan set up by a YAML text: run modes, parameters, properties and document features, with hooks and a step that fails."""
    errors: list[Exception] = []
    steps = (
        Step("least", lambda df, n: df.where(F.col("o_custkey") >= n)), Step("mark", lambda df, value: df.withColumn("mark", F.lit(value))), Step("broken", lambda df: df.select("no_such_column")),
        Step("urgent", lambda df: df.withColumn("hot", F.lit(1))), Step("off", lambda df: df.limit(0)),
    )
    plan = Plan(steps, before=lambda df: df.withColumn("seen", F.lit(1)), after=lambda df: df.where("seen = 1"), aborted=errors.append).configure(read_config(PLAN))
    out = plan.run(table(spark, sf_dir, "orders"), ignore_errors=True)
    assert len(errors) == 1
    return out.groupBy("kind", "mark", "hot").agg(F.count("*").alias("n"))
