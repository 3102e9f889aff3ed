"""Queries over column functions, message sources, sinks, statistics and event windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import concepts, uris
from marginalia.functions import text as X
from marginalia.operators import evaluation, gazetteer, tagging
from marginalia.plans.pipeline import Plan, Step
from marginalia.plans.registry import example, inline, query, table
from marginalia.plans.text_queries import TOKENS
from marginalia.sources import messages, sinks
from marginalia.streaming import documents as streams

# ---- strings -----------------------------------------------------------------------------------------------------


def _accents_sql(c: str) -> str:
    c = f"translate({c}, '{X.ACCENTED + X.CYRILLIC}', '{''.join(map(X.plain_letter, X.ACCENTED)) + X.CYRILLIC_TO}')"
    return reduce(lambda s, kv: f"replace({s}, '{kv[0]}', '{kv[1]}')", X.SEVERAL.items(), c)


@query(f"SELECT doc_id, md5(n) AS digest, CAST(length(n) AS BIGINT) AS n_chars FROM (SELECT doc_id, {_accents_sql(chr(34) + 'l' + chr(34))} AS n FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r!-/:-@\\[-`{{-~]+', ' ', 'g')) AS l FROM documents))")
def accent_normalise(spark, sf_dir):
    n = X.normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("n_chars"))


@query(rf"""WITH {TOKENS}, w AS (SELECT string, count(*) AS n FROM tok WHERE kind = 'word' GROUP BY string), c AS (SELECT n, regexp_matches(string, '^\p{{Lu}}') AS f, regexp_matches(substr(string, 2), '\p{{Lu}}') AS u, regexp_matches(substr(string, 2), '\p{{Ll}}') AS l FROM w)
  SELECT CASE WHEN f AND NOT l THEN 'UPPER' WHEN f AND NOT u THEN 'UPPERINITIAL' WHEN NOT f AND NOT u THEN 'LOWER' ELSE 'OTHER' END AS "case", count(*) AS strings, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""")
def case_of_string(spark, sf_dir):
    from marginalia.operators.tokens import strings

    w = strings(table(spark, sf_dir, "documents")).where("kind = 'word'").groupBy("string").agg(F.count("*").alias("n"))
    return w.groupBy(X.case_of(F.col("string")).alias("case")).agg(F.count("*").alias("strings"), F.sum("n").alias("n"))


TYPOS = "(VALUES ('smal'), ('ring'), ('rong'), ('gr8'), ('zzzz'), ('Widgets'), ('blu')) AS t(word)"


@example("SELECT * FROM (VALUES ('smal', 'small'), ('ring', 'ring'), ('rong', 'ring'), ('gr8', 'great'), ('zzzz', 'zzzz'), ('Widgets', 'widget'), ('blu', 'blue')) AS t(word, norm)")
def levenshtein_normalise(spark, sf_dir):
    words = F.explode(F.split("p_name", " ")).alias("word")
    known = table(spark, sf_dir, "part").select(words).distinct().unionByName(inline(spark, "(VALUES ('blue'), ('small'), ('ring'), ('widget')) AS t(word)"))
    return tagging.correct_spelling(inline(spark, TYPOS), known, inline(spark, "(VALUES ('gr8', 'great')) AS t(form, norm)"))


@query(r"SELECT doc_id, CAST(length(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS BIGINT) AS sc_string_length FROM documents")
def string_length_feature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.clean(F.col("text"))).cast("long").alias("sc_string_length"))


@query("SELECT p_partkey, ' ' || array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('small', 'red')), ' ') AS terms FROM part")
def context_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.context_terms(F.col("p_name"), ["small", "red"]).alias("terms"))


ENTRIES = "(VALUES (1, '  New   York '), (2, ' Zürich'), (3, '   ')) AS t(id, entry)"


@example("SELECT * FROM (VALUES (1, 'NEW YORK'), (2, 'ZÜRICH'), (3, '')) AS t(id, norm)")
def entry_normalise(spark, sf_dir):
    return inline(spark, ENTRIES).select("id", X.dictionary_entry(F.col("entry")).alias("norm"))


@example("SELECT * FROM (VALUES (1, 'a b'), (1, 'b a'), (1, 'a c'), (1, 'c a'), (1, 'b c'), (1, 'c b')) AS t(id, pair)")
def word_rotations(spark, sf_dir):
    d = inline(spark, "(VALUES (1, 'a b c')) AS t(id, s)")
    return d.select("id", F.explode(gazetteer.rotations(F.split("s", " "), 2)).alias("p")).select("id", F.array_join("p", " ").alias("pair"))


@query("SELECT super_class, count(*) AS n FROM (SELECT CASE p_type WHEN 'PROMO' THEN 'Sale' WHEN 'SMALL' THEN 'Size' WHEN 'LARGE' THEN 'Size' ELSE p_type END AS super_class FROM part) GROUP BY ALL")
def super_class(spark, sf_dir):
    classes = inline(spark, "(VALUES ('PROMO', 'Sale'), ('SMALL', 'Size'), ('LARGE', 'Size')) AS t(cls, super_class)")
    return gazetteer.super_class(table(spark, sf_dir, "part").withColumnRenamed("p_type", "cls"), classes).groupBy("super_class").agg(F.count("*").alias("n"))


# ---- identifiers -------------------------------------------------------------------------------------------------

SHORT_URIS = "(VALUES (1, 'Paris'), (2, 'dbpo:City'), (3, 'http://x.org/y'), (4, ''), (5, NULL), (6, 'foaf:name')) AS t(id, u)"


@example("SELECT * FROM (VALUES (1, 'http://dbpedia.org/resource/Paris'), (2, 'http://dbpedia.org/ontology/City'), (3, 'http://x.org/y'), (4, ''), (5, NULL), (6, 'http://xmlns.com/foaf/0.1/name')) AS t(id, full_uri)")
def expand_uri(spark, sf_dir):
    return inline(spark, SHORT_URIS).select("id", uris.expand(F.col("u")).alias("full_uri"))


@query("SELECT page_id, 'http://dbpedia.org/resource/' || url AS uri, url AS short FROM pages")
def shorten_uri(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("uri", F.concat(F.lit(uris.BASE), "url"))
    return p.select("page_id", "uri", uris.shorten(F.col("uri")).alias("short"))


LONG_URIS = "(VALUES (1, 'http://dbpedia.org/page/Old'), (2, 'http://dbpedia.org/resource/A%28b%29'), (3, 'http://other.org/x'), (4, 'http://dbpedia.org/resource/Keep')) AS t(id, uri)"


@example("SELECT * FROM (VALUES (1, 'http://dbpedia.org/resource/New'), (2, 'http://dbpedia.org/resource/A(b)'), (4, 'http://dbpedia.org/resource/Keep')) AS t(id, uri)")
def redirect_uri(spark, sf_dir):
    r = inline(spark, "(VALUES ('http://dbpedia.org/resource/Old', 'http://dbpedia.org/resource/New')) AS t(fromuri, touri)")
    return uris.fix(inline(spark, LONG_URIS), r).select("id", "uri")


@example("SELECT * FROM (VALUES (1, 'http://dbpedia.org/resource/Paris'), (2, 'http://dbpedia.org/resource/dbpo:City'), (3, 'http://x.org/y'), (4, ''), (5, ''), (6, 'http://dbpedia.org/resource/foaf:name')) AS t(id, uri)")
def mention_uri(spark, sf_dir):
    return inline(spark, SHORT_URIS).select("id", uris.mention_uri(F.col("u")).alias("uri"))


@example("SELECT * FROM (VALUES (1, 'http://x.org/Z%C3%BCrich'), (2, 'a%20b')) AS t(id, uri)")
def normalize_uri(spark, sf_dir):
    return inline(spark, "(VALUES (1, 'http://x.org/Zürich'), (2, 'a b')) AS t(id, u)").select("id", uris.encode(F.col("u")).alias("uri"))


# ---- concepts ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, round(CASE WHEN p_size > 0 THEN log10(p_size) ELSE 0 END, 6) AS log_freq, round((1e6 - p_partkey) / 1e6, 6) AS concept, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS dead, p_name || ': ' || p_type AS readable FROM part")
def concept_features(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cui = F.concat(F.lit("C0"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return p.select("p_partkey", F.round(concepts.log_frequency(F.col("p_size").cast("string")), 6).alias("log_freq"), F.round(concepts.concept_score(cui), 6).alias("concept"), concepts.is_dead(F.when(F.col("p_size") % 2 == 0, "1901-01-01")).alias("dead"), concepts.readable(F.col("p_name"), F.col("p_type")).alias("readable"))


STY = "(VALUES (1, 'C1', 'Tissue'), (2, 'C2', 'Finding'), (3, '', 'Tissue'), (4, 'C4', 'Geographic Area'), (5, 'C5', 'Body Part, Organ, or Organ Component'), (6, NULL, NULL)) AS t(id, inst, sty)"


@example("SELECT * FROM (VALUES (1, 'kept', 'Anatomy'), (2, 'kept', 'Observation'), (3, 'no inst', 'Anatomy'), (4, 'type', 'none'), (5, 'kept', 'Anatomy'), (6, 'no inst', 'none')) AS t(id, why, grp)")
def tidy_types(spark, sf_dir):
    t = concepts.tidy(inline(spark, STY))
    return t.select("id", F.coalesce("deleted_because", F.lit("kept")).alias("why"), F.coalesce(concepts.group_of(F.col("sty")), F.lit("none")).alias("grp"))


@example("SELECT * FROM (VALUES (1, 'Tissue'), (2, 'Finding'), (3, 'Tissue'), (4, 'Geographic_Area'), (5, 'Body_Part_Organ_or_Organ_Component')) AS t(id, type)")
def concept_types(spark, sf_dir):
    return inline(spark, STY).select("id", F.explode(concepts.type_names(F.col("sty"))).alias("type"))


@example("SELECT * FROM (VALUES (1, 1.5), (2, NULL), (3, NULL)) AS t(id, n)".replace("1.5", "CAST(1.5 AS DOUBLE)"))
def correct_null_features(spark, sf_dir):
    return inline(spark, "(VALUES (1, '1.5'), (2, 'null'), (3, NULL)) AS t(id, s)").select("id", concepts.number_or_null(F.col("s")).alias("n"))


@example("SELECT * FROM (VALUES (1, CAST(1291973473000 AS BIGINT), CAST(2010121009 AS BIGINT)), (2, NULL, NULL)) AS t(id, ms, hour)")
def created_at(spark, sf_dir):
    ts = concepts.created_at(F.col("s"))
    d = inline(spark, "(VALUES (1, 'Fri Dec 10 09:31:13 +0000 2010'), (2, 'yesterday')) AS t(id, s)")
    return d.select("id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyyMMddHH").cast("long").alias("hour"))


@query("SELECT CASE WHEN lang = 'fr' THEN 'preprocess-fr' WHEN source = 'src1' THEN 'preprocess-en-twitter' ELSE 'preprocess-en' END AS branch, count(*) AS n FROM documents GROUP BY ALL")
def document_routing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("doc_type", F.when(F.col("source") == "src1", "tweet"))
    return d.groupBy(concepts.routing(F.col("lang"), F.col("doc_type"))[2].alias("branch")).agg(F.count("*").alias("n"))


# ---- messages ----------------------------------------------------------------------------------------------------

TWEETS = """(VALUES (1, '{"id_str":"7","text":"a &amp; b #x","user":{"screen_name":"ann","name":"Ann B"},"entities":{"hashtags":[{"text":"x","indices":[10,12]}],"set:urls":[{"indices":[0,7]}]}}'), (2, '{"id_str":"8","text":"&lt;3 @bob","user":{"screen_name":"cat"},"entities":{"user_mentions":[{"indices":[6,10]}]}}')) AS t(id, js)"""


@example(f"SELECT id, json_extract_string(js, '$.user.screen_name') AS screen_name, json_extract_string(js, '$.text') AS text, json_extract_string(js, '$.user.name') AS name FROM {TWEETS}")
def tweet_paths(spark, sf_dir):
    return inline(spark, TWEETS).select("id", *[messages.dig(F.col("js"), p).alias(n) for p, n in (("user:screen_name", "screen_name"), ("text", "text"), ("user:name", "name"))])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", messages.dig(F.col("props"), "k").cast("long").alias("k"))


@example("SELECT * FROM (VALUES ('7', '', 'hashtags', 6, 8), ('7', 'set', 'urls', 0, 3), ('8', '', 'user_mentions', 3, 7)) AS t(id_str, aset, type, start, stop)")
def tweet_entities(spark, sf_dir):
    m = inline(spark, TWEETS).select(F.from_json("js", messages.MESSAGE).alias("m")).select("m.*")
    return messages.entities(m)


@example(f"SELECT id, replace(replace(replace(json_extract_string(js, '$.text'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM {TWEETS}")
def tweet_unescape(spark, sf_dir):
    return inline(spark, TWEETS).select("id", messages.unescape(messages.dig(F.col("js"), "text")).alias("text"))


@example("SELECT * FROM (VALUES (1, 'text', 0, 8), (1, 'user:name', 9, 14), (2, 'text', 0, 7)) AS t(id, key, start, stop)")
def tweet_content(spark, sf_dir):
    spans = messages.content(F.col("js"), ["text", "user:name"])[1]
    return inline(spark, TWEETS).select("id", F.explode(spans).alias("s")).select("id", "s.*")


@example("SELECT * FROM (VALUES (1, CAST(2 AS BIGINT)), (2, 3), (3, 0)) AS t(id, n)")
def read_messages(spark, sf_dir):
    d = inline(spark, """(VALUES (1, '[{"a":1},{"a":2}]'), (2, concat('{"a":1}', chr(10), '{"a":2}', chr(10), chr(10), '{"a":3}')), (3, '')) AS t(id, s)""")
    return d.select("id", F.size(messages.split_text(F.col("s"))).cast("long").alias("n"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)")
def join_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return messages.join_messages(c, "conv_id", "turn").select("conv_id", "turn", "start")


@query("WITH m AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) AS n FROM conversations) SELECT role, 'talk_' || lpad(CAST(n // 5 AS VARCHAR), 6, '0') AS doc_name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) + count(*) - 1 AS n_chars FROM m GROUP BY ALL")
def messages_per_document(spark, sf_dir):
    """Five messages a document, four in the first one."""
    c = table(spark, sf_dir, "conversations").withColumn("o", F.struct("conv_id", "turn", "text"))
    return messages.documents_of(c, 5, "talk", "o", part="role").select("role", "doc_name", "n", F.length("text").cast("long").alias("n_chars"))


# ---- sinks -------------------------------------------------------------------------------------------------------

XML_DOCS = "(VALUES (1, 'Bonn & Paris in May'), (2, 'none <here>')) AS t(doc_id, text)"
XML_MENTIONS = "(VALUES (1, 0, 4, 'bonn'), (1, 7, 12, 'paris'), (1, 10, 15, 'lost')) AS t(doc_id, start, stop, inst)"


@example("SELECT * FROM (VALUES (1, '<Mention inst=\"bonn\">Bonn</Mention> &amp; <Mention inst=\"paris\">Paris</Mention> in May', CAST(2 AS BIGINT)), (2, 'none &lt;here&gt;', 0)) AS t(doc_id, xml, n_mentions)")
def export_inline_xml(spark, sf_dir):
    return sinks.inline_xml(inline(spark, XML_DOCS), inline(spark, XML_MENTIONS))


@example("""SELECT * FROM (VALUES (1, '{"text":"Bonn & Paris in May","entities":{"M":[{"indices":[0,4]},{"indices":[7,12]},{"indices":[10,15]}]}}'), (2, '{"text":"none <here>"}')) AS t(doc_id, json)""")
def export_json(spark, sf_dir):
    return sinks.document_json(inline(spark, XML_DOCS), inline(spark, XML_MENTIONS).drop("inst").withColumn("type", F.lit("M")))


def document_mentions(spark, sf_dir):
    from marginalia.plans.text_queries import mentions

    return mentions(spark, sf_dir).select("doc_id", "start", "stop", F.col("norm").alias("inst")).distinct()


@query()
def export_inline_xml_documents(spark, sf_dir):
    """The dictionary matches of each document in its text; no SQL, tested by hand."""
    return sinks.inline_xml(table(spark, sf_dir, "documents").select("doc_id", "text"), document_mentions(spark, sf_dir))


@query()
def export_json_documents(spark, sf_dir):
    """The dictionary matches of each document by the first letter of their entry; no SQL, tested by hand."""
    m = document_mentions(spark, sf_dir).select("doc_id", "start", "stop", F.substring("inst", 1, 1).alias("type"))
    return sinks.document_json(table(spark, sf_dir, "documents").select("doc_id", "text"), m)


@example("SELECT '<table><caption>T</caption><tr><td>1</td><td>2</td><td>correct</td></tr><tr><td></td><td>3</td><td>spurious</td></tr></table>' AS html")
def export_difference_html(spark, sf_dir):
    o = inline(spark, "(VALUES ('T', 1, 1, 2, 'correct'), ('T', 1, NULL, 3, 'spurious')) AS t(type, doc_id, key_id, response_id, outcome)")
    return sinks.difference_html(o).select("html")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || p_type AS value FROM part")
def export_arff_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return sinks.arff_rows(p, ["p_partkey", "p_size"], ["p_type"]).select(F.substring_index("value", ",", 1).cast("long").alias("p_partkey"), F.expr("substring(value, instr(value, ',') + 1)").alias("value"))


# ---- statistics --------------------------------------------------------------------------------------------------




@query("SELECT p_brand, string_agg(DISTINCT w, '|' ORDER BY w) AS combined FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL")
def combined_feature(spark, sf_dir):
    """Values of a |-joined feature over all annotations of an inst."""
    p = table(spark, sf_dir, "part").select("p_brand", F.explode(X.pipe_values(F.replace("p_name", F.lit(" "), F.lit("|")))).alias("w"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("w")), "|").alias("combined"))


@query("SELECT 'type' AS feature, count(*) AS n FROM part UNION ALL SELECT 'brand', count(*) FROM part WHERE p_size > 25")
def feature_discovery(spark, sf_dir):
    from marginalia.operators.learning import discover

    p = table(spark, sf_dir, "part")
    features = F.map_filter(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.when(F.col("p_size") > 25, F.col("p_brand"))), lambda k, v: v.isNotNull())
    return discover(p.select(features.alias("features")))


@query("SELECT round(avg(p), 6) AS p_strict FROM (SELECT lang, round(avg(quality), 6) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def macro_average(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("p_strict"))
    for c in ("r_strict", "f_strict", "p_lenient", "r_lenient", "f_lenient"):
        g = g.withColumn(c, F.lit(0.0))
    return evaluation.macro(g).select("p_strict")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1 GROUP BY ALL")
def conditional_pipeline(spark, sf_dir):
    """Steps with run modes: one that always runs, one for rows with a feature, one that is switched off by configuration."""
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    plan = Plan((
        Step("latest", lambda df, keep: df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= keep).drop("_r"), params={"keep": 2}),
        Step("urgent", lambda df: df.withColumn("hot", F.lit(1)), when=("o_orderpriority", "1-URGENT")),
        Step("high", lambda df: df.withColumn("hot", F.lit(1)), when=("o_orderpriority", "2-HIGH")),
        Step("drop_all", lambda df: df.limit(0)),
    )).configure({"prrun": {"drop_all": "never"}, "prparm": {"latest.keep": 1}})
    out: DataFrame = plan.run(table(spark, sf_dir, "orders"))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"))


# ---- event windows (beyond documents) ----------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"), "6 hours", "event_type")


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '8 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
  SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, s""")
def events_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "8 hours", "user_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang = 'de'")
def corpus_subset(spark, sf_dir):
    """A view on part of a corpus: by a table of names, then by a condition."""
    from marginalia.sources import corpora

    d = corpora.subset(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return corpora.subset(d, F.col("lang") == "de").select("doc_id", "lang")
