"""Queries over candidates, graphs, similarity, ranking and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.model import cut_lineage
from marginalia.operators import candidates as C
from marginalia.operators import entities, graph, ranking, similarity
from marginalia.plans.registry import example, inline, query, table
from marginalia.plans.text_queries import TERM_SQL, TOKENS

# The suppliers of a part's line items are its candidates: a part is a mention, a return flag a document.
CANDS = "cands AS (SELECT l_returnflag AS doc_id, l_partkey AS mention_id, l_suppkey AS inst, min(l_linestatus) AS label, count(*) AS freq, round(sum(l_discount), 2) AS score, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL)"


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("doc_id"), F.col("l_partkey").alias("mention_id"), F.col("l_suppkey").alias("inst"))
    return g.agg(F.min("l_linestatus").alias("label"), F.count("*").alias("freq"), F.round(F.sum("l_discount"), 2).alias("score"), F.sum("l_quantity").cast("long").alias("qty"))


LABEL_INFO = """(VALUES ('small ring', '[{"inst":"r1","uri_freq":5},{"inst":"r2","uri_freq":7}]'), ('red widget', '[{"inst":"w1","uri_freq":1}]'), ('none', '[]')) AS t(label, info)"""


@query(f"SELECT p.p_partkey AS mention_id, json_extract_string(c, '$.inst') AS inst, CAST(json_extract(c, '$.uri_freq') AS INTEGER) AS uri_freq FROM part p JOIN (SELECT label, unnest(from_json(info, '[\"JSON\"]')) AS c FROM {LABEL_INFO}) i ON p.p_name = i.label")
def candidates_explode_json(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("label"))
    return C.from_label_info(m, inline(spark, LABEL_INFO), "inst:string,uri_freq:int").select("mention_id", "inst", "uri_freq")


@query(f"WITH {CANDS} SELECT doc_id, mention_id, inst, freq FROM cands WHERE freq >= 1 QUALIFY row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY freq DESC, inst) <= 3")
def candidate_topk_frequency(spark, sf_dir):
    return C.frequent(cands(spark, sf_dir), 1, 3).select("doc_id", "mention_id", "inst", "freq")


@query("SELECT p_partkey, p_type, p_brand FROM part WHERE p_type NOT IN ('PROMO', 'LARGE') AND p_brand <> 'Brand#2'")
def candidate_type_blacklist(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"airp_specific": F.concat_ws("|", "p_type", F.lit("x")), "dbp_specific": F.col("p_brand")})
    return C.drop_blocked(p, ["PROMO", "LARGE", "Brand#2"], untyped_too=True).select("p_partkey", "p_type", "p_brand")


@query(f"WITH {CANDS} SELECT a.mention_id, a.inst FROM cands a JOIN cands b ON a.doc_id = 'N' AND b.doc_id = 'R' AND a.mention_id = b.mention_id AND a.inst = b.inst")
def candidate_intersect(spark, sf_dir):
    c = cands(spark, sf_dir)
    return C.keep_insts(c.where("doc_id = 'N'"), c.where("doc_id = 'R'").withColumn("doc_id", F.lit("N"))).select("mention_id", "inst")


@query(f"WITH {CANDS} SELECT doc_id, mention_id - mention_id % 10 AS mention_id, inst, label, min((freq, score, qty))[1] AS freq FROM cands GROUP BY ALL".replace("min((freq, score, qty))[1]", "min(freq)"))
def candidate_merge(spark, sf_dir):
    c = cands(spark, sf_dir)
    into = c.select("doc_id", "mention_id", (F.col("mention_id") - F.col("mention_id") % 10).alias("target")).distinct()
    return C.merge_lists(c, into).select("doc_id", "mention_id", "inst", "label", "freq")


@query(f"WITH {CANDS} SELECT * FROM cands WHERE mention_id IN (SELECT p_partkey FROM part WHERE p_size < 10)".replace("SELECT *", "SELECT doc_id, mention_id, inst"))
def candidate_retain(spark, sf_dir):
    m = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("mention_id"), F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("doc_id"))
    return C.of_mentions(cands(spark, sf_dir), m).select("doc_id", "mention_id", "inst")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 3 = 0")
def candidate_class_filter(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumns({"airp_interesting": F.when(F.col("s_nationkey") % 3 == 0, "dbpo:PopulatedPlace|dbpo:Place").otherwise("dbpo:Person"), "dbp_interesting": F.lit(None).cast("string")})
    return C.of_class(s, "dbpo:PopulatedPlace").select("s_suppkey", "s_name")


# Orders stand for pairs of neighbouring mentions: the customer's nation and the part's supplier.
PAIR_MENTIONS = "(VALUES (1, 1, 0, 5, 'Paris'), (1, 2, 7, 12, 'Texas'), (1, 3, 20, 23, 'Rom'), (1, 4, 25, 29, 'Oslo'), (2, 1, 0, 4, 'Bonn')) AS t(doc_id, mention_id, start, stop, string)"
PAIR_TEXT = "(VALUES (1, 'Paris, Texas is not Rom, Oslo'), (2, 'Bonn')) AS t(doc_id, text)"
PAIR_CANDS = "(VALUES (1, 1, 'paris_fr', 'a'), (1, 1, 'paris_tx', 'a'), (1, 2, 'texas', 'b'), (1, 2, 'texas_md', 'b'), (1, 3, 'rome', 'c'), (1, 3, 'rom', 'c'), (1, 4, 'oslo', 'd'), (2, 1, 'bonn', 'e')) AS t(doc_id, mention_id, inst, label)"
PAIR_EDGES = "(VALUES ('texas', 'paris_tx', 3), ('paris_fr', 'france', 9)) AS t(src, dst, cnt)"


@example(f"SELECT * FROM {PAIR_CANDS} WHERE inst NOT IN ('paris_fr', 'texas_md')")
def pair_related_filter(spark, sf_dir):
    from marginalia.operators.tokens import tokenize

    m = inline(spark, PAIR_MENTIONS)
    pairs = C.comma_pairs(m, tokenize(inline(spark, PAIR_TEXT)))
    return C.related_pairs(pairs, inline(spark, PAIR_CANDS), inline(spark, PAIR_EDGES))


@query("""WITH p AS (SELECT o_orderkey AS doc_id, o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
  a AS (SELECT doc_id, 1 AS mention_id, 'c' || (c + x) AS inst FROM p, (VALUES (0), (1)) AS v(x)), b AS (SELECT doc_id, 2 AS mention_id, 's' || (s + x) AS inst FROM p, (VALUES (0), (1)) AS v(x)),
  e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1),
  l AS (SELECT a.doc_id, src, dst FROM a JOIN e ON src = a.inst JOIN b ON b.doc_id = a.doc_id AND dst = b.inst), g AS (SELECT doc_id, 1 AS mention_id, src AS inst FROM l UNION SELECT doc_id, 2, dst FROM l)
  SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) AS k WHERE doc_id NOT IN (SELECT doc_id FROM g) OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = k.doc_id AND g.mention_id = k.mention_id AND g.inst = k.inst)""")
def pair_related_edges(spark, sf_dir):
    """An order's customer and first supplier as a pair, two candidates each; the links are those of the other lines."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = j.where("l_linenumber = 1").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"))
    two = lambda i, c: p.select("doc_id", F.lit(i).alias("mention_id"), F.explode(F.array(F.col(c), F.col(c) + 1)).alias("k")).select("doc_id", "mention_id", F.concat(F.lit(c), F.col("k").cast("string")).alias("inst"))
    edges = j.where("l_linenumber > 1").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    pairs = p.select("doc_id", F.lit(1).alias("first_id"), F.lit(2).alias("second_id"))
    return C.related_pairs(pairs, two(1, "c").unionByName(two(2, "s")), edges)


SHORT = "(VALUES (1, 'The United Nations (UN) and the World Health Organization (WHO), later WHO'), (2, 'Bank of England (BOE) (X) none (YZ)'), (3, 'Red Green (AB)')) AS t(doc_id, text)"


@example("SELECT * FROM (VALUES (1, 'United Nations', 'UN'), (1, 'World Health Organization', 'WHO')) AS t(doc_id, definition, abbreviation)")
def abbreviation_match(spark, sf_dir):
    return C.abbreviation_pairs(inline(spark, SHORT))


SHORT_MENTIONS = "(VALUES (1, 1, 'World Health Organization'), (1, 2, 'WHO'), (1, 3, 'WHO'), (1, 4, 'Geneva')) AS t(doc_id, mention_id, string)"
SHORT_CANDS = "(VALUES (1, 1, 'who', 'x'), (1, 1, 'org', 'x'), (1, 2, 'who', 'y'), (1, 2, 'who_band', 'y'), (1, 3, 'who_band', 'y'), (1, 3, 'who', 'y'), (1, 4, 'geneva', 'z')) AS t(doc_id, mention_id, inst, label)"


@example(f"SELECT * FROM {SHORT_CANDS} WHERE inst IN ('who', 'geneva')")
def abbreviation_filter(spark, sf_dir):
    pairs = C.abbreviation_pairs(inline(spark, SHORT))
    return C.meet_abbreviations(inline(spark, SHORT_CANDS), inline(spark, SHORT_MENTIONS), pairs)


@example(f"SELECT doc_id, mention_id, inst, label FROM {SHORT_CANDS} WHERE NOT (mention_id = 3 AND inst = 'who_band') OR mention_id <> 3".replace(" WHERE NOT (mention_id = 3 AND inst = 'who_band') OR mention_id <> 3", " WHERE mention_id <> 3 OR inst = 'who_band' OR inst = 'who'"))
def propagate_by_string(spark, sf_dir):
    """Another mention of a reduced one's string is reduced alike (here to both candidates it had)."""
    changed = inline(spark, "(VALUES (1, 2)) AS t(doc_id, mention_id)")
    return C.propagate_by_string(inline(spark, SHORT_CANDS), inline(spark, SHORT_MENTIONS), changed)


@query(f"WITH {TOKENS}, p AS (SELECT doc_id, string, lead(string) OVER d AS gap, regexp_extract(lead(string, 2) OVER d, '^[a-z]+') AS w FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no)) SELECT doc_id, string || ' ' || w AS outer_string, w AS inner_string, count(*) AS n FROM p WHERE string IN ('The', 'the') AND gap = ' ' AND w <> '' GROUP BY ALL HAVING count(*) >= 3")
def prefix_the(spark, sf_dir):
    """'the X' and the X inside it, by an interval join of the two sets of spans."""
    from marginalia.operators.spans import span_join
    from marginalia.operators.tokens import tokenize

    w = Window.partitionBy("doc_id").orderBy("tok_no")
    t = tokenize(table(spark, sf_dir, "documents"))
    head = F.regexp_extract("word", "^[a-z]+", 0)
    t = t.withColumns({"gap": F.lead("string").over(w), "word": F.lead("string", 2).over(w)}).where("string in ('The', 'the') and gap = ' '").withColumn("word", head).where("word <> ''")
    t = cut_lineage(t.select("doc_id", "start", "stop", "string", "word"))  # read twice: texts are cut once
    outer = t.select("doc_id", F.col("start").alias("ann_id"), "start", (F.col("stop") + 1 + F.length("word")).alias("stop"), F.concat_ws(" ", "string", "word").alias("string"))
    inner = t.select("doc_id", (F.col("stop") + 1).alias("start"), (F.col("stop") + 1 + F.length("word")).alias("stop"), "word")
    pairs = span_join(outer, inner, "covers").where("b_stop = stop and b_start > start")
    return pairs.groupBy("doc_id", F.col("string").alias("outer_string"), F.col("b_word").alias("inner_string")).agg(F.count("*").alias("n")).where("n >= 3")


THE_MENTIONS = "(VALUES (1, 1, 0, 8, 'the Hague'), (1, 2, 4, 8, 'Hague'), (1, 3, 20, 28, 'the Times'), (1, 4, 24, 28, 'Times')) AS t(doc_id, mention_id, start, stop, string)"
THE_CANDS = "(VALUES (1, 1, 'hague'), (1, 1, 'band'), (1, 2, 'hague'), (1, 2, 'william'), (1, 3, 'times_uk'), (1, 4, 'times_font')) AS t(doc_id, mention_id, inst)"


@example("SELECT * FROM (VALUES (1, 2, 'hague'), (1, 3, 'times_uk'), (1, 4, 'times_font')) AS t(doc_id, mention_id, inst)")
def prefix_the_reduce(spark, sf_dir):
    return C.reduce_the(inline(spark, THE_CANDS), C.the_prefixed(inline(spark, THE_MENTIONS)))


@query(f"""WITH {TOKENS}, p AS (SELECT doc_id, string, lead(string) OVER d AS gap, lead(string, 2) OVER d AS w, lead(kind, 2) OVER d AS k FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY tok_no))
  SELECT doc_id, CAST(sum(CASE WHEN length(w) % 2 = 0 THEN 1 ELSE 3 END) AS BIGINT) AS n, CAST(sum(CASE WHEN length(w) % 2 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS mentions FROM p WHERE string IN ('The', 'the') AND gap = ' ' AND k = 'word' GROUP BY doc_id""")
def prefix_the_reduce_documents(spark, sf_dir):
    """'the X' has the insts X and the X; X has another one and, where its length is even, X."""
    from marginalia.operators.tokens import tokenize

    d = Window.partitionBy("doc_id").orderBy("tok_no")
    t = tokenize(table(spark, sf_dir, "documents"))
    t = t.withColumns({"gap": F.lead("string").over(d), "w": F.lead("string", 2).over(d), "k": F.lead("kind", 2).over(d), "z": F.lead("stop", 2).over(d)}).where("string in ('The', 'the') and gap = ' ' and k = 'word'")
    t = cut_lineage(t.select("doc_id", "start", "stop", "string", "w", "z"))  # read many times: texts are cut once
    outer = t.select("doc_id", (F.col("start") * 2).alias("mention_id"), "start", F.col("z").alias("stop"), F.concat_ws(" ", "string", "w").alias("string"), F.array("w", F.concat(F.lit("the "), "w")).alias("i"))
    other = F.concat(F.lit("other "), "w")
    inner = t.select("doc_id", ((F.col("stop") + 1) * 2 + 1).alias("mention_id"), (F.col("stop") + 1).alias("start"), F.col("z").alias("stop"), F.col("w").alias("string"), F.when(F.length("w") % 2 == 0, F.array(other, "w")).otherwise(F.array(other)).alias("i"))
    m = outer.unionByName(inner)
    left = C.reduce_the(m.select("doc_id", "mention_id", F.explode("i").alias("inst")), C.the_prefixed(m.drop("i")))
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("mention_id").alias("mentions"))


OWNERS = "(VALUES (1, 1, 0, 7, 'Anna''s'), (1, 2, 0, 4, 'Anna'), (1, 3, 9, 12, 'Bob')) AS t(doc_id, mention_id, start, stop, string)"
OWNER_CANDS = "(VALUES (1, 1, 'annas', 'Anna''s', 1), (1, 2, 'anna', 'Anna', 2), (1, 3, 'bob', 'Bob', 3)) AS t(doc_id, mention_id, inst, label, freq)"


@example("SELECT * FROM (VALUES (1, 1, 'annas', 'Anna''s', 1), (1, 1, 'anna', 'Anna', 2), (1, 3, 'bob', 'Bob', 3)) AS t(doc_id, mention_id, inst, label, freq)")
def possessive_merge(spark, sf_dir):
    return C.merge_lists(inline(spark, OWNER_CANDS), C.possessives(inline(spark, OWNERS)))


@example("SELECT * FROM (VALUES (1, 2, 10)) AS t(doc_id, mention_id, clone_id)")
def user_id_projection(spark, sf_dir):
    users = inline(spark, "(VALUES (1, 10, 0, 5), (1, 11, 6, 9)) AS t(doc_id, ann_id, start, stop)")
    names = inline(spark, "(VALUES (1, 10, 100, 120), (1, 11, 130, 140)) AS t(doc_id, user_ann_id, start, stop)")
    m = inline(spark, "(VALUES (1, 1, 101, 104), (1, 2, 106, 118), (1, 3, 6, 9), (1, 4, 131, 139)) AS t(doc_id, mention_id, start, stop)")
    return C.project_user_ids(users, names, m)


@query("""WITH c AS (SELECT p_brand AS mention_id, p_type AS readable, 'C' || lpad(CAST((p_partkey * 7919) % 100000 AS VARCHAR), 7, '0') AS cui FROM part), a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY mention_id, readable ORDER BY CAST(substr(cui, 2) AS BIGINT), cui) = 1)
  SELECT mention_id, readable, cui FROM a QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY CAST(substr(cui, 2) AS BIGINT), cui) <= 4""")
def readable_lowest_id_top(spark, sf_dir):
    cui = F.concat(F.lit("C"), F.lpad(((F.col("p_partkey") * 7919) % 100000).cast("string"), 7, "0"))
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("doc_id"), F.col("p_brand").alias("mention_id"), F.col("p_type").alias("readable"), cui.alias("cui"))
    return C.readable_top(p, 4).select("mention_id", "readable", "cui")


@query("""WITH c AS (SELECT upper(p_name) AS mention, count(*) AS total, sum(p_size) AS links, round(avg(p_retailprice), 4) AS linkprop FROM part WHERE p_size > 40 GROUP BY ALL)
  SELECT p_partkey, total AS freq, CAST(links AS BIGINT) AS link_freq, linkprop AS link_prob FROM part LEFT JOIN c ON lower(p_name) = lower(mention)""")
def mention_statistics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.where("p_size > 40").groupBy(F.upper("p_name").alias("mention")).agg(F.count("*").alias("total"), F.sum("p_size").alias("links"), F.round(F.avg("p_retailprice"), 4).alias("linkprop"))
    return C.mention_statistics(p.select("p_partkey", F.col("p_name").alias("string")), c).select("p_partkey", "freq", "link_freq", "link_prob")


# ---- graphs: customer -> part -> supplier ------------------------------------------------------------------------

EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, count(*) AS cnt FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, count(*) FROM lineitem GROUP BY ALL),
  nodes AS (SELECT DISTINCT src AS n FROM edges UNION SELECT DISTINCT dst FROM edges)"""


KEYS = {"c": ("customer", "c_custkey"), "p": ("part", "p_partkey"), "s": ("supplier", "s_suppkey")}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy(name("c", "o_custkey").alias("src"), name("p", "l_partkey").alias("dst")).agg(F.count("*").alias("cnt"))
    return a.unionByName(li.groupBy(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")).agg(F.count("*").alias("cnt")))


def _pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Each node of one kind with three of the other."""
    a, b = kind
    ids = table(spark, sf_dir, KEYS[a][0]).select(F.col(KEYS[a][1]).alias("id"), F.explode(F.expr("array(0, 1, 7)")).alias("d"))
    return ids.select(F.concat(F.lit(a), F.col("id").cast("string")).alias("a"), F.concat(F.lit(b), (F.col("id") + F.col("d")).cast("string")).alias("b")).where("a <> b").hint("shuffle_merge")  # as derived()


def _pairs_sql(kind: str) -> str:
    a, b = kind
    return f"pairs AS (SELECT '{a}' || i AS a, '{b}' || (i + d) AS b FROM (SELECT {KEYS[a][1]} AS i FROM {KEYS[a][0]}), (VALUES (0), (1), (7)) v(d) WHERE '{a}' || i <> '{b}' || (i + d))"


@query(f"WITH {EDGES}, {_pairs_sql('cp')} SELECT a, b, coalesce(cnt, 0) AS direct FROM pairs LEFT JOIN edges ON src = a AND dst = b")
def graph_direct(spark, sf_dir):
    return graph.direct(_pairs(spark, sf_dir, "cp"), edges(spark, sf_dir))


@query(f"WITH {EDGES}, {_pairs_sql('pp')} SELECT a, b, CAST(coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.src = y.src WHERE x.dst = a AND y.dst = b), 0) AS BIGINT) AS shared_parent FROM pairs")
def graph_shared_parent(spark, sf_dir):
    return graph.shared_parent(_pairs(spark, sf_dir, "pp"), edges(spark, sf_dir))


@query(f"WITH {EDGES}, {_pairs_sql('cc')} SELECT a, b, CAST(coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.dst = y.dst WHERE x.src = a AND y.src = b), 0) AS BIGINT) AS shared_child FROM pairs")
def graph_shared_child(spark, sf_dir):
    return graph.shared_child(_pairs(spark, sf_dir, "cc"), edges(spark, sf_dir))


@query(f"WITH {EDGES}, {_pairs_sql('cs')} SELECT a, b, CAST(coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src = a AND y.dst = b), 0) AS BIGINT) AS sequence FROM pairs")
def graph_sequence(spark, sf_dir):
    return graph.sequence(_pairs(spark, sf_dir, "cs"), edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {_pairs_sql('pp')}, near AS (SELECT a, b, 1 + ascii(substr(b, 2, 1)) % 5 AS dist FROM pairs), v AS (SELECT a, b, dist,
  coalesce((SELECT cnt FROM edges WHERE src = a AND dst = b), 0) + coalesce((SELECT cnt FROM edges WHERE src = b AND dst = a), 0) AS bi, coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.src = y.src WHERE x.dst = a AND y.dst = b), 0) AS sp,
  coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.dst = y.dst WHERE x.src = a AND y.src = b), 0) AS sc,
  coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src = a AND y.dst = b), 0) + coalesce((SELECT sum(x.cnt + y.cnt) FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src = b AND y.dst = a), 0) AS ind FROM near)
  SELECT a AS inst, round(sum(bi / dist), 6) AS bi_direct, round(sum(sp / dist), 6) AS shared_parent, round(sum(sc / dist), 6) AS shared_child, round(sum(ind / dist), 6) AS bi_indirect, round(round(sum(bi / dist), 6) + 0.25 * (round(sum(ind / dist), 6) + round(sum(sp / dist), 6) + round(sum(sc / dist), 6)), 6) AS combined FROM v GROUP BY a""")
def structural_combined(spark, sf_dir):
    p = _pairs(spark, sf_dir, "pp").select(F.lit(1).alias("doc_id"), F.col("a").alias("entity_id"), F.col("a").alias("inst"), F.col("b").alias("other_entity_id"), F.col("b").alias("other_inst"), (1 + F.ascii(F.substring("b", 2, 1)) % 5).alias("dist"))
    return graph.structural(p, edges(spark, sf_dir)).select("inst", "bi_direct", "shared_parent", "shared_child", "bi_indirect", "combined")


@query(f"""WITH {_pairs_sql('ss')}, l AS (SELECT DISTINCT 's' || l_suppkey AS inst, l_partkey AS src FROM lineitem), n AS (SELECT inst, count(*) AS n FROM l GROUP BY inst),
  j AS (SELECT p.a, p.b, (SELECT count(*) FROM l x JOIN l y ON x.src = y.src WHERE x.inst = p.a AND y.inst = p.b) AS both_, x.n AS na, y.n AS nb FROM pairs p LEFT JOIN n x ON x.inst = p.a LEFT JOIN n y ON y.inst = p.b)
  SELECT a, b, round(CASE WHEN both_ > 0 THEN (ln(greatest(na, nb)) - ln(both_)) / (ln(1e7) - ln(least(na, nb))) ELSE 0 END, 6) AS relatedness FROM j""")
def link_relatedness(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("inst"), F.col("l_partkey").alias("src"))
    return graph.link_relatedness(_pairs(spark, sf_dir, "ss"), links)


def _rank_sql(rounds: int) -> str:
    out = f"WITH {EDGES}, tot AS (SELECT src, sum(cnt) AS t FROM edges GROUP BY src), base AS (SELECT n AS node, 1.0 / (SELECT count(*) FROM nodes) AS w FROM nodes), r0 AS (SELECT node, CAST(w AS DOUBLE) AS rank FROM base)"
    for i in range(rounds):
        out += f", g{i} AS (SELECT dst, sum(cnt / t * rank) AS got FROM edges JOIN tot USING (src) JOIN r{i} ON src = node GROUP BY dst), r{i + 1} AS (SELECT node, 0.15 * w + 0.85 * coalesce(got, 0) AS rank FROM base LEFT JOIN g{i} ON dst = node)"
    return f"{out} SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_rank_sql(4))
def pagerank_fixed_iter(spark, sf_dir):
    return graph.page_rank(edges(spark, sf_dir), rounds=4).select("node", F.round("rank", 8).alias("rank"))


# ---- similarity --------------------------------------------------------------------------------------------------


@query(rf"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM ({TERM_SQL}) GROUP BY ALL), l AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS len, count(*) OVER (PARTITION BY term) AS df FROM t)
  SELECT doc_id, count(*) AS terms, round(sum(tf / len * ln((SELECT count(*) FROM documents) / df)), 6) AS weights FROM l GROUP BY doc_id""")
def tfidf_corpus(spark, sf_dir):
    t = similarity.tf_idf(table(spark, sf_dir, "documents"), "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weights"))


@query(r"""WITH ct AS (SELECT lang AS entity_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE source = 'src0'), tt AS (SELECT lang AS entity_id, source AS inst, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE source <> 'src0'),
  c AS (SELECT entity_id, term, count(*) AS tf FROM ct GROUP BY ALL), t AS (SELECT entity_id, inst, term, count(*) AS tf FROM tt GROUP BY ALL), df AS (SELECT entity_id, term, count(*) AS df FROM t GROUP BY ALL),
  x AS (SELECT entity_id, term, tf / coalesce(df, 1) AS x FROM c LEFT JOIN df USING (entity_id, term)), y AS (SELECT entity_id, inst, term, tf / df AS y FROM t JOIN df USING (entity_id, term)),
  d AS (SELECT entity_id, inst, sum(x * y) AS dot FROM x JOIN y USING (entity_id, term) GROUP BY ALL), na AS (SELECT entity_id, sqrt(sum(x * x)) AS na FROM x GROUP BY ALL), nb AS (SELECT entity_id, inst, sqrt(sum(y * y)) AS nb FROM y GROUP BY ALL)
  SELECT entity_id, inst, round(coalesce(dot, 0) / (na * nb), 6) AS cosine FROM nb JOIN na USING (entity_id) LEFT JOIN d USING (entity_id, inst)""")
def tficf_cosine(spark, sf_dir):
    """The texts of one source as the context of a language, those of the other sources as its candidates."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("entity_id"), F.col("source").alias("inst"), "text")
    ctx = d.where("inst = 'src0'").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    cnd = d.where("inst <> 'src0'").groupBy("entity_id", "inst").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return similarity.tf_icf(ctx, cnd)


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM d GROUP BY ALL)
  SELECT vec_id, round(sum(CAST(v AS DOUBLE) * m) / (sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) * sqrt(sum(m * m))), 6) AS cosine FROM d JOIN m USING (label, i) GROUP BY vec_id""")
def vector_cosine(spark, sf_dir):
    """Every vector against the mean of those with its label."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


VECTORS = "(VALUES ('red', 1.0, 0.0), ('small', 0.5, 0.5), ('ring', 0.0, 2.0), ('widget', 1.0, 1.0)) AS t(term, x, y)"


@query(f"""WITH v AS (SELECT * FROM {VECTORS}), t AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS term FROM (SELECT DISTINCT p_name FROM part)), s AS (SELECT p_name, sum(x) AS x, sum(y) AS y FROM t JOIN v USING (term) GROUP BY p_name)
  SELECT p_name, round((x * 1.0 + y * 2.0) / (sqrt(x * x + y * y) * sqrt(5.0)), 6) AS cosine FROM s""")
def vector_context(spark, sf_dir):
    """Sum of the vectors of a text's terms against the context's vector."""
    v = inline(spark, VECTORS).select("term", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("vec"))
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    t = similarity.text_vectors(names, "p_name", v, "p_name")
    return t.select("p_name", F.round(X.cosine(F.col("vec"), F.array(F.lit(1.0), F.lit(2.0))), 6).alias("cosine"))


PAIRS = "(VALUES (1, 'United Nations', 'UN'), (2, 'New York City', 'York New'), (3, 'Österreich', 'oesterreich'), (4, 'abc', 'xyz'), (5, 'BBC', 'British Broadcasting Corporation'), (6, '', 'x'), (7, 'a_b-c', 'a b c')) AS t(id, a, b)"


@example("SELECT * FROM (VALUES (1, 0.5), (2, 0.4), (3, 0.5), (4, 0.0), (5, 0.5), (6, 0.0), (7, 0.5)) AS t(id, score)".replace("0.5)", "CAST(0.5 AS DOUBLE))"))
def string_sim(spark, sf_dir):
    p = inline(spark, PAIRS)
    return p.select("id", F.round(X.name_match(X.normalise(F.col("a")), X.normalise(F.col("b"))), 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey, list_distinct(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 4))) AS a, list_distinct(list_transform(string_split(lower(p_type) || ' ' || 'ring', ' '), lambda w: substr(w, 1, 4))) AS b FROM part)
  SELECT p_partkey, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS score FROM p""")
def string_sim_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = F.concat(F.lower("p_type"), F.lit(" ring"))
    return p.select("p_partkey", F.round(X.name_match(F.col("p_name"), label), 6).alias("score"))


LABELS = "(VALUES (1, 'UN', 'United Nations|UN', 'title'), (2, 'PARIS', 'Paris', 'sentence'), (3, 'PARIS', 'Paris', 'upper'), (4, 'Paris', 'Rome|Paris Texas', 'title')) AS t(id, mention, labels, case_)"


@example("SELECT * FROM (VALUES (1, 0.5), (2, 0.45), (3, 0.5), (4, 0.333333)) AS t(id, score)")
def label_similarity(spark, sf_dir):
    p = inline(spark, LABELS)
    return p.select("id", F.round(similarity.label_similarity(F.col("mention"), X.pipe_values(F.col("labels")), F.col("case_")), 6).alias("score"))


# ---- ranking -----------------------------------------------------------------------------------------------------


@query(f"WITH {CANDS} SELECT doc_id, mention_id, inst, CAST(rank() OVER (PARTITION BY doc_id, mention_id ORDER BY freq DESC) AS BIGINT) AS freq_rank, CAST(rank() OVER (PARTITION BY doc_id, mention_id ORDER BY qty DESC) AS BIGINT) AS qty_rank FROM cands")
def rank_features(spark, sf_dir):
    r = ranking.add_ranks(cands(spark, sf_dir), "freq", "qty")
    return r.select("doc_id", "mention_id", "inst", F.col("rnfreqRank").cast("long").alias("freq_rank"), F.col("rnqtyRank").cast("long").alias("qty_rank"))


def _best(order: str, score: str, accept: str) -> str:
    return f"WITH {CANDS}, b AS (SELECT *, {score} AS sc FROM cands), f AS (SELECT *, max(sc) OVER w AS bs, max(freq) OVER w AS bf FROM b WINDOW w AS (PARTITION BY doc_id, mention_id)), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY {order}, inst) = 1) SELECT doc_id, mention_id, CASE WHEN {accept} THEN inst END AS inst, round(sc, 6) AS score, NOT ({accept}) AS is_nil FROM o"


@query(_best("sc DESC", "score", "sc >= 0.05"))
def disamb_simple(spark, sf_dir):
    return ranking.best_by(cands(spark, sf_dir), "score")


@query(_best("sc DESC", "CAST(score AS DOUBLE) * 1.0 + CAST(freq AS DOUBLE) * 0.25", "sc >= 0.3"))
def disamb_mix(spark, sf_dir):
    return ranking.best_by_sum(cands(spark, sf_dir), {"score": 1.0, "freq": 0.25}, 0.3)


@query(_best("CASE WHEN bs > 0.15 THEN sc ELSE freq END DESC, freq DESC", "score", "true"))
def disamb_mix_popularity(spark, sf_dir):
    return ranking.best_by_mix(cands(spark, sf_dir), ["score"], "freq", 0.15)


@query(_best("sc DESC", "CAST(freq AS DOUBLE)", "sc > 1"))
def disamb_popularity(spark, sf_dir):
    return ranking.best_by_popularity(cands(spark, sf_dir), "freq", 1)


@query(_best("CASE WHEN bs > 0.06 THEN sc ELSE freq END DESC", "CASE WHEN label = 'F' THEN -score ELSE score END", "bs > 0.06 OR bf > 1"))
def disamb_threshold_backoff(spark, sf_dir):
    c = cands(spark, sf_dir).withColumns({"class": F.when(F.col("label") == "F", "false").otherwise("true"), "confidence": F.col("score")})
    return ranking.best_by_model(c, 0.06, 1)


# ---- entities ----------------------------------------------------------------------------------------------------

# A conversation is an entity: its turns are mentions, and the words of a turn with 12 letters and more its candidates.
TURNS = r"turns AS (SELECT conv_id, turn, any_value(text) AS text FROM (SELECT * FROM conversations ORDER BY text) GROUP BY ALL)"


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("string"))
    m = c.select(F.lit(1).alias("doc_id"), F.col("conv_id").alias("entity_id"), F.concat_ws("/", "conv_id", "turn").alias("mention_id"), F.col("turn").alias("start"), "string")
    words = F.array_distinct(F.regexp_extract_all(F.lower("string"), F.lit(r"(\p{L}{12,})"), F.lit(1)))
    return m, m.select("doc_id", "mention_id", F.explode(words).alias("inst"), F.lit("w").alias("label"))


TURN_CTES = r"""m AS (SELECT conv_id, turn, min(text) AS string FROM conversations GROUP BY ALL), c AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(string), '\p{L}{12,}')) AS inst FROM m),
  r AS (SELECT conv_id, turn FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(string) DESC, turn, conv_id || '/' || turn) <= 2), pool AS (SELECT DISTINCT conv_id, inst FROM c JOIN r USING (conv_id, turn))"""


@query(f"WITH {TURN_CTES} SELECT conv_id || '/' || turn AS mention_id, inst FROM m JOIN pool USING (conv_id)")
def coref_pool_candidates(spark, sf_dir):
    return entities.pool_candidates(*turns(spark, sf_dir), n=2).select("mention_id", "inst")


@query(f"WITH {TURN_CTES}, e AS (SELECT conv_id, turn, inst, false AS flagged FROM m JOIN pool USING (conv_id) UNION ALL SELECT c.*, true FROM c WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.conv_id = c.conv_id AND p.inst = c.inst)) SELECT flagged, count(*) AS n FROM e GROUP BY flagged")
def coref_flag_candidates(spark, sf_dir):
    return entities.pool_candidates(*turns(spark, sf_dir), n=2, delete=False).groupBy("flagged").agg(F.count("*").alias("n"))


@query(f"WITH {TURN_CTES} SELECT conv_id AS entity_id, conv_id || '/' || turn AS mention_id FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len(string_split(string, ' ')) DESC, turn, mention_id) = 1")
def entity_wordiest_span(spark, sf_dir):
    return entities.wordiest_span(turns(spark, sf_dir)[0]).select("entity_id", "mention_id")


CHAIN_MENTIONS = "(VALUES (1, 1, 0, 5), (1, 2, 10, 15), (1, 3, 20, 25), (1, 4, 20, 25), (2, 1, 0, 5)) AS t(doc_id, mention_id, start, stop)"


@example("SELECT * FROM (VALUES (1, 1, CAST(77 AS BIGINT)), (1, 2, 77), (1, 3, -3), (1, 4, -4), (2, 1, -1)) AS t(doc_id, mention_id, entity_id)")
def entity_building(spark, sf_dir):
    chains = inline(spark, "(VALUES (1, 77, 0, 5), (1, 77, 10, 15), (1, 78, 20, 25)) AS t(doc_id, chain_id, start, stop)")
    return entities.build(inline(spark, CHAIN_MENTIONS), chains).select("doc_id", "mention_id", F.col("entity_id").cast("long").alias("entity_id"))


@example("SELECT * FROM (VALUES (1, 1, 'save the whales'), (1, 2, NULL)) AS t(doc_id, mention_id, expansion)")
def expansion_context(spark, sf_dir):
    m = inline(spark, "(VALUES (1, 1, 5, 9), (1, 2, 50, 55)) AS t(doc_id, mention_id, start, stop)").withColumn("ann_id", F.col("mention_id"))
    e = inline(spark, "(VALUES (1, 4, 20, 'user', 'Anna'), (1, 4, 20, 'hashtag', 'save the whales'), (1, 4, 20, 'url', 'a page')) AS t(doc_id, start, stop, kind, text)")
    return entities.expansion_of(m, e).select("doc_id", "mention_id", "expansion")



@query()
def ml_train_apply(spark, sf_dir):
    """Train a candidate classifier on line items and apply it; not to be had in SQL, tested for its accuracy."""
    from marginalia.operators import learning

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("sc_quantity"), F.col("l_discount").alias("sc_discount"), F.col("l_returnflag").alias("nm_flag"), F.when(F.col("l_quantity") > 25, "true").otherwise("false").alias("class"))
    model = learning.fit(li)
    return learning.apply(model, li.drop("class")).groupBy("nm_flag", "class").agg(F.count("*").alias("n"))


@query(f"WITH {CANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY freq DESC, inst) - 1 AS rk, count(*) OVER (PARTITION BY doc_id, mention_id) AS size FROM cands) SELECT doc_id, mention_id, inst, round(1 - rk / size + 0.001, 6) AS rank_score FROM r")
def result_rank_score(spark, sf_dir):
    """Scores of a result list by place alone."""
    from marginalia.operators.gazetteer import rank_score

    w = Window.partitionBy("doc_id", "mention_id")
    r = cands(spark, sf_dir).withColumns({"rk": F.row_number().over(w.orderBy(F.desc("freq"), "inst")) - 1, "size": F.count("*").over(w)})
    return r.select("doc_id", "mention_id", "inst", F.round(rank_score(F.col("rk"), F.col("size")), 6).alias("rank_score"))


@query("SELECT l_returnflag AS doc_id, l_partkey AS mention_id, l_suppkey AS inst FROM lineitem GROUP BY ALL")
def candidate_dedupe(spark, sf_dir):
    """Of candidates with one inst in a list one stays."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc_id"), F.col("l_partkey").alias("mention_id"), F.col("l_suppkey").alias("inst"), "l_linenumber")
    none = li.select("doc_id", "mention_id", F.col("mention_id").alias("target")).where("false")
    return C.merge_lists(li, none, "inst").select("doc_id", "mention_id", "inst")


@query("""WITH m AS (SELECT o_custkey AS doc_id, o_orderkey AS ann_id, o_orderkey % 97 AS start, o_orderkey % 97 + 8 AS stop FROM orders), d AS (SELECT c_custkey AS doc_id, 20 + c_custkey % 80 AS size FROM customer)
  SELECT doc_id, count(*) AS n, min(ann_id) AS least FROM m JOIN d USING (doc_id) WHERE stop <= size GROUP BY doc_id""")
def original_span_switch(spark, sf_dir):
    """Mentions inside the original text, before what expansions appended."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (20 + F.col("c_custkey") % 80).alias("size"))
    at = F.col("o_orderkey") % 97
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ann_id"), at.alias("start"), (at + 8).alias("stop"))
    return entities.in_original(m, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ann_id").alias("least"))

