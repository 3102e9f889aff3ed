"""Queries over spans: interval joins and the filters built of them. The line items of an order stand for spans of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import model
from marginalia.operators import entities, evaluation, spans
from marginalia.plans.registry import example, inline, query, table

ITEMS = """items AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS ann_id, l_returnflag AS type, l_linestatus AS status,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) * 10 AS stop, l_quantity FROM lineitem)"""
EVENTS = "ev AS (SELECT event_type AS doc_id, event_id AS ann_id, user_id % 2 AS side, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704067200 AS start, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704067200 + user_id * 60 AS stop FROM events)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (order), ann_id, type (return flag), status, start (day of shipping), stop."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    df = table(spark, sf_dir, "lineitem").withColumn("ann_id", F.row_number().over(w).cast("long"))
    return df.select(F.col("l_orderkey").alias("doc_id"), "ann_id", F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"), day.cast("long").alias("start"), (day + F.col("l_quantity").cast("long") * 10).alias("stop"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = items(spark, sf_dir)
    return i.where("type = 'N'").drop("type", "status"), i.where("type <> 'N'").drop("type", "status")


def _pairs_sql(condition: str) -> str:
    return f"WITH {ITEMS} SELECT a.doc_id, a.ann_id, b.ann_id AS b_ann_id, a.start, b.start AS b_start FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.type = 'N' AND b.type <> 'N' AND {condition}"


def _pairs(spark: SparkSession, sf_dir: str, kind: str, bucket: int = spans.BUCKET) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return spans.span_join(a, b, kind, bucket=bucket).select("doc_id", "ann_id", "b_ann_id", "start", "b_start")


@query(_pairs_sql("a.start < b.stop AND b.start < a.stop"))
def interval_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir, "overlap")


@query(_pairs_sql("a.start <= b.stop AND b.start <= a.stop"))
def interval_touch(spark, sf_dir):
    return _pairs(spark, sf_dir, "touch", 128)


@query(_pairs_sql("a.start >= b.start AND a.stop <= b.stop"))
def interval_contained(spark, sf_dir):
    return _pairs(spark, sf_dir, "within")


@query(_pairs_sql("a.start <= b.start AND a.stop >= b.stop"))
def interval_covering(spark, sf_dir):
    return _pairs(spark, sf_dir, "covers", 256)


@query(f"WITH {ITEMS}, r AS (SELECT doc_id, ann_id, start // 30 AS start, stop // 30 AS stop, type FROM items) SELECT a.doc_id, a.ann_id, b.ann_id AS b_ann_id FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.start = b.start AND a.stop = b.stop AND a.ann_id < b.ann_id")
def interval_coextensive(spark, sf_dir):
    r = items(spark, sf_dir).select("doc_id", "ann_id", F.expr("start div 30").alias("start"), F.expr("stop div 30").alias("stop"))
    return spans.span_join(r, r, "coextensive").where("ann_id < b_ann_id").select("doc_id", "ann_id", "b_ann_id")


@query(f"WITH {EVENTS} SELECT a.doc_id, a.ann_id, count(*) AS n, CAST(sum(b.ann_id) AS BIGINT) AS others FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.side = 0 AND b.side = 1 AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")
def interval_overlap_bucketed(spark, sf_dir):
    """Five documents with all spans between them: pieces of the time line spread each over many tasks."""
    second = F.unix_timestamp(F.date_trunc("second", F.col("ts"))) - 1704067200
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("doc_id"), F.col("event_id").alias("ann_id"), (F.col("user_id") % 2).alias("side"), second.alias("start"), (second + F.col("user_id") * 60).alias("stop"))
    return spans.overlap_sums(e.where("side = 0"), e.where("side = 1"), bucket=14400).withColumnRenamed("total", "others")


@query(f"WITH {ITEMS} SELECT DISTINCT a.doc_id, a.ann_id, b.ann_id AS b_ann_id FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.type = 'N' AND b.type <> 'N' AND ((b.start >= a.start AND b.stop <= a.stop) OR (b.start <= a.start AND b.stop >= a.stop))")
def contained_or_covering(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return spans.contained_or_covering(a, b).select("doc_id", "ann_id", "b_ann_id")


def _exists_sql(condition: str, negate: str = "") -> str:
    return f"WITH {ITEMS} SELECT doc_id, ann_id, start, stop FROM items a WHERE type = 'N' AND {negate} EXISTS (SELECT 1 FROM items b WHERE a.doc_id = b.doc_id AND b.type <> 'N' AND {condition})"


@query(_exists_sql("a.start < b.stop AND b.start < a.stop"))
def span_filter_semi(spark, sf_dir):
    """Keep spans that overlap one of the other side (found names, gold mentions)."""
    return spans.matched(*sides(spark, sf_dir))


@query(_exists_sql("a.start < b.stop AND b.start < a.stop", "NOT"))
def span_filter_anti(spark, sf_dir):
    """Drop spans under a date, an address or a link."""
    return spans.matched(*sides(spark, sf_dir), keep=False)


@query(_exists_sql("a.start >= b.start AND a.stop <= b.stop", "NOT"))
def span_filter_not_inside(spark, sf_dir):
    return spans.matched(*sides(spark, sf_dir), kind="within", keep=False)


@query(f"WITH {ITEMS} SELECT a.doc_id, a.ann_id, arg_min(b.status, (b.start, b.status)) AS entity_type FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.type = 'N' AND b.type <> 'N' AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")
def span_entity_type(spark, sf_dir):
    i = items(spark, sf_dir)
    a, b = i.where("type = 'N'").drop("type", "status"), i.where("type <> 'N'").drop("type").withColumnRenamed("status", "type")
    return spans.with_entity_type(a, b).select("doc_id", "ann_id", "entity_type")


@query(f"WITH {ITEMS} SELECT doc_id, ann_id FROM items a WHERE NOT EXISTS (SELECT 1 FROM items b WHERE a.doc_id = b.doc_id AND b.start <= a.start AND b.stop >= a.stop AND (b.stop - b.start > a.stop - a.start OR b.ann_id < a.ann_id))")
def remove_contained(spark, sf_dir):
    return spans.drop_contained(items(spark, sf_dir)).select("doc_id", "ann_id")


@query(f"WITH {ITEMS}, r AS (SELECT doc_id, ann_id, start // 90 AS start, stop // 90 AS stop, type FROM items) SELECT doc_id, ann_id FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, start, stop ORDER BY type, ann_id) = 1")
def coextensive_dedupe(spark, sf_dir):
    r = items(spark, sf_dir).withColumns({"start": F.expr("start div 90"), "stop": F.expr("stop div 90")})
    return spans.one_per_extent(r, "type").select("doc_id", "ann_id")


@query(f"WITH {ITEMS} SELECT doc_id, ann_id, stop - start AS length FROM items WHERE stop - start > 100")
def span_length_filter(spark, sf_dir):
    return spans.longer_than(items(spark, sf_dir), 100).select("doc_id", "ann_id", (F.col("stop") - F.col("start")).alias("length"))


@query(f"WITH {ITEMS} SELECT a.doc_id, a.ann_id FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.start <= b.start AND a.stop >= b.stop WHERE a.type = 'N' GROUP BY ALL HAVING bool_or(b.status = 'F')")
def pos_filter_boolor(spark, sf_dir):
    """Spans that hold a token of the wanted class."""
    i = items(spark, sf_dir)
    return spans.with_proper_noun(i.where("type = 'N'"), i, F.col("status") == "F").select("doc_id", "ann_id")


@query(f"""WITH {ITEMS}, j AS (SELECT a.doc_id, a.ann_id, CASE WHEN bool_or(b.type = 'A') THEN 'returned' WHEN bool_or(b.type = 'R') THEN 'refused' END AS why FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.type = 'N' AND b.type IN ('A', 'R') AND a.start < b.stop AND b.start < a.stop GROUP BY ALL)
  SELECT coalesce(j.why, 'kept') AS deleted_because, count(*) AS n FROM items i LEFT JOIN j USING (doc_id, ann_id) WHERE i.type = 'N' GROUP BY ALL""")
def audit_trail(spark, sf_dir):
    """Filters that mark in place of dropping: how many spans each reason took."""
    i = items(spark, sf_dir)
    n = i.where("type = 'N'")
    for flag, why in (("A", "returned"), ("R", "refused")):
        n = spans.mark(n, spans.matched(n, i.where(F.col("type") == flag)), why)
    return n.groupBy(F.coalesce("deleted_because", F.lit("kept")).alias("deleted_because")).agg(F.count("*").alias("n"))


TEXTS = "(VALUES (1, 'on the old New York Times and the the Bay Area office'), (2, 'Berlin Wall Museum')) AS t(doc_id, text)"
NESTED = "(VALUES (1, 1, 11, 19), (1, 2, 11, 25), (1, 3, 3, 14), (1, 4, 34, 46), (1, 5, 38, 53), (2, 1, 0, 11), (2, 2, 7, 18)) AS t(doc_id, ann_id, start, stop)"


@example("SELECT * FROM (VALUES (1, 2), (1, 5), (2, 1)) AS t(doc_id, ann_id)")
def filter_overlapping(spark, sf_dir):
    """Contained spans go; of partly overlapping ones the later, or the earlier if only an article leads to the later."""
    return spans.resolve_overlaps(inline(spark, NESTED).where("not (doc_id = 1 and ann_id = 3)"), inline(spark, TEXTS)).select("doc_id", "ann_id")


@query(f"""WITH {ITEMS}, w AS (SELECT a.doc_id, a.ann_id, count(*) AS n FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.start <= b.start AND a.stop >= b.stop GROUP BY ALL),
  long AS (SELECT i.* FROM items i JOIN w USING (doc_id, ann_id) WHERE type = 'R' AND n >= 2) SELECT i.doc_id, i.ann_id FROM items i JOIN w USING (doc_id, ann_id) WHERE type = 'N' AND NOT (w.n < 2 AND EXISTS (SELECT 1 FROM long l WHERE l.doc_id = i.doc_id AND l.start <= i.start AND l.stop >= i.stop AND l.stop - l.start > i.stop - i.start))""")
def person_part_filter(spark, sf_dir):
    i = items(spark, sf_dir)
    return spans.drop_parts_of_persons(i.where("type = 'N'"), i.where("type = 'R'"), i.withColumn("kind", F.lit("word"))).select("doc_id", "ann_id")


@query(f"WITH {ITEMS} SELECT doc_id, ann_id FROM items WHERE type <> 'A' OR status <> 'F'")
def unknown_filter(spark, sf_dir):
    """Names that only the rule for unknown ones found go."""
    i = items(spark, sf_dir).select("doc_id", "ann_id", F.when(F.col("type") == "A", "Person").otherwise("Date").alias("type"), F.when(F.col("status") == "F", "Unknown").alias("rule"))
    return spans.drop_unknown(i).select("doc_id", "ann_id")


@query(f"WITH {ITEMS} SELECT 'all' AS aset, type, count(*) AS n FROM items GROUP BY ALL UNION ALL SELECT 'copy', type, count(*) FROM items WHERE type = 'A' GROUP BY ALL UNION ALL SELECT 'moved', type, count(*) FROM items WHERE type = 'R' GROUP BY ALL")
def set_transfer(spark, sf_dir):
    """Copy one type to another set, move another type, delete a third set."""
    i = items(spark, sf_dir)
    a = i.select(F.col("doc_id"), F.lit("all").alias("aset"), "ann_id", "type", "start", "stop", F.create_map().cast("map<string,string>").alias("features"))
    a = model.transfer(model.transfer(a, "all", "copy", "A"), "all", "tmp", "R", move=True)
    a = model.transfer(model.transfer(a, "tmp", "moved"), "tmp", "all")
    return model.reset(a, "tmp").groupBy("aset", "type").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT a.doc_id, a.ann_id AS a, b.ann_id AS b, min(abs(a.start - b.start)) AS dist FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.ann_id <> b.ann_id AND abs(a.start - b.start) <= 50 GROUP BY ALL")
def entity_distance(spark, sf_dir):
    i = items(spark, sf_dir).select("doc_id", F.col("ann_id").alias("entity_id"), "start")
    return entities.proximal(i, 50, bucket=64)


@query(f"""WITH {ITEMS}, k AS (SELECT *, status AS inst FROM items WHERE type = 'N'), r AS (SELECT *, status AS inst FROM items WHERE type = 'R'),
  p AS (SELECT k.doc_id, k.ann_id AS ka, r.ann_id AS ra, k.start AS ks, r.start AS rs, CASE WHEN k.start = r.start AND k.stop = r.stop AND k.inst = r.inst THEN 0 WHEN k.inst = r.inst THEN 1 WHEN k.start = r.start AND k.stop = r.stop THEN 2 ELSE 3 END AS g FROM k JOIN r ON k.doc_id = r.doc_id AND k.start < r.stop AND r.start < k.stop),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ka ORDER BY g, rs, ra) AS kn, row_number() OVER (PARTITION BY doc_id, ra ORDER BY g, ks, ka) AS rn FROM p), m AS (SELECT * FROM b WHERE kn = 1 AND rn = 1),
  o AS (SELECT CASE g WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'incorrect' END AS outcome FROM m UNION ALL SELECT 'missing' FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = k.doc_id AND m.ka = k.ann_id) UNION ALL SELECT 'spurious' FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id AND m.ra = r.ann_id))
  SELECT outcome, count(*) AS n FROM o GROUP BY ALL""")
def eval_strict_lenient(spark, sf_dir):
    i = items(spark, sf_dir).withColumnRenamed("status", "inst")
    return evaluation.pair_up(i.where("type = 'N'").drop("type"), i.where("type = 'R'").drop("type")).groupBy("outcome").agg(F.count("*").alias("n"))


PREDICTED = "p AS (SELECT l.quality AS k, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS r, d.lang FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {PREDICTED}, o AS (SELECT lang, CASE WHEN k = 1 AND r = 1 THEN 'correct' WHEN k = 1 THEN 'missing' WHEN r = 1 THEN 'spurious' END AS o FROM p), g AS (SELECT lang, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'missing') AS missing, count(*) FILTER (o = 'spurious') AS spurious FROM o WHERE o IS NOT NULL GROUP BY ROLLUP (lang)),
  q AS (SELECT *, round(CASE WHEN correct + spurious > 0 THEN correct / (correct + spurious) ELSE 0 END, 6) AS p_strict, round(CASE WHEN correct + missing > 0 THEN correct / (correct + missing) ELSE 0 END, 6) AS r_strict FROM g)
  SELECT coalesce(lang, 'all') AS lang, correct, missing, spurious, p_strict, r_strict, round(CASE WHEN p_strict + r_strict > 0 THEN 2 * p_strict * r_strict / (p_strict + r_strict) ELSE 0 END, 6) AS f_strict FROM q""")
def eval_prf_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).alias("r"))
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("k"))  # noqa: E741
    o = d.join(l, "doc_id").select("lang", F.when(F.col("k") & F.col("r"), "correct").when(F.col("k"), "missing").when(F.col("r"), "spurious").alias("outcome")).where("outcome is not null")
    return evaluation.scores(o, "lang").select(F.coalesce("lang", F.lit("all")).alias("lang"), "correct", "missing", "spurious", "p_strict", "r_strict", "f_strict")


@query(f"""WITH {ITEMS}, c AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS mention_id, l_suppkey % 5 AS inst FROM lineitem),
  k AS (SELECT i.*, (i.doc_id + i.ann_id) % 5 AS inst FROM items i WHERE type = 'N') SELECT found, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM items m JOIN c ON c.doc_id = m.doc_id AND c.mention_id = m.ann_id WHERE m.doc_id = k.doc_id AND m.start < k.stop AND k.start < m.stop AND c.inst = k.inst) AS found FROM k) GROUP BY ALL""")
def eval_max_recall(spark, sf_dir):
    from pyspark.sql import Window

    i = items(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("mention_id"), (F.col("l_suppkey") % 5).alias("inst"))
    k = i.where("type = 'N'").withColumn("inst", (F.col("doc_id") + F.col("ann_id")) % 5)
    return evaluation.max_recall(k, i.withColumnRenamed("ann_id", "mention_id"), c).groupBy("found").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, a AS (SELECT doc_id, start // 60 AS start, type FROM items), b AS (SELECT doc_id, start // 60 AS start, CASE WHEN doc_id % 10 = 0 THEN 'X' ELSE type END AS type FROM items WHERE ann_id < 6),
  x AS (SELECT *, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.start, y.start) AS start, coalesce(x.type, y.type) AS type, coalesce(x.n, 0) - coalesce(y.n, 0) AS d FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.start = y.start AND x.type = y.type)
  SELECT doc_id, start, type, CASE WHEN d > 0 THEN 'reference' ELSE 'response' END AS side, abs(d) AS n FROM j WHERE d <> 0""")
def diff_ref_resp(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("start", F.expr("start div 60"))
    b = i.where("ann_id < 6").withColumn("type", F.when(F.col("doc_id") % 10 == 0, "X").otherwise(F.col("type")))
    return evaluation.differences(i.select("doc_id", "start", "type"), b.select("doc_id", "start", "type"))


@query(f"WITH {ITEMS} SELECT a.type, CASE WHEN a.status = b.status THEN 'true' ELSE 'false' END AS class, count(*) AS n FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.type <> 'N' AND b.type = 'N' AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")
def training_instances(spark, sf_dir):
    i = items(spark, sf_dir).withColumnRenamed("status", "inst")
    return entities.training_instances(i.where("type = 'N'"), i.where("type <> 'N'")).groupBy("type", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, c AS (SELECT *, CASE WHEN type = 'N' AND status = 'O' THEN 'Person' WHEN type = 'N' THEN 'Other' ELSE '' END AS mapped FROM items), e AS (SELECT *, CASE WHEN type = 'A' THEN 'Person' ELSE 'Location' END AS kind FROM items WHERE type <> 'N'),
  j AS (SELECT c.doc_id, c.ann_id, c.mapped, bool_or(e.kind = c.mapped) AS same FROM c LEFT JOIN e ON c.doc_id = e.doc_id AND c.start < e.stop AND e.start < c.stop WHERE c.type = 'N' GROUP BY ALL)
  SELECT mapped AS mapped_type, coalesce(CASE WHEN mapped = 'Other' THEN 'unknown' WHEN same THEN 'match' WHEN NOT same THEN 'mismatch' END, 'none') AS nm_overlap, count(*) AS n FROM j GROUP BY ALL""")
def ner_class_match(spark, sf_dir):
    i = items(spark, sf_dir)
    classes = F.when(F.col("status") == "O", F.array(F.lit("dbpo:Person"))).otherwise(F.array(F.lit("dbpo:Thing")))
    c = i.where("type = 'N'").withColumn("mapped_type", entities.mapped_type(classes, {"Person": ["dbpo:Person"], "Location": ["dbpo:Place"]}))
    e = i.where("type <> 'N'").withColumn("type", F.when(F.col("type") == "A", "PERSON").otherwise("Location"))
    out = entities.class_match(c.drop("type", "status"), e)
    return out.groupBy("mapped_type", F.coalesce("nm_overlap", F.lit("none")).alias("nm_overlap")).agg(F.count("*").alias("n"))
