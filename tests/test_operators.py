"""Operators that SQL can't express, sources, sinks and streams, by hand-made cases and brute force."""

import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia import model
from marginalia.functions import text as X
from marginalia.operators import candidates, entities, evaluation, gazetteer, graph, learning, negation, rules, spans, tagging, tokens
from marginalia.plans.pipeline import Plan, Step
from marginalia.sources import corpora, dictionaries, messages, sinks
from marginalia.streaming import documents as streams

TEXT = "Mr. Smith paid 3/4 of 12 to the Word company (on 7.5). Then 'it' ended!"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_tiles_rebuild_the_text(spark):
    texts = [TEXT, "", "ünï çödé\n\t🙂🙂 x", "a" * 3000, None]
    got = tokens.tokenize(docs(spark, *texts)).orderBy("doc_id", "tok_no").collect()
    for i, t in enumerate(texts, 1):
        mine = [r for r in got if r.doc_id == i]
        assert "".join(r.string for r in mine) == (t or "")
        assert all(t[r.start : r.stop] == r.string for r in mine)


def test_sentences(spark):
    s = tokens.sentences(tokens.tokenize(docs(spark, "Mr. Smith left at 7.5. He ran! Why? .....\n\nNew paragraph", ""))).orderBy("sent_no").collect()
    assert [r.string for r in s] == ["Mr. Smith left at 7.5.", "He ran!", "Why?", ".....", "New paragraph"]


def spans_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ann_id long, start int, stop int")


RELATIONS = [(0, 10), (0, 5), (5, 10), (3, 7), (10, 12), (12, 15), (0, 0), (10, 10), (9, 11), (0, 12), (2, 2)]


@pytest.mark.parametrize("kind", ["overlap", "touch", "within", "covers", "coextensive"])
@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_all_interval_relations(spark, kind, bucket):
    r = random.Random(3)
    a = [(1, i, s, e) for i, (s, e) in enumerate(RELATIONS)] + [(2, i, s, s + r.randint(0, 9)) for i, s in enumerate(r.choices(range(40), k=20))]
    b = [(1, i, s, e) for i, (s, e) in enumerate(RELATIONS)] + [(2, i, s, s + r.randint(0, 9)) for i, s in enumerate(r.choices(range(40), k=20))] + [(3, 1, 0, 9)]
    test = {"overlap": lambda x, y: x[2] < y[3] and y[2] < x[3], "touch": lambda x, y: x[2] <= y[3] and y[2] <= x[3], "within": lambda x, y: x[2] >= y[2] and x[3] <= y[3], "covers": lambda x, y: x[2] <= y[2] and x[3] >= y[3], "coextensive": lambda x, y: x[2:] == y[2:]}[kind]
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and test(x, y))
    fa, fb = spans_frame(spark, a), spans_frame(spark, b)
    assert sorted(tuple(r) for r in spans.span_join(fa, fb, kind, bucket=bucket).select("doc_id", "ann_id", "b_ann_id").collect()) == want
    hit = {(d, i) for d, i, _ in want}
    assert {(r.doc_id, r.ann_id) for r in spans.matched(fa, fb, kind, bucket=bucket).collect()} == hit
    assert {(r.doc_id, r.ann_id) for r in spans.matched(fa, fb, kind, keep=False, bucket=bucket).collect()} == {x[:2] for x in a} - hit
    left = spans.span_join(fa, fb, kind, "left", bucket=bucket)
    assert left.count() == len(want) + len({x[:2] for x in a} - hit)


def test_interval_join_shuffles_on_pieces_and_has_no_cross_join(spark):
    fa = spans_frame(spark, [(1, 1, 0, 5)])
    plan = spans.span_join(fa, fa)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rule_file_preferences(spark):
    parsed = rules.parse_rules('num=[0-9]+\n|(<<num>>)\n1 => Int v=$1\n|<<num>>/<<num>>\n0 => Fraction k="c"\n|[A-Z]\\w+\n|Word\n0 => Upper\n|Word\n0 => Last\n')
    assert [r.pattern for r in parsed] == ["([0-9]+)", "[0-9]+/[0-9]+", "[A-Z]\\w+|Word", "Word"]
    d = docs(spark, TEXT, None, "")
    at = lambda pref, over=False: sorted((r.start, r.stop, r.type) for r in rules.annotate(d, parsed, pref, over).collect())
    longest = at("LONGEST_LASTRULE")
    assert (15, 18, "Fraction") in longest and (15, 16, "Int") not in longest
    word = TEXT.index("Word")
    assert (word, word + 4, "Last") in longest and (word, word + 4, "Upper") in at("LONGEST_FIRSTRULE")
    assert {t for s, _, t in at("LONGEST_ALLRULES") if s == word} == {"Upper", "Last"}
    assert (15, 16, "Int") in at("FIRSTRULE")
    assert len(at("ALL")) > len(longest) and len(at("ALL", True)) > len(at("ALL"))
    one = rules.annotate(d, parsed).where("type = 'Fraction'").first()
    assert one.features == {"k": "c"}
    with pytest.raises(ValueError):
        rules.annotate(d, parsed, "NONE")


def test_found_strings_have_offsets(spark):
    text = "Dr Bell saw Dr Bell. Mount Etna and Mount Etna"
    d = docs(spark, text, None, "", "12,7;300 ü4")
    got = rules.entity_spans(d).collect()
    assert all(text[r.start : r.stop] == r.string for r in got)
    assert sorted(r.start for r in got if r.type == "Person") == [0, 12]
    for t, i in ((text, 1), ("12,7;300 ü4", 4)):
        want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+|Etna", t)]
        assert [(r.start, r.stop, r.string) for r in rules.find_spans(d, "text", "[0-9]+|Etna").where(F.col("doc_id") == i).orderBy("match_no").collect()] == want


def test_control_styles(spark):
    f = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 9, 2), (1, 3, 6, 1), (1, 9, 11, 1), (2, 4, 5, 1)], "doc_id long, start int, stop int, rule int")
    pick = lambda style: sorted((r.doc_id, r.start, r.stop) for r in rules.control(f, style, "rule").collect())
    assert pick("all") == sorted([(1, 0, 5), (1, 0, 9), (1, 3, 6), (1, 9, 11), (2, 4, 5)])
    assert pick("appelt") == [(1, 0, 9), (1, 9, 11), (2, 4, 5)]
    assert pick("once") == [(1, 0, 5), (2, 4, 5)]
    assert pick("first") == [(1, 0, 5), (1, 3, 6), (1, 9, 11), (2, 4, 5)]


def test_matches_anywhere(spark):
    d = docs(spark, "The word and theatre", None)
    words = ["the", "theatre", "rd an", "he"]
    got = sorted((r.start, r.norm) for r in gazetteer.match_anywhere(d, words, longest_only=False).collect())
    low = "The word and theatre".upper()
    want = sorted((m.start(), w.upper()) for w in words for m in re.finditer(f"(?={re.escape(w.upper())})", low))
    assert got == want
    longest = sorted((r.start, r.norm) for r in gazetteer.match_anywhere(d, words).collect())
    assert (13, "THEATRE") in longest and (13, "THE") not in longest
    with pytest.raises(ValueError):
        gazetteer.match_anywhere(d, words, most=2)


def test_chunk_may_not_be_crossed(spark):
    t = tokens.sentence_numbers(tokens.tokenize(docs(spark, "New. York")))
    d = spark.createDataFrame([("NEW .", 2), (". YORK", 2), ("YORK", 1)], "norm string, n int")
    assert {r.norm for r in gazetteer.match(t, d, 2, chunk="sent_no").collect()} == {"YORK"}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.def").write_text("a.lst:loc:city:en:Place\nb.lst.gz:per\n")
    (tmp_path / "a.lst").write_text("Bonn\tinst=b\tx=1\n\nRome\n")
    with gzip.open(tmp_path / "b.lst.gz", "wt") as f:
        f.write("Ann\tinst=a\n")
    got = {(r.entry, r.ann_type, r.features.get("inst")) for r in dictionaries.read_lists(spark, f"{tmp_path}/d.def").collect()}
    assert got == {("Bonn", "Place", "b"), ("Rome", "Place", None), ("Ann", "Lookup", "a")}
    bad = spark.createDataFrame([("x\tnothing",)], "value string")
    with pytest.raises(Exception, match="no feature=value"):
        dictionaries.parse_list(bad).collect()
    assert dictionaries.parse_yaml("lists:\n- listFile: a.lst\n  majorType: 'x'\n- listFile: b.lst # c\n") == [{"listFile": "a.lst", "majorType": "x"}, {"listFile": "b.lst"}]
    (tmp_path / "idx.tsv").write_text("# no\n// no\na\tb\nc\nd\te\n")
    assert sorted(tuple(r) for r in dictionaries.read_delimited_index(spark, f"{tmp_path}/idx.tsv", ["x", "y"]).collect()) == [("a", "b"), ("d", "e")]


def test_hashtags_and_chunks(spark):
    assert tagging.split_hashtag("savethewhales", frozenset(["save", "the", "whales", "sa", "vet", "hew"])) == ["save", "the", "whales"]
    assert tagging.split_hashtag("sooo", frozenset(["so"])) == ["sooo"]
    assert tagging.split_hashtag("BigNews", frozenset()) == ["Big", "News"]
    t = spark.createDataFrame([(1, 0, i, w, g) for i, (w, g) in enumerate([("the", "DT"), ("dog", "NN"), ("barks", "VBZ"), ("it", "PRP")])], "doc_id long, sent_no long, tok_no int, string string, tag string")
    got = [r.chunk for r in tagging.chunk_nouns(t, ["I O P=PRP", "O B W=barks T=I:-1", "I X T=Z:-1"]).orderBy("tok_no").collect()]
    assert got == ["X", "I", "B", "O"]


def test_chains_in_order(spark):
    s = spark.createDataFrame([(1, 1, 0, 10, ["a", "b"]), (1, 2, 5, 12, ["b"]), (1, 3, 11, 20, ["x", "y"]), (1, 4, 30, 40, []), (2, 9, 0, 5, ["q"])], "doc_id long, entity_id long, start int, stop int, insts array<string>")
    got = {(r.doc_id, r.entity_id): r.final_id for r in entities.resolve_chains(s).collect()}
    assert got == {(1, 1): 1, (1, 2): None, (1, 3): 3, (1, 4): 4, (2, 9): 9}


def test_graph_golden(spark):
    e = spark.createDataFrame([("u1", "u2", 22), ("u1", "u3", 23), ("u2", "u3", 24), ("u2", "u4", 23)], "src string, dst string, cnt int")
    p = spark.createDataFrame([("u1", "u2"), ("u1", "u3"), ("u1", "u4"), ("u3", "u2")], "a string, b string")
    get = lambda f, c: {(r.a, r.b): r[c] for r in f(p, e).collect()}
    assert get(graph.direct, "direct") == {("u1", "u2"): 22, ("u1", "u3"): 23, ("u1", "u4"): 0, ("u3", "u2"): 0}
    assert get(graph.shared_parent, "shared_parent")[("u3", "u2")] == 45
    assert get(graph.sequence, "sequence")[("u1", "u3")] == 46
    assert get(graph.shared_child, "shared_child")[("u1", "u2")] == 47
    near = p.select(F.lit(1).alias("doc_id"), F.col("a").alias("entity_id"), F.col("a").alias("inst"), F.col("b").alias("other_entity_id"), F.col("b").alias("other_inst"), F.when(F.col("b") == "u4", 9).otherwise(0).alias("dist"))
    far = {r.inst: r.uni_direct for r in graph.structural(near, e, last_only=True).collect()}
    assert far["u1"] == 0.0
    assert {r.inst: r.uni_direct for r in graph.structural(near, e).collect()}["u1"] == 45.0


def test_page_rank_personalised(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], "src string, dst string, cnt int")
    r = {x.node: x["rank"] for x in graph.page_rank(e, 20, start=spark.createDataFrame([("c", 1.0)], "node string, weight double")).collect()}
    assert abs(r["c"] - 0.15) < 1e-9 and r["a"] > r["b"] > 0


def test_pairing_is_one_to_one(spark):
    k = spark.createDataFrame([(1, 1, 0, 5, "x"), (1, 2, 6, 9, "y"), (1, 3, 20, 22, "z")], "doc_id long, ann_id long, start int, stop int, inst string")
    r = spark.createDataFrame([(1, 1, 0, 5, "x"), (1, 2, 0, 8, "y"), (1, 3, 40, 41, "q")], "doc_id long, ann_id long, start int, stop int, inst string")
    got = sorted(((x.key_id, x.response_id, x.outcome) for x in evaluation.pair_up(k, r).collect()), key=str)
    assert got == sorted([(1, 1, "correct"), (2, 2, "partial"), (3, None, "missing"), (None, 3, "spurious")], key=str)


def test_classifier_learns(spark):
    r = random.Random(1)
    rows = [(x := r.random(), r.choice("ab"), "true" if x > 0.5 else "false") for _ in range(400)] + [(None, None, "false")]
    df = spark.createDataFrame(rows, "sc_x double, nm_k string, class string")
    got = learning.apply(learning.fit(df, rounds=80), df.withColumnRenamed("class", "truth")).collect()
    assert sum(g["class"] == g.truth for g in got) / len(got) > 0.95 and all(0.5 <= g.confidence <= 1 for g in got)
    assert learning.feature_names(["scA", "rnXRank", "nmB", "sc_x", "x"]) == (["scA", "rnXRank", "sc_x"], ["nmB"])


def test_negation_scope_stops_at_terminations(spark):
    t = spark.createDataFrame([(1, 0, 0, 2, "negation", "Negated", False)], "doc_id long, sent_no long, start int, stop int, kind string, value string, pseudo boolean")
    e = spark.createDataFrame([(1, 0, 10, 13)], "doc_id long, sent_no long, start int, stop int")
    s = spark.createDataFrame([(1, 0, 30)], "doc_id long, sent_no long, stop int")
    c = spark.createDataFrame([(1, 0, 1, 4, 8), (1, 0, 2, 15, 20)], "doc_id long, sent_no long, ann_id long, start int, stop int")
    assert [r.negation for r in negation.tag(c, t, e, s).orderBy("ann_id").collect()] == ["Negated", "Affirmed"]


def test_messages(spark, tmp_path):
    js = [{"id_str": "1", "text": "a &lt; b", "user": {"screen_name": "x"}, "entities": {"hashtags": [{"indices": [0, 1], "text": "t"}]}}, {"id_str": "2", "text": "c"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, js)))
    (tmp_path / "a.json").write_text(json.dumps(js))
    (tmp_path / "s.json").write_text(json.dumps({"search_metadata": {}, "statuses": js}))
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, js)))
    for name, shape in (("l.json", "lines"), ("a.json", "array"), ("s.json", "search"), ("z.json.gz", "lines")):
        got = messages.read(spark, f"{tmp_path}/{name}", shape)
        assert sorted((r.id_str, r.text) for r in got.collect()) == [("1", "a &lt; b"), ("2", "c")], name
        assert [(r.type, r.start, r.stop) for r in messages.entities(got).collect()] == [("hashtags", 0, 1)]
    m = spark.createDataFrame([(i, f"t{i}") for i in range(1, 8)], "o int, text string")
    assert [(r.doc_name, r.text.split("\n")) for r in messages.documents_of(m, 3, "n", "o").orderBy("doc_name").collect()] == [("n_000000", ["t1", "t2"]), ("n_000001", ["t3", "t4", "t5"]), ("n_000002", ["t6", "t7"])]


def test_directory_and_saving(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, t in (("a.txt", "één"), ("b.xml", "<x/>"), ("c.md", "no"), ("sub/d.txt", "deep")):
        (tmp_path / "in" / n).write_text(t, encoding="utf-8")
    flat = corpora.directory(spark, f"{tmp_path}/in", ["txt", ".xml"])
    assert sorted(r.text for r in flat.collect()) == ["<x/>", "één"]
    assert corpora.directory(spark, f"{tmp_path}/in", ["txt"], recurse=True).count() == 2
    assert corpora.subset(flat, F.col("text").contains("n")).count() == 1
    assert corpora.subset(flat, flat.where("text = '<x/>'")).count() == 1
    corpora.save(flat.withColumn("lang", F.lit("fr")), f"{tmp_path}/out", ["lang"])
    assert spark.read.parquet(f"{tmp_path}/out").where("lang = 'fr'").count() == 2


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    corpora.save_jdbc(d, url, "docs", **options)
    assert sorted(tuple(r) for r in corpora.jdbc(spark, url, "docs", **options).collect()) == [("a", "x"), ("b", "y")]
    assert corpora.jdbc(spark, url, "docs", query='SELECT * FROM docs WHERE "name" LIKE \'a\'', **options).count() == 1


def test_sinks(spark, tmp_path):
    d = docs(spark, "a < b & c", "none", None)
    m = spark.createDataFrame([(1, 0, 1, "i"), (1, 0, 3, "longer"), (1, 2, 5, "j"), (1, 8, 9, None)], "doc_id long, start int, stop int, inst string")
    xml = {r.doc_id: r.xml for r in sinks.inline_xml(d, m).collect()}
    assert xml[1] == '<Mention inst="longer">a &lt;</Mention> b &amp; <Mention inst="">c</Mention>' and xml[2] == "none"
    assert sinks.response_xml(sinks.inline_xml(d, m)).where("doc_id = 2").first().xml == "<response><text>none</text><msg></msg><status>ok</status></response>"
    unit = spark.createDataFrame([(1, 7, 2, 9)], "doc_id long, ann_id long, start int, stop int")
    got = sinks.covered_json(m.where("inst = 'j'").withColumn("type", F.lit("M")), unit, d).first()
    assert got.doc_id == "1:7" and json.loads(got.json) == {"text": "< b & c", "entities": {"M": [{"indices": [0, 3]}]}}
    assert sinks.arff_header("r", ["x"], {"k": ["a", "b"]})[1:3] == ["@attribute x numeric", "@attribute k {a,b}"]
    sinks.write_tsv(m, f"{tmp_path}/t")
    assert spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/t").count() == 4
    sinks.write_lines(d.where("text is not null"), f"{tmp_path}/l", "text")
    assert spark.read.text(f"{tmp_path}/l").count() == 2


def test_stream_is_the_batch(spark, tmp_path):
    d = docs(spark, "one two. three", "four", "five six")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    steps = lambda df: tokens.sentences(tokens.tokenize(df))
    streams.annotate_stream(stream, steps, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "sent_no", "string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps(d).select("doc_id", "sent_no", "string").collect()))


def test_model_round_trip(spark):
    s = spark.createDataFrame([(1, 5, 9, "x"), (1, 5, 12, "y"), (1, 0, 3, None)], "doc_id long, start int, stop int, inst string")
    a = model.to_annotations(model.number(s, "inst"), "A", "Lookup", "inst")
    assert a.columns == [c.split()[0] for c in model.ANNOTATIONS.split(", ")]
    back = model.from_annotations(a, "A", "Lookup", features=("inst",))
    assert sorted((r.ann_id, r.start, r.stop) for r in back.collect()) == [(1, 0, 3), (2, 5, 12), (3, 5, 9)]
    box = spark.createDataFrame([(1, 4, 10)], "doc_id long, start int, stop int")
    moved = model.transfer(a, "A", "B", "Lookup", move=True, inside=box)
    assert sorted((r.aset, r.start, r.stop) for r in moved.collect()) == [("A", 0, 3), ("A", 5, 12), ("B", 5, 9)]
    assert model.reset(moved, "A").count() == 1


def test_plan_configuration(spark):
    p = Plan((Step("a", lambda df, n: df.withColumn("n", F.lit(n)), params={"n": 1}), Step("b", lambda df: df.where("false"))))
    got = p.configure({"prrun": {"b": ("lang", "fr")}, "prparm": {"a.n": 5}}).run(spark.createDataFrame([("fr",), ("en",), (None,)], "lang string"))
    assert sorted((str(r.lang), r.n) for r in got.collect()) == [("None", 5), ("en", 5)]
    with pytest.raises(KeyError):
        p.configure({"prrun": {"c": "never"}})


def test_name_match_is_null_safe(spark):
    df = spark.createDataFrame([("a b", None), ("", ""), ("ab", "Alpha Beta")], "a string, b string")
    assert [r[0] for r in df.select(X.name_match(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))).collect()] == [0.0, 0.0, 0.5]


def test_blocked_classes_by_default(spark):
    c = spark.createDataFrame([("a", "dbpo:Person|dbpo:Work"), ("b", "dbpo:Place"), ("c", None)], "inst string, airp_specific string")
    assert sorted(r.inst for r in candidates.drop_blocked(c).collect()) == ["a", "b", "c"]
    d = spark.createDataFrame([("a", "dbpo:Agent|dbpo:Building"), ("b", "dbpo:Place|dbpo:Animal")], "inst string, airp_specific string")
    assert [r.inst for r in candidates.drop_blocked(d).collect()] == ["a"]
