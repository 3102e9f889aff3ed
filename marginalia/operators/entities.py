"""Entities: chains of mentions that name one thing; their distances, pooled candidates and agreement with other annotators."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.spans import BUCKET, matched, span_join

FAR = 1_000_000


def build(mentions: DataFrame, chains: DataFrame) -> DataFrame:
    """entity_id of each mention: its chain (doc_id, chain_id, start, stop) where its extent is unique, else its own (-mention_id)."""
    unique = mentions.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "start", "stop"))).where("_n = 1")
    hit = unique.join(chains, ["doc_id", "start", "stop"]).groupBy("doc_id", "mention_id").agg(F.min("chain_id").alias("chain_id"))
    return mentions.join(hit, ["doc_id", "mention_id"], "left").withColumn("entity_id", F.coalesce("chain_id", -F.col("mention_id"))).drop("chain_id")


def longest_spans(mentions: DataFrame, n: int) -> DataFrame:
    """The n longest mentions of each entity; the earlier of equal ones."""
    w = Window.partitionBy("doc_id", "entity_id").orderBy(F.desc(F.length("string")), "start", "mention_id")
    return mentions.withColumn("span_rank", F.row_number().over(w)).where(F.col("span_rank") <= n)


def wordiest_span(mentions: DataFrame) -> DataFrame:
    """The mention of each entity with the most words."""
    w = Window.partitionBy("doc_id", "entity_id").orderBy(F.desc(F.size(F.split("string", " "))), "start", "mention_id")
    return mentions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pool_candidates(mentions: DataFrame, cands: DataFrame, n: int = 3, delete: bool = True) -> DataFrame:
    """Each mention of an entity gets the candidates of the entity's n longest mentions; its others are deleted or flagged."""
    ruling = longest_spans(mentions, n).select("doc_id", "entity_id", "mention_id")
    pooled = cands.join(ruling, ["doc_id", "mention_id"]).groupBy("doc_id", "entity_id", "inst").agg(F.min("label").alias("label"))
    every = mentions.select("doc_id", "entity_id", "mention_id").join(pooled, ["doc_id", "entity_id"]).select("doc_id", "mention_id", "inst", "label")
    if delete:
        return every
    own = cands.select("doc_id", "mention_id", "inst", "label")
    other = own.join(every, ["doc_id", "mention_id", "inst"], "left_anti").withColumn("flagged", F.lit(True))
    return every.withColumn("flagged", F.lit(False)).unionByName(other)


def resolve_chains(spans: DataFrame) -> DataFrame:
    """spans (doc_id, entity_id, start, stop, insts array) -> doc_id, entity_id, start, stop, final_id (null: dropped).

    Overlapping spans of two entities, in order: with a shared inst the entities merge (smaller id), otherwise the span
    with fewer candidates goes (of equals the first). Depends on the order, so it runs document by document.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "stop", "entity_id"], kind="stable").reset_index(drop=True)
        final = {e: e for e in g["entity_id"]}

        def find(e: int) -> int:
            while final[e] != e:
                e = final[e]
            return e

        alive = [True] * len(g)
        rows = list(g.itertuples(index=False))
        open_: list[int] = []
        for j, b in enumerate(rows):
            open_ = [i for i in open_ if alive[i] and rows[i].stop > b.start]
            for i in open_:
                a = rows[i]
                if not (alive[i] and alive[j]) or find(a.entity_id) == find(b.entity_id):
                    continue
                if set(a.insts) & set(b.insts):
                    x, y = sorted((find(a.entity_id), find(b.entity_id)))
                    final[y] = x
                elif len(a.insts) <= len(b.insts):
                    alive[i] = False
                else:
                    alive[j] = False
            open_.append(j)
        g["final_id"] = pd.array([find(e) if ok else None for e, ok in zip(g["entity_id"], alive, strict=True)], dtype="Int64")
        return g[["doc_id", "entity_id", "start", "stop", "final_id"]]

    return spans.groupBy("doc_id").applyInPandas(run, "doc_id long, entity_id long, start int, stop int, final_id long")


def proximal(entities: DataFrame, within: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs of entities of a document whose mentions start at most `within` apart: doc_id, a, b, dist (both ways)."""
    m = entities.select("doc_id", F.col("entity_id").alias("a"), F.col("start").alias("s"))
    near = max(bucket, within + 1)
    left = m.withColumn("_p", F.explode(F.expr(f"sequence(greatest(s - {within}, 0) div {near}, (s + {within}) div {near})")))
    right = m.select("doc_id", F.col("a").alias("b"), F.col("s").alias("t"), F.expr(f"s div {near}").alias("_p"))
    pairs = left.join(right, ["doc_id", "_p"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("s") - F.col("t")) <= within))
    return pairs.groupBy("doc_id", "a", "b").agg(F.min(F.abs(F.col("s") - F.col("t"))).alias("dist"))


def expansion_of(mentions: DataFrame, expansions: DataFrame) -> DataFrame:
    """Text of the one expansion that covers a mention: of a hashtag, else a link, else a user id; expansions (doc_id, start, stop, kind, text)."""
    rank = F.when(F.col("b_kind") == "hashtag", 0).when(F.col("b_kind") == "url", 1).otherwise(2)
    hit = span_join(mentions, expansions, "within").groupBy(*mentions.columns).agg(F.min(F.struct(rank.alias("r"), F.col("b_text").alias("t")))["t"].alias("expansion"))
    return mentions.join(hit.select("doc_id", "mention_id", "expansion"), ["doc_id", "mention_id"], "left")


def in_original(mentions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mentions inside the original text (sizes: doc_id, size), before what expansions appended."""
    return mentions.join(sizes, "doc_id").where(F.col("stop") <= F.col("size")).select(*mentions.columns)


def share_inst(a: Column, b: Column) -> Column:
    """Whether two lists of insts have one in common; a missing list has none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def of_keys_only(entities: DataFrame, keys: DataFrame, switch: DataFrame) -> DataFrame:
    """In the documents of switch (doc_id) only entities that overlap a gold mention stay; in others all do."""
    on = entities.join(switch.select("doc_id").distinct(), "doc_id", "left_semi")
    off = entities.join(switch.select("doc_id").distinct(), "doc_id", "left_anti")
    return off.unionByName(matched(on, keys, "overlap").select(*off.columns))


def append_expansions(docs: DataFrame, mentions: DataFrame, cache: DataFrame, gap: str = "\n") -> tuple[DataFrame, DataFrame]:
    """Texts with what is known of their mentions after them, and where: (docs, spans of doc_id, mention_id, start, stop).

    mentions (doc_id, mention_id, start, kind, key), cache (kind, key, text). Expansions follow in the order of the
    mentions, each after a gap; a mention that the cache lacks has none. The original text keeps its offsets.
    """
    known = mentions.join(cache.groupBy("kind", "key").agg(F.min("text").alias("more")), ["kind", "key"])
    lists = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "mention_id", "more"))).alias("_m"))
    longer = docs.join(lists, "doc_id", "left")
    text = F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(gap), F.array_join(F.transform("_m", lambda x: x["more"]), gap)))
    before = lambda i: F.aggregate(F.slice("_m", F.lit(1), i), F.length("text"), lambda n, x: n + len(gap) + F.length(x["more"]))
    places = F.transform("_m", lambda x, i: F.struct(x["mention_id"].alias("mention_id"), (before(i) + len(gap)).alias("start"), (before(i) + len(gap) + F.length(x["more"])).alias("stop")))
    spans = longer.where("_m is not null").select("doc_id", F.explode(places).alias("p")).select("doc_id", "p.*")
    return longer.withColumn("text", text).select(*docs.columns), spans


def mapped_type(classes: Column, groups: dict[str, Sequence[str]]) -> Column:
    """The first group (in order: Person, Location, Organization, ...) with one of the classes; else Other."""
    out = F.lit("Other")
    for name, members in reversed(list(groups.items())):
        out = F.when(F.arrays_overlap(classes, F.lit(list(members))), name).otherwise(out)
    return out


def class_match(cands: DataFrame, found: DataFrame) -> DataFrame:
    """nm_overlap and nm_exact: match, mismatch, unknown (candidate of type Other) or null (no entity there).

    cands: spans with ann_id and mapped_type; found: entities (start, stop, type).
    """
    kind = F.initcap(F.lower("type"))
    f = found.select("doc_id", "start", "stop", kind.alias("type")).where("type in ('Person', 'Location', 'Organization')")
    exact = (F.col("b_start") == F.col("start")) & (F.col("b_stop") == F.col("stop"))
    same = F.col("b_type") == F.col("mapped_type")
    seen = span_join(cands, f, "overlap").groupBy("doc_id", "ann_id").agg(F.max(same).alias("near_same"), F.max(F.when(exact, same)).alias("exact_same"))
    j = cands.join(seen, ["doc_id", "ann_id"], "left")
    say = lambda c: F.when(F.col("mapped_type") == "Other", "unknown").when(F.col(c), "match").when(~F.col(c), "mismatch")
    return j.withColumns({"nm_overlap": say("near_same"), "nm_exact": say("exact_same")}).drop("near_same", "exact_same")


def training_instances(keys: DataFrame, cands: DataFrame, exact_only: bool = False) -> DataFrame:
    """Candidates that overlap a gold mention, with class true or false by equality of inst."""
    pairs = span_join(cands, keys.select("doc_id", "start", "stop", "inst"), "coextensive" if exact_only else "overlap")
    return pairs.withColumn("class", F.when(F.col("inst") == F.col("b_inst"), "true").otherwise("false"))
