"""Link counts of a directed weighted graph for given pairs, relatedness, structural similarity, page rank.

edges (src, dst, cnt), one row for each (src, dst). Only the pairs asked for are built: two-step paths start from the
pairs' own edges, never from all of the graph's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.model import cut_lineage

LINKS_TOTAL = 1e7


def load(spark, path: str) -> DataFrame:
    """Edges from tab-separated files (from, to, count), also compressed ones."""
    raw = spark.read.csv(path, sep="\t", schema="src string, dst string, cnt int")
    return raw.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum("cnt").cast("int").alias("cnt"))


def direct(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with direct: the count of a -> b, or 0."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cnt").cast("long").alias("direct"))
    return pairs.join(e, ["a", "b"], "left").withColumn("direct", F.coalesce("direct", F.lit(0)))


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, out: str) -> DataFrame:
    """Sum of both counts over all x with (a, x) in left and (b, x) in right."""
    p = pairs.select("a", "b").distinct()
    left = left.join(p.select("a").distinct(), "a", "left_semi")
    right = right.join(p.select("b").distinct(), "b", "left_semi")
    sums = p.join(left, "a").join(right, ["b", "x"]).groupBy("a", "b").agg(F.sum(F.col("w1") + F.col("w2")).cast("long").alias(out))
    return pairs.join(sums, ["a", "b"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def _side(edges: DataFrame, node: str, own: str, w: str) -> DataFrame:
    other = "dst" if node == "src" else "src"
    return edges.select(F.col(node).alias(own), F.col(other).alias("x"), F.col("cnt").alias(w))


def shared_parent(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of both links from every node that links to a and to b."""
    return _meet(pairs, _side(edges, "dst", "a", "w1"), _side(edges, "dst", "b", "w2"), "shared_parent")


def shared_child(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return _meet(pairs, _side(edges, "src", "a", "w1"), _side(edges, "src", "b", "w2"), "shared_child")


def sequence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of both links of every path a -> x -> b."""
    return _meet(pairs, _side(edges, "src", "a", "w1"), _side(edges, "dst", "b", "w2"), "sequence")


def structural(pairs: DataFrame, edges: DataFrame, last_only: bool = False) -> DataFrame:
    """Structural similarity of candidates: pairs (doc_id, entity_id, inst, other_entity_id, other_inst, dist).

    Counts are divided by the distance (1 at least) and summed over the candidates of all near entities; last_only
    takes those of the farthest entity alone. Returns doc_id, entity_id, inst and the sums.
    """
    named = pairs.where("inst <> other_inst").withColumns({"a": F.col("inst"), "b": F.col("other_inst")})
    if last_only:
        far = named.groupBy("doc_id", "entity_id").agg(F.max(F.struct("dist", "other_entity_id"))["other_entity_id"].alias("other_entity_id"))
        named = named.join(far, ["doc_id", "entity_id", "other_entity_id"], "left_semi")
    p = named.select("a", "b").distinct()
    both = sequence(shared_child(shared_parent(direct(p, edges), edges), edges), edges)
    back = sequence(direct(p.select(F.col("b").alias("a"), F.col("a").alias("b")), edges), edges)
    back = back.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("direct").alias("direct_back"), F.col("sequence").alias("sequence_back"))
    scored = named.join(both.join(back, ["a", "b"]), ["a", "b"])
    per = lambda c: F.round(F.sum(c / F.greatest(F.col("dist"), F.lit(1))), 6)
    out = scored.groupBy("doc_id", "entity_id", "inst").agg(
        per(F.col("direct")).alias("uni_direct"), per(F.col("direct") + F.col("direct_back")).alias("bi_direct"),
        per(F.col("shared_parent")).alias("shared_parent"), per(F.col("shared_child")).alias("shared_child"),
        per(F.col("sequence")).alias("uni_indirect"), per(F.col("sequence") + F.col("sequence_back")).alias("bi_indirect"),
    )
    return out.withColumn("combined", F.round(F.expr("bi_direct + 0.25 * (bi_indirect + shared_parent + shared_child)"), 6))


def link_relatedness(pairs: DataFrame, inlinks: DataFrame, total: float = LINKS_TOTAL) -> DataFrame:
    """Normalised link distance of pairs (a, b) from inlinks (inst, src): (ln max - ln both) / (ln total - ln min); 0 without common links."""
    links = inlinks.distinct()
    size = links.groupBy("inst").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").distinct()
    both = p.join(links.select(F.col("inst").alias("a"), "src"), "a").join(links.select(F.col("inst").alias("b"), "src"), ["b", "src"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    j = both.join(size.select(F.col("inst").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("inst").alias("b"), F.col("n").alias("nb")), "b")
    value = (F.log(F.greatest("na", "nb")) - F.log("both")) / (F.log(F.lit(total)) - F.log(F.least("na", "nb")))
    return pairs.join(j.select("a", "b", value.alias("relatedness")), ["a", "b"], "left").withColumn("relatedness", F.round(F.coalesce("relatedness", F.lit(0.0)), 6))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, start: DataFrame | None = None, every: int = 5) -> DataFrame:
    """node, rank after a fixed number of rounds; start (node, weight): the personalised form.

    Each round is one join and one aggregation; every few rounds the ranks go to the checkpoint folder, if one is set.
    Nodes without links out pass nothing on.
    """
    out = edges.groupBy("src").agg(F.sum("cnt").alias("total"))
    share = edges.join(out, "src").select("src", "dst", (F.col("cnt") / F.col("total")).alias("p"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    weights = nodes.withColumn("w", F.lit(1.0)) if start is None else nodes.join(start.select("node", F.col("weight").alias("w")), "node", "left").fillna(0.0, ["w"])
    total = weights.agg(F.sum("w")).first()[0]
    if not total:
        return nodes.withColumn("rank", F.lit(0.0))
    base = weights.withColumn("w", F.col("w") / total)
    rank = base.withColumnRenamed("w", "rank")
    for i in range(rounds):
        got = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("in"))
        rank = base.join(got, base["node"] == got["dst"], "left").select("node", ((1 - damping) * F.col("w") + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if (i + 1) % every == 0 and i + 1 < rounds:
            rank = cut_lineage(rank)
    return rank
