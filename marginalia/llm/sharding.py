"""Balanced label propagation: documents to shards, linked documents together, counts at most one apart.

Nodes are distinct texts with their numbers of copies. Two nodes are neighbours if they share the least or the largest hash
of their five-word shingles (near copies mostly do), and the copies of a text are neighbours of each other. A node's
state is (node, shard, cnt), several rows for a text that is spread over several shards.

Nodes with neighbours are laid over the shards, side by side by least hash. Then, round by round, each link's histogram of
shards is joined to its nodes, a node's votes for each shard are summed up, and half of the nodes (another half each
time) move to the shard with most of their neighbours, if it has more of them than their own and its quota has room. It
ends when nothing moves. Documents without neighbours fill what is left, so the law `rows` holds exactly.

Null texts count as empty; repeated rows are separate documents; an empty table gives no rows. A text with more copies than
a shard has places is spread over as few shards as hold it. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bits_for, positions, stash, unstash
from marginalia.llm.fingerprints import let, shingle_hashes, word_hashes


def _cases(values: list[int], pos: str):
    """Index of the first cumulative value above pos: a literal array of one number per shard."""
    total, ends = 0, []
    for v in values:
        total += v
        ends.append(total)
    return F.expr(f"size(filter(array({','.join(f'{e}L' for e in ends)}), e -> e <= {pos}))")


def link_keys(text: Column) -> Column:
    """Least and largest shingle hash of a text; none of a text without words."""
    return let(word_hashes(text), lambda h: let(shingle_hashes(h), lambda s: F.filter(F.array(F.array_min(s), F.array_max(s)), lambda k: k.isNotNull())))


def links_between(nodes: DataFrame) -> DataFrame:
    """nodes (node, cnt, keys) -> (node, key): the keys that two nodes have, and a key of its own for a node with copies."""
    every = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    size = stash(every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "link-keys")
    own = nodes.where("cnt > 1").select("node", F.xxhash64("node", F.lit("copies")).alias("key"))
    return every.join(size, "key").select("node", "key").unionByName(own)


def lay_out(nodes: DataFrame, shards: int, quota: int) -> DataFrame:
    """nodes (node, cnt, first) -> (node, shard, cnt): side by side in the order of `first`, no shard over quota.

    A text that fills shards takes those at the end; what is left of it and the others lie evenly over the rest. What does
    not fit (fewer documents than shards) is left out.
    """
    giants = nodes.where(F.col("cnt") > quota).orderBy("node").select("node", "cnt").collect() if quota else []  # fewer than shards
    full = [(g.node, g.cnt // quota, g.cnt % quota) for g in giants]
    left = shards - sum(k for _, k, _ in full)
    filled, s = [], left
    for node, k, _ in full:
        filled += [(node, s + i, quota) for i in range(k)]
        s += k
    rest = nodes
    for node, _, more in full:
        rest = rest.withColumn("cnt", F.when(F.col("node") == node, F.lit(more).cast("long")).otherwise(F.col("cnt")))
    rest = rest.where("cnt > 0")
    total = min(rest.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0], left * quota)
    state = nodes.sparkSession.createDataFrame(filled, "node long, shard int, cnt long")
    if not total:
        return state
    at = positions(rest, [], F.xxhash64("first"), ["first", "node"], bits_for(total), "start", F.col("cnt")).where(f"start < {total}")
    at = at.withColumn("cnt", F.least("cnt", F.lit(total) - F.col("start")))
    shard_of = lambda x: F.expr(f"cast(({x}) * {left} div {total} as int)")
    edge = lambda s: f"cast((({s}) * {total} + {left - 1}) div {left} as long)"  # noqa: E731  first position of a shard
    parts = at.select("node", "start", "cnt", F.explode(F.sequence(shard_of("start"), shard_of("start + cnt - 1"))).alias("shard"))
    held = F.least(F.col("start") + F.col("cnt"), F.expr(edge("shard + 1"))) - F.greatest(F.col("start"), F.expr(edge("shard")))
    return state.unionByName(parts.select("node", "shard", held.alias("cnt")).where("cnt > 0"))


def histogram(state: DataFrame, links: DataFrame) -> DataFrame:
    """key, shard, held: how many documents of a link each shard has."""
    return links.join(state, "node").groupBy("key", "shard").agg(F.sum("cnt").alias("held"))


def cut_edges(state: DataFrame, links: DataFrame) -> tuple[int, int]:
    """(cut, all) edges, counting for each link those from its documents to one of them in its fullest shard."""
    per = histogram(state, links).groupBy("key").agg((F.sum("held") - F.max("held")).alias("cut"), (F.sum("held") - 1).alias("edges"))
    return tuple(int(x or 0) for x in per.agg(F.sum("cut"), F.sum("edges")).first())


def propagate(state: DataFrame, links: DataFrame, quota: int, shards: int, rounds: int = 8) -> DataFrame:
    """state (node, shard, cnt), links (node, key), both written -> state in which neighbours share shards more; no shard over quota grows."""
    still = 0
    for number in range(rounds):
        load = {r.shard: r.s for r in state.groupBy("shard").agg(F.sum("cnt").alias("s")).collect()}  # one row per shard
        room = F.array(*[F.lit(max(0, quota - load.get(s, 0))).cast("long") for s in range(shards)])
        # shards entries at most for each link, written so that a hot link's nodes can be split over tasks
        held = stash(histogram(state, links).groupBy("key").agg(F.collect_list(F.struct("shard", "held")).alias("h")).where("size(h) > 1"), "link-shards")
        asked = links.join(held, "key").groupBy("node").agg(F.flatten(F.collect_list("h")).alias("h"))  # three links at most
        mine = state.where(F.pmod(F.xxhash64("node", "shard", F.lit(number)), F.lit(2)) == 0).select("node", F.col("shard").alias("own"), "cnt")
        held_by = lambda s: F.aggregate(F.filter("h", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda n, x: n + x["held"])
        votes = mine.join(asked, "node").withColumn("here", F.greatest(held_by(F.col("own")) - F.col("cnt"), F.lit(0)))
        open_ = F.filter(F.array_distinct(F.transform("h", lambda x: x["shard"])), lambda s: (s != F.col("own")) & (F.get(room, s) >= F.col("cnt")))
        other = F.filter(F.transform(open_, lambda s: F.struct(held_by(s).alias("votes"), (-s).alias("minus"))), lambda x: x["votes"] > F.col("here"))
        moves = votes.select("node", "own", "cnt", F.array_max(other).alias("best")).where("best is not null").select("node", "own", "cnt", (-F.col("best.minus")).cast("int").alias("target"))
        moves = positions(moves, ["target"], F.xxhash64("node", "own"), ["node", "own"], bits_for(sum(load.values()), shards), "ahead", F.col("cnt"))
        moves = stash(moves.where(F.col("ahead") + F.col("cnt") <= F.get(room, F.col("target"))).select("node", F.col("own").alias("shard"), "target", "cnt"), "shard-moves")
        unstash(held)
        still = still + 1 if moves.isEmpty() else 0  # each half gets its turn
        if still == 0:
            change = moves.select("node", "shard", (-F.col("cnt")).alias("cnt")).unionByName(moves.select("node", F.col("target").alias("shard"), "cnt"))
            new = stash(state.unionByName(change).groupBy("node", "shard").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"), "shard-state")
            unstash(state)
            state = new
        unstash(moves)
        if still == 2:
            break
    return state


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    body = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("node"), link_keys(body).alias("keys"))
    base = stash(base.withColumn("rnd", F.xxhash64("doc_id", "text_crc32", "size")), "shard-docs")
    nodes = stash(base.groupBy("node").agg(F.count("*").alias("cnt"), F.first("keys").alias("keys")), "shard-nodes")
    links = stash(links_between(nodes), "shard-links")
    first = links.groupBy("node").agg(F.min("key").alias("first"))
    linked = stash(nodes.join(first, "node").select("node", "cnt", "first"), "shard-linked")
    n = base.count()
    hist = propagate(stash(lay_out(linked, shards, n // shards), "shard-state"), links, n // shards, shards)
    whole = stash(hist.groupBy("node").agg(F.count("*").alias("parts"), F.min("shard").alias("one")), "shard-whole")
    columns = ["doc_id", "size", "text_crc32", "rnd", "shard"]
    tagged = stash(base.drop("keys").join(whole, "node", "left"), "shard-tagged")
    # at most 2 * shards texts are split: by the layout, as moves split none; or cut off at its end
    cut = hist.groupBy("node").agg(F.sum("cnt").alias("held")).join(linked, "node").where("held < cnt").select("node")
    several = stash(whole.where("parts > 1").select("node").union(cut).distinct(), "shard-split")
    up = Window.partitionBy("node").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = hist.join(several, "node").withColumn("end", F.sum("cnt").over(up)).select(F.col("node").alias("l"), "shard", "end", (F.col("end") - F.col("cnt")).alias("begin"))
    split = positions(tagged.join(F.broadcast(several), "node"), ["node"], F.col("rnd"), ["doc_id"], bits_for(n), "rank")
    split = split.join(F.broadcast(ranges), F.expr("node = l and rank >= begin and rank < end"), "left").select(*columns)
    others = tagged.join(F.broadcast(several), "node", "left_anti").select(*columns[:4], F.col("one").alias("shard"))
    every = stash(split.unionByName(others), "shard-laid")
    load = {r.shard: r.s for r in hist.groupBy("shard").agg(F.sum("cnt").alias("s")).collect()}
    order = sorted(range(shards), key=lambda s: (-load.get(s, 0), s))
    goal = {s: n // shards + (i < n % shards) for i, s in enumerate(order)}
    need = [goal[s] - load.get(s, 0) for s in range(shards)]
    loose = positions(every.where("shard is null").drop("shard"), [], F.col("rnd"), ["doc_id"], bits_for(n), "rank").withColumn("shard", _cases(need, "rank")).select(*columns)
    every = positions(stash(every.where("shard is not null").unionByName(loose), "shard-placed"), ["shard"], F.col("rnd"), ["doc_id"], bits_for(n, shards), "slot")
    out = stash(every.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shards")
    for used in (base, nodes, links, linked, hist, whole, tagged):
        unstash(used)
    return out
