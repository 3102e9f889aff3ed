"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if it is set in over half the hashes.
Two fingerprints link at `DISTANCE` or fewer differing bits, and a component is what links reach.

Search: with at most 2 differing bits, at least two of four 16-bit blocks are equal, so pairs meet in one of six
tables keyed by two blocks. In a key, fingerprints are sorted by their distance to the first pivot; a pair whose
distances to any pivot differ by more than `DISTANCE` can't be near (triangle inequality) and is discarded, and the
survivors are verified by XOR. Keys with over `HOT_KEY` distinct fingerprints are cut again, by two of four bytes of
the other 32 bits, which leaves at most 2**16 fingerprints to a key. Only links of a spanning forest leave a key.

`near_groups` finds near copies by the similarity of their shingle sets (SIMILARITY and more), of which fingerprints of 64
bits are too coarse a measure. Texts meet on the KEYS least hashes of their shingles (two texts of similarity 0.8 share
none with a chance of 0.2 ** KEYS, three in a million); pivot tables and fingerprints discard pairs, and so does the similarity of sketches of
the SKETCH least hashes. It decides only where both texts have no more shingles than that; else it is an estimate, MARGIN
is asked of it, and survivors are verified on their whole shingle sets. First a spanning forest of each key is verified;
where one of its links is refuted, so is every pair of the key's linked texts that the verified links leave apart.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a class, and rows that share a doc_id but not the
text are apart; an empty table gives no rows. Only doc_id and text are read, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import connected_components, keep_rows, stash, tune, unstash

DISTANCE = 2
SHINGLE = 3
SEED = 42
HOT_KEY = 4096
#: Similarity of shingle sets; least hashes on which texts meet, by which hot keys are cut, and on which texts are compared; bits that near
#: copies differ in at most.
SIMILARITY, KEYS, CUTS, SKETCH, BITS = 0.8, 8, 16, 160, 28
#: How far under the similarity asked for an estimate may be: 4.7 standard deviations of one from SKETCH hashes at 0.8.
MARGIN = 0.15
#: A hash that more sketches have comes after all others in the prefixes of sketches.
COMMON = 256
#: Reference fingerprints: fixed pseudo-random numbers, the same in every run.
PIVOTS = np.random.default_rng(20240501).integers(0, 2**64, 12, dtype=np.uint64)


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)


def fingerprint(h: np.ndarray) -> int:
    """The 64-bit majority of the hashes, unsigned."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(hashes(t, shingle)) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, docs.select("doc_id").schema.add("fp", "long"))


def near_pairs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, root) among rows of equal key; rows in any order, fingerprints of a key distinct."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    root = np.arange(len(fp))
    live = np.arange(len(fp))
    step = 0

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while len(live):
        step += 1
        live = live[live + step < len(fp)]
        other = live + step
        near = (key[live] == key[other]) & (table[other, 0] - table[live, 0] <= distance)
        live, other = live[near], other[near]
        ok = np.ones(len(live), bool)
        for p in range(1, table.shape[1]):
            i = np.flatnonzero(ok)
            if not len(i):
                break
            ok[i] = np.abs(table[live[i], p] - table[other[i], p]) <= distance
        i, j = live[ok], other[ok]
        true = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (root[i] != root[j])
        for a, b in zip(i[true].tolist(), j[true].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if true.any():
            while (flat := root[root]).tobytes() != root.tobytes():
                root = flat
    moved = np.flatnonzero(root != np.arange(len(root)))
    return order[moved], order[root[moved]]


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """classes (cls, fp), fp distinct -> spanning links (a, b) between classes within the distance."""
    if distance > 2:
        raise ValueError("four blocks with two equal hold for a distance of 2 at most")
    block = lambda i, bits: F.shiftrightunsigned("fp", i * bits).bitwiseAND((1 << bits) - 1)
    pairs = list(combinations(range(4), 2))
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(block(j, 16), 16).bitwiseOR(block(i, 16)).alias("k")) for t, (i, j) in enumerate(pairs)])
    rows = classes.select("cls", "fp", F.explode(tables).alias("x")).select("cls", "fp", "x.t", "x.k", F.lit(0).alias("s"), F.lit(0).cast("long").alias("k2"))
    size = stash(rows.groupBy("t", "k").agg(F.count("*").alias("m")).where("m > 1"), "table-sizes")
    rows = rows.join(size, ["t", "k"])
    small, hot = rows.where(f"m <= {HOT_KEY}"), rows.where(f"m > {HOT_KEY}")
    # the two blocks that table t leaves free, as one 32-bit number, then two of its four bytes
    free = [[b for b in range(4) if b not in p] for p in pairs]
    rest = F.element_at(F.array(*[F.shiftleft(block(q[1], 16), 16).bitwiseOR(block(q[0], 16)) for q in free]), F.col("t") + 1)
    byte = lambda i: F.shiftrightunsigned("rest", 8 * i).bitwiseAND(255)
    again = F.array(*[F.struct(F.lit(s + 1).alias("s"), F.shiftleft(byte(j), 8).bitwiseOR(byte(i)).alias("k2")) for s, (i, j) in enumerate(pairs)])
    hot = hot.withColumn("rest", rest).select("cls", "fp", "t", "k", F.explode(again).alias("y")).select("cls", "fp", "t", "k", "y.s", "y.k2")
    rows = small.select("cls", "fp", "t", "k", "s", "k2").unionByName(hot).select("cls", "fp", F.xxhash64("t", "k", "s", "k2").alias("key"))

    def work(b: pd.DataFrame) -> pd.DataFrame:
        cls = b["cls"].to_numpy()
        i, j = near_pairs(b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64), distance)
        return pd.DataFrame({"a": cls[i], "b": cls[j]})

    return by_key(rows, work, ["fp"], "a long, b long").distinct()


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (doc_id, fp) -> doc_id, fp, component_id (the smallest doc_id reachable)."""
    prints = stash(prints, "simhash")
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("cls")), "simhash-classes")
    roots = connected_components(links(classes, distance))
    known = classes.join(roots, F.col("cls") == F.col("node"), "left").select("fp", F.coalesce("root", "cls").alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, n (distinct shingles), k (hash of the whole set), keys (least hashes), sketch (upper halves of
    the least hashes, ascending)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
                h = np.unique(hashes(text, shingle))
                fp = fingerprint(h)  # of the set, as the similarity is
                least = h[:SKETCH] if len(h) else np.zeros(1, np.uint64)
                rows.append((doc, th, fp, len(h), xxhash.xxh64_intdigest(h.tobytes(), SEED), least[:CUTS].view(np.int64).tolist(), (least >> np.uint64(32)).astype("<u4").tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "th", "fp", "n", "k", "keys", "sketch"])
            yield out.assign(**{c: out[c].to_numpy(np.uint64).view(np.int64) for c in ("fp", "k")})

    tune(docs.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select("doc_id").schema)
    return docs.select("doc_id", text_hash().alias("th"), "text").mapInPandas(run, f"{schema}, th long, fp long, n int, k long, keys array<long>, sketch binary")


NONE = np.uint32(0xFFFFFFFF)


def grid(blobs: list[bytes]) -> np.ndarray:
    """Sketches as rows of one array, filled up with NONE."""
    lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    out = np.full((len(blobs), SKETCH), NONE, np.uint32)
    out[np.arange(SKETCH)[None, :] < lens[:, None]] = np.minimum(np.frombuffer(b"".join(blobs), "<u4"), NONE - np.uint32(1))
    return out


def jaccard(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of the sets behind rows of sketches: exact where both are held whole, else over the hashes that both hold."""
    top = np.minimum(np.where(nx > SKETCH, x[:, -1], NONE - np.uint32(1)), np.where(ny > SKETCH, y[:, -1], NONE - np.uint32(1)))
    z = np.sort(np.concatenate([x, y], axis=1), axis=1)
    inside = z <= top[:, None]
    both = ((z[:, 1:] == z[:, :-1]) & inside[:, 1:]).sum(axis=1)
    return both / np.maximum(1, inside.sum(axis=1) - both)


def similar_pairs(key: np.ndarray, fp: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of equal key whose sets are similar, or may be where a sketch doesn't hold them whole; rows in any order.

    A spanning forest, of likely pairs as far as they go; with apart every pair whose rows differ in it.
    """
    order = np.lexsort((n, key))
    key, fp, n, sketch = key[order], fp[order], n[order], sketch[order]
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    root = np.arange(len(fp)) if apart is None else apart[order]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for margin in (0, MARGIN) if apart is None else (MARGIN,):
        live, step = np.arange(len(fp)), 0
        while len(live):
            step += 1
            live = live[live + step < len(fp)]
            # sorted by size, so what is too large now is so from here on
            live = live[(key[live] == key[live + step]) & (n[live] >= similarity * n[live + step])]
            i = live[root[live] != root[live + step]]
            i = i[np.abs(table[i] - table[i + step]).max(axis=1, initial=0) <= BITS]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= BITS]
            for at in range(0, len(i), 4_000):
                a = i[at : at + 4_000]
                # n grows with the row, so the second set is the larger one
                x = a[jaccard(sketch[a], n[a], sketch[a + step], n[a + step]) >= similarity - np.where(n[a + step] > SKETCH, margin, 0)]
                if apart is None:
                    new = []
                    for y in x.tolist():
                        p, q = find(y), find(y + step)
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            new.append(y)
                    x = np.array(new, np.int64)
                pairs.append((x, x + step))
            if len(i) and apart is None:
                while (flat := root[root]).tobytes() != root.tobytes():
                    root = flat
            if step % 64 == 0 and len(live):  # a key whose rows are all linked has nothing left to find
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                whole = np.minimum.reduceat(root, cut) == np.maximum.reduceat(root, cut)
                live = live[~np.repeat(whole, np.diff(np.append(cut, len(key))))[live]]
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return order[i], order[j]


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float, written: list[DataFrame]) -> DataFrame:
    """pairs (a, b) of cls -> a, b, alike: whether their whole shingle sets are similar. Only texts of pairs are fetched."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep.doc_id", "rep.th"), "cls"), "pair-ids")
    written.append(ids)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("th")).join(ids, ["doc_id", "th"])
    texts = stash(texts.groupBy("cls").agg(F.first("text").alias("text")), "pair-texts")
    written.append(texts)
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alike = []
            for s, t in zip(b["text_a"], b["text_b"], strict=True):
                x, y = np.unique(hashes(s, shingle)), np.unique(hashes(t, shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield b[["a", "b"]].assign(alike=np.array(alike, bool))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, alike boolean")


def by_key(rows: DataFrame, work, columns: list[str], schema: str) -> DataFrame:
    """work(rows of whole keys) -> rows of the schema; rows are dealt and sorted by key, keys are never cut."""
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("cls", "key", *columns).repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            last = b["key"].iloc[-1] if len(b) else None
            if len(b) and b["key"].iloc[0] != last:  # a key ended in this batch: all before the last key is whole
                cut = int(np.searchsorted(b["key"].to_numpy(), last))
                yield work(pd.concat([*rest, b.iloc[:cut]]))
                rest = [b.iloc[cut:]]
            elif len(b):
                if rest and rest[-1]["key"].iloc[-1] != last:
                    yield work(pd.concat(rest))
                    rest = []
                rest.append(b)
        if rest:
            yield work(pd.concat(rest))

    return rows.mapInPandas(run, schema)


def shared(rows: DataFrame, written: list[DataFrame]) -> DataFrame:
    """Rows whose key others have too, with their number m."""
    # written, so that the join deals both sides anew and adaptive execution can cut a hot key's partition
    written.append(stash(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key-sizes"))
    return rows.join(written[-1], "key")


def block_pairs(rows: DataFrame) -> DataFrame:
    """rows (cls, key, m) -> cls, key: the texts of a key are dealt to blocks, and any two blocks meet as a key of their own, so
    every pair still meets and no key holds many more than HOT_KEY / 2 texts."""
    blocks = F.ceil(F.col("m") * 4 / HOT_KEY).cast("int")
    dealt = rows.withColumn("blocks", F.greatest(blocks, F.lit(2))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    return met.select("cls", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"))


def prefixes(classes: DataFrame, similarity: float, written: list[DataFrame]) -> DataFrame:
    """classes (cls, n, sketch) -> cls, key: of each sketch so many hashes, those that few sketches have first, that any two which
    `similar_pairs` takes have one in common.

    It asks that sketches have `least` hashes in common, so the first common one, in any order of all hashes, comes before a sketch's last least - 1.
    """
    most = math.ceil((similarity - MARGIN) * SKETCH - 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(np.frombuffer(x, "<u4")).astype(np.int64).tolist() for x in b["sketch"]]
            least = [min(math.ceil(similarity * n - 1e-9), most) for n in b["n"].tolist()]
            # upper halves may be equal; then one more for each
            take = [2 * (len(x) // 4) - len(y) - m + 1 for x, y, m in zip(b["sketch"], sets, least, strict=True)]
            yield pd.DataFrame({"cls": b["cls"], "take": take, "hs": sets})

    sets = stash(classes.select("cls", "n", "sketch").mapInPandas(run, "cls long, take int, hs array<long>"), "hot-sketches")
    each = sets.select("cls", F.explode("hs").alias("h"))
    common = stash(each.groupBy("h").agg(F.count("*").alias("f")).where(f"f > {COMMON}"), "common-hashes")
    written += [sets, common]
    often = each.join(common, "h").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "h")))["h"].alias("often"))  # at most SKETCH
    often_ = F.coalesce("often", F.array().cast("array<long>"))
    order = F.concat(F.array_except("hs", often_), often_)
    return sets.join(often, "cls", "left").select("cls", F.explode(F.slice(order, F.lit(1), F.col("take"))).alias("h")).select("cls", F.xxhash64("h").alias("key"))


def hot_keys(hot: DataFrame, classes: DataFrame, similarity: float, written: list[DataFrame]) -> DataFrame:
    """hot (cls, key), keys of over HOT_KEY texts -> cls, key: no key holds many more, and similar texts of a key still meet.

    Texts meet on the prefixes of their sketches instead, which loses nothing. Where a hash of a text's prefix is one that over HOT_KEY prefixes
    have (near copies of many texts), the text stays in its keys, which are cut by bands of their size: a text goes to its own and the
    next band, and two texts of similar size have one in common, so nothing is lost. What is still larger is cut by each other of
    the CUTS least hashes of a text: two texts of similarity 0.8 that meet there have none other in common with a chance of 0.2 ** 15, far below
    that of not meeting at all. What is larger even then is cut into blocks of which any two meet, which loses nothing.
    """
    ids = stash(hot.select("cls").distinct(), "hot-texts")
    written.append(ids)
    first = stash(shared(prefixes(classes.join(ids, "cls", "left_semi"), similarity, written), written), "prefix-keys")
    written.append(first)
    out, many = first.where(f"m <= {HOT_KEY}").select("cls", "key"), first.where(f"m > {HOT_KEY}").select("cls").distinct()
    if many.isEmpty():
        return out
    left = hot.join(many, "cls", "left_semi").join(classes.select("cls", "n", "keys"), "cls")
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.01 / similarity))).cast("int")
    banded = shared(left.withColumn("band", F.explode(F.array(band, band + 1))).select("cls", "keys", F.col("key").alias("of"), F.xxhash64("key", "band").alias("key")), written)
    banded = stash(banded, "banded-keys")
    written.append(banded)
    out = out.unionByName(banded.where(f"m <= {HOT_KEY}").select("cls", "key"))
    still = banded.where(f"m > {HOT_KEY}")
    if still.isEmpty():
        return out
    cut = shared(still.withColumn("other", F.explode(F.filter("keys", lambda k: k != F.col("of")))).select("cls", F.xxhash64("key", "other").alias("key")), written)
    return out.unionByName(cut.where(f"m <= {HOT_KEY}").select("cls", "key")).unionByName(block_pairs(cut.where(f"m > {HOT_KEY}")))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (hash of the text), component_id (the smallest doc_id reachable by similarities of `similarity` and more) and kept (in one text
    of each component) of every row of docs.

    Keys of over HOT_KEY texts go through `hot_keys`.
    """
    same = ["k", "fp", "n"]  # texts of one set, by its hash beside fingerprint and size
    written: list[DataFrame] = []
    keep = lambda df, name: written.append(stash(df, name)) or written[-1]
    prints = keep(sketches(docs, shingle), "sketches")
    classes = prints.groupBy(*same).agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = keep(classes.withColumn("cls", F.monotonically_increasing_id()), "sketch-classes")
    # keys are counted and cut without the sketches, which then go only where two texts meet
    met = keep(shared(classes.select("cls", F.explode(F.slice("keys", 1, KEYS)).alias("key")), written), "met")
    hot = met.where(f"m > {HOT_KEY}").select("cls", "key")
    met = met.where(f"m <= {HOT_KEY}").select("cls", "key")
    if not hot.isEmpty():
        met = met.unionByName(hot_keys(hot, classes, similarity, written))
    # a frame of its own, so no one plan holds all that cuts keys
    met = keep(met, "met")
    held = ["fp", "n", "sketch"]

    def work(b: pd.DataFrame) -> pd.DataFrame:
        cls, key, n = (b[c].to_numpy() for c in ("cls", "key", "n"))
        apart = b["root"].to_numpy() if "root" in b else None
        i, j = similar_pairs(key, b["fp"].to_numpy().view(np.uint64), n, grid(b["sketch"].tolist()), similarity, apart)
        return pd.DataFrame({"key": key[i], "a": np.minimum(cls[i], cls[j]), "b": np.maximum(cls[i], cls[j]), "whole": np.maximum(n[i], n[j]) <= SKETCH})

    schema = "key long, a long, b long, whole boolean"
    forest = keep(by_key(met.join(classes.select("cls", *held), "cls"), work, held, schema), "forest")
    checked = keep(verified(forest.where("not whole").select("a", "b").distinct(), classes, docs, shingle, similarity, written), "checked")
    sure = forest.where("whole").select("a", "b").unionByName(checked.where("alike").select("a", "b")).distinct()
    roots = connected_components(sure)
    refuted = checked.where("not alike").select("a", "b")
    if not refuted.isEmpty():
        # where a link of a key's forest fails, the texts it held together may be linked by others
        keys = forest.where("not whole").join(refuted, ["a", "b"]).select("key").distinct()
        left = forest.join(keys, "key").select("key", F.explode(F.array("a", "b")).alias("cls")).distinct()
        left = left.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
        more = keep(by_key(left.join(classes.select("cls", *held), "cls"), work, [*held, "root"], schema).select("a", "b", "whole").distinct(), "more-pairs")
        again = verified(more.where("not whole").select("a", "b").join(refuted, ["a", "b"], "left_anti"), classes, docs, shingle, similarity, written)
        first_roots, roots = roots, connected_components(sure.unionByName(more.where("whole").select("a", "b")).unionByName(again.where("alike").select("a", "b")))
        unstash(first_roots)
    known = keep(classes.join(roots, F.col("cls") == F.col("node"), "left").select(*same, "rep", F.coalesce("root", "cls").alias("root")), "near-classes")
    first = keep(known.groupBy("root").agg(F.min("rep").alias("first")), "near-firsts")
    known = keep(known.join(first, "root").select(*same, "first"), "near-classes")
    out = prints.join(known, same)
    out = stash(out.select("doc_id", "th", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("first")).alias("kept")), "near-groups")
    unstash(*written, roots)
    return out


def keep_distinct(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id. Columns as in docs."""
    groups = near_groups(docs, shingle, similarity)
    kept = stash(groups.where("kept").groupBy("doc_id", F.col("th").alias("mark")).agg(F.count("*").alias("copies")), "kept-texts")
    unstash(groups)
    return keep_rows(docs, kept, text_hash())


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    out = components(fingerprints(docs))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

