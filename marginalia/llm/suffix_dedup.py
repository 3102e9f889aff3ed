"""Suffix-array deduplication: bytes covered by a string of `LENGTH` bytes that also starts elsewhere.

1. Equal texts (null: empty) form a class; of a class with copies every byte of a long enough text goes.
2. Every start p of a `LENGTH`-byte window has one anchor: the position with the least hash of its `GRAM` bytes among
   those inside the window (the leftmost of equals). The anchor depends on the window's bytes alone, so equal windows
   have equal anchor hashes, and a run of starts with one anchor is one row (h, rh, cls, lo, hi, m), rh being a hash of
   all the bytes the run's windows cover. An anchor hash of one row repeats nothing; an anchor hash all of whose rows
   are equal in (rh) repeats them whole. Both need no suffix array.
3. The other anchors' distinct runs go to shards by anchor hash, hot anchors to several shards. In a shard a suffix
   array is refined by Larsson-Sadakane doubling in numpy, Kasai's common prefixes mark windows that repeat in the
   shard, and shards that share a hot anchor are merged: the windows of each, as sorted digests of their bytes,
   are searched for in the others' by binary search, range by range. An anchor has as many ranges as shards, so
   neither a shard nor a range grows with the anchor.
   What is found comes back as one row for each distinct run, and only runs that stand once are asked about.

Hashes of 64 bits stand for bytes only together with an equal anchor hash. Windows never cross documents. Repeated
rows are copies of each other; an empty table gives no rows. Only doc_id and text are read, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stash, tune, unstash

LENGTH, GRAM = 200, 64
#: Rows of one anchor in one shard at most (on average); more are dealt to several shards.
HOT_ANCHOR = 512
#: Symbols of 9 bits in one 64-bit key; distance of the positions whose common prefixes are compared in full.
FIRST, STRIDE = 7, 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on, by doubling: of 8 bytes, 16, 32, ..."""
    with np.errstate(over="ignore"):
        n = len(data) - gram + 1
        h = data.astype(np.uint64) + np.uint64(1)
        width = 1
        while width < gram:
            step = min(width, gram - width)
            h = _mix(h[: len(h) - step] * BASE + h[step:])
            width += step
        return h[:n]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, lo, hi, m) of the runs of starts with one anchor: starts lo to hi (inclusive), anchor at m."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h = gram_hashes(data, gram)
    w = length - gram + 1
    # the least value of each window of w hashes by doubling, with its leftmost place
    low, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        low, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        width += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    m = at[first].astype(np.int64)
    return h[m], first, last, m


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order. data: small integers.

    Larsson and Sadakane's refinement: sorted by the first symbols, then each group of equals by the rank of the
    suffix as far on, doubling; groups of one are never touched again. Equals are refined to the end: the bound of
    `common_prefixes` needs whole suffixes in order.
    """
    n = len(data)
    pad = np.concatenate([data.astype(np.uint64), np.zeros(FIRST, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(FIRST):
        key = (key << np.uint64(9)) | pad[i : i + n]
    sa = np.argsort(key)
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]]) if n else np.zeros(0, bool)
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = FIRST
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        s = sa[at]
        far = s + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        both = group[at] * (n + 1) + second
        order = np.argsort(both)
        both = both[order]
        sa[at] = s[order]
        new[at] |= np.concatenate([[True], both[1:] != both[:-1]])
        place = np.flatnonzero(new[at])
        group[at] = np.repeat(at[place], np.diff(np.append(place, len(at))))
        rank[sa[at]] = group[at]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to limit and to the ends of both runs, of each suffix with the one before it in order.

    Kasai's bound, for all at once: a suffix shares with its predecessor at least what the suffix k symbols before
    it shares with its own, less k. So every STRIDE-th position is compared from its start and the others from there.
    """
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate([data.astype(np.uint64), np.zeros(FIRST, np.uint64)])
    packed = np.zeros(n, np.uint64)
    for i in range(FIRST):
        packed = (packed << np.uint64(9)) | pad[i : i + n]
    got = np.zeros(n, np.int64)

    def extend(a: np.ndarray) -> None:
        b = before[a]
        a, b = a[b >= 0], b[b >= 0]
        room = np.minimum(np.minimum(ends[a] - a, ends[b] - b), limit)
        now = np.minimum(got[a], room)
        for width in (FIRST, 1):
            live = np.flatnonzero(now + width <= room)
            while len(live):
                x, y = a[live] + now[live], b[live] + now[live]
                live = live[packed[x] == packed[y] if width > 1 else data[x] == data[y]]
                now[live] += width
                live = live[now[live] + width <= room[live]]
        got[a] = now

    at = np.arange(n)
    base = at[::STRIDE]
    extend(base)
    got = np.maximum(got[base].repeat(STRIDE)[:n] - at % STRIDE, 0)
    extend(at)
    return got[sa]


def repeated_starts(runs: list[bytes], starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For distinct runs (bytes; windows start at 0 to starts[i] - 1 in run i): flags of windows that start twice in the shard."""
    lens = np.fromiter(map(len, runs), np.int64, len(runs))
    total = int(lens.sum()) + len(runs)
    data = np.zeros(total, np.uint16)
    begin = np.cumsum(np.append(0, lens[:-1] + 1))
    flat = np.frombuffer(b"".join(runs), np.uint8)
    inside = np.ones(total, bool)
    inside[begin + lens] = False
    data[inside] = flat.astype(np.uint16) + 1
    sa = suffix_array(data)
    window = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, starts, strict=True)]) if len(runs) else np.zeros(0, np.int64)
    valid = np.zeros(total, bool)
    valid[window] = True
    order = sa[valid[sa]]
    ends = np.repeat(begin + lens, lens + 1)
    lcp = common_prefixes(data, sa, ends, length)
    at = np.flatnonzero(valid[sa])
    same = np.concatenate([[False], np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) >= length]) if len(at) > 1 else np.zeros(len(at), bool)
    twice = same | np.append(same[1:], False)
    mark = np.zeros(total, bool)
    mark[order[twice]] = True
    return [mark[b : b + s] for b, s in zip(begin, starts, strict=True)]


def _intervals(flags: np.ndarray) -> np.ndarray:
    """Pairs [first, last] of runs of ones, as one int32 array."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.column_stack([edge[::2], edge[1::2] - 1]).astype(np.int32).ravel()


def anchor_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (cls, text) -> h, rh, cls, lo, hi."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            parts = []
            for cls, text in zip(b["cls"], b["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                h, lo, hi, _ = anchors(np.frombuffer(raw, np.uint8), length, gram)
                if len(h):
                    view = memoryview(raw)
                    rh = np.fromiter((digest(view[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(h))
                    parts.append((h, rh, np.full(len(h), cls), lo, hi))
            if parts:
                c = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pd.DataFrame({"h": c[0].view(np.int64), "rh": c[1].view(np.int64), "cls": c[2], "lo": c[3].astype(np.int32), "hi": c[4].astype(np.int32)})

    return docs.select("cls", "text").mapInPandas(run, "h long, rh long, cls long, lo int, hi int")


def _shards(runs: DataFrame, length: int) -> DataFrame:
    """runs (h, rh, bucket, run, n_starts) -> h, rh, starts (binary): windows that start twice in their shard."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_starts([bytes(x) for x in g["run"]], g["n_starts"].to_numpy(), length)
        out = pd.DataFrame({"h": g["h"], "rh": g["rh"], "starts": [_intervals(f).tobytes() for f in flags]})
        return out[out["starts"].str.len() > 0]

    return runs.groupBy("bucket").applyInPandas(work, "h long, rh long, starts binary")


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """Windows of hot anchors (parts: in how many shards) that start twice anywhere: h, rh, starts (binary).

    Each shard sends, for each range of digests, one sorted block of its windows' digests; blocks of one anchor and
    range meet in a task, where each is searched for the others' digests by binary search.
    """
    nothing = {"h": pd.Series(dtype="int64"), "rh": pd.Series(dtype="int64"), "starts": pd.Series(dtype=object)}

    def emit(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, part in g.groupby("h"):
            bits = int(part["parts"].iloc[0] - 1).bit_length()  # at least as many ranges as shards
            dig, rh, at = [], [], []
            for r, run, n in zip(part["rh"], part["run"], part["n_starts"], strict=True):
                view = memoryview(bytes(run))
                dig.append(np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + length]) for i in range(n)), np.uint64, n))
                rh.append(np.full(n, r, np.int64))
                at.append(np.arange(n, dtype=np.int32))
            d, rh_, at_ = np.concatenate(dig), np.concatenate(rh), np.concatenate(at)
            order = np.argsort(d, kind="stable")
            d, rh_, at_ = d[order], rh_[order], at_[order]
            k = (d >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(d), np.int64)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(d)], strict=True):
                rows.append((h, k[s], d[s:e].tobytes(), rh_[s:e].tobytes(), at_[s:e].tobytes()))
        return pd.DataFrame(rows, columns=["h", "k", "d", "r", "a"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        mine = np.concatenate([np.frombuffer(x, np.uint64) for x in g["d"]])
        rhs, ats = np.concatenate([np.frombuffer(x, np.int64) for x in g["r"]]), np.concatenate([np.frombuffer(x, np.int32) for x in g["a"]])
        every = np.sort(mine)
        twice = np.searchsorted(every, mine, side="right") - np.searchsorted(every, mine, side="left") > 1
        out = pd.DataFrame({"rh": rhs[twice], "at": ats[twice]}).groupby("rh")["at"].apply(lambda x: np.sort(np.repeat(x.to_numpy(), 2)).astype(np.int32).tobytes())
        return pd.DataFrame({"h": g["h"].iloc[0], "rh": out.index.to_numpy(np.int64), "starts": out.to_numpy()}) if len(out) else pd.DataFrame(nothing)

    blocks = runs.groupBy("bucket").applyInPandas(emit, "h long, k long, d binary, r binary, a binary")
    return blocks.groupBy("h", "k").applyInPandas(meet, "h long, rh long, starts binary")


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (cls, text), cls unique -> cls, lo, hi, starts: runs (starts lo to hi) that repeat, whole (null) or in the places that
    starts, an array of blobs of int32 pairs relative to lo, gives."""
    none = F.lit(None).cast("array<binary>").alias("starts")
    rows = stash(anchor_rows(docs, length, gram), "anchors")
    by = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("rh").alias("r0"), F.max("rh").alias("r1")).where("n > 1")
    # written, so that both sides of the join are dealt anew and adaptive execution can cut a hot anchor's partition
    by = stash(by.select("h", (F.col("r0") != F.col("r1")).alias("mixed")), "anchor-counts")
    again = stash(rows.join(by.hint("merge"), "h"), "repeated-anchors")
    unstash(rows)
    whole = again.where("not mixed").select("cls", "lo", "hi", none)
    # one row of each distinct run; equal runs repeat whole
    mine = again.where("mixed").drop("mixed")
    distinct = mine.groupBy("h", "rh").agg(F.count("*").alias("n"), F.min(F.struct("cls", "lo", "hi")).alias("x"))
    distinct = stash(distinct.select("h", "rh", "n", "x.cls", "x.lo", "x.hi"), "runs")
    per = stash(distinct.groupBy("h").agg(F.count("*").alias("runs")), "anchor-runs")
    total = distinct.count()
    shards = max(1, total // 4000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if total > 20_000 else 1)
    parts = F.ceil(F.col("runs") / HOT_ANCHOR).cast("int").alias("parts")
    wanted = distinct.join(per.hint("merge"), "h").select("cls", "h", "rh", "lo", "hi", parts)
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("h", F.pmod("rh", "parts")), F.lit(shards)))
    wanted = wanted.groupBy("cls").agg(F.collect_list(F.struct("h", "rh", "lo", "hi", "parts", "bucket")).alias("w"))  # no more than a text has anchors

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, w in zip(b["text"], b["w"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(x["h"], x["rh"], x["parts"], x["bucket"], raw[x["lo"] : x["hi"] + length], x["hi"] - x["lo"] + 1) for x in w]
            yield pd.DataFrame(out, columns=["h", "rh", "parts", "bucket", "run", "n_starts"])

    runs = docs.select("cls", "text").join(wanted, "cls").select("text", "w").mapInPandas(cut, "h long, rh long, parts int, bucket long, run binary, n_starts int")
    runs = stash(runs, "run-bytes")
    # one row for each run; runs that stand twice are whole already, so each row found meets one row
    found = _shards(runs, length).unionByName(_merge(runs.where("parts > 1"), length)).groupBy("h", "rh").agg(F.collect_list("starts").alias("starts"))  # at most one for each shard of the anchor
    some = distinct.where("n = 1").join(found, ["h", "rh"]).select("cls", "lo", "hi", "starts")
    twins = stash(distinct.where("n > 1").select("h", "rh"), "run-twins")
    twice = mine.join(twins.hint("merge"), ["h", "rh"], "left_semi").select("cls", "lo", "hi", none)
    out = stash(whole.unionByName(twice).unionByName(some), "repeats")
    for used in (by, again, distinct, per, runs, twins):
        unstash(used)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    tune(docs.sparkSession)
    body = F.coalesce("text", F.lit(""))
    key = [F.xxhash64(body).alias("k1"), F.xxhash64(F.reverse(body), F.lit(1)).alias("k2")]
    ids = stash(docs.select("doc_id", *key), "text-keys")
    # the number of a class is that of its row in the written table
    classes = ids.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("cls", F.monotonically_increasing_id()), "text-classes")
    # of rows with one doc_id and one text any will do; a doc_id with two texts stands for two classes
    one = docs.select("doc_id", body.alias("text"), *key)
    texts = one.join(classes, ["doc_id", "k1", "k2"]).dropDuplicates(["cls"]).select("cls", "copies", "text")
    texts = stash(texts, "distinct-texts")
    repeats = covered(texts, length, gram)
    spans = repeats.groupBy("cls").agg(F.collect_list(F.struct("lo", "hi", "starts")).alias("spans"))  # no more than a text has anchors

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cls, text, spans_, n in zip(b["cls"], b["text"], b["spans"], b["copies"], strict=True):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                if n > 1 and len(raw) >= length:
                    edge[0], edge[-1] = 1, -1
                for x in spans_ if spans_ is not None else ():
                    blobs = [np.array([0, x["hi"] - x["lo"]])] if x["starts"] is None else [np.frombuffer(bytes(y), np.int32) for y in x["starts"]]
                    for pairs in blobs:
                        np.add.at(edge, pairs[::2] + x["lo"], 1)
                        np.add.at(edge, pairs[1::2] + x["lo"] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                out.append((cls, len(raw), int(gone.sum()), n_spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["cls", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = texts.join(spans, "cls", "left").mapInPandas(strip, "cls long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    done = stash(done, "stripped-texts")
    unstash(texts)
    unstash(repeats)
    return ids.join(classes.select("k1", "k2", "cls").join(done, "cls"), ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
