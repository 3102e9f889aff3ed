"""Best-fit-decreasing packing of token sequences.

A document is its token ids and the end id; one longer than `CAPACITY` is cut so that only its first piece may be
shorter. All pieces of one length are alike, so best-fit decreasing runs on the histogram of lengths (`CAPACITY`
numbers, whatever the corpus): a segment tree over remaining capacities finds the tightest open bin in logarithmic
time, and bins of one capacity are kept as ranges of sequence numbers. The plan has a few rows for each length; each
piece finds its place in it by its rank among the pieces of its length. Pieces of the full length stand outside of it.

Null texts are empty and still take one place for the end id. Repeated rows are packed each; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import bits_for, positions, stash, tune
from marginalia.llm.tokens import tokenizer_path, unit_tokenizer

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


class CapacityTree:
    """Segment tree over remaining capacities: how many bins are open with each, and the least one that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity >= need of an open bin."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): pieces of a length from a rank on, one to each sequence."""
    tree, ranges, out, bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no piece can have {length} tokens")
        while left:
            room = tree.tightest(length)
            if room is None:  # whole new bins, each filled with this length as best fit would
                each = capacity // length
                full, rest = divmod(left, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        for i in range(n):
                            out.append((length, rank + i * times, times, bins, i * length))
                        remaining = capacity - n * length
                        if remaining:
                            tree.add(remaining, times)
                            ranges[remaining].append((bins, times))
                        bins += times
                        rank += n * times
                left = 0
                continue
            first, n = ranges[room].popleft()
            # the tightest bin takes pieces of this length while it has room for them
            each = room // length
            times = min(n, left // each) if left >= each else 0
            take, times = (each, times) if times else (left, 1)
            for i in range(take):
                out.append((length, rank + i * times, times, first, capacity - room + i * length))
            tree.add(room, -times)
            if n > times:
                ranges[room].appendleft((first + times, n - times))
            if remaining := room - take * length:
                tree.add(remaining, times)
                ranges[remaining].append((first, times))
            rank += take * times
            left -= take * times
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = unit_tokenizer(tokenizer_path(tokenizer), True)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(tok.ids(text), END_ID).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, i, s, e - s, zlib.crc32(ids[s:e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """pieces() with sequence_id and offset."""
    parts = stash(pieces(docs, capacity, tokenizer), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # a full piece is a sequence of its own: it needs no place in the plan and no rank
    full, rest = parts.where(F.col("length") == capacity), parts.where(F.col("length") < capacity)
    sizes = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    alone = lambda after: full.select(*columns[:5], (F.monotonically_increasing_id() + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not sizes:
        return alone(0)
    table = np.array(plan(sizes, capacity), np.int64)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # grows with capacity, not with the corpus
    most = max(sizes.values())
    ranked = positions(rest, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece"], bits_for(most), "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        base = int(t[:, 1].max() + t[:, 2].max() + 1)
        keys = t[:, 0] * base + t[:, 1]
        for b in batches:
            rank = b["rank"].to_numpy()
            i = np.searchsorted(keys, b["length"].to_numpy() * base + rank, side="right") - 1
            yield b.drop(columns="rank").assign(sequence_id=t[i, 3] + rank - t[i, 1], offset=t[i, 4])

    placed = ranked.select(*columns[:5], "rank").mapInPandas(run, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.unionByName(alone(int((table[:, 3] + table[:, 2]).max())))
