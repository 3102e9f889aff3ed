"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A file (`MAGIC`) holds a run of documents in ascending doc_id order: their doc_ids and lengths, then blocks of at most
`BLOCK` ids, each with its length, its compressed length and the crc32 of its ids. A block's coder starts from the
same state, so any block can be read alone. For each id, the id that last followed the two ids before (order 2) is
offered, then the one that last followed the one before (order 1); whether it is taken is coded with a probability
mixed from counters of orders 0, 1 and 2, whose weights follow how well each did. Otherwise the whole id is coded with
adaptive order-0 counts: those of upper bytes, then those of lower bytes after such an upper one (`AFTER` classes of them).
All arithmetic is exact (integers, or floats that hold integers), so decoding repeats it.
Blocks are independent, so many are coded side by side as the lanes of numpy arrays.

Null texts are empty and have the end id alone. Rows that share a doc_id stand side by side, ordered by their texts.
An empty table gives no files and no rows. A task writes its files under names of its own attempt, and only the files that
its rows name are read, so a lost executor costs a rewrite of its part. In a store that pyarrow doesn't know but Spark does
(s3a://, abfss://), the bytes of each file are a row of a table that Spark writes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import new_path, stash, tune
from marginalia.llm.tokens import tokenizer_path, unit_tokenizer

MAGIC = b"TIDS1\0"
BLOCK, LANES = 2048, 2048
#: Places for contexts of one and of two ids in a block's tables; classes of upper bytes that the lower byte follows; weight of one id.
ONE, TWO, AFTER, GAIN = 512, 1024, 32, 24
#: Counts are halved where their sum passes this.
MOST = 8000
FILE_IDS = 3_000_000
TOKENIZER, END_ID = "word_bpe_49k.json", 1
NONE = 0xFFFF
TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 40)
LOW56 = np.uint64((1 << 56) - 1)
#: x @ SUMS: running sums of 16 small integers, exact in 32-bit floats.
SUMS = np.triu(np.ones((16, 16), np.float32))


def _floor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of integers below 2**34 and 2**18, exactly: a 64-bit quotient can't round up to the next integer."""
    return (a / b).astype(np.int64)


class Lanes:
    """Models and coder registers of some blocks; lane k is active while k < the number of lanes given to a step."""

    def __init__(self, n: int, steps: int, data: list[bytes] | None = None):
        self.rows = np.arange(n)
        self.cand1, self.cand2 = np.full((n, ONE), NONE, np.uint16), np.full((n, TWO), NONE, np.uint16)
        self.q0, self.q1, self.q2 = np.full(n, 6000, np.int32), np.full((n, ONE), 6000, np.uint16), np.full((n, TWO), 6000, np.uint16)
        self.s0, self.s1 = np.full(n, 6000, np.int32), np.full((n, ONE), 6000, np.uint16)
        self.w = np.full((3, n), 1 << 14, np.int64)
        # byte counts as 16 x 16, with the sums of each 16: one set for upper bytes, AFTER sets for lower ones
        self.count, self.group = np.ones((n, AFTER + 1, 16, 16), np.uint16), np.full((n, AFTER + 1, 16), 16, np.uint16)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, LOW56, np.uint64)
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ptr = np.zeros(n, np.int64)
        self.data = data
        if data is None:
            self.out = np.zeros((n, steps * 4 + 64), np.uint8)
        else:
            width = max(map(len, data)) + 16
            self.out = np.zeros((n, width), np.uint8)
            for i, d in enumerate(data):
                self.out[i, : len(d)] = np.frombuffer(d, np.uint8)
            self.code = np.zeros(n, np.uint64)
            for i in range(7):
                self.code = (self.code << np.uint64(8)) | self.out[:, i]
            self.ptr[:] = 7

    def renorm(self, at: np.ndarray | slice) -> None:
        rows = self.rows[at]
        low, rng = self.low[rows], self.range[rows]
        first = True
        while len(rows):
            same = ((low ^ (low + rng)) & LOW56) < TOP
            same &= (low + rng) <= LOW56
            small = ~same & (rng < BOT)
            move = same | small
            if first and not move.any():
                return
            if not move.all():
                keep = np.flatnonzero(move)
                rows, low, rng, small = rows[keep], low[keep], rng[keep], small[keep]
            if not len(rows):
                return
            first = False
            rng = np.where(small, (~low + np.uint64(1)) & (BOT - np.uint64(1)), rng)
            if self.data is None:
                self.out[rows, self.ptr[rows]] = (low >> np.uint64(48)).astype(np.uint8)
            else:
                self.code[rows] = ((self.code[rows] << np.uint64(8)) | self.out[rows, self.ptr[rows]]) & LOW56
            self.ptr[rows] += 1
            low, rng = (low << np.uint64(8)) & LOW56, (rng << np.uint64(8)) & LOW56
            self.low[rows], self.range[rows] = low, rng

    def bit(self, rows: np.ndarray | slice, p: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        """Code one bit of each lane; p: chance of a one in 16 bits. Decoding gives the bits."""
        part = (self.range[rows] >> np.uint64(16)) * p.astype(np.uint64)
        if y is None:
            y = ((self.code[rows] - self.low[rows]) & LOW56) < part
        self.low[rows] = np.where(y, self.low[rows], self.low[rows] + part)
        self.range[rows] = np.where(y, part, self.range[rows] - part)
        return y

    def step(self, k: int, x: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first k lanes (x), or decode it (None)."""
        act, rows = slice(0, k), self.rows[:k]
        a, b = self.a[act], self.b[act]
        h1 = ((b * 40503) >> 4) & (ONE - 1)
        h2 = ((a * 30011 + b * 51787) >> 3) & (TWO - 1)
        c1, c2 = self.cand1[rows, h1], self.cand2[rows, h2]
        q0, q1, q2 = self.q0[act], self.q1[rows, h1].astype(np.int64), self.q2[rows, h2].astype(np.int64)
        w0, w1, w2 = self.w[0, act], self.w[1, act], self.w[2, act]
        p = np.clip(_floor(w0 * q0 + w1 * q1 + w2 * q2, w0 + w1 + w2), 64, 65472)
        hit = self.bit(act, p, None if x is None else x == c2)
        goal = np.where(hit, 65535, 0)
        for i, (w, q) in enumerate(((w0, q0), (w1, q1), (w2, q2))):
            self.w[i, act] = w + ((((65535 - np.abs(goal - q)) >> 1) - w) >> 5) + 1
        self.q0[act] = q0 + ((goal - q0) >> 6)
        self.q1[rows, h1] = q1 + ((goal - q1) >> 4)
        self.q2[rows, h2] = q2 + ((goal - q2) >> 2)
        out = c2.astype(np.int64) if x is None else x
        miss = np.flatnonzero(~hit)
        if len(miss):
            m1 = h1[miss]
            s0, s1 = self.s0[miss].astype(np.int64), self.s1[miss, m1].astype(np.int64)
            p = np.clip((s0 + 3 * s1) >> 2, 64, 65472)
            got = self.bit(miss, p, None if x is None else x[miss] == c1[miss])
            goal = np.where(got, 65535, 0)
            self.s0[miss] = s0 + ((goal - s0) >> 6)
            self.s1[miss, m1] = s1 + ((goal - s1) >> 3)
            if x is None:
                out[miss] = c1[miss]
            lit = miss[~got]
            if len(lit):
                self.renorm(lit)
                value = self.literal(lit, None if x is None else x[lit])
                if x is None:
                    out[lit] = value
        self.renorm(act)
        self.cand1[rows, h1] = out
        self.cand2[rows, h2] = out
        self.a[act], self.b[act] = b, out
        return out

    def byte(self, rows: np.ndarray, of: np.ndarray | int, x: np.ndarray | None) -> np.ndarray:
        """Code a byte of each lane by the counts of its set `of`, or decode it."""
        group = self.group[rows, of].astype(np.float32)
        cum = (group @ SUMS).astype(np.int64)
        total = cum[:, -1]
        unit = self.range[rows] // total.astype(np.uint64)
        i = np.arange(len(rows))
        if x is None:
            target = np.minimum(((self.code[rows] - self.low[rows]) & LOW56) // unit, (total - 1).astype(np.uint64)).astype(np.int64)
            g = (cum <= target[:, None]).sum(axis=1)
        else:
            g = x >> 4
        below = cum[i, g] - group[i, g].astype(np.int64)
        count = self.count[rows, of, g].astype(np.float32)
        inner = (count @ SUMS).astype(np.int64)
        s = (inner <= (target - below)[:, None]).sum(axis=1) if x is None else x & 15
        mine = count[i, s].astype(np.int64)
        self.low[rows] += unit * (below + inner[i, s] - mine).astype(np.uint64)
        self.range[rows] = unit * mine.astype(np.uint64)
        self.count[rows, of, g, s] += GAIN
        self.group[rows, of, g] += GAIN
        full = np.flatnonzero(total > MOST)
        if len(full):
            r, o = rows[full], of if isinstance(of, int) else of[full]
            self.count[r, o] = (self.count[r, o] + 1) >> 1
            self.group[r, o] = self.count[r, o].sum(axis=2, dtype=np.uint16)
        return (g << 4) | s

    def literal(self, rows: np.ndarray, x: np.ndarray | None) -> np.ndarray:
        upper = self.byte(rows, AFTER, None if x is None else x >> 8)
        return (upper << 8) | self.byte(rows, upper % AFTER, None if x is None else x & 255)

    def finish(self) -> list[bytes]:
        for i in range(7):
            self.out[self.rows, self.ptr] = ((self.low >> np.uint64(48)) & np.uint64(255)).astype(np.uint8)
            self.low = (self.low << np.uint64(8)) & LOW56
            self.ptr += 1
        return [self.out[i, :p].tobytes() for i, p in enumerate(self.ptr)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Compressed bytes of each block (uint16 ids, none empty)."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        lens = np.array([len(blocks[i]) for i in part])
        grid = np.zeros((lens[0], len(part)), np.int64)
        for j, i in enumerate(part):
            grid[: lens[j], j] = blocks[i]
        lanes = Lanes(len(part), int(lens[0]))
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        for t in range(lens[0]):
            lanes.step(int(live[t]), grid[t, : live[t]])
        for i, d in zip(part, lanes.finish(), strict=True):
            out[i] = d
    return out


def decode_blocks(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(data)
    order = sorted(range(len(data)), key=lambda i: -sizes[i])
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        lens = np.array([sizes[i] for i in part])
        grid = np.zeros((lens[0], len(part)), np.uint16)
        lanes = Lanes(len(part), int(lens[0]), [data[i] for i in part])
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        for t in range(lens[0]):
            grid[t, : live[t]] = lanes.step(int(live[t]), None)
        for j, i in enumerate(part):
            out[i] = grid[: lens[j], j].copy()
    return out


def file_bytes(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    """One file: documents in the order given."""
    flat = np.concatenate(ids).astype(np.uint16)
    blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
    packed = encode_blocks(blocks)
    index = np.array(doc_ids, "<i8").tobytes() + np.array([len(x) for x in ids], "<u4").tobytes()
    head = MAGIC + struct.pack("<QQI", len(doc_ids), len(blocks), zlib.crc32(index)) + index
    table = b"".join(struct.pack("<III", len(b), len(p), zlib.crc32(b.astype("<u2"))) for b, p in zip(blocks, packed, strict=True))
    return head + table + b"".join(packed)


def read_file(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_ids and the ids of each document; ValueError if a checksum fails."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC)
    n, m, crc = struct.unpack_from("<QQI", raw, at)
    at += 20
    if zlib.crc32(raw[at : at + 12 * n]) != crc:
        raise ValueError("index is damaged")
    docs, lens = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<u4", n, at + 8 * n)
    at += 12 * n
    table = [struct.unpack_from("<III", raw, at + 12 * i) for i in range(m)]
    at += 12 * m
    data = []
    for _, size, _ in table:
        data.append(raw[at : at + size])
        at += size
    blocks = decode_blocks(data, [t[0] for t in table])
    for b, t in zip(blocks, table, strict=True):
        if zlib.crc32(b.astype("<u2")) != t[2]:
            raise ValueError("a block is damaged")
    flat = np.concatenate(blocks) if blocks else np.zeros(0, np.uint16)
    return docs, np.split(flat, np.cumsum(lens)[:-1])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///"))


def reachable(folder: str) -> bool:
    """Whether pyarrow can write there."""
    try:
        _open(folder)
    except (ValueError, OSError, ImportError):
        return False
    return True


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write docs into files of the folder; returns their list (part, seq, path, n_ids, payload), in document order.

    payload: the bytes of a file that only Spark can write; null for the others.
    """
    direct = reachable(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tok, part, seq, rows = unit_tokenizer(tokenizer_path(tokenizer), False), TaskContext.get().partitionId(), 0, []
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal seq, size
            if doc_ids:
                path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tids"
                data = file_bytes(doc_ids, ids)
                if direct:
                    store, name = _open(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(name) as f:
                        f.write(data)
                rows.append((part, seq, path, size, None if direct else data))
                doc_ids.clear()
                ids.clear()
                seq, size = seq + 1, 0

        def listed() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["part", "seq", "path", "n_ids", "payload"])
            rows.clear()
            return out

        for b in batches:
            for doc, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                doc_ids.append(doc)
                ids.append(np.append(tok.ids(text), np.uint16(end_id)))
                size += len(ids[-1])
                if size >= FILE_IDS:
                    flush()
                    yield listed()
        flush()
        yield listed()

    tune(docs.sparkSession)
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInPandas(run, "part int, seq int, path string, n_ids long, payload binary")


def read_back(files: DataFrame) -> DataFrame:
    """files (path, start, payload) -> doc_id, start, n_tokens, ids_crc32 of each document in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start, payload in zip(b["path"], b["start"], b["payload"], strict=True):
                if payload is None:
                    store, name = _open(path)
                    with store.open_input_stream(name) as f:
                        payload = f.read()
                docs, ids = read_file(bytes(payload))
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pd.DataFrame({"doc_id": docs, "start": start + np.cumsum(lens) - lens, "n_tokens": lens, "ids_crc32": [zlib.crc32(x.astype("<u4")) for x in ids]})

    return files.select("path", "start", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all docs and return what the files hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    listed = stash(write_files(docs, folder or new_path(spark, "token-ids")), "token-files")
    ahead = lambda *p: Window.partitionBy(*p[:-1] or [F.lit(0)]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_part = listed.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead("part")), F.lit(0))).select("part", "base")  # a row for each write task
    files = listed.join(by_part, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(ahead("part", "seq")), F.lit(0)))
    return read_back(files.repartitionByRange(max(1, listed.count()), "start"))  # a task for each file
