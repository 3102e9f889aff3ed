"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Spaces become markers (U+2581), one more stands before the text, and of all ways to cut the text into pieces the one
with the largest sum of log scores is taken (of equals, longer last pieces). A character that no piece covers alone is
written as its UTF-8 bytes. Decoding joins the pieces, turns markers into spaces and drops the first.
The piece file may hold ranks in place of log scores (files made for byte-pair merging do): these become a Zipf
distribution over the ranks. No piece may have a marker after another character or hold a line end (checked), so a
text falls into units at spaces and line ends; a batch's new units are searched together in numpy and kept.

Null texts are empty and give no ids; a text may hold anything (a literal U+2581 comes back as a space, as in the
format). Whole texts of any length are read. Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from marginalia.llm.common import tune
from marginalia.llm.tokens import tokenizer_path

MARK = "\u2581"
PIECES = "piece_bpe_32k.model"
CACHE = 500_000
#: How far below the worst piece a character in bytes scores.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """Trie of byte strings: node n goes by byte b to base[n] + b + 1 where check there is n; value[n] is an id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for k, v in keys.items():
            node = root
            for b in k:
                node = node.setdefault(b, {})
            node[-1] = v
        size = 1 << 17
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        first = 1
        todo = [(root, 0)]
        while todo:
            node, at = todo.pop()
            value[at] = node.get(-1, -1)
            kids = sorted(b for b in node if b >= 0)
            if not kids:
                base[at] = 0
                continue
            off = np.array(kids) + 1
            if first + 2000 > size - 300 or used[first : first + 400].all():
                first += 200
            b = max(0, first - int(off[0]))
            while True:
                if b + 300 > len(used):
                    grow = len(used)
                    base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                    used = np.concatenate([used, np.zeros(grow, bool)])
                    size = len(used)
                if b + off[0] and not used[b + off].any():
                    break
                free = np.flatnonzero(~used[b + off[0] + 1 : b + off[0] + 4096])
                b += int(free[0]) + 1 if len(free) else 4096
            base[at] = b
            used[b + off] = True
            check[b + off] = at
            while used[first]:
                first += 1
            todo += [(node[k], b + k + 1) for k in kids]
        last = int(np.flatnonzero(used).max()) + 260
        self.base, self.check, self.value = base[:last].copy(), check[:last].copy(), value[:last].copy()

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        to = self.base[node] + byte + 1
        return np.where((to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == node), to, -1)


class Vocabulary:
    """Pieces, log scores and byte ids of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        scores = np.full(n, -np.inf)
        keys = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} joins units")
                self.pieces[i] = piece.replace(MARK, " ").encode()
                keys[piece.encode()] = i
                scores[i] = sp.get_score(i)
        normal = np.array(sorted(keys.values()))
        if len(normal) and (scores[normal] == np.round(scores[normal])).all():  # ranks
            rank = -scores[normal]
            scores[normal] = -np.log(rank + 10) - math.log((1 / (rank + 10)).sum())
        self.scores = scores
        self.unknown = float(scores[normal].min()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(keys)
        self.longest = max(map(len, keys))


class Encoder:
    """ids(text) and decode(ids)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cache = vocabulary, {}

    def search(self, units: list[str]) -> list[np.ndarray]:
        """Viterbi over all units at once."""
        v, raw = self.v, [u.encode("utf-8", "surrogatepass") for u in units]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(lens)
        begin, stop = ends - lens, np.repeat(ends, lens)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(starts, len(data)))
        node, live = np.zeros(len(starts), np.int64), np.arange(len(starts))
        got_s, got_e, got_id = [], [], []
        alone = np.zeros(len(starts), bool)
        for d in range(v.longest):
            ok = starts[live] + d < stop[starts[live]]
            live = live[ok]
            to = v.trie.step(node[live], data[starts[live] + d])
            live, to = live[to >= 0], to[to >= 0]
            if not len(live):
                break
            node[live] = to
            hit = v.trie.value[to] >= 0
            at = live[hit]
            got_s.append(starts[at])
            got_e.append(starts[at] + d + 1)
            got_id.append(v.trie.value[to[hit]].astype(np.int64))
            alone[at[width[at] == d + 1]] = True
        bare = np.flatnonzero(~alone)
        s = np.concatenate([*got_s, starts[bare]])
        e = np.concatenate([*got_e, starts[bare] + width[bare]])
        ids = np.concatenate([*got_id, np.full(len(bare), -1)])
        score = np.where(ids >= 0, v.scores[ids], v.unknown)
        first = np.repeat(begin, lens)
        order = np.lexsort((-s, e - first[s]))  # by end within the unit; among them short pieces first
        s, e, ids, score = s[order], e[order], ids[order], score[order]
        rel = e - first[s]
        # best[k]: of the text before position k; a unit's first position is the end of the one before, so starts are apart
        best_e, back = np.full(len(data) + 1, -np.inf), np.full(len(data) + 1, -1)
        cuts = np.flatnonzero(np.concatenate([[True], rel[1:] != rel[:-1]])) if len(rel) else np.zeros(0, int)
        bounds = [*cuts.tolist(), len(rel)]
        at_start = s == first[s]
        for a, b in zip(bounds, bounds[1:], strict=False):
            cand = np.where(at_start[a:b], 0.0, best_e[s[a:b]]) + score[a:b]
            np.maximum.at(best_e, e[a:b], cand)
            win = np.flatnonzero(cand == best_e[e[a:b]])
            back[e[a:b][win]] = a + win
        out: list[list[int]] = [[] for _ in units]
        where, who = ends.copy(), np.flatnonzero(lens > 0)
        while len(who):
            m = back[where[who]]
            for u, i, x, y in zip(who.tolist(), ids[m].tolist(), s[m].tolist(), e[m].tolist(), strict=True):
                if i >= 0:
                    out[u].append(i)
                else:
                    out[u].extend(v.byte_id[data[x:y][::-1]].tolist())
            where[who] = s[m]
            who = who[where[who] > begin[who]]
        return [np.array(o[::-1], np.uint16) for o in out]

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        out = []
        for i, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            head = (MARK if not i else "") + parts[0]
            if "" not in parts:
                out += [head, *[MARK + p for p in parts[1:]]]
            else:
                now = head
                for p in parts[1:]:
                    if now.rstrip(MARK):
                        out.append(now)
                        now = MARK + p
                    else:
                        now += MARK + p
                out.append(now)
            out.append("\n")
        return [u for u in out[:-1] if u]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.units(t or "") for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new: dict[str, None] = {}
        for us in split:
            for u in set(us).difference(self.cache):
                new[u] = None
        fresh = sorted(new, key=len)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.cache.update(zip(part, [x.tobytes() for x in self.search(part)], strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, us)), np.uint16) for us in split]

    def decode(self, ids: np.ndarray) -> bytes:
        raw = b"".join(map(self.v.pieces.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


def encode_documents(docs: DataFrame, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), n_byte_ids, decoded_sha256, round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path(pieces)))  # as large as the piece file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(shared.value)
        is_byte = np.zeros(len(enc.v.pieces), bool)
        is_byte[enc.v.byte_id] = True
        for b in batches:
            rows = []
            for i in range(0, len(b), 100):
                texts = b["text"].iloc[i : i + 100].tolist()
                for doc, text, ids in zip(b["doc_id"].iloc[i : i + 100], texts, enc.ids(texts), strict=True):
                    raw = enc.decode(ids)
                    rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4")), int(is_byte[ids].sum()), hashlib.sha256(raw).hexdigest(), raw == (text or "").encode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32", "n_byte_ids", "decoded_sha256", "round_trip"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, docs.select("doc_id").schema.add("n_tokens", "long").add("ids_crc32", "long").add("n_byte_ids", "long").add("decoded_sha256", "string").add("round_trip", "boolean"))
