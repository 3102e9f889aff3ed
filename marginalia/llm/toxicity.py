"""Toxicity by class-conditional Kneser-Ney models over the byte sequences of words.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of orders 2 to `ORDER` over lower-cased words with
their edges marked; both back off to one shared model of continuation counts over both classes, so rare expressions
are judged by their parts; `STRENGTH` counts of the order below are added to each context, so that what was seen once or
twice is little evidence. A word's evidence is its log-likelihood ratio. A text gives the length-normalised ratio of
the whole, of its most toxic window, that of its two most toxic words, and how many of its words, for its length, have
ratios over each of `CUTS`; a logistic layer turns these into a score. Context ends at the edges of a word.
The layer is fitted on ratios that the models of the other half of the sample give, then the models are fitted on all.

Training rows: labelled documents whose crc32(doc_id as text) mod 5 is not 0, of each class the `max_rows` distinct
texts with the smallest hashes (a documented bound; all of them where there are fewer). Labels, lang, source and doc_id
are never inputs of a score. Scoring reads every whole text, and long runs without white space in overlapping parts.

Null and empty texts score as texts without evidence. Labels that are null are not used; without labels of both
classes every score is 0. Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stash, tune, unstash

ORDER = 8
MAX_ROWS = 2000
DISCOUNT, STRENGTH = 0.75, 30.0
WINDOW = 24
CUTS = np.array([1.0, 2.0, 3.0, 4.0, 6.0])
FEATURES = 3 + len(CUTS)
#: Words and their ratios kept by a worker; texts cut into words at once.
CACHE, TOGETHER = 400_000, 100
#: A word is what stands between white space, without marks at its ends. A run of over LONGEST characters is cut at its marks, and what
#: is longer still counts as words of that length that overlap by half, so all of it is read, and an expression of up to half the length
#: stands whole in one.
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
LONGEST = 40
INNER = re.compile(r"[^\W_]+")
JUMP = 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    ws = (text or "").lower().split()
    if max(map(len, ws), default=0) <= LONGEST:
        return ws
    half = LONGEST // 2
    parts = [p for w in ws for p in ([w] if len(w) <= LONGEST else INNER.findall(w) or [w])]
    return [w[i : i + LONGEST] for w in parts for i in range(0, max(1, len(w) - half), half)]


def _bytes(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words as one byte sequence, each between a 1 and a 2, and the number of its word for each byte."""
    raw = [b"\1" + w.strip(EDGE).encode("utf-8", "surrogatepass") + b"\2" for w in vocabulary]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(raw)), lens)


def _grams(seq: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Key of the gram of n bytes that ends at each byte; 0 where a word has no such gram."""
    key = np.zeros(len(seq), np.uint64)
    if n > len(seq):
        return key
    with np.errstate(over="ignore"):
        for back in range(n - 1, -1, -1):
            key[:back] += np.uint64(1)
            key[back:] += seq[: len(seq) - back]
            key[back:] += np.uint64(1)
            key *= MIX
            key ^= key >> np.uint64(29)
        key += np.uint64(n)
    if n > 1:
        key[: n - 1] = 0
        key[n - 1 :][owner[n - 1 :] != owner[: len(owner) - n + 1]] = 0
    return key


class Model:
    """Log-likelihood ratio of words, toxic over ordinary."""

    def __init__(self, counts: dict[int, Counter], order: int = ORDER):
        self.order = order
        vocabulary = sorted(set(counts[0]) | set(counts[1]))
        weight = [np.array([counts[y][w] for w in vocabulary], np.float64) for y in (0, 1)]
        seq, owner = _bytes(vocabulary)
        self.keys, self.num, self.ctx = {}, {}, {}
        grams = below = np.zeros(0, np.uint64)
        for n in range(1, order + 1):
            below, grams = grams, _grams(seq, owner, n)
            at = np.flatnonzero(grams != 0)
            keys, inverse = np.unique(grams[at], return_inverse=True)
            # the highest order counts words; the others count in how many distinct words of the class the gram stands
            once = weight if n == order else [(w > 0).astype(np.float64) for w in weight]
            num = np.stack([np.bincount(inverse, once[y][owner[at]], len(keys)) for y in (0, 1)])
            if n == 1:
                num = np.stack([num.sum(axis=0)] * 2)  # shared by both classes
                num[:, keys == grams[0] if len(seq) else slice(0)] = 0  # the first mark is never predicted
                self.total = np.float32(num[0].sum())
            else:  # what follows a context: counts and kinds, kept beside the context's own key
                last = np.zeros(len(keys), np.int64)
                last[inverse] = at
                c = np.searchsorted(self.keys[n - 1], below[last - 1])
                m = len(self.keys[n - 1])
                total = [np.bincount(c, num[y], m) for y in (0, 1)]
                kinds = [np.bincount(c, (num[y] > 0).astype(np.float64), m) for y in (0, 1)]
                self.ctx[n] = np.array([total, kinds], np.float32).reshape(2, 2, m)
            self.keys[n], self.num[n] = keys, num.astype(np.float32)
        self.jump = {n: np.searchsorted(k, np.arange(1 << JUMP, dtype=np.uint64) << np.uint64(64 - JUMP)).astype(np.int32) for n, k in self.keys.items()}

    def _find(self, n: int, wanted: np.ndarray) -> np.ndarray:
        """Place of each key among those of order n, or -1. Keys are hashes, so their top bits all but give the place."""
        keys = self.keys[n]
        out = np.full(len(wanted), -1, np.int64)
        if not len(keys):
            return out
        i = self.jump[n][(wanted >> np.uint64(64 - JUMP)).astype(np.int64)].astype(np.int64)
        open_ = np.arange(len(wanted))
        while len(open_):
            ok = i < len(keys)
            open_, i = open_[ok], i[ok]
            k, w = keys[i], wanted[open_]
            hit = k == w
            out[open_[hit]] = i[hit]
            go = k < w
            open_, i = open_[go], i[go] + 1
        return out

    def ratios(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.zeros(0)
        seq, owner = _bytes(vocabulary)
        place = self._find(1, _grams(seq, owner, 1))
        num = np.where(place >= 0, self.num[1][:, place], 0) if len(self.keys[1]) else np.zeros((2, len(seq)), np.float32)
        p = (num + np.float32(0.1)) / (self.total + np.float32(25.6))
        for n in range(2, self.order + 1):
            context, grams = np.concatenate([[-1], place[:-1]]), _grams(seq, owner, n)
            at = np.flatnonzero((context >= 0) & (grams != 0))
            c = context[at]
            here = np.full(len(seq), -1, np.int64)
            known = place[at] >= 0  # a gram can only be known if its end is
            here[at[known]] = self._find(n, grams[at[known]])
            g = here[at]
            num = np.where(g >= 0, self.num[n][:, g], np.float32(0)) if len(self.keys[n]) else np.zeros((2, len(at)), np.float32)
            total, kinds = self.ctx[n][0][:, c], self.ctx[n][1][:, c]
            seen = total > 0
            low = p[:, at]
            safe = np.where(seen, total, np.float32(1))
            down = np.float32(DISCOUNT) * kinds + np.float32(STRENGTH)
            p[:, at] = np.where(seen, (np.maximum(num - np.float32(DISCOUNT), 0) + down * low) / (safe + np.float32(STRENGTH)), low)
            place = here
        ratio = np.log(np.maximum(p[1], 1e-9)) - np.log(np.maximum(p[0], 1e-9))
        ratio[seq == 1] = 0
        return np.bincount(owner, ratio, len(vocabulary))


class Scorer:
    """Scores of texts; the ratios of words are kept between texts."""

    def __init__(self, model: Model | None, layer: np.ndarray | None = None):
        self.model, self.layer, self.cache = model, layer, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for at in range(0, len(texts), TOGETHER):
            lists = [words(t) for t in texts[at : at + TOGETHER]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            new: set[str] = set()
            for ws in lists:
                new.update(set(ws).difference(self.cache))
            fresh = list(new)
            for i in range(0, len(fresh), 8_000):
                part = fresh[i : i + 8_000]
                self.cache.update(zip(part, self.model.ratios(part).tolist(), strict=True))
            get = self.cache.__getitem__
            for row, ws in zip(out[at:], lists, strict=False):
                if ws:
                    row[:] = self._text(np.fromiter(map(get, ws), np.float64, len(ws)))
        return out

    @staticmethod
    def _text(r: np.ndarray) -> tuple[float, ...]:
        sums = np.concatenate([[0.0], np.cumsum(r)])
        w = min(WINDOW, len(r))
        clip = np.maximum(r, 0)
        top = np.partition(clip, len(r) - 2)[-2:].sum() / 2 if len(r) > 1 else clip[0]
        over = len(r) - np.searchsorted(np.sort(r), CUTS, side="right")
        return r.mean(), (sums[w:] - sums[:-w]).max() / w, top, *np.log1p(over / (1 + len(r) / 100))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.layer is None:
            return np.zeros(len(texts))
        mean, scale, beta = self.layer
        x = np.column_stack([np.ones(len(texts)), (self.features(texts) - mean[1:]) / scale[1:]])
        return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def fit_layer(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps; rows: mean, scale, weights (a constant first)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[penalty * len(x) / 100 + 0.1] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.stack([np.append(0, mean), np.append(1, scale), beta])


def train(texts: list[str], labels: list[int]) -> Scorer:
    """Models and layer from labelled texts; without both classes a scorer that gives 0."""
    y = np.array(labels)
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return Scorer(None)
    half = np.zeros(len(y), np.int64)
    for c in (0, 1):
        half[y == c] = np.arange((y == c).sum()) % 2
    counts = [{0: Counter(), 1: Counter()} for _ in range(2)]
    for t, c, h in zip(texts, y.tolist(), half.tolist(), strict=True):
        counts[h][c].update(words(t))
    x = np.zeros((len(y), FEATURES))
    for h in (0, 1):
        other = np.flatnonzero(half == h)
        x[other] = Scorer(Model(counts[1 - h])).features([texts[i] for i in other])
    for c in (0, 1):
        counts[0][c].update(counts[1].pop(c))
    return Scorer(Model(counts[0]), fit_layer(x, y))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """toxic, h, text: of each class at most max_rows distinct labelled texts that are not held out, those with the smallest hashes (of texts, without their last bit).

    They are chosen by hashes alone; then only the chosen texts are fetched.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct().where(~held_out())
    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    hashed = stash(known.join(docs.select("doc_id", h), "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id")), "labelled")
    # of a large class a multiple of max_rows is numbered, chosen by a bound on the hash, so no window holds a whole class
    size = {r.toxic: r.n for r in hashed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two classes
    key = F.shiftrightunsigned("h", 1)
    near = F.lit(False)
    for y, n in size.items():
        near = near | ((F.col("toxic") == y) & (key <= int(min(1.0, 4 * max_rows / n) * (2**63 - 1024))) if n > 8 * max_rows else F.col("toxic") == y)
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(key, "h"))
    wanted = stash(hashed.where(near).withColumn("place", place).where(F.col("place") <= max_rows).select("doc_id", "h", "toxic"), "sample")
    unstash(hashed)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h).join(F.broadcast(wanted), ["doc_id", "h"])  # at most 2 * max_rows rows are broadcast
    return texts.groupBy("toxic", "h").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> bytes:
    """`train` on the sample, in one task: it gets no more than the sample's bound. The result is packed and may be empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"toxic": [], "text": []}), *batches])
        scorer = train(rows["text"].tolist(), rows["toxic"].astype(int).tolist())
        yield pd.DataFrame({"fitted": [zlib.compress(pickle.dumps((scorer.model, scorer.layer), 5), 1)]})

    rows = sample(docs, labels, max_rows).repartition(1).sortWithinPartitions(F.desc("toxic"), "h").select("toxic", "text")
    found = rows.mapInPandas(run, "fitted binary").first()
    return bytes(found[0]) if found else b""


@lru_cache(maxsize=1)
def unpacked(fitted: bytes) -> tuple[Model | None, np.ndarray | None]:
    """Model and layer, once for all tasks that a worker runs."""
    return pickle.loads(zlib.decompress(fitted)) if fitted else (None, None)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def scorer(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """A function of a text column: struct(score double, predicted int). Nothing but the texts goes to Python."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))  # bounded by max_rows texts of each class

    @F.pandas_udf("score double, predicted int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(*unpacked(shared.value))
        for texts in batches:
            s = own.scores(texts.tolist())
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return run


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = docs.select("doc_id", scorer(docs, labels, max_rows)(F.col("text")).alias("result"))
    return out.select("doc_id", held_out().alias("held_out"), "result.score", "result.predicted")


def ordinary(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that are not predicted to be toxic; all columns as they are."""
    return docs.where(scorer(docs, labels, max_rows)(F.col("text"))["predicted"] == 0)
