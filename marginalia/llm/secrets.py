"""Secret scans: candidates by expressions, false positives removed by a random forest.

Candidates are assigned values (`name = value`; one in quotes up to the closing quote, whatever it holds), blocks between
BEGIN and END lines, and long tokens that hold a digit or are all capitals. The forest sees
their length, the transitions between kinds of characters, how much of them a dictionary covers, whether they stand in
a path or address, and the words next to them; no expression decides by itself. It is trained on labelled findings that
`labelled_findings` writes from fixed templates and seed (`FINDINGS` of them, the same in every run), as no table holds
labels of secrets.

Null and empty texts have no candidates; whole texts of any length are scanned. Repeated rows give repeated findings;
an empty table gives none. Only doc_id and text are read by `scan`; `redact` keeps all columns.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name, tune

FINDINGS, TREES, DEPTH, SEED = 4000, 40, 10, 7
MASK = "[SECRET]"
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]{3,40}-----\s(?P<block>[\s\S]*?)-----END [A-Z ]{3,40}-----"
    r"|[:=][ \t]*(?P<mark>[\"'])(?P<quoted>(?:(?!(?P=mark))[^\n\\]|\\.){6,})(?P=mark)"
    r"|[:=][ \t]*[\"']?(?P<value>[^\s\"',;<>(){}\[\]]{6,})"
    r"|(?<![\w+/=\-])(?P<bare>[A-Za-z0-9+/_\-]{16,}={0,2}(?![=\w]))")  # fmt: skip
KINDS = ("block", "quoted", "value", "bare")
#: A value of fewer characters, out of quotes, needs a name before it that tells of secrets.
SHORT = 8
NAMES = re.compile(r"passw|passwd|pwd|key|secret|token|api.?key|access|credential|auth|private|bearer|login|client", re.I)
HARMLESS = re.compile(r"commit|sha|md5|checksum|digest|hash|uuid|guid|etag|revision|version|isbn|order|invoice|tracking|phone|card|build|example|placeholder|sample", re.I)
DICTIONARY = sorted(set("""able about access account action address after again align alpha analysis answer apple archive array article aside
background bank base batch before below best beta between bind blue board body book border bottom box branch bridge build button cache call
canvas card case cell center change changeme channel char chart check child class clean client close cloud code collect color column comment
commit common component config connect console content control copy core count cover create credential cross current custom data database date
debug default delete delta demo deploy design detail device dialog direct display document dollar domain double down driver dummy edge edit
element email empty enable engine enter entry error event example export extend extra factory false feature fetch field figure file filter final
first float flow focus folder font footer force form format forward frame free from front full function future game gate general get global grand
graph gray green grid group guide handle hash head header height hello help here hidden high home host hover http https icon image import index
info init inner input insert inside install instance int interface internal invoice item java job join json key keyboard label lambda language
large last layer layout left length letter level library light limit line link list load local lock log login logo long loop lower main make
manager map margin mark master match math matrix max media medium member memory menu message meta method middle min mode model module monitor
more mouse move name native navigation need network never new next node none normal note null number object offset online open operator option
order origin other outer output over overflow owner package padding page panel parent parse part pass password path pattern payment people phone
photo picture pixel place placeholder plain plan plate player please plugin point policy pool popup port position post power prefix present
preview price print private process product profile program project property protocol provider proxy public push python query queue quick radio
random range rate reader record redirect reference refresh region register release remote remove render repeat replace report request reset
resource response result return review right role root rotate route row rule sample save scale schema scope screen script scroll search second
secret section security select send sequence server service session set setting shadow shape share sheet shell shift short show side sign simple
single site size skip slide small socket sort source space span spark spring square stack stage standard start state static status step stop
storage store stream string style submit success sum super support switch symbol sync system table target task team template test text theme
thread time title toggle token tool top total touch track transform transition tree true type unique unit update upload upper user util value
variable vector version vertical video view visible wait web weight white width window with word work wrapper write year your zone""".split()), key=len, reverse=True)
COVER = re.compile("|".join(w for w in DICTIONARY if len(w) > 2))


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        s, e = m.span(kind)
        while kind != "quoted" and e > s and text[e - 1] in ".,:!?\n":
            e -= 1
        value = text[s:e]
        if kind == "value" and len(value) < SHORT and not NAMES.search(text[max(0, s - 24) : s]):
            continue
        if value and (kind != "bare" or value.isupper() or any(c.isdigit() for c in value)):
            out.append((s, e))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, start: int, end: int) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 24]
    n = len(value)
    kinds = [_kind(c) for c in value]
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    share = [kinds.count(k) / n for k in range(4)]
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(value).values())
    covered = sum(m.end() - m.start() for m in COVER.finditer(value.lower())) / n
    hexes = sum(c in "0123456789abcdef" for c in value) / n
    vowels = sum(c in "aeiouAEIOU" for c in value) / max(1, kinds.count(0) + kinds.count(1))
    near = before[-24:]
    return [
        n, entropy, *share, sum(v for (a, b), v in moves.items() if a != b) / n, (moves[0, 2] + moves[2, 0]) / n, (moves[1, 2] + moves[2, 1]) / n, (moves[0, 1] + moves[1, 0]) / n,
        covered, hexes, vowels, max(Counter(value).values()) / n,
        value.count("/") / n, value.count("-") / n, value.count(".") / n, float("://" in value or near[-3:] == "://"), float(near[-1:] in "/.\\@#"), float(after[:1] in "/.\\@"),
        float(bool(NAMES.search(near))), float(bool(HARMLESS.search(near))), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(near[-1:] in "\"'"), float(bool(NAMES.search(before))), float(bool(HARMLESS.search(after))),
        float("@" in value), float(value[:1] in "$%{<"), sum(c.isspace() for c in value) / n, max(map(len, re.split(r"[^A-Za-z0-9]+", value))) / n, float("private" in before.lower()), float("certificate" in before.lower() or "public" in before.lower()),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of n findings; 1: a secret."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    up, mixed, hexes, digits = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef", string.digits
    syllables = "an be con de er for in lo mi no or pa re sta ti un ver wa zu che oui ment tion sch eur".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    long_word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(7, 12)))
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_token", "client_secret", "auth", "private_key", "DB_PASSWORD", "SECRET_KEY"]
    secrets = [
        lambda: ("", r.choice(["AKIA", "ASIA"]) + pick(up, 16), ""), lambda: ("key " + word() + " ", "AKIA" + pick(up, 16), ""),
        lambda: (f'{r.choice(names)} = "', pick(hexes, r.choice([32, 40, 40, 64])), '"'), lambda: (f"{r.choice(names)}=", pick(hexes, r.randint(12, 24)), ""),
        lambda: (f"{r.choice(names)}: ", pick(mixed, r.randint(12, 40)), ""), lambda: (f"{r.choice(names)}='", pick(mixed + "!#%&*+-_", r.randint(10, 24)), "'"),
        lambda: ("", r.choice(["ghp_", "gho_", "ghs_"]) + pick(mixed, 36), ""), lambda: ("", r.choice(["sk_live_", "sk-"]) + pick(mixed, 32), ""),
        lambda: ("", "xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24), ""), lambda: ("bearer ", "eyJ" + pick(mixed, 30) + "-" + pick(mixed, 40), ""),
        lambda: ("secret access key ", pick(mixed + "+/", 40), ""), lambda: (f'{r.choice(names)} = "', pick(mixed + "!#$%&()*+,-./:;<=>?@[]^_{|}~", r.randint(9, 24)), '"'),
        lambda: (f"{r.choice(names)}={r.choice(chr(34) + chr(39))}", word()[:4] + pick(mixed, r.randint(4, 8)), '"'), lambda: (f"{r.choice(names)}:" + " " * r.randint(1, 9), word()[:5] + pick(digits, r.randint(2, 4)) + pick(mixed + "!#*", r.randint(3, 8)), ""),
        lambda: ("-----BEGIN " + r.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----\n", "\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(2, 20))), "\n-----END "),
    ]
    harmless = [
        lambda: (r.choice(["commit ", "sha1: ", "revision ", "checksum=", "md5 = ", "etag: \"", "digest: "]), pick(hexes, r.choice([32, 40, 64])), ""),
        lambda: ("", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), ""), lambda: ("uuid=", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("see ", "/".join(r.choice(DICTIONARY) for _ in range(4)) + "/" + word() + pick(digits, 2), ".html"), lambda: ("https:", "//" + word() + ".example/" + word() + "/" + pick(digits, 6), ""),
        lambda: ("card ", pick(digits, 16), ""), lambda: ("", pick(digits, r.randint(16, 20)), ""), lambda: ("order_id=", pick(digits, r.randint(8, 14)), ""),
        lambda: ("mail: ", word() + "." + pick(digits, 2) + "@mail" + pick(digits, 1) + ".example.com", ""), lambda: ("", "_".join(r.choice(DICTIONARY) for _ in range(4)) + pick(digits, 1), ""),
        lambda: (f"{r.choice(names)} = ", r.choice(["your_token_here", "xxxxxxxxxxxx", "changeme123", "${SECRET_TOKEN}", "<password>", "placeholder", "example_key", "os.environ", "********"]), ""),
        lambda: ("version = ", ".".join(pick(digits, 2) for _ in range(4)), ""), lambda: ("name: ", long_word(), ""), lambda: ("", "-".join(word() for _ in range(5)) + pick(digits, 2), ""),
        lambda: ("", (long_word() + word()).upper(), ""), lambda: ("item=", word() + word() + word() + pick(digits, 1), ""), lambda: ("", "=" * r.randint(16, 40) + pick(digits, 1), ""), lambda: ("", "-" * r.randint(16, 40) + pick(digits, 1), ""),
        lambda: (r.choice(["title", "label", "said", "note", "password hint", "text", "key"]) + r.choice([': "', ' = "', ":  '"]), " ".join(word() for _ in range(r.randint(2, 14))), '"'), lambda: (r.choice(["key", "token", "type", "pwd", "secret"]) + r.choice([": ", "="]), word() + r.choice(["", word(), "_" + word()]), ""),
        lambda: ("-----BEGIN " + r.choice(["CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"]) + "-----\n", "\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(2, 20))), "\n-----END "), lambda: (r.choice(["page", "time", "size", "price"]) + r.choice([":", " = "]), pick(digits, r.randint(1, 3)) + r.choice([":", ".", "x", "/"]) + pick(digits, r.randint(4, 6)), ""),
        lambda: (r.choice(["src", "href", "path", "file"]) + '="', "/" + "/".join(word() for _ in range(r.randint(2, 5))) + r.choice([".png", ".html", "", ".js"]), '"'), lambda: ("", pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:12], r.randint(16, 24)), ""),
    ]
    out = []
    for i in range(n):
        label = i % 2
        before, value, after = r.choice(secrets if label else harmless)()
        left = " ".join(word() for _ in range(r.randint(2, 6))) + " "
        text = left + before + value + after + " " + " ".join(word() for _ in range(r.randint(2, 6)))
        start = len(left) + len(before)
        out.append((text, start, start + len(value), label))
    return [f for f in out if f[2] > f[1]]


class Forest:
    """Random forest of binary trees on bootstrap samples, sqrt(features) tried at each node, Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[i], y[i], depth, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
        """Rows: feature (-1: leaf), threshold, left, right, share of ones."""
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, left: int) -> int:
            me, p = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0, 0, 0, p])
            if not left or p in (0.0, 1.0) or len(rows) < 4:
                return me
            best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
                at = np.flatnonzero(v[1:] > v[:-1])
                if not len(at):
                    continue
                n1, o1 = at + 1, ones[at]
                n2, o2 = len(rows) - n1, ones[-1] - o1
                cost = o1 * (1 - o1 / n1) + o2 * (1 - o2 / n2)
                k = int(np.argmin(cost))
                if cost[k] < best[0]:
                    best = (float(cost[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
            if best[1] >= 0:
                below = x[rows, best[1]] <= best[2]
                a = grow(rows[below], left - 1)
                b = grow(rows[~below], left - 1)
                nodes[me] = [best[1], best[2], a, b, p]
            return me

        grow(np.arange(len(x)), depth)
        return np.array(nodes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := t[at, 0] >= 0).any():
                i = np.flatnonzero(inner)
                node = t[at[i]]
                at[i] = np.where(x[i, node[:, 0].astype(np.int64)] <= node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
            total += t[at, 4]
        return total / max(1, len(self.trees))


@lru_cache(maxsize=1)
def forest() -> Forest:
    found = labelled_findings()
    return Forest(np.array([features(t, s, e) for t, s, e, _ in found]), np.array([y for *_, y in found], np.float64))


def findings(texts: list[str | None], model: Forest) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of each text's candidates, in order."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(t, s, e) for t, spans in zip(texts, found, strict=True) for s, e in spans]
    scores = iter(model.scores(np.array(x)) if x else ())
    return [[(s, e, float(next(scores))) for s, e in spans] for spans in found]


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, length, value_crc32, score, is_secret (offsets in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest())  # TREES trees, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for b in batches:
            texts = b["text"].tolist()
            rows = [(d, s, e - s, zlib.crc32(t[s:e].encode("utf-8", "surrogatepass")), p, p >= threshold) for d, t, spans in zip(b["doc_id"].tolist(), texts, findings(texts, shared.value), strict=True) for s, e, p in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "value_crc32", "score", "is_secret"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, docs.select("doc_id").schema.add("start", "long").add("length", "long").add("value_crc32", "long").add("score", "double").add("is_secret", "boolean"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with each secret replaced by MASK and n_chars counted anew where a text changed. Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(forest())

    @F.pandas_udf("text string, changed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, texts = [], b.tolist()
            for text, spans in zip(texts, findings(texts, shared.value), strict=True):
                for s, e, p in reversed(spans):
                    if p >= threshold:
                        text = text[:s] + MASK + text[e:]
                out.append(text)
            yield pd.DataFrame({"text": pd.Series(out, dtype=object), "changed": [x is not y for x, y in zip(out, texts, strict=True)]})

    tune(docs.sparkSession)
    name = free_name(docs, "redacted")
    masked = docs.withColumn(name, run(F.col("text")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for i, field in enumerate(docs.schema):
        if field.name == "text":
            columns[i] = F.col(name)["text"].alias("text")
        elif field.name == "n_chars":
            columns[i] = F.when(F.col(name)["changed"], F.char_length(F.col(name)["text"]).cast(field.dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return masked.select(*columns)
