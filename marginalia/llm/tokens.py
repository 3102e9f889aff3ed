"""Token ids of whole texts by a tokenizers file, with a cache of space-separated units.

Both tokenizer files used here never join characters across one plain space that stands between two other characters,
so the ids of a text are those of its units in order. A unit of Latin letters with at most one mark after it goes
straight to the library's BPE model; any other goes through the whole library tokenizer. (`tests/llm` checks the ids
against the library on whole texts.) Where the same vocabulary also lies there as ranks, a text of plain characters
only is encoded by those at once, after a check that both files agree: the ids are the same, and take less time.
A text that holds the literal of a special token goes through the library whole, which gives that token's own id.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Units kept by a worker before its cache starts anew; bounds its memory.
CACHE = 800_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}


def ranked_encoding(path: str, vocab: dict[str, int]):
    """The vocabulary at path as ranks of byte strings; ValueError unless every rank is the id of the same bytes in vocab."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    chars = _byte_chars()
    if any(vocab.get(token.decode("latin-1").translate(chars)) != rank for token, rank in ranks.items()):
        raise ValueError(f"{path} holds another vocabulary")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class UnitTokenizer:
    """ids(text) as the tokenizers library gives them with add_special_tokens=False.

    byte_level: a unit keeps the space before it (byte-level BPE, case kept); otherwise white space only separates
    and letters are lower-cased.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
    #: Characters that every engine of expressions puts in the same class.
    SAFE = re.compile("[\n !-~¡-¬®-ſ‐-‟…€]*")
    #: What Python takes for white space and the tokenizer's expression may not.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str, byte_level: bool, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        literals = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        #: In any case, as a normalizer may lower it; the library decides.
        self.special = re.compile("|".join(map(re.escape, literals)), re.I) if literals else None
        self.model, self.chars = self.tok.model, _byte_chars()
        self.byte_level, self.limit = byte_level, cache
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranked = ranked_encoding(ranks, self.tok.get_vocab()) if byte_level and os.path.exists(ranks) else None
        self.cache: dict[str, bytes] = {}  # ids of units as they stand
        self.spaced: dict[str, bytes] = {}  # byte level: ids of units with a space before them, kept without it

    def _piece(self, piece: str) -> bytes:
        """Ids of Latin letters alone, with or without a space before them."""
        text = (piece if self.byte_level else piece.lower()).encode().decode("latin-1").translate(self.chars)
        return array("H", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _fill(self, missing: set[str], cache: dict[str, bytes], space: str = "") -> None:
        """Put the ids of the missing units into the cache."""
        hard = []
        for u in missing:
            m = self.PLAIN.fullmatch(u)
            if m is None:
                hard.append(u)
                continue
            word, mark = m[1], m[2]
            ids = cache.get(word)
            if ids is None:
                ids = cache[word] = self._piece(space + word)
            if mark:
                cache[u] = ids + array("H", [t.id for t in self.model.tokenize(mark)]).tobytes()
        for i in range(0, len(hard), 10_000):
            part = hard[i : i + 10_000]
            for u, e in zip(part, self.tok.encode_batch_fast([space + u for u in part], add_special_tokens=False), strict=True):
                cache[u] = array("H", e.ids).tobytes()

    def _look(self, units: list[str], cache: dict[str, bytes], space: str = "") -> bytes:
        if missing := set(units).difference(cache):
            self._fill(missing, cache, space)
        return b"".join(map(cache.__getitem__, units))

    def ids(self, text: str | None) -> np.ndarray:
        """uint16 ids of the text (both vocabularies are below 65,536)."""
        text = text or ""
        if self.special and self.special.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)
        if self.ranked and self.SAFE.fullmatch(text):
            return np.array(self.ranked.encode_ordinary(text), np.uint16)
        if len(self.cache) + len(self.spaced) > self.limit:
            self.cache.clear()
            self.spaced.clear()
        if not self.byte_level:
            return np.frombuffer(self._look(text.split() if not self.ODD.search(text) else [u for u in text.split(" ") if u], self.cache), "<u2")
        lines = [line.split(" ") for line in text.split("\n")]
        if text.split() == [w for line in lines for w in line]:  # only single spaces and line ends, each between two words
            newline = self._look(["\n"], self.cache)
            return np.frombuffer(newline.join([self._look(w[:1], self.cache) + self._look(w[1:], self.spaced, " ") for w in lines]), "<u2")
        units, now = [], ""
        for i, p in enumerate(text.split(" ")):  # a plain space between two characters that are no white space ends a unit
            if i and p and now and not p[0].isspace() and not now[-1].isspace():
                units.append(now)
                now = " " + p
            else:
                now += " " * (i > 0) + p
        return np.frombuffer(self._look([*units, now] if now else units, self.cache), "<u2")


@lru_cache(maxsize=2)
def unit_tokenizer(path: str, byte_level: bool) -> UnitTokenizer:
    """One tokenizer for all tasks that a worker runs, with what its bounded cache holds."""
    return UnitTokenizer(path, byte_level)
