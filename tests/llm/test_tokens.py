"""Unit tokenization against the library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from marginalia.llm.tokens import UnitTokenizer, tokenizer_path

PIECES = ["the", "Éçeau", "naïve", "x" * 30, "12345", "3.14", "don't", "'s", "...", "!?", "\n", "\n\n", "\t", "  ", " ", "日本語", "🙂👍🏽", "a_b", "A.B.", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endo", "ftext|>", "<|endoftext|> ", "ſß", "é", "\r\n", "word.", "Ωmega", " ", "１２"]


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_library_s(name, byte_level):
    lib = Tokenizer.from_file(tokenizer_path(name))
    unit = UnitTokenizer(tokenizer_path(name), byte_level, cache=50)
    r = random.Random(3)
    texts = ["", " ", "\n", *PIECES]
    for _ in range(3000):
        sep = r.choice(["", " ", " ", "\n"])
        texts.append(sep.join(r.choice(PIECES) for _ in range(r.randint(1, 40))))
    for t in texts:
        assert unit.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert unit.ids(None).tolist() == []


@pytest.mark.parametrize("name,byte_level,want", [("byte_bpe_50k.json", True, [64, 220, 50256, 275]), ("word_bpe_49k.json", False, [320, 49407, 321])])
def test_special_tokens_keep_their_ids(name, byte_level, want):
    assert UnitTokenizer(tokenizer_path(name), byte_level).ids("a <|endoftext|> b").tolist() == want


def test_plain_texts_by_ranks():
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    unit = UnitTokenizer(tokenizer_path("byte_bpe_50k.json"), True)
    assert unit.ranked is not None
    r = random.Random(9)
    every = [c for c in map(chr, [*range(10, 0x180), *range(0x2010, 0x2030), 0x20AC]) if unit.SAFE.fullmatch(c)]
    for _ in range(400):
        t = "".join(r.choice(every) if r.random() < 0.6 else r.choice("  \n'abcst") for _ in range(r.randint(1, 120)))
        assert unit.SAFE.fullmatch(t) and unit.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
