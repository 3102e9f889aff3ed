"""Column functions over strings: case, token classes, accents, string similarity."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transliteration of lower-cased letters.
ACCENTED = "áàăâåãąāḃćĉčċçďḋđéèĕêěëėęēḟƒğĝġģĥħíìîïĩįīĵķĺľļłṁńňñņóòôőõōơṗŕřŗśŝšṡşșťṫţțŧúùŭûůűũųūưẃẁŵẅýỳŷÿźžżµ"
UNDECOMPOSED = {"đ": "d", "ƒ": "f", "ħ": "h", "ł": "l", "ŧ": "t", "µ": "u"}
CYRILLIC = "абвгдеёзийклмнопрстуфхцыэ"
CYRILLIC_TO = "abvgdeezijklmnoprstufhcye"
SEVERAL = {"ä": "ae", "æ": "ae", "ð": "dh", "ö": "oe", "ø": "oe", "ß": "SS", "ü": "ue", "þ": "th", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "ju", "я": "ja"}
# End of fixed values.

ASCII_PUNCT = r"!-/:-@\[-`{-~"
SPLIT_WORDS = f"[_ {ASCII_PUNCT}]+"


def plain_letter(c: str) -> str:
    return UNDECOMPOSED.get(c) or unicodedata.normalize("NFD", c)[0]


def strip_accents(c: Column) -> Column:
    """Transliterate lower-case accented Latin and Cyrillic letters."""
    c = F.translate(c, ACCENTED + CYRILLIC, "".join(map(plain_letter, ACCENTED)) + CYRILLIC_TO)
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), SEVERAL.items(), c)


def normalise(c: Column) -> Column:
    """Lower case, runs of white space and ASCII punctuation to one space, trimmed, letters transliterated; null stays null."""
    return strip_accents(F.trim(F.regexp_replace(F.lower(c), rf"[\s{ASCII_PUNCT}]+", " ")))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def count_of(c: Column, kind: str) -> Column:
    """How many characters of a Unicode class a string has."""
    return F.length(F.regexp_replace(c, rf"[^\p{{{kind}}}]", ""))


def case_of(c: Column) -> Column:
    """EMPTY, UPPER, UPPERINITIAL, LOWER or OTHER; the first letter is judged apart from the others."""
    first = c.rlike(r"^\p{Lu}")
    rest = F.substring(c, 2, 2**30)
    upper, lower = rest.rlike(r"\p{Lu}"), rest.rlike(r"\p{Ll}")
    return F.when(c == "", "EMPTY").when(first & ~lower, "UPPER").when(first & ~upper, "UPPERINITIAL").when(~first & ~upper, "LOWER").when(c.isNotNull(), "OTHER")


def token_kind(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{L}"), "word").when(c.rlike(r"^\p{N}"), "number").when(c == " ", "space").when(c.rlike(r"^[\t\n\r\f]"), "control").when(c.rlike(r"^\p{P}"), "punctuation").otherwise("symbol")


def token_orth(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{Lu}\p{Ll}*$"), "upperInitial").when(c.rlike(r"^\p{Lu}+$"), "allCaps").when(c.rlike(r"^\p{Ll}+$"), "lowercase").when(c.rlike(r"^\p{L}+$"), "mixedCaps")


def sentence_case(c: Column) -> Column:
    """upper, title, sentence, lower or anomalous by the shares of capitals among letters and initials; else null."""
    words = F.filter(F.split(c, SPLIT_WORDS), lambda w: w != "")
    initials = F.transform(words, lambda w: F.substring(w, 1, 1))
    up, low = F.lit(0.001) + count_of(c, "Lu"), F.lit(0.001) + count_of(c, "Ll")
    ups = F.lit(0.001) + F.size(F.filter(initials, lambda w: w.rlike(r"\p{Lu}")))
    lows = F.lit(0.001) + F.size(F.filter(initials, lambda w: w.rlike(r"\p{Ll}")))
    head = F.substring(c, 1, 1)
    cased = F.when(head.rlike(r"\p{Lu}"), F.when(ups / lows > 1, "title").otherwise("sentence"))
    return F.when(up / low > 5, "upper").otherwise(F.coalesce(cased, F.when(head.rlike(r"\p{Ll}"), F.when(low / up > 5, "lower").otherwise("anomalous"))))


def name_words(c: Column) -> Column:
    return F.filter(F.split(c, SPLIT_WORDS), lambda w: F.trim(w) != "")


def _acronym(short: Column, full: Column) -> Column:
    """Share of letters of a single word that are the initials of the other name, over letters and words together."""
    letters = F.filter(F.split(F.upper(short[0]), ""), lambda x: x != "")
    same = F.size(F.filter(F.zip_with(letters, full, lambda a, b: a == F.upper(F.substring(b, 1, 1))), lambda x: x))
    fits = (F.size(short) == 1) & (F.length(F.get(short, F.lit(0))) == F.size(full))
    return F.when(fits, same / (F.size(letters) + F.size(full)))


def name_match(a: Column, b: Column) -> Column:
    """Likeness of two names, 0 to 1: the better of the acronym score and the shared four-letter beginnings of words."""
    x, y = name_words(a), name_words(b)
    p, q = (F.array_distinct(F.transform(w, lambda s: F.substring(s, 1, 4))) for w in (x, y))
    shared = F.size(F.array_intersect(p, q))
    word = F.when(shared > 0, shared / (F.size(p) + F.size(q))).otherwise(0.0)
    return F.greatest(F.coalesce(F.when(F.size(x) == 1, F.coalesce(_acronym(x, y), F.lit(0.0))), F.lit(0.0)), F.coalesce(F.when(F.size(y) == 1, F.coalesce(_acronym(y, x), F.lit(0.0))), F.lit(0.0)), word)


def context_terms(c: Column, stop: list[str]) -> Column:
    """Lower-cased words without stop words, each after a space (also the first), as the vector scorers read texts."""
    words = F.filter(F.transform(F.split(c, SPLIT_WORDS), F.lower), lambda w: (w != "") & ~w.isin(stop))
    return F.concat(F.lit(" "), F.array_join(words, " "))


def camel_split(c: Column) -> Column:
    """Parts of a camel-case string: before a capital after a small letter, and after two or more capitals."""
    return F.split(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z]{2})([a-z])", "$1 $2"), " ")


def dictionary_entry(c: Column, case_sensitive: bool = False) -> Column:
    """A dictionary entry as it is matched: white space of any kind to one space, trimmed, upper case unless case counts."""
    c = F.trim(F.regexp_replace(c, r"[\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))
    return c if case_sensitive else F.upper(c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def pipe_values(c: Column) -> Column:
    """The values of a |-joined string; none for null or empty."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
