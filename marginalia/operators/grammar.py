"""Grammars over sequences of tokens.

Each token of a sentence is coded in one letter by its class, its word or the dictionary it was found in; the letters
of a sentence make a string, a rule is a regular expression over it, and a match is a span of tokens. Phases follow
each other: what one finds can be coded anew for the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.model import cut_lineage
from marginalia.operators.rules import PHASES, control, entity_spans
from marginalia.operators.spans import matched, span_join
from marginalia.operators.tokens import sentence_numbers, tokenize


@dataclass(frozen=True)
class SequenceRule:
    """An expression over letters; where several match at one place the control style and then the order decide."""

    pattern: str
    type: str
    features: dict[str, str] = field(default_factory=dict)


def match_sequences(tokens: DataFrame, rules: list[SequenceRule], code: str = "code", style: str = "appelt", by: tuple[str, ...] = ("sent_no",)) -> DataFrame:
    """doc_id, start, stop, first, last (token numbers), codes, rule_no, type, features of the matches kept.

    tokens: doc_id, by, tok_no, start, stop and the letter in `code`. One shuffle gathers sentences; all rules run in one pass.
    """
    keys = ["doc_id", *by]
    seq = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_no", "start", "stop", F.col(code).alias("c")))).alias("s"))
    seq = seq.withColumn("codes", F.array_join(F.transform("s", lambda x: x["c"]), ""))

    def found(n: int, r: SequenceRule) -> Column:
        gaps = F.split("codes", r.pattern, -1)
        hits = F.regexp_extract_all("codes", F.lit(f"({r.pattern})"), F.lit(1))
        before = lambda arr, i: F.aggregate(F.slice(arr, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(hits, lambda h, i: F.struct(F.lit(n).alias("rule_no"), h.alias("codes"), (before(gaps, i + 1) + before(hits, i)).alias("at")))

    every = F.flatten(F.array(*[found(n, r) for n, r in enumerate(rules)]))
    rows = seq.select(*keys, "s", F.explode(every).alias("m")).select(*keys, "m.*", F.slice("s", F.col("m.at") + 1, F.length("m.codes")).alias("t"))
    rows = rows.select(*keys, "rule_no", "codes", F.col("t")[0]["start"].alias("start"), F.element_at("t", -1)["stop"].alias("stop"), F.col("t")[0]["tok_no"].alias("first"), F.element_at("t", -1)["tok_no"].alias("last"))
    kept = control(rows, style, "rule_no", keys=("doc_id", *by))
    pick = lambda values: reduce(lambda acc, nv: F.when(F.col("rule_no") == nv[0], nv[1]).otherwise(acc), list(enumerate(values)), F.lit(None))
    maps = [F.create_map(*[F.lit(x) for kv in r.features.items() for x in kv]) if r.features else F.create_map().cast("map<string,string>") for r in rules]
    return kept.withColumns({"type": pick([F.lit(r.type) for r in rules]), "features": pick(maps)})


def code_of(pairs: list[tuple[Column, str]], other: str = "o") -> Column:
    """The letter of the first condition that holds."""
    out = F.lit(other)
    for condition, letter in reversed(pairs):
        out = F.when(condition, letter).otherwise(out)
    return out


# ---- verb groups -------------------------------------------------------------------------------------------------

ADVERB = "[rx]*"


def verb_code(string: Column, tag: Column) -> Column:
    """Letters of verb groups: H have, h had, a am, w was, e be, n been, g being, W will, M may, D do, E did, t to, v go, z goes, d went, N gone, G going, r adverb, x not."""
    w = F.lower(string)
    words = [("x", "not n't never"), ("H", "have has 've"), ("h", "had"), ("a", "am is are 'm 're"), ("w", "was were"), ("e", "be"), ("n", "been"), ("g", "being"), ("W", "will shall 'll wo"), ("D", "do does"), ("E", "did")]
    tags = [("M", "MD"), ("t", "TO"), ("v", "VB"), ("z", "VBZ"), ("z", "VBP"), ("d", "VBD"), ("N", "VBN"), ("G", "VBG"), ("r", "RB")]
    return code_of([*[(w.isin(ws.split()), c) for c, ws in words], *[(tag == t, c) for c, t in tags]])


def verb_rules() -> list[SequenceRule]:
    """Verb groups by tense, voice and kind, made of the forms of their auxiliaries.

    A perfect ends in a participle, a continuous form in -ing, a passive in a participle after a form of be; each
    auxiliary gives the form of what follows it. So every group is a chain: (modal, to or nothing), have?, be (continuous)?,
    be (passive)?, verb.
    """
    out: list[SequenceRule] = []
    # finite heads: (kind, time, have, be, plain verb)
    heads = [("finite", "Pre", "H", "a", "[zv]"), ("finite", "Pas", "h", "w", "d"), ("finite", "Fut", f"W{ADVERB}[Hv]", f"W{ADVERB}e", f"W{ADVERB}v"), ("modal", "Modal", f"M{ADVERB}[Hv]", f"M{ADVERB}e", f"M{ADVERB}v"), ("infinitive", "Inf", f"t{ADVERB}[Hv]", f"t{ADVERB}e", f"t{ADVERB}v")]
    for kind, time, have, be, plain in heads:
        add = lambda aspect, voice, *chain, kind=kind, time=time: out.append(SequenceRule(ADVERB.join(chain), "VG", {"kind": kind, "tense": f"{aspect}{time}", "voice": voice}))
        add("PerCon", "passive", have, "n", "g", "N")
        add("PerCon", "active", have, "n", "G")
        add("Per", "passive", have, "n", "N")
        add("Per", "active", have, "[Nn]")
        add("Con", "passive", be, "g", "N")
        add("Con", "active", be, "[Gg]")
        add("Sim", "passive", be, "N")
        add("Sim", "active", plain)
    out += [SequenceRule(f"D{ADVERB}v", "VG", {"kind": "finite", "tense": "SimPre", "voice": "active"}), SequenceRule(f"E{ADVERB}v", "VG", {"kind": "finite", "tense": "SimPas", "voice": "active"})]
    out += [SequenceRule(p, "VG", {"kind": "finite", "tense": t, "voice": "active"}) for p, t in (("[aHD]", "SimPre"), ("[whE]", "SimPas"), (f"W{ADVERB}e", "SimFut"))]
    out += [SequenceRule(f"g{ADVERB}N", "VG", {"kind": "participle", "tense": "Pre", "voice": "passive"}), SequenceRule("[Gg]", "VG", {"kind": "participle", "tense": "Pre", "voice": "active"}), SequenceRule("[Nn]", "VG", {"kind": "participle", "tense": "Pas", "voice": "passive"})]
    return out


def verb_groups(tagged: DataFrame) -> DataFrame:
    """Verb groups of tokens (doc_id, sent_no, tok_no, start, stop, string, tag): span, kind, tense, voice, negated."""
    coded = tagged.withColumn("code", verb_code(F.col("string"), F.col("tag")))
    g = match_sequences(coded, verb_rules())
    f = F.col("features")
    return g.select("doc_id", "first", "last", "start", "stop", f["kind"].alias("kind"), f["tense"].alias("tense"), f["voice"].alias("voice"), F.col("codes").contains("x").alias("negated"))


# ---- names -------------------------------------------------------------------------------------------------------

# Words that tell what kind of name stands next to them.
NAME_WORDS = {
    "T": "Mr Mrs Ms Miss Dr Prof Professor Sir Lord Lady Dame President Senator Judge Captain General",
    "C": "Ltd Limited Inc Corp Corporation PLC GmbH AG LLC Group Holdings",
    "K": "University College Institute Ministry Department Bank Church Council Committee Association Agency",
    "L": "River Lake Mount Valley Island Bay Street Park Bridge Ocean Sea",
    "J": "president minister chairman director manager secretary spokesman professor engineer editor",
    "S": "says said added told",
    "i": "in at near from to",
    "f": "of",
    "d": "the The",
    "&": "and &",
}
# End of fixed values.
#: Letters of dictionary types, in order of precedence.
DICTIONARY_CODES = {"first_name": "F", "surname": "N", "location": "P", "organization": "O", "country": "P"}
_U = "[UFNAPO]"  # a capitalised word of any kind
_W = "[UFNAPOLK]"  # or one that may be part of a company's name
NAME_PHASE = [
    SequenceRule(f"TT?[.]?(?:I[.]?)*{_U}+", "Person", {"rule": "PersonTitle"}),
    SequenceRule(f"F+(?:I[.]?)*[UN]{{1,2}}", "Person", {"rule": "PersonFull"}),
    SequenceRule("(?:I[.]?)+[UN]", "Person", {"rule": "PersonInitials"}),
    SequenceRule("F+", "Person", {"rule": "FirstName"}),
    SequenceRule(f"{_W}+(?:&{_W}+)?C+", "Organization", {"rule": "CompanyEnding"}),
    SequenceRule(f"Kfd?{_U}+", "Organization", {"rule": "KeyOf"}),
    SequenceRule(f"{_U}+K", "Organization", {"rule": "NameKey"}),
    SequenceRule("O+", "Organization", {"rule": "Dictionary"}),
    SequenceRule("LUU?|U{1,3}L", "Location", {"rule": "LocationKey"}),
    SequenceRule("P+", "Location", {"rule": "Dictionary"}),
    SequenceRule("J", "JobTitle", {"rule": "JobTitle"}),
    SequenceRule("[UA]+", "Unknown", {"rule": "Unknown"}),
]
#: Unknown names next to a clue, looked for among what the first phase left; Q: an unknown name, p: a person, q: an organization.
CONTEXT_PHASE = [
    SequenceRule("Q(?=,?[0-9]|S)", "Person", {"rule": "PersonContext"}),
    SequenceRule("(?<=J)Q", "Person", {"rule": "JobTitlePerson"}),
    SequenceRule("(?<=S)Q", "Person", {"rule": "SaysPerson"}),
    SequenceRule("(?<=i)Q", "Location", {"rule": "LocationContext"}),
    SequenceRule("(?<=q&)Q", "Organization", {"rule": "OrgConjOrg"}),
]


def name_codes(tokens: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Code of each token for the name rules: words that tell names, then the dictionary type (lookups: doc_id, start, stop, kind), then its case."""
    s, orth = F.col("string"), F.col("orth")
    if lookups is not None:
        rank = {k: i for i, k in enumerate(DICTIONARY_CODES)}
        order = reduce(lambda acc, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(acc), rank.items(), F.lit(len(rank)))
        known = lookups.select("doc_id", "start", "stop", order.alias("rank"))
        hit = span_join(tokens.select("doc_id", "tok_no", "start", "stop").withColumn("ann_id", F.col("tok_no")), known, "within").groupBy("doc_id", "tok_no").agg(F.min("b_rank").alias("_rank"))
        tokens = tokens.join(hit, ["doc_id", "tok_no"], "left")
    else:
        tokens = tokens.withColumn("_rank", F.lit(None).cast("int"))
    dictionary = [(F.col("_rank") == i, c) for i, c in enumerate(DICTIONARY_CODES.values())]
    words = [(s.isin(w.split()), c) for c, w in NAME_WORDS.items()]
    shape = [(s.rlike(r"^\p{Lu}$"), "I"), (orth == "upperInitial", "U"), (orth == "allCaps", "A"), (s == ".", "."), (s == ",", ","), (F.col("kind") == "number", "0")]
    return tokens.withColumn("code", code_of([*words, *dictionary, *shape])).drop("_rank")


def find_names(tokens: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Names of visible tokens (doc_id, sent_no, tok_no, start, stop, string, kind, orth): doc_id, start, stop, type, rule.

    Two phases: names by titles, endings, keys and dictionaries; then unknown names by the words next to them.
    """
    first = match_sequences(name_codes(tokens, lookups), NAME_PHASE)
    letter = code_of([(F.col("type") == "Unknown", "Q"), (F.col("type") == "Person", "p"), (F.col("type") == "Organization", "q"), (F.col("type") == "JobTitle", "J")], "u")
    # one letter for each name found, and the tokens outside of names as they are
    inside = first.select("doc_id", F.explode(F.sequence("first", "last")).alias("tok_no"))
    outside = name_codes(tokens).join(inside, ["doc_id", "tok_no"], "left_anti").select("doc_id", "sent_no", "tok_no", "start", "stop", "code")
    again = outside.unionByName(first.select("doc_id", "sent_no", F.col("first").alias("tok_no"), "start", "stop", letter.alias("code")))
    second = match_sequences(again, CONTEXT_PHASE).select("doc_id", "start", "stop", F.col("type").alias("_type"), F.col("features")["rule"].alias("_rule"))
    j = first.select("doc_id", "start", "stop", "type", F.col("features")["rule"].alias("rule")).join(second, ["doc_id", "start", "stop"], "left")
    return j.select("doc_id", "start", "stop", F.coalesce("_type", "type").alias("type"), F.coalesce("_rule", "rule").alias("rule"))


def entity_cascade(docs: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """doc_id, start, stop, type, rule of all phases: addresses, amounts, dates and identifiers by expressions, then names by
    rules over coded tokens, unknown ones last.

    A match that overlaps one of an earlier phase goes; inside a phase the longer goes first, then the earlier.
    """
    facts = entity_spans(docs, PHASES).select("doc_id", "start", "stop", "type", F.col("type").alias("rule"), F.col("rule_no").alias("phase"))
    t = numbered(tokens_of(docs))
    names = find_names(t, lookups)
    last = F.when(F.col("type") == "Unknown", len(PHASES) + 1).otherwise(len(PHASES))
    every = cut_lineage(facts.unionByName(names.withColumn("phase", last)))
    every = every.withColumn("ann_id", F.xxhash64("doc_id", "start", "stop", "type", "rule"))
    size = F.col("stop") - F.col("start")
    before = (F.col("b_phase") < F.col("phase")) | (F.col("b_phase") == F.col("phase")) & ((F.col("b_stop") - F.col("b_start") > size) | (F.col("b_stop") - F.col("b_start") == size) & (F.col("b_start") < F.col("start")))
    return matched(every, every.select("doc_id", "start", "stop", "phase"), "overlap", keep=False, extra=before).select("doc_id", "start", "stop", "type", "rule")


def tokens_of(docs: DataFrame) -> DataFrame:
    return sentence_numbers(tokenize(docs))


def numbered(tokens: DataFrame) -> DataFrame:
    """Tokens without white space, numbered anew so that neighbours have neighbouring numbers."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    return tokens.where(~F.col("string").rlike(r"^[ \t\n\r\f]$")).withColumn("tok_no", F.row_number().over(w))
