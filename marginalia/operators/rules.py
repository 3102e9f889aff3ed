"""Regular-expression annotators: rule files with macros, single rules, entity patterns, and rules over tag sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFERENCES = ("ALL", "FIRSTRULE", "LASTRULE", "LONGEST_FIRSTRULE", "LONGEST_LASTRULE", "LONGEST_ALLRULES")


@dataclass(frozen=True)
class Action:
    groups: tuple[int, ...]
    type: str
    constants: tuple[tuple[str, str], ...] = ()
    captures: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Rule:
    pattern: str
    actions: tuple[Action, ...] = field(default_factory=tuple)


def parse_rules(text: str) -> list[Rule]:
    """Rules of a file: `name=pattern` defines <<name>>, lines with | are alternatives, `groups => Type k="v",k=$n` ends a rule."""
    macros: dict[str, str] = {}
    rules: list[Rule] = []
    patterns: list[str] = []
    actions: list[Action] = []

    def close() -> None:
        if patterns and actions:
            rules.append(Rule("|".join(patterns), tuple(actions)))
        patterns.clear()
        actions.clear()

    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith(("#", "//")):
            continue
        if m := re.fullmatch(r"([\d,\s]+)=>\s*([\w:.\-]+)\s*(.*)", line):
            pairs = re.findall(r'(\w+)\s*=\s*(?:"([^"]*)"|\$(\d+))', m[3])
            actions.append(Action(tuple(int(x) for x in m[1].split(",")), m[2], tuple((k, v) for k, v, n in pairs if not n), tuple((k, int(n)) for k, _, n in pairs if n)))
            continue
        if line.startswith("|"):
            if actions:
                close()
            patterns.append(re.sub(r"<<(\w+)>>", lambda m: macros[m[1]], line[1:]))
        elif m := re.match(r"(\w+)=(.*)", line):
            macros[m[1]] = re.sub(r"<<(\w+)>>", lambda k: macros[k[1]], m[2])
    close()
    return rules


def scan_text(text: str, compiled: list[re.Pattern], preference: str, overlapping: bool) -> list[tuple[int, re.Match]]:
    """(rule number, match) in order; at each place the preference picks among the rules that match there."""
    out: list[tuple[int, re.Match]] = []
    nexts: list[re.Match | None] = [p.search(text) for p in compiled]
    at = 0
    while True:
        nexts = [m if m is None or m.start() >= at else p.search(text, at) for p, m in zip(compiled, nexts, strict=True)]
        live = [(i, m) for i, m in enumerate(nexts) if m is not None]
        if not live:
            return out
        first = min(m.start() for _, m in live)
        here = [(i, m) for i, m in live if m.start() == first]
        longest = max(m.end() for _, m in here)
        if preference.startswith("LONGEST"):
            here = [(i, m) for i, m in here if m.end() == longest]
        if preference.endswith("FIRSTRULE"):
            here = here[:1]
        elif preference.endswith("LASTRULE"):
            here = here[-1:]
        out += here
        at = first + 1 if overlapping else max(first + 1, max(m.end() for _, m in here))
        if at > len(text):
            return out


def annotate(docs: DataFrame, rules: list[Rule], preference: str = "LONGEST_LASTRULE", overlapping: bool = False) -> DataFrame:
    """doc_id, start, stop, type, rule_no, features of every action of every match. Null texts have none."""
    if preference not in PREFERENCES:
        raise ValueError(f"no preference {preference}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.pattern) for r in rules]
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for i, m in scan_text(text or "", compiled, preference, overlapping):
                    for a in rules[i].actions:
                        for g in a.groups:
                            if m.start(g) >= 0:
                                rows.append((doc, m.start(g), m.end(g), a.type, i, dict(a.constants) | {k: m[n] for k, n in a.captures if m[n] is not None}))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "type", "rule_no", "features"])

    schema = docs.select("doc_id").schema.add("start", "integer").add("stop", "integer").add("type", "string").add("rule_no", "integer")
    from pyspark.sql.types import MapType, StringType

    return docs.select("doc_id", "text").mapInPandas(run, schema.add("features", MapType(StringType(), StringType())))


def find_all(df: DataFrame, column: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, match_no (from 0), string of the matches of one rule that do not overlap. Stays in the JVM."""
    return df.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))).alias("match_no", "string"))


# Patterns that the engines of Spark and of SQL data bases read alike: no look-around.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
ENTITIES = {
    "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "Ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "Phone": r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4})?",
    "Url": r"(?:https?|ftp)://[A-Za-z0-9.-]+(?:/[^ \t\n\r\f\"'<>]*)?",
    "Money": r"(?:[$£€] ?[0-9][0-9,.]*(?: ?(?:million|billion|thousand|m|bn|k)\b)?|[0-9][0-9,.]* ?(?:dollars|pounds|euros|USD|GBP|EUR)\b)",
    "Percent": r"[0-9]+(?:\.[0-9]+)? ?(?:%|percent\b|per cent\b)",
    "Date": rf"(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th)? (?:{MONTHS})(?:,? [0-9]{{4}})?|(?:{MONTHS}) [0-9]{{1,2}}(?:st|nd|rd|th)?(?:,? [0-9]{{4}})?)",
    "Time": r"\b[0-9]{1,2}(?::[0-9]{2}){1,2}(?: ?(?:am|pm|AM|PM))?\b|\b[0-9]{1,2} ?(?:am|pm|AM|PM)\b|\b[0-9]{1,2} o'clock\b",
    "Postcode": r"\b[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}\b",
    "Identifier": r"\b[A-Z]+[0-9]+[A-Z0-9]*\b",
    "Street": r"\b[0-9]+ (?:[A-Z][a-z]+ )+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Square|Drive|Close)\b",
}
_DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_SPANS = "second|minute|hour|day|week|month|quarter|year|decade|century"
#: Dates that are told from the day of writing, and lengths of time.
RELATIVE_DATES = (
    rf"\b(?:[Yy]esterday|[Tt]oday|[Tt]omorrow|[Tt]onight)\b|\b(?:[Ll]ast|[Nn]ext|[Tt]his|[Ee]very) (?:{_DAYS}|{MONTHS}|{_SPANS}|spring|summer|autumn|winter|weekend|morning|evening|night)\b"
    rf"|\b(?:[0-9]+|a|an|one|two|three|four|five|six|seven|eight|nine|ten) (?:{_SPANS})s? (?:ago|earlier|later|from now)\b|\b(?:{_DAYS})\b|\b(?:early|mid|late)[ -](?:{MONTHS}|[0-9]{{4}}s?)\b|\b[0-9]{{4}}s\b"
)
#: The phases of the cascade in order of precedence: a match that overlaps one of an earlier phase goes.
PHASES = [
    ("Url", ENTITIES["Url"]), ("Email", ENTITIES["Email"]), ("Ip", ENTITIES["Ip"]), ("Money", ENTITIES["Money"]), ("Percent", ENTITIES["Percent"]), ("Date", ENTITIES["Date"]), ("Time", ENTITIES["Time"]),
    ("Date", RELATIVE_DATES), ("Phone", ENTITIES["Phone"]), ("Street", ENTITIES["Street"]), ("Postcode", ENTITIES["Postcode"]), ("Identifier", ENTITIES["Identifier"]),
]
# Words that tell persons, organizations and places.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Sir|Lord|Lady|Dame|President|Senator|Judge|Captain|General"
FRENCH_TITLES = "M|Mme|Mlle|Docteur|Monsieur|Madame|Mademoiselle|Maître|Président"
COMPANY_ENDINGS = "Ltd|Limited|Inc|Incorporated|Corp|Corporation|PLC|plc|GmbH|AG|SA|LLC|Group|Holdings"
ORGANIZATION_KEYS = "University|College|Institute|Ministry|Department|Bank|Church|Council|Committee|Association|Agency"
LOCATION_KEYS = "River|Lake|Mount|Valley|Island|Bay|Street|Park|Bridge|Ocean|Sea"
JOBS = "president|minister|chairman|director|manager|secretary|spokesman|professor|engineer|editor"
# End of fixed values.
NAME = r"[A-Z][\p{L}'-]+"
NAME_RULES = [
    ("Person", rf"\b(?:{TITLES})\.? (?:[A-Z]\. )*{NAME}(?: {NAME})*"),
    ("Organization", rf"(?:{NAME} )+(?:and {NAME} |& {NAME} )?(?:{COMPANY_ENDINGS})\b"),
    ("Organization", rf"(?:{ORGANIZATION_KEYS}) of (?:the )?{NAME}(?: {NAME})*|(?:{NAME} )+(?:{ORGANIZATION_KEYS})\b"),
    ("Location", rf"(?:{NAME} )+(?:{LOCATION_KEYS})\b|(?:Lake|Mount|River) {NAME}"),
    ("JobTitle", rf"\b(?:{JOBS})\b"),
    ("Person", rf"{NAME}(?: {NAME})*, [0-9]{{1,3}},"),
]
FRENCH_RULES = [
    ("Person", rf"\b(?:{FRENCH_TITLES})\.? {NAME}(?: {NAME})*"),
    ("Organization", rf"(?:Université|Banque|Ministère|Institut|Société) (?:de |du |des |d')?(?:la |l')?{NAME}(?: {NAME})*"),
    ("Location", rf"(?:Mont|Lac|Rue|Place|Avenue) (?:de |du |des |d')?(?:la |l')?{NAME}"),
    ("Date", r"[0-9]{1,2}(?:er)? (?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)(?: [0-9]{4})?"),
    ("Money", r"[0-9][0-9 .,]*(?:€|euros|francs)"),
    ("Percent", r"[0-9]+(?:,[0-9]+)? ?(?:%|pour cent)"),
]


def named_entities(docs: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, rule_no, type, match_no, string of every match of the name rules (each rule on its own)."""
    rules = NAME_RULES if rules is None else rules

    def matches(n: int, type_: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), lambda s, i: F.struct(F.lit(n).alias("rule_no"), F.lit(type_).alias("type"), i.alias("match_no"), s.alias("string")))

    found = F.flatten(F.array(*[matches(n, t, p) for n, (t, p) in enumerate(rules)]))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def find_spans(df: DataFrame, column: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """find_all with start and stop: what stands between the matches is cut out by the same expression, and the lengths are summed up."""
    found = F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(column, pattern, -1), lambda x: F.length(x))
    both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda s, g: F.struct(s.alias("string"), g.alias("gap")))
    rows = df.select(key, F.posexplode(both).alias("match_no", "m")).select(key, "match_no", "m.string", "m.gap")
    stop = F.sum(F.col("gap") + F.length("string")).over(Window.partitionBy(key).orderBy("match_no")).cast("int")
    return rows.withColumn("stop", stop).select(key, "match_no", (F.col("stop") - F.length("string")).alias("start"), "stop", "string")


def entity_spans(docs: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, type, rule_no, start, stop, string of every match of the name rules; `control` picks among them."""
    out = None
    for n, (type_, pattern) in enumerate(NAME_RULES if rules is None else rules):
        one = find_spans(docs, "text", pattern).select("doc_id", F.lit(type_).alias("type"), F.lit(n).alias("rule_no"), "start", "stop", "string")
        out = one if out is None else out.unionByName(one)
    return out


def control(found: DataFrame, style: str, *order: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keep matches as a grammar's control style does: all; appelt (longest from a start, then by the order, and none inside one kept); first (shortest from a start); once (one for each key).

    keys: what matches never cross (a document, or a sentence of it).
    """
    if style == "all":
        return found
    if style == "once":
        w = Window.partitionBy(*keys).orderBy("start", *order)
    else:
        w = Window.partitionBy(*keys, "start").orderBy(F.desc("stop") if style == "appelt" else F.asc("stop"), *order)
    one = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if style != "appelt":
        return one
    # what starts inside an earlier match that was kept goes: walked in order, key by key, in one row
    rest = [c for c in found.columns if c not in keys]
    rows = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest)), lambda a, b: a["start"] - b["start"]).alias("_s"))
    nothing = F.struct(F.lit(-1).cast(found.schema["stop"].dataType).alias("e"), F.filter("_s", lambda x: F.lit(False)).alias("k"))
    kept = F.aggregate("_s", nothing, lambda acc, x: F.when(x["start"] >= acc["e"], F.struct(x["stop"].alias("e"), F.concat(acc["k"], F.array(x)).alias("k"))).otherwise(acc), lambda acc: acc["k"])
    return rows.select(*keys, F.explode(kept).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest]).select(*found.columns)
