"""Candidates of mentions: their list algebra and the filters before scoring.

candidates (doc_id, mention_id, inst, label, ...) belong to mentions (doc_id, mention_id, start, stop, string, ...) by key,
so a list without candidates simply has no rows, and a removed mention takes its candidates along by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import pipe_values
from marginalia.model import cut_lineage
from marginalia.operators.spans import matched, span_join

KEY = ["doc_id", "mention_id"]
# Classes whose members are no candidates.
BLOCKED_CLASSES = [f"dbpo:{c}" for c in """Activity Aircraft Amphibian Animal AnimangaCharacter Anime Arachnid ArtistDiscography Asteroid Award Bacteria Biomolecule Bird Bone Brain Cave
CelestialBody ChemicalCompound Colour Conifer Convention Crustacean CultivatedVariety Currency Drug Embryology Enzyme EthnicGroup Eukaryote Fern
FilmFestival Fish FloweringPlant Food Fungus Galaxy GivenName Insect Language Legislature Locomotive LunarCrater Mammal MilitaryConflict
MilitaryStructure Mineral MixedMartialArtsEvent Mollusca MusicGenre MusicFestival Nerve OlympicResult PersonFunction Planet Plant ProgrammingLanguage
Protein PublicTransitSystem Race RaceHorse RailwayTunnel Religious Reptile Road Rocket Ship SiteOfSpecialScientificInterest SpaceMission SpaceShuttle
SpaceStation Species Star SupremeCourtOfTheUnitedStatesCase Tax Train Vein Volcano Weapon Year WorldHeritageSite""".split()]
CLASS_FEATURES = ["airp_specific", "airp_interesting", "dbp_specific", "dbp_interesting"]
# End of fixed values.


def from_label_info(mentions: DataFrame, label_info: DataFrame, fields: str) -> DataFrame:
    """One row for each candidate in the JSON array `info` of the mention's label; mentions without a label have none."""
    rows = label_info.select("label", F.explode(F.from_json("info", f"array<struct<{fields}>>")).alias("c")).select("label", "c.*")
    return mentions.join(rows, "label")


def keep_insts(cands: DataFrame, other: DataFrame) -> DataFrame:
    """Candidates whose inst is in the other list of the same mention (other: doc_id, mention_id, inst)."""
    return cands.join(other.select(*KEY, "inst").distinct(), [*KEY, "inst"], "left_semi")


def of_mentions(cands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates of the mentions that are left; dangling ones go."""
    return cands.join(mentions.select(*KEY).distinct(), KEY, "left_semi")


def merge_lists(cands: DataFrame, into: DataFrame, *keys: str) -> DataFrame:
    """Candidates moved to another mention (into: doc_id, mention_id, target), of equal keys one (the least row) in a list."""
    keys = keys or ("inst", "label")
    to = cands.join(into, KEY, "left").withColumn("mention_id", F.coalesce("target", "mention_id")).drop("target")
    rest = [c for c in cands.columns if c not in (*KEY, *keys)]
    if not rest:
        return to.select(*KEY, *keys).distinct()
    return to.groupBy(*KEY, *keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, *keys, *[F.col("_r")[c].alias(c) for c in rest])


def top(cands: DataFrame, feature: str, n: int, keep_null: bool = True) -> DataFrame:
    """The n candidates of each mention with the largest value; nulls last (or out), ties by inst."""
    df = cands if keep_null else cands.where(F.col(feature).isNotNull())
    w = Window.partitionBy(*KEY).orderBy(F.col(feature).desc_nulls_last(), "inst")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def clone(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies of lists for other mentions (pairs: doc_id, mention_id, clone_id)."""
    return cands.join(pairs, KEY).withColumn("mention_id", F.col("clone_id")).drop("clone_id")


def merge_coextensive(mentions: DataFrame) -> DataFrame:
    """mention_id -> target: the first mention with the same extent."""
    w = Window.partitionBy("doc_id", "start", "stop")
    return mentions.select(*KEY, F.min("mention_id").over(w).alias("target"))


def classes(df: DataFrame) -> Column:
    return F.array_distinct(F.flatten(F.array(*[pipe_values(F.col(c)) for c in CLASS_FEATURES if c in df.columns])))


def drop_blocked(cands: DataFrame, blocked: list[str] | None = None, untyped_too: bool = False) -> DataFrame:
    """Candidates with a blocked class (or, if asked, with none) go."""
    own = classes(cands)
    fine = ~F.arrays_overlap(own, F.lit(blocked or BLOCKED_CLASSES))
    return cands.where(fine & (F.size(own) > 0) if untyped_too else fine)


def of_class(cands: DataFrame, cls: str) -> DataFrame:
    interesting = F.concat(pipe_values(F.col("airp_interesting")), pipe_values(F.col("dbp_interesting")))
    return cands.where(F.array_contains(interesting, cls))


def frequent(cands: DataFrame, least: float = 0, most: int = 10, feature: str = "freq") -> DataFrame:
    """Candidates without a frequency or below `least` go, then the `most` most frequent ones of a mention stay."""
    return top(cands.where(F.col(feature) >= least), feature, most)


def comma_pairs(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs of mentions with only a comma (and white space) between them: doc_id, first_id, second_id."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    seen = tokens.where(~F.col("string").rlike(r"^[ \t\n\r\f]$"))
    comma = seen.withColumns({"a": F.lag("stop").over(w), "z": F.lead("start").over(w)}).where("string = ','").select("doc_id", "a", "z")
    first = mentions.select("doc_id", F.col("mention_id").alias("first_id"), F.col("stop").alias("a"))
    second = mentions.select("doc_id", F.col("mention_id").alias("second_id"), F.col("start").alias("z"))
    return comma.join(first, ["doc_id", "a"]).join(second, ["doc_id", "z"]).select("doc_id", "first_id", "second_id")


def comma_singles(mentions: DataFrame) -> DataFrame:
    """Mentions with a comma inside."""
    return mentions.where(F.col("string").contains(","))


def linked_insts(pairs: DataFrame, cands: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, mention_id, inst of the candidates of each pair's two mentions that have a link to one of the other, either way."""
    a = cands.select("doc_id", F.col("mention_id").alias("first_id"), F.col("inst").alias("x"))
    b = cands.select("doc_id", F.col("mention_id").alias("second_id"), F.col("inst").alias("y"))
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    # only links between candidates count, and a link joins the two sides: no pair of candidates is built that none joins
    links = links.join(a.select(F.col("x").alias("src")).distinct(), "src", "left_semi").join(b.select(F.col("y").alias("dst")).distinct(), "dst", "left_semi").hint("shuffle_merge")
    linked = pairs.join(a, ["doc_id", "first_id"]).join(links, F.col("x") == F.col("src")).withColumnRenamed("dst", "y").join(b, ["doc_id", "second_id", "y"])
    linked = linked.select("doc_id", "first_id", "second_id", "x", "y")
    return linked.select("doc_id", F.col("first_id").alias("mention_id"), F.col("x").alias("inst")).unionByName(linked.select("doc_id", F.col("second_id").alias("mention_id"), F.col("y").alias("inst"))).distinct()


def reduce_to(cands: DataFrame, good: DataFrame) -> DataFrame:
    """Lists of the mentions in good (doc_id, mention_id, inst) keep only its insts; other lists stay as they are."""
    touched = good.select(*KEY).distinct()
    return cands.join(touched, KEY, "left_anti").unionByName(cands.join(good.select(*KEY, "inst"), [*KEY, "inst"], "left_semi").select(*cands.columns))


def related_pairs(pairs: DataFrame, cands: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates of each pair's two mentions that have a link to one of the other, either way; of a pair without any link all stay."""
    return reduce_to(cands, linked_insts(pairs, cands, edges))


def earliest_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, first_id, second_id, start, stop) without those that overlap one that starts earlier, or at the same place and is longer."""
    p = pairs.withColumn("ann_id", F.xxhash64("doc_id", "first_id", "second_id"))
    before = (F.col("b_start") < F.col("start")) | ((F.col("b_start") == F.col("start")) & (F.col("b_stop") > F.col("stop")))
    return matched(p, p.select("doc_id", "start", "stop"), "overlap", keep=False, extra=before).drop("ann_id")


def location_pairs(mentions: DataFrame, pairs: DataFrame, cands: DataFrame, edges: DataFrame, cls: str = "dbpo:PopulatedPlace") -> tuple[DataFrame, DataFrame]:
    """Candidates of 'A, B' narrowed down by what both have to do with each other: (cands, mentions) that are left.

    Of overlapping pairs the earliest counts. A pair that no mention with a comma overlaps: if places (candidates of cls)
    of both have a link, both lists keep only such places. A pair that just one such mention covers exactly: if the first
    has places of it, the mention goes, the first list keeps those places, and where they have links to places of the
    second, both keep the linked ones. Any other pair stays as it is. Lists of other mentions with the string of a
    narrowed one are narrowed alike. pairs (doc_id, first_id, second_id); mentions (doc_id, mention_id, start, stop, string).
    """
    first = mentions.select("doc_id", F.col("mention_id").alias("first_id"), "start")
    second = mentions.select("doc_id", F.col("mention_id").alias("second_id"), "stop")
    found = earliest_pairs(pairs.join(first, ["doc_id", "first_id"]).join(second, ["doc_id", "second_id"]))
    singles = comma_singles(mentions).select("doc_id", "mention_id", "start", "stop")
    over = span_join(found, singles, "overlap").groupBy("doc_id", "first_id", "second_id").agg(
        F.count("*").alias("n"), F.max("b_mention_id").alias("one_id"), F.max((F.col("b_start") == F.col("start")) & (F.col("b_stop") == F.col("stop"))).alias("exact"))
    found = cut_lineage(found.join(over, ["doc_id", "first_id", "second_id"], "left"))
    places = of_class(cands, cls)
    alone = found.where("n is null").select("doc_id", "first_id", "second_id")
    covered = found.where("n = 1 and exact").select("doc_id", "first_id", "second_id", "one_id")
    # places of the single mention that the first of the pair has too
    one = places.select("doc_id", F.col("mention_id").alias("one_id"), "inst")
    both = covered.join(one, ["doc_id", "one_id"]).join(cands.select("doc_id", F.col("mention_id").alias("first_id"), "inst").distinct(), ["doc_id", "first_id", "inst"])
    both = cut_lineage(both)
    shared = both.select("doc_id", F.col("first_id").alias("mention_id"), "inst").distinct()
    gone = both.select("doc_id", F.col("one_id").alias("mention_id")).distinct()
    kept = both.select("doc_id", "first_id", "second_id").distinct()
    narrowed = places.select(*KEY, "inst").join(shared.select(*KEY).distinct(), KEY, "left_anti").unionByName(shared)
    good = linked_insts(alone.unionByName(kept), narrowed, edges)
    good = cut_lineage(good)
    good = good.unionByName(shared.join(good.select(*KEY).distinct(), KEY, "left_anti"))
    left = cut_lineage(reduce_to(of_mentions(cands, mentions).join(gone, KEY, "left_anti"), good))
    rest = mentions.join(gone, KEY, "left_anti")
    return propagate_by_string(left, rest, good.select(*KEY).distinct()), rest


def remove_lists(mentions: DataFrame, cands: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions and candidates without the lists of gone (doc_id, mention_id), and how many candidates went: doc_id, removed."""
    keys = gone.select(*KEY).distinct()
    taken = cands.join(keys, KEY, "left_semi").groupBy("doc_id").agg(F.count("*").alias("removed"))
    return mentions.join(keys, KEY, "left_anti"), cands.join(keys, KEY, "left_anti"), taken


def remove_candidates(cands: DataFrame, gone: DataFrame) -> DataFrame:
    """Candidates without those of gone (doc_id, mention_id, inst)."""
    return cands.join(gone.select(*KEY, "inst").distinct(), [*KEY, "inst"], "left_anti")


def describe(cands: DataFrame, *features: str) -> DataFrame:
    """doc_id, mention_id, line: a list as text, for logs: inst{feature=value, ...} in order, missing values left out."""
    pairs = F.filter(F.array(*[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in features]), lambda x: x.isNotNull())
    one = F.concat("inst", F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return cands.select(*KEY, one.alias("one")).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("one")), "; ").alias("line"))


def the_prefixed(mentions: DataFrame) -> DataFrame:
    """Pairs (outer_id, inner_id): 'the X' and the mention X inside it with the same end."""
    m = mentions.select("doc_id", F.col("mention_id").alias("ann_id"), "start", "stop", "string")
    p = span_join(m, m.drop("string"), "covers").where("b_stop = stop and b_start > start and lower(substring(string, 1, b_start - start)) rlike '^the[ ]+$'")
    return p.select("doc_id", F.col("ann_id").alias("outer_id"), F.col("b_ann_id").alias("inner_id"))


def reduce_the(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where outer and inner share insts the outer list goes and the inner one is reduced to what both have."""
    outer = cands.select("doc_id", F.col("mention_id").alias("outer_id"), "inst")
    inner = cands.select("doc_id", F.col("mention_id").alias("inner_id"), "inst")
    both = pairs.join(outer, ["doc_id", "outer_id"]).join(inner, ["doc_id", "inner_id", "inst"]).select("doc_id", "outer_id", "inner_id", "inst")
    gone = both.select("doc_id", F.col("outer_id").alias("mention_id")).distinct()
    kept = both.select("doc_id", F.col("inner_id").alias("mention_id"), "inst").distinct()
    left = cands.join(gone, KEY, "left_anti")
    reduced = kept.select(*KEY).distinct()
    return left.join(reduced, KEY, "left_anti").unionByName(left.join(kept, [*KEY, "inst"], "left_semi").select(*cands.columns))


def possessives(mentions: DataFrame) -> DataFrame:
    """mention_id -> target: a mention inside X's, with the same start and no 's of its own, gives its candidates to X's."""
    m = mentions.select("doc_id", F.col("mention_id").alias("ann_id"), "start", "stop", "string")
    p = span_join(m.where("string like '%''s'"), m.drop("string"), "covers").where("b_start = start and b_stop <= stop - 2")
    return p.select("doc_id", F.col("b_ann_id").alias("mention_id"), F.col("ann_id").alias("target"))


def abbreviation_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, definition, abbreviation: capitalised words whose initials are the two to six capitals in brackets after them."""
    word = r"[A-Z][\p{L}-]*"
    pattern = rf"(({word}(?: (?:(?:of|the|and|for|de|la) ){{0,2}}{word}){{1,5}}) \(([A-Z]{{2,6}})\))"
    f = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    f = f.select("doc_id", F.regexp_extract("m", r"^(.*) \(", 1).alias("d"), F.regexp_extract("m", r"\(([A-Z]+)\)$", 1).alias("abbreviation"))
    caps = F.filter(F.transform(F.split("d", " "), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].rlike("^[A-Z]"))
    n = F.length("abbreviation")
    last = F.slice(caps, F.greatest(F.size(caps) - n + 1, F.lit(1)), n)
    f = f.withColumn("_l", last).where(F.size(caps) >= n)
    initials = F.array_join(F.transform("_l", lambda x: F.substring(x["w"], 1, 1)), "")
    words = F.split("d", " ")
    definition = F.array_join(F.slice(words, F.col("_l")[0]["i"] + 1, F.size(words)), " ")
    return f.where(initials == F.col("abbreviation")).select("doc_id", definition.alias("definition"), "abbreviation").distinct()


def meet_abbreviations(cands: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lists of a definition and of every mention of its abbreviation are reduced to what both have; with nothing in common both go."""
    named = cands.join(mentions.select(*KEY, "string"), KEY)
    d = pairs.join(named.select("doc_id", F.col("string").alias("definition"), "inst").distinct(), ["doc_id", "definition"])
    a = named.select("doc_id", F.col("string").alias("abbreviation"), "inst").distinct()
    common = d.join(a, ["doc_id", "abbreviation", "inst"])
    both = common.select("doc_id", F.col("definition").alias("string"), "inst").unionByName(common.select("doc_id", F.col("abbreviation").alias("string"), "inst")).distinct()
    affected = pairs.select("doc_id", F.explode(F.array("definition", "abbreviation")).alias("string")).distinct()
    return named.join(affected, ["doc_id", "string"], "left_anti").select(*cands.columns).unionByName(named.join(affected, ["doc_id", "string"], "left_semi").join(both, ["doc_id", "string", "inst"], "left_semi").select(*cands.columns))


def propagate_by_string(cands: DataFrame, mentions: DataFrame, changed: DataFrame) -> DataFrame:
    """Lists that were reduced (changed: mention keys) also reduce the lists of other mentions with the same string."""
    named = cands.join(mentions.select(*KEY, "string"), KEY)
    ruling = named.join(changed.select(*KEY).distinct(), KEY, "left_semi")
    allowed = ruling.select("doc_id", "string", "inst").distinct()
    ruled = allowed.select("doc_id", "string").distinct()
    return named.join(ruled, ["doc_id", "string"], "left_anti").unionByName(named.join(allowed, ["doc_id", "string", "inst"], "left_semi").select(*named.columns)).select(*cands.columns)


def project_user_ids(user_ids: DataFrame, names: DataFrame, mentions: DataFrame) -> DataFrame:
    """A user id without a mention takes the longest mention inside its name: doc_id, mention_id, clone_id.

    user_ids (doc_id, ann_id, start, stop), names (doc_id, user_ann_id, start, stop).
    """
    bare = matched(user_ids, mentions, "overlap", keep=False)
    inside = span_join(names, mentions.select("doc_id", "start", "stop", "mention_id"), "covers")
    best = inside.groupBy("doc_id", "user_ann_id").agg(F.min_by("b_mention_id", F.struct((F.col("b_start") - F.col("b_stop")).alias("l"), "b_mention_id")).alias("mention_id"))
    return best.join(bare.select("doc_id", F.col("ann_id").alias("user_ann_id")), ["doc_id", "user_ann_id"]).select("doc_id", "mention_id", F.col("user_ann_id").alias("clone_id"))


def readable_top(cands: DataFrame, n: int = 6) -> DataFrame:
    """Of candidates with one readable name the lowest concept number stays, then the n lowest of a mention."""
    number = F.substring("cui", 2, 20).cast("long")
    a = Window.partitionBy(*KEY, "readable").orderBy(number, "cui")
    b = Window.partitionBy(*KEY).orderBy(number, "cui")
    one = cands.withColumn("_n", F.row_number().over(a)).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(b)).where(F.col("_n") <= n).drop("_n")


def mention_statistics(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """freq, link_freq and link_prob of a mention's string (counts: mention, total, links, linkprop); unknown ones have null."""
    c = counts.groupBy(F.lower("mention").alias("_k")).agg(F.max("total").alias("freq"), F.max("links").alias("link_freq"), F.max("linkprop").alias("link_prob"))
    return mentions.withColumn("_k", F.lower("string")).join(c, "_k", "left").drop("_k")
