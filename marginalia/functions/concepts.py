"""Column functions for clinical concept candidates, and other small features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semantic types that are kept, and the groups they belong to.
GROUPS = {
    "Anatomy": ["Body Location or Region", "Body Part, Organ, or Organ Component", "Body Space or Junction", "Body System", "Tissue", "Anatomical Abnormality", "Acquired Abnormality", "Congenital Abnormality", "Anatomical Structure"],
    "Disease": ["Injury or Poisoning", "Pathologic Function", "Disease or Syndrome", "Mental or Behavioral Dysfunction", "Cell or Molecular Dysfunction", "Experimental Model of Disease", "Sign or Symptom", "Neoplastic Process"],
    "Investigation": ["Diagnostic Procedure", "Laboratory Procedure", "Laboratory or Test Result", "Research Activity", "Molecular Biology Research Technique"],
    "Drug": ["Clinical Drug", "Pharmacologic Substance", "Antibiotic"],
    "Care": ["Health Care Activity", "Health Care Related Organization", "Self-help or Relief Organization", "Therapeutic or Preventive Procedure"],
    "Observation": ["Finding", "Clinical Attribute", "Individual Behavior", "Population Group", "Patient or Disabled Group"],
}
KEPT_TYPES = [*[t for t in GROUPS["Anatomy"] if t != "Anatomical Structure"], "Finding", *GROUPS["Disease"], "Mental Process", *GROUPS["Investigation"], *GROUPS["Drug"]]
CONCEPT_BASE = "http://linkedlifedata.com/resource/umls/id/"
TYPE_BASE = "http://linkedlifedata.com/resource/semanticnetwork/id/"
# End of fixed values.


def group_of(sty: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, types in GROUPS.items():
        out = out.when(sty.isin(types), name)
    return out


def type_names(sty: Column) -> Column:
    """Distinct annotation types of a comma-joined list of semantic types."""
    return F.array_distinct(F.split(F.regexp_replace(F.trim(F.regexp_replace(sty, r",\s", "_")), r"\s+", "_"), ","))


def vocabularies(vocabs: Column) -> Column:
    """The vocabularies of a comma-joined list; empty parts at its end are none."""
    return F.split(F.regexp_replace(vocabs, ",+$", ""), ",")


def tidy(df: DataFrame) -> DataFrame:
    """Mentions without an identifier or of another type get a reason in deleted_because."""
    bad = F.when(F.coalesce("inst", F.lit("")) == "", "no inst").when(~F.coalesce("sty", F.lit("")).isin(KEPT_TYPES), "type")
    return df.withColumn("deleted_because", bad)


def readable(pref: Column, sty: Column) -> Column:
    return F.concat(F.coalesce(pref, F.lit("null")), F.lit(": "), F.coalesce(sty, F.lit("null")))


def log_frequency(c: Column) -> Column:
    """log10 of a positive number, else 0; non-numbers count as missing."""
    n = c.try_cast("double")
    return F.coalesce(F.when(n > 0, F.log10(n)), F.lit(0.0))


def concept_score(cui: Column) -> Column:
    """Lower concept numbers score higher, up to 1."""
    return (F.lit(1e6) - F.substring(cui, 3, 20).try_cast("double")) / 1e6


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def is_dead(death_date: Column) -> Column:
    return F.when(F.coalesce(F.trim(death_date), F.lit("")) != "", "true").otherwise("false")


def created_at(c: Column) -> Column:
    """Timestamp of 'EEE MMM dd HH:mm:ss Z yyyy'; the day of the week is not needed. Anything else is null."""
    return F.try_to_timestamp(F.substring(c, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


def routing(lang: Column, doc_type: Column) -> tuple[Column, Column, Column]:
    """Language (default en), document type (default generic) and the branch that processes it."""
    lang, doc_type = F.coalesce(F.nullif(lang, F.lit("")), F.lit("en")), F.coalesce(F.nullif(doc_type, F.lit("")), F.lit("generic"))
    branch = F.when(lang == "fr", "preprocess-fr").when(doc_type == "tweet", "preprocess-en-twitter").otherwise("preprocess-en")
    return lang, doc_type, branch
