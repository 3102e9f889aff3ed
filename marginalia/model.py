"""The tables of the engine: standoff annotations in rows, one table for each kind.

documents    doc_id, text
annotations  doc_id, aset, ann_id, type, start, stop, features (map)
tokens       doc_id, tok_no, start, stop, string, kind, orth
spans        doc_id, ann_id, start, stop and whatever a step adds
candidates   doc_id, mention_id, inst, label and scores (sc_*) or nominal features (nm_*)

Offsets count code points, begin at 0 and are half open.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANNOTATIONS = "doc_id long, aset string, ann_id long, type string, start int, stop int, features map<string,string>"


def number(spans: DataFrame, *payload: str, out: str = "ann_id") -> DataFrame:
    """Number the spans of each document by start, longer first, then the payload: the same in every run."""
    return spans.withColumn(out, F.row_number().over(Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), *payload)).cast("long"))


def to_annotations(spans: DataFrame, aset: str, type_: str, *features: str) -> DataFrame:
    """Rows of the annotation table from numbered spans; the named columns become features."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("string"))]
    fm = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return spans.select(F.col("doc_id").cast("long"), F.lit(aset).alias("aset"), F.col("ann_id").cast("long"), F.lit(type_).alias("type"), F.col("start").cast("int"), F.col("stop").cast("int"), fm.alias("features"))


def from_annotations(annotations: DataFrame, aset: str, *types: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Spans of one set, of the given types, with the named features as columns."""
    df = annotations.where(F.col("aset") == aset)
    df = df.where(F.col("type").isin(*types)) if types else df
    return df.select("doc_id", "ann_id", "type", "start", "stop", *[F.col("features")[f].alias(f) for f in features])


def transfer(annotations: DataFrame, source: str, target: str, *types: str, move: bool = False, inside: DataFrame | None = None, all_unless_found: bool = False) -> DataFrame:
    """Copy (or move) annotations of the types from one set to another; inside: only those within one of its spans, and with
    all_unless_found all those of documents that have no such span."""
    mine = F.col("aset") == source
    if types:
        mine &= F.col("type").isin(*types)
    picked = annotations.where(mine)
    if inside is not None:
        from marginalia.operators.spans import matched

        within = matched(picked, inside, "within")
        bare = picked.join(inside.select("doc_id").distinct(), "doc_id", "left_anti").select(*picked.columns)
        picked = within.unionByName(bare) if all_unless_found else within
    copies = picked.withColumn("aset", F.lit(target))
    if not move:
        return annotations.unionByName(copies)
    rest = annotations.join(picked.select("doc_id", "aset", "ann_id"), ["doc_id", "aset", "ann_id"], "left_anti")
    return rest.unionByName(copies)


def reset(annotations: DataFrame, *asets: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Annotations without those of the sets (of the types only, if any are named)."""
    gone = F.col("aset").isin(*asets)
    return annotations.where(~(gone & F.col("type").isin(*types)) if types else ~gone)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from the session's checkpoint folder, so that long loops have short plans.

    Where no folder is set, local mode takes one of its own; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marginalia-"))
    return df.checkpoint()


def settle(spark: SparkSession) -> SparkSession:
    """Session settings that right results need.

    With spark.sql.unionOutputPartitioning (new in Spark 4.1) a union of inputs that are dealt alike counts as dealt so
    itself; adaptive execution may then have put the partitions of its inputs together differently, and a grouping or
    window after the union sees parts of its groups only.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")  # as Spark has it; registered queries turn it off for themselves
    return spark
