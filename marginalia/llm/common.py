"""Shared helpers: written intermediate tables, scalable positions, connected components."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.model import settle

#: Rows and bytes of one Arrow batch to a Python worker, at most; texts may be long. (A row larger than that goes alone.)
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: At most 2**MAX_BITS buckets per part in `positions`: one window sums up their totals.
MAX_BITS = 22
#: Up to so many edges (16 bytes each) components are found in one task.
FEW_EDGES = 200_000


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="marginalia-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    return folder or _own_dir()


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    settle(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = settle(df.sparkSession)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete what `stash` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_rows(docs: DataFrame, chosen: DataFrame, mark: Column) -> DataFrame:
    """Of docs, one row for each of chosen (doc_id, mark, copies), found by doc_id and mark; copies: how many rows of docs it has.

    All columns of docs as they are, carried as one, so that none can clash. Texts are shuffled once, by doc_id and mark.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), mark.alias("sign"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("sign").eqNullSafe(F.col("mark"))
    out = whole.join(chosen.where("copies = 1"), same, "left_semi")
    again = chosen.where("copies > 1")
    if not again.isEmpty():
        out = out.unionByName(whole.join(again, same, "left_semi").dropDuplicates(["id", "sign"]))
    return out.select("row.*")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/documents.parquet")


def bits_for(rows: int, parts: int = 1, per_bucket: int = 4_000) -> int:
    """Bits of the bucket number that keep a bucket of one part near per_bucket rows."""
    return max(0, min(MAX_BITS, math.ceil(math.log2(max(1, rows / max(1, parts) / per_bucket)))))


def positions(df: DataFrame, part: list[str], hashed: Column, ties: list, bits: int, out: str = "pos", weight: Column | None = None) -> DataFrame:
    """Add out: how much weight (rows, by default) stands before a row in its part, ordered by `hashed`, then ties.

    Two levels: rows are bucketed by the top bits of the hash, the buckets' totals (at most parts x 2**bits rows)
    are summed up in order, and a window numbers the rows inside each bucket; it is dealt as the join with the totals is.
    No window holds a whole part. Names that begin with "_" and the name of out are taken: df must not have them.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    keyed = df.withColumn("_h", hashed).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 64 - bits).cast("int") if bits else F.lit(0)).withColumn("_w", w)
    totals = keyed.groupBy(*part, "_b").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], F.col("_b").alias("_pb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    on = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)] + [F.col("_b") == F.col("_pb")]
    joined = keyed.join(totals, functools.reduce(lambda a, b: a & b, on))
    inside = Window.partitionBy(*part, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    return joined.withColumn(out, pos.cast("long")).drop("_h", "_b", "_w", "_pb", "_before", *[f"_p{i}" for i in range(len(part))])


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that are not the smallest of their component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(flat := new[new], new):
            new = flat
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node reachable; nodes with no edge are not listed.

    Alternating large-star and small-star steps; each step is one aggregation and one join, and its result is
    written to the shared folder, so no list of neighbours or of components is ever held in one place. At most FEW_EDGES
    edges are held in one task, which spares the driver the plans of the rounds.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= FEW_EDGES:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = list(batches)
            if rows:
                node, root = roots_of(*(np.concatenate([b[c].to_numpy() for b in rows]) for c in ("u", "v")))
                yield pd.DataFrame({"node": node, "root": root})

        out = stash(e.coalesce(1).mapInPandas(run, "node long, root long"), "edges")
        unstash(e)
        return out
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstash(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._stash_path = e._stash_path
    return out
