"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is an append-only table (digest, keep_id, group_size) in buckets by digest. Of each batch, what a sort-merge
anti-join finds to be new is appended; of digests that are known, one row with the batch's largest doc_id and count is,
so that `read` gives the largest doc_id and the size of each group over all batches, in whatever order they came.
Reading sums up within buckets: it shuffles nothing.

Null texts count as empty. Of equal texts the row with the largest doc_id stays. Repeated rows (same doc_id and text) count
as copies; of those `keep_distinct` keeps one. An empty batch adds nothing. Rows without a doc_id count, and stay only where
no row of the group has one. Only doc_id and text are read; other columns of any name are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import keep_rows, new_path, remove, settle, stash, unstash

#: A digest is hot from this share of all rows on, so there are at most HOT of them, and these alone are broadcast.
HOT = 1000
#: Batches in which one table is fed to its own index, from the largest doc_ids down.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id, group_size) in `buckets` buckets by digest, sorted in each file. It outlives the object and
    is found again by its name; `drop` removes it."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = settle(spark)
        self.buckets = buckets or max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or new_path(spark, self.table)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """digest, keep_id, group_size: one row for each digest."""
        return self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Of batch (digest, ...), the rows whose digest the index lacks; the index's side of the anti-join is not shuffled."""
        return batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti") if self.exists() else batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Append batch (doc_id, digest) and return its new digests: digest, keep_id, group_size (written; the caller may `unstash`)."""
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).repartition(self.buckets, "digest")
        if not self.exists():
            new = stash(groups, "new-digests")
            self._write(new)
            return new
        groups = stash(groups, "batch-digests")
        new = stash(self.fresh(groups), "new-digests")
        known = groups.join(new.select("digest").hint("merge"), "digest", "left_anti")
        self._write(new.unionByName(known))
        unstash(groups)
        return new

    def _write(self, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", self.path).saveAsTable(self.table)

    def match(self, batch: DataFrame) -> DataFrame:
        """batch (doc_id, digest) with keep_id and group_size. Digests that fill over 1 / HOT of all rows are broadcast, so no task gets more."""
        groups = self.read()
        total = self.rows().agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        is_hot = F.col("group_size") * HOT > F.lit(total)
        hot = groups.where(is_hot)
        rest = groups.where(~is_hot)
        one = batch.join(F.broadcast(hot), "digest")  # fewer than HOT rows
        other = batch.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest")
        return one.unionByName(other)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def grouped(batch: DataFrame, batches: int = BATCHES) -> DataFrame:
    """batch (doc_id, digest), written -> doc_id, digest, keep_id, group_size, written, by way of an index of its own."""
    index = DigestIndex(batch.sparkSession)
    low, high = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [low + (high - low) * i // batches for i in range(batches - 1, 0, -1)] if isinstance(low, int) else []
    part = F.lit(0)
    for i, c in enumerate(cuts):
        part = F.when(F.col("doc_id") <= c, F.lit(i + 1)).otherwise(part)
    for i in range(len(cuts) + 1):
        unstash(index.add(batch.where(part == i)))
    out = stash(index.match(batch), "grouped-digests")
    index.drop()
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, by way of a new index."""
    batch = stash(digests(docs), "digests")
    out = grouped(batch)
    unstash(batch)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs without the copies; of rows that also share the doc_id one stays. Columns as in docs.

    The rows that stay are chosen by digests alone; texts are then shuffled once, by doc_id and digest.
    """
    batch = stash(digests(docs), "digests")
    kept = grouped(batch).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", F.col("digest").alias("mark")).agg(F.count("*").alias("copies"))
    kept = stash(kept, "kept-digests")
    unstash(batch)
    return keep_rows(docs, kept, digest(F.col("text")))
