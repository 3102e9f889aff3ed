"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.model import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Small fixed cases, for the tests alone: a query and the SQL of the rows it must give.
EXAMPLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
FLAGSHIP = "linked_mentions"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settle(spark)
            # what is dealt by doc_id stays where it is in joins on doc_id and more: tokens are never shuffled for them
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def example(sql: str):
    """A fixed case of an operator; the registered query of the same name runs over whole tables."""

    def put(f):
        EXAMPLES[f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of SQL that both engines read alike (no backslashes), over one of the driver's tables: `... FROM part`.

    They are never broadcast by an estimate: from a few coded columns of a file that is estimated to be small come texts and tokens a
    hundred times as large, which the driver would have to hold.
    """
    head, _, rest = sql.rpartition(" FROM ")
    name, _, tail = rest.partition(" ")
    table(spark, sf_dir, name).createOrReplaceTempView(f"source_{name}")
    return spark.sql(f"{head} FROM source_{name} {tail}").hint("shuffle_merge")


def inline(spark: SparkSession, values: str) -> DataFrame:
    """Rows of an SQL fragment such as `(VALUES (1, 'a')) AS t(x, y)`, which both engines read alike (no backslashes): a few, so they are broadcast."""
    return F.broadcast(spark.sql(f"SELECT * FROM {values}"))
