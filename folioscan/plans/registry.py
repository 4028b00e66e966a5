"""Registry of queries: a Spark function per name and, for most, the SQL for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.session import SPREAD

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query function under a name."""

    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


# Tables whose rows hold whole texts, with their key.
TEXTS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the test data, as its files are split.

    Only a session that asks for it (``spark.folioscan.spread``, which the local session of tests and bench sets, as their text tables
    are one row group each) deals the texts out over its cores first. A cluster leaves it unset.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in TEXTS and spark.conf.get(SPREAD, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism, TEXTS[name])
    return df
