"""Run a stream over everything that has landed and give back what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import ensure_checkpoint_dir
from folioscan.streaming.operators import event_time


def stream_table(spark: SparkSession, sf: str, name: str, ts: str | None = None) -> DataFrame:
    """One table of a folder as a file stream, be it one file or a folder of files; the schema comes from the table itself."""
    path = f"{sf}/{name}.parquet"
    # as a pattern, for a stream takes a plain path only if it is a folder
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}[.]parquet")
    return event_time(df, ts) if ts else df


def run_append(df: DataFrame, stateful: bool = False) -> DataFrame:
    """Run an append stream to its end and read its sink."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    with with_state(spark) if stateful else nullcontext():
        query = (
            df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_complete(df: DataFrame) -> DataFrame:
    """Run an aggregation in complete mode and read the last result it wrote."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = (
        df.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def with_state(spark: SparkSession, clock: bool = False) -> Iterator[None]:
    """Queries that are started inside keep their state in the store that processors with state need.

    With ``clock`` they count processing time. Such a query would go on with batches without data for ever, as time passes, so
    it runs none and can come to an end.
    """
    wanted = {PROVIDER: ROCKSDB, **({NO_DATA: "false"} if clock else {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Upserts:
    """A table of the newest row per key. Each batch is a folder of its own, named by its id, so a batch that is written again replaces itself."""

    def __init__(self, folder: str, keys: list[str]):
        self.folder, self.keys = folder, keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The row of the latest batch for each key."""
        rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(self.folder)
        names = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "batch").alias("row"))
        return newest.select(*self.keys, "row.*")


def run_updates(df: DataFrame, keys: list[str], clock: bool = False) -> DataFrame:
    """Run a stream in update mode to its end and read what its upserts leave: only keys that changed are written."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = Upserts(f"{base}/out", keys)
    with with_state(spark, clock):
        query = df.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    return table.read(spark, df.schema)
